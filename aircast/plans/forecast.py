"""The 7-day forecast.  Recursive predictions are a fold over one
array of at most ``horizon`` future rows per series (``aggregate`` with a
struct accumulator) -- never a driver loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS
from ..keys import kjoin
from ..functions import calendar as cal
from ..functions import scalar as S
from ..schemas import FORECAST_FIELDS, WEATHER_FIELDS
from . import gram as G
from . import models as M
from .features import future_calendar


def last_values(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Last humidity and the last two temperatures per series."""
    hum = feats.groupBy(*keys).agg(F.max_by("hum_mean", "ds").alias("hum_last"))
    return kjoin(hum, last_two(feats, "temp_mean", keys=keys), keys)


#: The column that holds the day before's value, by row.
LAGGED = {"temp_mean": "temp_lag1", "co2_mean": "co2_lag1"}


def last_two(feats: DataFrame, col: str, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Last and second-to-last value of ``col`` per series, in one aggregate: the last row's lag
    is the value before it (NULL where the series has one row).  Other columns are lagged here."""
    from pyspark.sql import Window

    lag = LAGGED.get(col)
    if lag not in feats.columns:
        lag = "_lag"
        feats = feats.withColumn(lag, F.lag(col).over(Window.partitionBy(*keys).orderBy("ds")))
    g = feats.groupBy(*keys).agg(F.max_by(F.struct(col, lag), "ds").alias("a"), F.count(F.lit(1)).alias("_n"))
    return g.select(*keys, F.col(f"a.{col}").alias(f"{col}_last"), F.when(F.col("_n") > 1, F.col(f"a.{lag}")).alias(f"{col}_prev"))


def future_scaffold(feats: DataFrame, weather: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, horizon: int = 7) -> DataFrame:
    """Days last+1 .. last+horizon per series with weather, calendar
    and the default exogenous values (presence 0.3, humidity = last,
    co2_diff1 0, rapid_rise false, temp_diff 0)."""
    b = feats.groupBy(*keys).agg(
        F.max("ds").alias("last_ds"), F.min("ds").alias("first_ds"), F.count(F.lit(1)).alias("n"),
        F.max_by("hum_mean", "ds").alias("hum_mean"),
    )
    rows = b.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("ds", F.date_add("last_ds", F.col("h")))
    rows = rows.join(weather, "ds", "left")
    rows = future_calendar(rows)
    return rows.select(
        *keys, "h", "ds", *WEATHER_FIELDS, "is_weekend", "is_holiday", "dayofweek", "day_sin", "day_cos",
        F.lit(0.3).alias("presence_ratio"), "hum_mean", F.lit(0.0).alias("temp_diff"), F.lit(0.0).alias("co2_diff1"),
        F.lit(False).alias("rapid_rise"), F.date_diff("ds", "first_ds").alias("t_days"),
        (F.col("n") + F.col("h")).cast("double").alias("t_row"),
    )


def _collect_future(rows: DataFrame, keys, fields: list[Column]) -> DataFrame:
    """The future rows of each series as one array ordered by h (<= horizon)."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("h"), *fields))).alias("fut"))


def temp_fold(fut: Column, lag1: Column, lag2: Column, base, b1: Column, b2: Column, low, high) -> Column:
    """yhat(h) = clip(base(r) + b1*lag1 + b2*lag2, low(r), high(r)); the
    clipped value becomes lag1 of the next step."""
    out_t = "array<struct<h:int,ds:date,pred_temp:double,low:double,temp_lag1:double,temp_lag2:double>>"
    init = F.struct(lag1.cast("double").alias("l1"), lag2.cast("double").alias("l2"), F.lit(None).cast(out_t).alias("out"))

    def step(acc, r):
        y = S.clip(base(r) + b1 * acc["l1"] + b2 * acc["l2"], low(r), high(r))
        item = F.struct(r["h"].cast("int").alias("h"), r["ds"].alias("ds"), y.alias("pred_temp"), low(r).cast("double").alias("low"), acc["l1"].alias("temp_lag1"), acc["l2"].alias("temp_lag2"))
        return F.struct(y.alias("l1"), acc["l1"].alias("l2"), F.concat(F.coalesce(acc["out"], F.array().cast(out_t)), F.array(item)).alias("out"))

    return F.aggregate(fut, init, step, lambda acc: acc["out"])


def co2_fold_expr(fut: Column, u1: Column, u2: Column, e: Column, phi1, phi2, delta, theta, xb) -> Column:
    """u(h) = phi1 u(h-1) + phi2 u(h-2) + delta t(h) + theta e [h = 1];
    yhat(h) = x(h).beta + u(h)."""
    out_t = "array<struct<h:int,ds:date,pred_co2:double>>"
    init = F.struct(u1.cast("double").alias("u1"), u2.cast("double").alias("u2"), F.lit(None).cast(out_t).alias("out"))

    def step(acc, r):
        ma = F.when(r["h"] == 1, theta * e).otherwise(F.lit(0.0))
        u = phi1 * acc["u1"] + phi2 * acc["u2"] + delta * r["t_row"] + ma
        item = F.struct(r["h"].cast("int").alias("h"), r["ds"].alias("ds"), (xb(r) + u).alias("pred_co2"))
        return F.struct(u.alias("u1"), acc["u1"].alias("u2"), F.concat(F.coalesce(acc["out"], F.array().cast(out_t)), F.array(item)).alias("out"))

    return F.aggregate(fut, init, step, lambda acc: acc["out"])


def co2_paths(rows: DataFrame, models: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """One row per series: its future rows (h, ds, t_row, xb = x.beta) and the model."""
    rows = rows if "t_row" in rows.columns else rows.withColumn("t_row", F.col("t").cast("double"))
    fut = _collect_future(rows, list(keys), [F.col("ds"), F.col("t_row"), F.col("x")])
    j = kjoin(fut, models, list(keys))
    xb = F.transform("fut", lambda r: F.struct(r["h"].alias("h"), r["ds"].alias("ds"), r["t_row"].alias("t_row"), G.dot(r["x"], F.col("beta")).alias("xb")))
    return j.withColumn("fut", xb)


def co2_fold(rows: DataFrame, models: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, bounds: bool = False) -> DataFrame:
    """K15 over given future rows (columns h, ds, t_row, x with x[0] = 1)."""
    keys = list(keys)
    j = co2_paths(rows, models, keys=keys)
    if bounds:
        from .intervals import co2_bounds

        j = co2_bounds(j, keys=keys)
    expr = co2_fold_expr(
        F.col("fut"), F.col("u_last"), F.col("u_prev"), F.coalesce(F.col("eps_last"), F.lit(0.0)),
        F.col("phi1"), F.col("phi2"), F.col("delta"), F.coalesce(F.col("theta"), F.lit(0.0)), lambda r: r["xb"],
    )
    own = ["lower", "upper"] if bounds else []
    at = [F.col(c)[F.col("h") - 1].alias(f"pred_co2_{c}") for c in own]
    return j.select(*keys, *own, F.inline(expr)).select(*keys, "h", "ds", "pred_co2", *at)


def co2_forecast(scaffold: DataFrame, models: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS,
                 exog: Sequence[str] = tuple(M.CO2_EXOG), bounds: bool = False) -> DataFrame:
    """7 steps ahead with the scaffold's exogenous columns.  ``bounds``: also
    pred_co2_lower and pred_co2_upper (``intervals.co2_bounds``)."""
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in exog])
    return co2_fold(scaffold.withColumn("x", x), models, keys=keys, bounds=bounds)


def temp_paths(scaffold: DataFrame, models: DataFrame, feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, yearly: int = 0) -> DataFrame:
    """One row per series: its future rows (h, ds, base, bounds), the model and the last two values.
    ``base`` is the model's value without its lag terms."""
    keys = list(keys)
    seeds = feats.groupBy(*keys).agg(
        F.max_by(F.struct("temp_mean", "temp_lag1"), "ds").alias("_l"), F.count(F.lit(1)).alias("_n"),
        F.avg(F.col("temp_mean") - F.col("outside_temp_max")).alias("avg_temp_diff"),
    ).select(
        *keys, F.col("_l.temp_mean").alias("l1"),
        F.when(F.col("_n") > 1, F.col("_l.temp_lag1")).otherwise(F.col("_l.temp_mean")).alias("l2"), "avg_temp_diff",
    )
    sc = kjoin(M.weekly_fourier(scaffold, yearly=yearly), models.select(*keys, "first_ds", "span_days", "bends", "beta", "delta"), keys)
    t = F.date_diff(F.col("ds"), F.col("first_ds")).cast("double")
    sc = sc.withColumn("base", M.temp_value(M.temp_vector(t, {"temp_lag1": F.lit(0.0), "temp_lag2": F.lit(0.0)}, yearly), t))
    fut = sc.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("h", "ds", "base", "outside_temp_max"))).alias("fut"))
    return kjoin(kjoin(fut, seeds, keys), models.drop("first_ds", "dropped", "dropped_terms"), keys)


def temp_forecast(scaffold: DataFrame, models: DataFrame, feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS,
                  bounds: bool = False, yearly: int = 0) -> DataFrame:
    """Recursive temperature with lags fed back, each step clipped to
    [outside max, outside max + mean(indoor - outdoor max)].  ``bounds``: also
    pred_temp_lower and pred_temp_upper (``intervals.temp_bounds``)."""
    keys = list(keys)
    j = temp_paths(scaffold, models, feats, keys=keys, yearly=yearly)
    if bounds:
        from .intervals import temp_bounds

        j = temp_bounds(j, keys=keys)
    expr = temp_fold(
        F.col("fut"), F.col("l1"), F.col("l2"),
        lambda r: r["base"], F.col("beta")[M.LAG1_IDX], F.col("beta")[M.LAG2_IDX],
        lambda r: r["outside_temp_max"], lambda r: r["outside_temp_max"] + F.col("avg_temp_diff"),
    )
    own = ["lower", "upper"] if bounds else []
    out = j.select(*keys, *own, F.inline(expr))
    at = [F.col(c)[F.col("h") - 1].alias(f"pred_temp_{c}") for c in own]
    return out.select(*keys, "h", "ds", "pred_temp", (F.col("pred_temp") - F.col("low")).alias("temp_diff"), "temp_lag1", "temp_lag2", *at)


def avg_temp_diff_of(feats: DataFrame, keys) -> DataFrame:
    return feats.groupBy(*keys).agg(F.avg(F.col("temp_mean") - F.col("outside_temp_max")).alias("avg_temp_diff"))


#: What a forecast row says beside its 12 fields.
EXTRA_FIELDS = ("pred_temp_lower", "pred_temp_upper", "pred_co2_lower", "pred_co2_upper", "status")


def forecast_table(scaffold: DataFrame, temp_fc: DataFrame, co2_fc: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS,
                   status: DataFrame | None = None) -> DataFrame:
    """C2 (temperature part, CO2 part and future rows on (keys, ds))
    plus H9 advice -> the 12-field result per series, the bounds that the parts carry, and with
    ``status`` (``run_status``) why a series has no prediction (it then has none at all)."""
    keys = list(keys)
    parts = [c for c in temp_fc.columns + co2_fc.columns if c.startswith("pred_")]
    j = temp_fc.drop("h", "temp_diff", "temp_lag1", "temp_lag2").join(co2_fc.drop("h"), [*keys, "ds"]).join(
        scaffold.select(*keys, "ds", *WEATHER_FIELDS, "is_weekend", "is_holiday"), [*keys, "ds"]
    )
    if status is not None:
        j = kjoin(j, status, keys, "left").withColumns({c: F.when(F.col("usable"), F.col(c)) for c in parts})
    j = j.withColumn("advies", S.advice(F.col("pred_co2"), F.col("pred_temp")))
    return j.select(*keys, *FORECAST_FIELDS, *[c for c in EXTRA_FIELDS if c in j.columns])


def run_status(temp_models: DataFrame, co2_models: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """(keys, status, usable) of a run.  A model that could not be fitted names its part and makes the
    run unusable; one whose CO2 errors grow without bound is served and says so."""
    c = kjoin(
        temp_models.select(*keys, F.col("status").alias("_t")),
        co2_models.select(*keys, F.col("status").alias("_c"), F.coalesce("explosive", F.lit(False)).alias("_x")), list(keys),
    )
    usable = (F.col("_t") == "ok") & (F.col("_c") == "ok")
    text = (
        F.when(usable, F.when(F.col("_x"), "co2: explosive").otherwise("ok"))
        .when(F.col("_t") == F.col("_c"), F.col("_t"))
        .otherwise(F.concat_ws("; ", F.when(F.col("_t") != "ok", F.concat(F.lit("temp: "), "_t")), F.when(F.col("_c") != "ok", F.concat(F.lit("co2: "), "_c"))))
    )
    return c.select(*keys, text.alias("status"), usable.alias("usable"))


def run_forecast(feats: DataFrame, weather: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, horizon: int = 7,
                 lam: float = 1.0, leak_free: bool = False, bounds: bool = True) -> DataFrame:
    """Flagship plan: features -> both models -> scaffold -> folds -> table.
    The feature table and the (one row per series) models feed several branches, so they are checkpointed once."""
    from ..session import materialize

    keys = list(keys)
    feats = materialize(feats)
    sc = future_scaffold(feats, weather, keys=keys, horizon=horizon)
    tm = materialize(M.fit_temp(feats, keys=keys, lam=lam))
    cm = materialize(M.fit_co2(feats, keys=keys, leak_free=leak_free)[0])
    temp = temp_forecast(sc, tm, feats, keys=keys, bounds=bounds)
    return forecast_table(sc, temp, co2_forecast(sc, cm, keys=keys, bounds=bounds), keys=keys, status=run_status(tm, cm, keys=keys))


def forecast_runs(feats: DataFrame, weather: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, back: Sequence[int] = (0, 7, 14),
                  min_days: int = 7, **how) -> DataFrame:
    """Runs of K18 as they would have been made on several days: ``back`` days before each series'
    last one.  A run sees only the days up to its own (run_id), and is dropped where those are fewer than ``min_days``.
    (series, run_id) is the key of a run, so all runs are fitted by the same plan at once."""
    from ..session import materialize

    keys = list(keys)
    feats = materialize(feats)
    last = feats.groupBy(*keys).agg(F.max("ds").alias("_last"), F.min("ds").alias("_first"))
    runs = last.select(*keys, "_first", F.explode(F.array(*[F.date_sub("_last", n) for n in back])).alias("run_id"))
    runs = runs.where(F.date_diff("run_id", "_first") >= min_days - 1).drop("_first")
    own = kjoin(feats, runs, keys).where(F.col("ds") <= F.col("run_id"))
    return run_forecast(own, weather, keys=[*keys, "run_id"], **how).withColumn("h", F.date_diff("ds", "run_id"))


# The older variant's record, its seasonal order, changepoints and priors.
OLD_FIELDS = [
    "ds", "pred_temp", "outside_temp_max", "outside_temp_min", "precipitation", "cloudcover", "wind", "solar_radiation",
    "is_weekend", "is_holiday", "sleep_time_ratio", "temp_lag1", "temp_lag2", "day_sin", "day_cos", "pred_co2",
    "presence_ratio", "hum_mean", "temp_diff", "co2_diff1", "rapid_rise",
]
OLD_YEARLY, OLD_BENDS, OLD_PRIOR, OLD_LAMBDA = 10, 25, 0.05, 0.01


def run_forecast_old(feats: DataFrame, weather: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, horizon: int = 7) -> DataFrame:
    """K18 of the older variant, on ``features(backfill=False, sleep_ratio=True)``: yearly and weekly terms and
    all regressors whatever the span, nine exogenous columns for CO2 (among them the temperature's own forecast, less the outdoor
    maximum), and the 21-field record."""
    from ..session import materialize

    keys = list(keys)
    feats = materialize(feats)
    sleep = F.lit(8 / 24)
    sc = materialize(future_scaffold(feats, weather, keys=keys, horizon=horizon).withColumn("sleep_time_ratio", sleep))
    gate = M.regressor_gate(feats, keys=keys, yearly=OLD_YEARLY, bends=OLD_BENDS, full_span=0)
    tm = materialize(M.fit_temp(feats, keys=keys, lam=OLD_LAMBDA, prior=OLD_PRIOR, gate=gate, yearly=OLD_YEARLY))
    temp = materialize(temp_forecast(sc, tm, feats, keys=keys, yearly=OLD_YEARLY))
    cm = materialize(M.fit_co2(feats, keys=keys, exog=M.CO2_EXOG_OLD)[0])
    rows = sc.drop("temp_diff").join(temp.drop("h"), [*keys, "ds"])
    co2 = co2_forecast(rows, cm, keys=keys, exog=M.CO2_EXOG_OLD)
    out = kjoin(rows.join(co2.drop("h"), [*keys, "ds"]), run_status(tm, cm, keys=keys), keys, "left")
    out = out.withColumns({c: F.when(F.col("usable"), F.col(c)) for c in ("pred_temp", "pred_co2")})
    return out.select(*keys, *OLD_FIELDS, "status")


# ----------------------------------------------- fixed-coefficient folds
# Fixed values (test coefficients for the exact-oracle folds).
FIXED_TEMP = (2.0, 0.1, 0.6, 0.2)  # intercept, outside_temp_max, lag1, lag2
FIXED_CO2_BETA = (200.0, 8.0, 15.0, -10.0, 0.5, 20.0)  # CO2_EXOG order
FIXED_AR = (0.5, 0.2, 0.01)  # phi1, phi2, delta


def temp_forecast_fixed(scaffold: DataFrame, feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """K16 with fixed coefficients (exact oracle: recursive CTE)."""
    keys = list(keys)
    a, b, c, d = FIXED_TEMP
    seeds = last_two(feats, "temp_mean", keys=keys)
    diff = avg_temp_diff_of(feats, keys)
    fut = _collect_future(scaffold, keys, [F.col("ds"), F.col("outside_temp_max")])
    j = kjoin(kjoin(fut, seeds, keys), diff, keys)
    expr = temp_fold(
        F.col("fut"), F.col("temp_mean_last"), F.col("temp_mean_prev"),
        lambda r: F.lit(a) + F.lit(b) * r["outside_temp_max"], F.lit(c), F.lit(d),
        lambda r: r["outside_temp_max"], lambda r: r["outside_temp_max"] + F.col("avg_temp_diff"),
    )
    return j.select(*keys, F.inline(expr)).select(*keys, "h", "ds", "pred_temp")


def co2_forecast_fixed(scaffold: DataFrame, feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """K15 with fixed coefficients; u seeds are the last two residuals
    co2_mean - x.beta of the feature rows (exact oracle: recursive CTE)."""
    keys = list(keys)
    beta = F.array(*[F.lit(v) for v in FIXED_CO2_BETA])
    xf = F.array(*[F.col(c).cast("double") for c in M.CO2_EXOG])
    r = feats.withColumn("u", F.col("co2_mean") - G.dot(xf, beta))
    seeds = last_two(r, "u", keys=keys)
    fut = _collect_future(scaffold.withColumn("x", xf), keys, [F.col("ds"), F.col("t_row"), F.col("x")])
    j = kjoin(fut, seeds, keys)
    p1, p2, dl = FIXED_AR
    expr = co2_fold_expr(
        F.col("fut"), F.col("u_last"), F.col("u_prev"), F.lit(0.0), F.lit(p1), F.lit(p2), F.lit(dl), F.lit(0.0),
        lambda rr: G.dot(rr["x"], beta),
    )
    return j.select(*keys, F.inline(expr)).select(*keys, "h", "ds", "pred_co2")
