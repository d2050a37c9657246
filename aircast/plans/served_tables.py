"""Queries served from the models' own runs (K18 made on several days), and the scores of the models.

The history and answer operators (A11-A15, C2, C3, C5, C7, D14, D15, D18, I7, I10) take any
table of runs.  Their twins in ``trend_tables`` and ``prompt_tables`` feed them a persistence forecaster, which
SQL can follow; here the runs are those of ``forecast.forecast_runs``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clean as C
from ..operators import daily as D
from ..operators import evaluate as EV
from ..operators import order as O
from ..session import materialize
from . import forecast as FC
from . import history as H
from . import models as M
from . import prompts as P
from .daily_tables import feature_table, weather_of
from .model_tables import shared_features
from .prompt_tables import prompts_of
from .readings import AS_OF, cleaned, daily_table
from .registry import query, r6, with_


def model_runs_of(spark, sf):
    """Runs of the models 0, 7 and 14 days before each room's last day."""
    return FC.forecast_runs(feature_table(spark, sf), weather_of(spark, sf))


@query("model_runs")
def model_runs(spark, sf):
    """K18 on several days: the 12 fields, the bounds and the status of every run."""
    return model_runs_of(spark, sf)


@query("served_forecast")
def served_forecast(spark, sf):
    """A13 + A11: the newest model run of each room in the layout of the forecast file."""
    return H.sink_layout(H.latest_run(model_runs_of(spark, sf)))


@query("served_history")
def served_history(spark, sf):
    """Every model run appended to a history folder, and its last two read back as JSON records."""
    from ..streaming.streams import stream_dir

    runs = materialize(model_runs_of(spark, sf))
    path = stream_dir(spark, "model-history") + "/history"
    H.history_append(runs, path, "weekly")
    return H.records_json(H.last_n_runs(H.read_history(spark, path), n=2))


@query("served_eval")
def served_eval(spark, sf):
    """C2 + C3: actual days of the last week beside what the newest model run that covers them predicted."""
    a = C.since_as_of(D.daily_actuals(cleaned(spark, sf), zone="UTC"), as_of=AS_OF, day="day")
    lp = materialize(O.latest_run_per_day(model_runs_of(spark, sf)).withColumnRenamed("ds", "day"))
    return EV.eval_join(a, lp.select("room_id", "day", "run_id", "pred_temp"), lp.select("room_id", "day", "pred_co2"))


def model_pairs(spark, sf):
    """(room_id, model, split, y, yhat) of every way in which the models are scored."""
    f = shared_features(spark, sf)
    tm = materialize(M.fit_temp(f))
    temp = M.temp_fitted(f, tm)
    co2 = M.fit_co2(f)[1]
    own = ("room_id", "model", "split", "y", "yhat")

    def pairs(df, model, split, y="y", yhat="yhat"):
        return df.select("room_id", F.lit(model).alias("model"), F.lit(split).alias("split"), F.col(y).alias("y"), F.col(yhat).alias("yhat"))

    out = pairs(temp, "temp", "in_sample").union(pairs(co2, "co2", "in_sample"))
    out = out.union(pairs(M.rolling_cv(f), "temp", "rolling"))
    out = out.union(pairs(M.walk_forward(f), "co2", "walk_forward", "actual", "pred"))
    out = out.union(pairs(M.walk_forward_ma(f), "co2", "walk_forward_ma", "actual", "pred"))
    runs = EV.forecast_pairs(FC.forecast_runs(f, weather_of(spark, sf)), daily_table(spark, sf))
    return out.union(runs.withColumn("split", F.when(F.col("h") == 1, "next_day").otherwise("rest_of_week")).select(*own))


@query("model_metrics")
def model_metrics(spark, sf):
    """D14 + D15: MAE and RMSE of both models per room: in sample, rolling origin, walk-forward (refitted, and
    with the MA term carried), and of the runs that were really made."""
    return EV.error_metrics(model_pairs(spark, sf), by=("model", "split"), exact=False)


@query("model_residual_histogram")
def model_residual_histogram(spark, sf):
    """15 equal bins of each model's in-sample residuals per room."""
    f = shared_features(spark, sf)
    t = M.temp_fitted(f, M.fit_temp(f)).withColumn("model", F.lit("temp"))
    c = M.fit_co2(f)[1].select("room_id", "ds", "y", "yhat").withColumn("model", F.lit("co2"))
    r = materialize(t.unionByName(c).where(F.col("yhat").isNotNull()).withColumn("r", F.col("y") - F.col("yhat")))
    return EV.histogram(r, "r", bins=15, keys=["room_id", "model"])


@query("served_answers")
def served_answers(spark, sf):
    """C5 + I7: forecast-day prompts answered from the newest model run that covers the day."""
    p = prompts_of(spark, sf).where(F.col("intent") == "forecast_day")
    return P.day_answer(P.forecast_lookup(p, O.latest_run_per_day(model_runs_of(spark, sf)), as_of=AS_OF)).select("prompt_id", "room_id", "answer")


@query("served_context")
def served_context(spark, sf):
    """Forecast prompts with the room's newest model run as a table of text."""
    p = prompts_of(spark, sf).where(F.col("intent") == "forecast")
    return P.forecast_context(p, H.latest_run(model_runs_of(spark, sf))).select("prompt_id", "room_id", "context")


@query("served_warnings")
def served_warnings(spark, sf):
    """C7 + H11: the warning of today's row of the newest model run, per room."""
    t = EV.today_row(O.latest_run_per_day(model_runs_of(spark, sf)), as_of=AS_OF)
    return t.select("room_id", "run_id", "ds", "pred_co2", "pred_temp", S.warning_text(F.col("pred_co2"), F.col("pred_temp")).alias("warning"))


@query("trend_changepoints")
def trend_changepoints(spark, sf):
    """K2 + K4: where the trend may bend and by how much (degrees over the whole span), with the present prior and with
    the wider one of the older variant."""
    f = shared_features(spark, sf)
    out = None
    for variant, prior in (("current", M.CHANGEPOINT_PRIOR), ("old", 0.05)):
        m = M.fit_temp(f, prior=prior).where("span_days >= 21")
        rows = F.transform(F.arrays_zip("bends", "delta"), lambda x: F.struct(F.date_add("first_ds", x["bends"].cast("int")).alias("bend_ds"), x["delta"].alias("delta")))
        part = m.select("room_id", F.lit(variant).alias("variant"), "sigma", F.inline(rows))
        out = part if out is None else out.union(part)
    return out


@query("walk_forward_ma")
def walk_forward_ma(spark, sf):
    """K14 with its MA term: recursive extended least squares through each room's days, with the
    reference's column list and leak_free."""
    f = shared_features(spark, sf)
    a = M.walk_forward_ma(f).withColumn("variant", F.lit("default"))
    return a.unionByName(M.walk_forward_ma(f, leak_free=True).withColumn("variant", F.lit("leak_free")))


@query("interval_coverage")
def interval_coverage(spark, sf):
    """K16 / K15 intervals held against what came: per room and model, the days of the runs that have an
    actual value and those inside the bounds."""
    runs = model_runs_of(spark, sf).where("pred_co2 IS NOT NULL")
    j = runs.join(daily_table(spark, sf).select("room_id", "ds", "co2_mean", "temp_mean"), ["room_id", "ds"])
    rows = F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"{m}_mean").alias("y"), F.col(f"pred_{m}_lower").alias("lower"), F.col(f"pred_{m}_upper").alias("upper"))
        for m in ("co2", "temp")
    ])
    r = j.select("room_id", F.inline(rows)).where("y IS NOT NULL AND lower IS NOT NULL")
    inside = F.col("y").between(F.col("lower"), F.col("upper"))
    return r.groupBy("room_id", "model").agg(F.count(F.lit(1)).alias("n"), F.sum(inside.cast("bigint")).alias("n_inside"))


_ALL_OPTIMAL = with_("SELECT room_id, TRUE AS optimal FROM feats GROUP BY room_id", "feats")


def _optimal(gradients):
    return gradients.groupBy("room_id").agg(F.max(F.abs("gradient")).alias("g")).select("room_id", (F.col("g") < 1e-7).alias("optimal"))


@query("temp_model_optimal", _ALL_OPTIMAL)
def temp_model_optimal(spark, sf):
    """K4: whether the fit of each room fulfils its normal equations, checked on the rows."""
    f = shared_features(spark, sf)
    return _optimal(M.temp_optimality(f, materialize(M.fit_temp(f))))


@query("co2_model_optimal", _ALL_OPTIMAL)
def co2_model_optimal(spark, sf):
    """K6: the same for the first and the last pass."""
    f = shared_features(spark, sf)
    m, rows = M.fit_co2(f)
    return _optimal(M.co2_optimality(rows, m))


_OLS_WALK = """SELECT room_id, ds AS cutoff, lead(ds) OVER w AS ds, lead(temp_mean) OVER w AS y,
       regr_intercept(temp_mean, outside_temp_max) OVER u + regr_slope(temp_mean, outside_temp_max) OVER u * lead(outside_temp_max) OVER w AS yhat,
       row_number() OVER w AS rn, count(*) OVER (PARTITION BY room_id) AS n_rows, regr_count(temp_mean, outside_temp_max) OVER u AS n_fit
FROM feats WINDOW w AS (PARTITION BY room_id ORDER BY ds), u AS (PARTITION BY room_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def ols_walk(spark, sf):
    """The one-regressor walk-forward as a table of (room_id, cutoff, ds, y, yhat)."""
    w = M.walk_forward_ols(feature_table(spark, sf))
    return w.select("room_id", F.date_sub("test_ds", 1).alias("cutoff"), F.col("test_ds").alias("ds"), F.col("actual").alias("y"), F.col("pred").alias("yhat"))


@query(
    "cv_vs_persistence_ols",
    with_(
        f"""SELECT room_id, {r6('mae', 'mae')}, {r6('rmse', 'rmse')}, n_cutoffs, {r6('persistence_mae', 'persistence_mae')},
       mae > persistence_mae * 1.5 AS worse_than_persistence
FROM (SELECT room_id, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, count(DISTINCT ds - 1) AS n_cutoffs, avg(pd) AS persistence_mae
      FROM (SELECT *, abs(y - lag(y) OVER (PARTITION BY room_id ORDER BY ds)) AS pd FROM ({_OLS_WALK}) a
            WHERE rn >= floor(n_rows * 0.6) + 1 AND ds IS NOT NULL AND n_fit >= 3) b GROUP BY room_id) c""",
        "feats",
    ),
)
def cv_vs_persistence_ols(spark, sf):
    """K13 on a CV table that SQL can make: the one-regressor walk-forward against persistence."""
    return M.cv_metrics(ols_walk(spark, sf))


@query(
    "model_aic_ols",
    with_(
        f"""SELECT room_id, 'ols' AS model, n, {r6('rss', 'rss')}, {r6('n * ln(rss / n) + 6', 'aic')}
FROM (SELECT f.room_id, count(*) AS n, sum((f.temp_mean - (m.a + m.b * f.outside_temp_max)) * (f.temp_mean - (m.a + m.b * f.outside_temp_max))) AS rss
      FROM feats f JOIN (SELECT room_id, regr_intercept(temp_mean, outside_temp_max) AS a, regr_slope(temp_mean, outside_temp_max) AS b FROM feats GROUP BY room_id) m
        ON m.room_id = f.room_id GROUP BY f.room_id) r""",
        "feats",
    ),
)
def model_aic_ols(spark, sf):
    """K8 on the residuals of the one-regressor model."""
    f = feature_table(spark, sf)
    j = f.join(M.temp_trend_ols(f), "room_id")
    rows = j.select("room_id", F.col("temp_mean").alias("y"), (F.col("intercept") + F.col("slope") * F.col("outside_temp_max")).alias("yhat"))
    return M.model_aic(rows, k=3, model="ols")


@query("forecast_table_old")
def forecast_table_old(spark, sf):
    """K18 of the older variant: yearly terms, nine exogenous columns, 21 fields."""
    return FC.run_forecast_old(feature_table(spark, sf, backfill=False, sleep_ratio=True), weather_of(spark, sf))
