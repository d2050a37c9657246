"""Queries: models, evaluation and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import forecast as FC
from . import models as M
from .daily_tables import feature_table, weather_of
from .registry import cte, query, r6, with_
from ..session import materialize


def shared_features(spark, sf):
    """The feature table, checkpointed: the model queries read it in
    several branches (gate, sums, seeds, scaffold, folds)."""
    return materialize(feature_table(spark, sf))

# ---------------------------------------------------------------- oracle CTEs
cte(
    "gate",
    """SELECT room_id, CAST(max(ds) - min(ds) AS BIGINT) AS span_days FROM feats GROUP BY room_id""",
    "feats",
)
cte(
    "sc",
    """SELECT b.room_id, g.h, CAST(b.last_ds + CAST(g.h AS INT) AS DATE) AS ds, w.outside_temp_max, w.outside_temp_min,
       w.precipitation, w.cloudcover, w.wind, w.solar_radiation,
       isodow(CAST(b.last_ds + CAST(g.h AS INT) AS DATE)) - 1 >= 5 AS is_weekend, hd.hds IS NOT NULL AS is_holiday,
       isodow(CAST(b.last_ds + CAST(g.h AS INT) AS DATE)) - 1 AS dayofweek,
       sin(2 * pi() * (isodow(CAST(b.last_ds + CAST(g.h AS INT) AS DATE)) - 1) / 7.0) AS day_sin,
       cos(2 * pi() * (isodow(CAST(b.last_ds + CAST(g.h AS INT) AS DATE)) - 1) / 7.0) AS day_cos,
       0.3 AS presence_ratio, b.hum_mean, 0.0 AS temp_diff, 0.0 AS co2_diff1, false AS rapid_rise,
       CAST(b.last_ds + CAST(g.h AS INT) AS DATE) - b.first_ds AS t_days, CAST(b.n + g.h AS DOUBLE) AS t_row
FROM (SELECT room_id, max(ds) AS last_ds, min(ds) AS first_ds, count(*) AS n, arg_max(hum_mean, ds) AS hum_mean
      FROM feats GROUP BY room_id) b
CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS h) g
LEFT JOIN weather w ON w.ds = CAST(b.last_ds + CAST(g.h AS INT) AS DATE)
LEFT JOIN (SELECT DISTINCT ds AS hds FROM holidays) hd ON hd.hds = CAST(b.last_ds + CAST(g.h AS INT) AS DATE)""",
    "feats",
    "weather",
    "holidays",
)
cte(
    "last2",
    """SELECT room_id, max(CASE WHEN rn = 1 THEN temp_mean END) AS t_last, max(CASE WHEN rn = 2 THEN temp_mean END) AS t_prev,
       max(CASE WHEN rn = 1 THEN u END) AS u_last, max(CASE WHEN rn = 2 THEN u END) AS u_prev
FROM (SELECT room_id, temp_mean,
             co2_mean - ((((((0.0 + CAST(presence_ratio AS DOUBLE) * 200.0) + CAST(hum_mean AS DOUBLE) * 8.0)
               + CAST(is_weekend AS DOUBLE) * 15.0) + CAST(is_holiday AS DOUBLE) * -10.0) + CAST(co2_diff1 AS DOUBLE) * 0.5)
               + CAST(rapid_rise AS DOUBLE) * 20.0) AS u,
             row_number() OVER (PARTITION BY room_id ORDER BY ds DESC) AS rn FROM feats)
GROUP BY room_id""",
    "feats",
)
cte(
    "tdiff",
    "SELECT room_id, avg(temp_mean - outside_temp_max) AS d FROM feats GROUP BY room_id",
    "feats",
)
cte(
    "tfold",
    """SELECT room_id, 0 AS h, t_last AS l1, t_prev AS l2 FROM last2
UNION ALL
SELECT f.room_id, f.h + 1,
       least(greatest(2.0 + 0.1 * s.outside_temp_max + 0.6 * f.l1 + 0.2 * f.l2, s.outside_temp_max), s.outside_temp_max + d.d),
       f.l1
FROM tfold f JOIN sc s ON s.room_id = f.room_id AND s.h = f.h + 1 JOIN tdiff d ON d.room_id = f.room_id""",
    "last2",
    "sc",
    "tdiff",
)
cte(
    "cfold",
    """SELECT room_id, 0 AS h, u_last AS u1, u_prev AS u2 FROM last2
UNION ALL
SELECT f.room_id, f.h + 1, 0.5 * f.u1 + 0.2 * f.u2 + 0.01 * s.t_row, f.u1
FROM cfold f JOIN sc s ON s.room_id = f.room_id AND s.h = f.h + 1""",
    "last2",
    "sc",
)
cte(
    "cuts",
    """SELECT r.room_id, c.cutoff, r.ds FROM (
  SELECT room_id, CAST(hi - 1 - CAST(k AS INT) AS DATE) AS cutoff FROM (
    SELECT room_id, hi, unnest(generate_series(0, (hi - 1) - (lo + CAST(greatest(7, hi - lo - 3) AS INT)))) AS k
    FROM (SELECT room_id, min(ds) AS lo, max(ds) AS hi FROM feats GROUP BY room_id)
    WHERE lo + CAST(greatest(7, hi - lo - 3) AS INT) <= hi - 1)) c
JOIN feats r ON r.room_id = c.room_id AND r.ds > c.cutoff AND r.ds <= c.cutoff + 1""",
    "feats",
)

# ------------------------------------------------------------- O queries
@query(
    "regressor_gate",
    with_(
        """SELECT room_id, span_days, CAST(CASE WHEN span_days < 21 THEN 3 ELSE 12 END AS BIGINT) AS n_regressors,
       span_days >= 21 AS weekly, CAST(CASE WHEN span_days < 21 THEN 0 ELSE 5 END AS BIGINT) AS n_changepoints,
       span_days < 30 AS warn_small FROM gate""",
        "gate",
    ),
)
def regressor_gate(spark, sf):
    """K2: per-room span, regressor set size, weekly terms, changepoints and small-data warning."""
    return M.regressor_gate(feature_table(spark, sf)).select(
        "room_id", "span_days", "n_regressors", "weekly", "n_changepoints", "warn_small"
    )


_FOURIER_SQL = ", ".join(
    r6(f"{fn}(2 * pi() * {k} * CAST(ds - DATE '1970-01-01' AS DOUBLE) / 7.0)", f"wk_{fn}{k}")
    for k in range(1, M.FOURIER_ORDER + 1)
    for fn in ("sin", "cos")
)


@query("weekly_fourier", with_(f"SELECT room_id, ds, {_FOURIER_SQL} FROM feats", "feats"))
def weekly_fourier(spark, sf):
    """K3: weekly Fourier terms (order 3) per day."""
    return M.weekly_fourier(feature_table(spark, sf)).select("room_id", "ds", *M.FOURIER_TERMS)


@query(
    "temp_trend_ols",
    with_(
        f"""SELECT room_id, {r6('regr_slope(temp_mean, outside_temp_max)', 'slope')},
       {r6('regr_intercept(temp_mean, outside_temp_max)', 'intercept')}, {r6('regr_r2(temp_mean, outside_temp_max)', 'r2')},
       CAST(regr_count(temp_mean, outside_temp_max) AS BIGINT) AS n FROM feats GROUP BY room_id""",
        "feats",
    ),
)
def temp_trend_ols(spark, sf):
    """K5: slope, intercept and r2 of temperature on outdoor maximum per room."""
    return M.temp_trend_ols(feature_table(spark, sf))


@query(
    "walk_forward_ols",
    with_(
        f"""SELECT room_id, test_ds, n_fit, {r6('slope', 'slope')}, {r6('intercept', 'intercept')},
       {r6('intercept + slope * x_next', 'pred')}, {r6('actual', 'actual')}, {r6('actual - (intercept + slope * x_next)', 'err')}
FROM (SELECT room_id, ds, row_number() OVER w AS rn, count(*) OVER (PARTITION BY room_id) AS n_rows,
             regr_slope(temp_mean, outside_temp_max) OVER u AS slope,
             regr_intercept(temp_mean, outside_temp_max) OVER u AS intercept,
             CAST(regr_count(temp_mean, outside_temp_max) OVER u AS BIGINT) AS n_fit,
             lead(ds) OVER w AS test_ds, lead(outside_temp_max) OVER w AS x_next, lead(temp_mean) OVER w AS actual
      FROM feats
      WINDOW w AS (PARTITION BY room_id ORDER BY ds),
             u AS (PARTITION BY room_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE rn >= floor(n_rows * 0.6) + 1 AND test_ds IS NOT NULL AND n_fit >= 3""",
        "feats",
    ),
)
def walk_forward_ols(spark, sf):
    """K14 one-regressor form (exact oracle)."""
    return M.walk_forward_ols(feature_table(spark, sf))


_SC_OUT = ", ".join(
    [
        "room_id", "CAST(h AS BIGINT) AS h", "ds", r6("outside_temp_max", "outside_temp_max"), r6("outside_temp_min", "outside_temp_min"),
        r6("precipitation", "precipitation"), "CAST(cloudcover AS BIGINT) AS cloudcover", r6("wind", "wind"),
        r6("solar_radiation", "solar_radiation"), "is_weekend", "is_holiday", "CAST(dayofweek AS BIGINT) AS dayofweek",
        r6("day_sin", "day_sin"), r6("day_cos", "day_cos"), r6("presence_ratio", "presence_ratio"), r6("hum_mean", "hum_mean"),
        r6("temp_diff", "temp_diff"), r6("co2_diff1", "co2_diff1"), "rapid_rise", "CAST(t_days AS BIGINT) AS t_days",
        r6("t_row", "t_row"),
    ]
)


@query("future_scaffold", with_(f"SELECT {_SC_OUT} FROM sc", "sc"))
def future_scaffold(spark, sf):
    """The 7 future days per room with weather, calendar and default exogenous values."""
    return FC.future_scaffold(feature_table(spark, sf), weather_of(spark, sf))


@query(
    "last_values",
    with_(
        f"""SELECT l.room_id, {r6('h.hum_last', 'hum_last')}, {r6('l.t_last', 'temp_mean_last')}, {r6('l.t_prev', 'temp_mean_prev')}
FROM last2 l JOIN (SELECT room_id, arg_max(hum_mean, ds) AS hum_last FROM feats GROUP BY room_id) h ON h.room_id = l.room_id""",
        "last2",
        "feats",
    ),
)
def last_values(spark, sf):
    """Last humidity and last two temperatures per room."""
    return FC.last_values(feature_table(spark, sf))


@query(
    "split_80_20",
    with_(
        """SELECT room_id, ds, rn, n_rows, rn > n_rows - greatest(CAST(floor(n_rows * 0.2) AS BIGINT), 1) AS is_test
FROM (SELECT room_id, ds, row_number() OVER (PARTITION BY room_id ORDER BY ds) AS rn,
             count(*) OVER (PARTITION BY room_id) AS n_rows FROM feats)""",
        "feats",
    ),
)
def split_80_20(spark, sf):
    """Row number, series length and the last-20 % test flag per day."""
    return M.split_80_20(feature_table(spark, sf)).select("room_id", "ds", "rn", "n_rows", "is_test")


@query("cutoffs", with_("SELECT room_id, cutoff, ds FROM cuts", "cuts"))
def cutoffs(spark, sf):
    """Rolling-origin cutoffs per room and the day each one predicts."""
    return M.cutoffs(feature_table(spark, sf)).select("room_id", "cutoff", "ds")


@query("distinct_cutoffs", with_("SELECT room_id, count(DISTINCT cutoff) AS n_cutoffs FROM cuts GROUP BY room_id", "cuts"))
def distinct_cutoffs(spark, sf):
    """Number of distinct CV cutoffs per room."""
    return M.cutoffs(feature_table(spark, sf)).groupBy("room_id").agg(F.countDistinct("cutoff").alias("n_cutoffs"))


@query(
    "persistence_baseline",
    with_(
        f"""SELECT room_id, {r6('avg(abs(temp_mean - prev))', 'persistence_mae')} FROM (
  SELECT c.room_id, f.temp_mean, lag(f.temp_mean) OVER (PARTITION BY c.room_id ORDER BY c.ds) AS prev
  FROM cuts c JOIN feats f ON f.room_id = c.room_id AND f.ds = c.ds) GROUP BY room_id""",
        "cuts",
        "feats",
    ),
)
def persistence_baseline(spark, sf):
    """Mean |y - previous y| over the CV rows."""
    from pyspark.sql import Window

    f = feature_table(spark, sf)
    c = M.cutoffs(f).join(f.select("room_id", "ds", "temp_mean"), ["room_id", "ds"])
    w = Window.partitionBy("room_id").orderBy("ds")
    return c.withColumn("_d", F.abs(F.col("temp_mean") - F.lag("temp_mean").over(w))).groupBy("room_id").agg(
        F.avg("_d").alias("persistence_mae")
    )


@query(
    "expanding_slices",
    with_(
        """SELECT room_id, ds AS cutoff, test_ds, rn AS n_train FROM (
  SELECT room_id, ds, row_number() OVER w AS rn, count(*) OVER (PARTITION BY room_id) AS n_rows, lead(ds) OVER w AS test_ds
  FROM feats WINDOW w AS (PARTITION BY room_id ORDER BY ds))
WHERE rn >= floor(n_rows * 0.6) + 1 AND test_ds IS NOT NULL""",
        "feats",
    ),
)
def expanding_slices(spark, sf):
    """Expanding train / next-day test slices from 60 % of each series."""
    return M.expanding_slices(feature_table(spark, sf))


@query(
    "temp_forecast_fixed",
    with_(f"SELECT f.room_id, CAST(f.h AS BIGINT) AS h, s.ds, {r6('f.l1', 'pred_temp')} FROM tfold f JOIN sc s ON s.room_id = f.room_id AND s.h = f.h WHERE f.h >= 1",
          "tfold", recursive=True),
)
def temp_forecast_fixed(spark, sf):
    """K16 fold with fixed coefficients against a recursive CTE."""
    f = shared_features(spark, sf)
    return FC.temp_forecast_fixed(FC.future_scaffold(f, weather_of(spark, sf)), f)


_XB_SC = (
    "((((((0.0 + CAST(s.presence_ratio AS DOUBLE) * 200.0) + CAST(s.hum_mean AS DOUBLE) * 8.0) + CAST(s.is_weekend AS DOUBLE) * 15.0)"
    " + CAST(s.is_holiday AS DOUBLE) * -10.0) + CAST(s.co2_diff1 AS DOUBLE) * 0.5) + CAST(s.rapid_rise AS DOUBLE) * 20.0)"
)


@query(
    "co2_forecast_fixed",
    with_(f"SELECT f.room_id, CAST(f.h AS BIGINT) AS h, s.ds, {r6(_XB_SC + ' + f.u1', 'pred_co2')} FROM cfold f JOIN sc s ON s.room_id = f.room_id AND s.h = f.h WHERE f.h >= 1",
          "cfold", recursive=True),
)
def co2_forecast_fixed(spark, sf):
    """K15 fold with fixed coefficients against a recursive CTE."""
    f = shared_features(spark, sf)
    return FC.co2_forecast_fixed(FC.future_scaffold(f, weather_of(spark, sf)), f)


# --------------------------------------------- R queries (no SQL oracle)
@query("temp_model")
def temp_model(spark, sf):
    """K4: ridge coefficients per series (raw units, x . beta)."""
    return M.fit_temp(shared_features(spark, sf))


@query("co2_model")
def co2_model(spark, sf):
    """K6: CO2 regression with AR(2) errors, drift and MA(1) per room (three least-squares passes)."""
    m, _ = M.fit_co2(shared_features(spark, sf))
    return m


@query("co2_coefficients")
def co2_coefficients(spark, sf):
    """K7: CO2 model coefficients as (room, term, value) rows."""
    m, _ = M.fit_co2(shared_features(spark, sf))
    return M.co2_coefficients(m)


@query("model_aic")
def model_aic(spark, sf):
    """K8: AIC of the CO2 model per room from its residual sums."""
    _, rows = M.fit_co2(shared_features(spark, sf))
    return M.model_aic(rows)


@query("fitted_values")
def fitted_values(spark, sf):
    """K9: in-sample predictions of both models."""
    f = shared_features(spark, sf)
    t = M.temp_fitted(f, M.fit_temp(f)).withColumn("model", F.lit("temp"))
    _, rows = M.fit_co2(f)
    c = rows.select("room_id", "ds", "y", "yhat").withColumn("model", F.lit("co2"))
    return t.unionByName(c)


@query("residuals")
def residuals(spark, sf):
    """Y - yhat of both models over the last 7 days of each series."""
    from ..operators.clean import last_n_days

    fv = fitted_values(spark, sf)
    return last_n_days(fv, ts="ds").withColumn("residual", F.col("y") - F.col("yhat"))


@query("holdout_eval")
def holdout_eval(spark, sf):
    """CO2 model fitted on the first 80 % of days, MAE / RMSE on the rest, per room; with the
    reference's column list and with the target-leaking columns lagged (leak_free)."""
    f = shared_features(spark, sf)
    a = M.holdout_eval(f).withColumn("variant", F.lit("default"))
    b = M.holdout_eval(f, leak_free=True).withColumn("variant", F.lit("leak_free"))
    return a.unionByName(b)


@query("rolling_cv")
def rolling_cv(spark, sf):
    """K12 rows (one per cutoff)"""
    return M.rolling_cv(shared_features(spark, sf))


@query("cv_vs_persistence")
def cv_vs_persistence(spark, sf):
    """K12 metrics + K13 flag"""
    return M.cv_metrics(M.rolling_cv(shared_features(spark, sf)))


@query("walk_forward")
def walk_forward(spark, sf):
    """K14 (CO2, cumulative sums), with the reference's column list and leak_free."""
    f = shared_features(spark, sf)
    a = M.walk_forward(f).withColumn("variant", F.lit("default"))
    b = M.walk_forward(f, leak_free=True).withColumn("variant", F.lit("leak_free"))
    return a.unionByName(b)


@query("co2_forecast")
def co2_forecast(spark, sf):
    """7-day CO2 forecast (regression part + AR(2)/drift/MA fold) per room."""
    f = shared_features(spark, sf)
    m, _ = M.fit_co2(f)
    return FC.co2_forecast(FC.future_scaffold(f, weather_of(spark, sf)), m)


@query("temp_forecast")
def temp_forecast(spark, sf):
    """Recursive 7-day temperature forecast per room, each step clipped and fed back."""
    f = shared_features(spark, sf)
    return FC.temp_forecast(FC.future_scaffold(f, weather_of(spark, sf)), M.fit_temp(f), f)


@query("forecast_table")
def forecast_table(spark, sf):
    """The 12-field 7-day forecast per series (flagship)."""
    return FC.run_forecast(feature_table(spark, sf), weather_of(spark, sf))


@query("small_data_eval")
def small_data_eval(spark, sf):
    """Small-data evaluation (span < 14 days) of the temperature model per room."""
    return M.small_data_eval(shared_features(spark, sf))
