"""Queries: trends (D3-D9, D17, D20), latest rows (E5, F), set operations
(G), run-history tables (A11-A16, C2-C4, C7-C9, D12-D16, D18)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal
from ..functions import scalar as S
from ..operators import clean as C
from ..operators import daily as D
from ..operators import order as O
from ..operators import trends as TR
from ..operators import evaluate as EV
from ..sources import fixtures as fx
from ..sources import store
from . import history as H
from .daily_tables import advice_sql, feature_table, warning_sql, weather_of
from .readings import AS_OF, MCOLS, OFFICE_DAYS, cleaned, daily_table
from .registry import LOCAL, avg_exact_sql, cte, query, r6, with_

SEASON_LIST = "['Winter', 'Spring', 'Summer', 'Autumn']"

cte(
    "week",
    """SELECT c.* FROM clean c JOIN (SELECT room_id, max(ts) AS mx FROM clean GROUP BY room_id) m USING (room_id)
WHERE c.ts >= m.mx - INTERVAL 7 DAYS""",
    "clean",
)
cte(
    "trendrows",
    f"""SELECT w.*, hour(local_ts) AS hour, isodow(CAST(local_ts AS DATE)) - 1 >= 5 AS is_weekend,
       hd.hds IS NOT NULL AS is_holiday,
       list_extract({SEASON_LIST}, CAST(month(local_ts) % 12 // 3 + 1 AS INT)) AS season
FROM week w LEFT JOIN (SELECT DISTINCT ds AS hds FROM holidays) hd ON CAST(w.local_ts AS DATE) = hd.hds""",
    "week",
    "holidays",
)
cte("timed", f"SELECT *, {LOCAL} AS local_ts FROM parsed WHERE ts IS NOT NULL", "parsed")
cte(
    "hourly_latest",
    """SELECT room_id, CAST(local_ts AS DATE) AS day, hour(local_ts) AS hour, id, ts_raw, co2, temperature, humidity,
       presence, ts, local_ts
FROM timed
QUALIFY row_number() OVER (PARTITION BY room_id, CAST(local_ts AS DATE), hour(local_ts) ORDER BY ts DESC, id DESC) = 1""",
    "timed",
)
cte(
    "runs",
    f"""SELECT d.room_id, d.ds AS run_id, g.h, CAST(d.ds + CAST(g.h AS INT) AS DATE) AS ds, d.temp_mean AS pred_temp,
       w.outside_temp_max, w.outside_temp_min, w.precipitation, w.cloudcover, w.wind, w.solar_radiation,
       isodow(CAST(d.ds + CAST(g.h AS INT) AS DATE)) - 1 >= 5 AS is_weekend, hd.hds IS NOT NULL AS is_holiday,
       d.co2_mean AS pred_co2, {advice_sql('d.co2_mean', 'd.temp_mean')} AS advies
FROM daily2 d CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS h) g
LEFT JOIN weather w ON w.ds = CAST(d.ds + CAST(g.h AS INT) AS DATE)
LEFT JOIN (SELECT DISTINCT ds AS hds FROM holidays) hd ON hd.hds = CAST(d.ds + CAST(g.h AS INT) AS DATE)""",
    "daily2",
    "weather",
    "holidays",
)
cte(
    "latest_per_day",
    "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY room_id, ds ORDER BY run_id DESC) = 1",
    "runs",
)
cte(
    "latest_run",
    "SELECT r.* FROM runs r JOIN (SELECT room_id, max(run_id) AS mr FROM runs GROUP BY room_id) m "
    "ON r.room_id = m.room_id AND r.run_id = m.mr",
    "runs",
)

RUN_OUT = ", ".join(
    [
        "room_id", "run_id", "CAST(h AS BIGINT) AS h", "ds", r6("pred_temp", "pred_temp"),
        r6("outside_temp_max", "outside_temp_max"), r6("outside_temp_min", "outside_temp_min"),
        r6("precipitation", "precipitation"), "CAST(cloudcover AS BIGINT) AS cloudcover", r6("wind", "wind"),
        r6("solar_radiation", "solar_radiation"), "is_weekend", "is_holiday", r6("pred_co2", "pred_co2"), "advies",
    ]
)


def week_rows(spark, sf):
    return TR.trend_columns(C.last_n_days(cleaned(spark, sf)))


def runs_table(spark, sf):
    return H.persistence_runs(daily_table(spark, sf), weather_of(spark, sf))


def hourly_latest(spark, sf):
    """Hourly rows of all readings that have a time: outliers are shown, not modelled."""
    r = C.drop_bad_timestamps(C.parse_timestamp(fx.measurements(spark, sf)))
    return TR.latest_per_hour(C.to_local_time(r))


# ----------------------------------------------------------------- trends
def _prof_sql(by: str) -> str:
    return with_(
        f"SELECT room_id, {by}, {r6('avg(co2)', 'co2_mean')}, {r6(avg_exact_sql('temperature'), 'temperature_mean')} "
        f"FROM trendrows GROUP BY room_id, {by}",
        "trendrows",
    )


@query("hourly_profile", _prof_sql("hour").replace("SELECT room_id, hour,", "SELECT room_id, CAST(hour AS BIGINT) AS hour,", 1))
def hourly_profile(spark, sf):
    """D3: mean by local hour over the last 7 days."""
    return TR.profile(week_rows(spark, sf), "hour")


@query("weekend_profile", _prof_sql("is_weekend"))
def weekend_profile(spark, sf):
    """Mean CO2 / temperature on weekend vs weekdays, last 7 days."""
    return TR.profile(week_rows(spark, sf), "is_weekend")


@query("holiday_profile", _prof_sql("is_holiday"))
def holiday_profile(spark, sf):
    """Mean CO2 / temperature on holidays vs other days, last 7 days."""
    return TR.profile(week_rows(spark, sf), "is_holiday")


@query(
    "season_profile",
    with_(
        f"""SELECT k.room_id, k.season, {r6('a.co2_mean', 'co2_mean')}, {r6('a.temperature_mean', 'temperature_mean')}
FROM (SELECT DISTINCT room_id, unnest({SEASON_LIST}) AS season FROM trendrows) k
LEFT JOIN (SELECT room_id, season, avg(co2) AS co2_mean, {avg_exact_sql('temperature')} AS temperature_mean
           FROM trendrows GROUP BY room_id, season) a ON k.room_id = a.room_id AND k.season = a.season""",
        "trendrows",
    ),
)
def season_profile(spark, sf):
    """D6 with C4 (all four seasons listed; missing ones NULL)."""
    return TR.season_profile(week_rows(spark, sf))


@query(
    "trend_slices",
    with_(
        f"""SELECT room_id, CAST(hour AS BIGINT) AS hour, is_weekend, is_holiday, season,
       {r6('avg(co2)', 'co2_mean')}, {r6(avg_exact_sql('temperature'), 'temperature_mean')},
       CASE WHEN grouping(hour) = 0 THEN 'hour' WHEN grouping(is_weekend) = 0 THEN 'weekend'
            WHEN grouping(is_holiday) = 0 THEN 'holiday' ELSE 'season' END AS slice
FROM trendrows
GROUP BY GROUPING SETS ((room_id, hour), (room_id, is_weekend), (room_id, is_holiday), (room_id, season))""",
        "trendrows",
    ),
)
def trend_slices(spark, sf):
    """D3-D6 for both metrics in one grouping-sets pass."""
    return TR.trend_slices(week_rows(spark, sf))


@query(
    "office_vs_home",
    with_(
        f"""SELECT room_id, CAST(hour(local_ts) AS BIGINT) AS hour,
       {r6(f"avg(CASE WHEN CAST(local_ts AS DATE) IN (DATE '{OFFICE_DAYS[0]}', DATE '{OFFICE_DAYS[1]}') THEN co2 END)", 'co2_office')},
       {r6(f"avg(CASE WHEN CAST(local_ts AS DATE) NOT IN (DATE '{OFFICE_DAYS[0]}', DATE '{OFFICE_DAYS[1]}') THEN co2 END)", 'co2_home')}
FROM week GROUP BY room_id, hour(local_ts)""",
        "week",
    ),
)
def office_vs_home(spark, sf):
    """Mean CO2 by local hour on office days vs other days, last 7 days."""
    return TR.office_vs_home(cleaned(spark, sf), office_days=OFFICE_DAYS)


@query("distinct_days", with_("SELECT DISTINCT room_id, CAST(local_ts AS DATE) AS day FROM clean ORDER BY 1, 2", "clean"))
def distinct_days(spark, sf):
    """The local days present per room, sorted."""
    return TR.distinct_days(cleaned(spark, sf))


@query(
    "span_days",
    with_(
        "SELECT room_id, min(ds) AS first_ds, max(ds) AS last_ds, CAST(max(ds) - min(ds) AS BIGINT) AS span_days, "
        "count(*) AS n_days FROM daily GROUP BY room_id",
        "daily",
    ),
)
def span_days(spark, sf):
    """First day, last day, span and number of days per room."""
    return D.span_days(daily_table(spark, sf))


@query(
    "min_days_guard",
    with_(
        "SELECT room_id, count(*) AS n_days, CASE WHEN count(*) < 7 THEN 'too_few_days' ELSE 'ok' END AS status "
        "FROM daily2 GROUP BY room_id",
        "daily2",
    ),
)
def min_days_guard(spark, sf):
    """D11 on the day table (per-series status, never an exception)."""
    return D.min_days_guard(daily_table(spark, sf))


_E5 = "room_id, day, CAST(hour AS BIGINT) AS hour, id, ts_raw, CAST(co2 AS BIGINT) AS co2, temperature, humidity, presence, ts, local_ts"


@query("latest_per_hour", with_(f"SELECT {_E5} FROM hourly_latest", "hourly_latest"))
def latest_per_hour(spark, sf):
    """E5: the last reading of every local hour per room."""
    return hourly_latest(spark, sf)


@query(
    "co2_extremes",
    with_(
        """SELECT room_id, day, CAST(max(co2) AS BIGINT) AS max_co2, first(ts ORDER BY co2 DESC, ts DESC) AS max_ts,
       CAST(min(co2) AS BIGINT) AS min_co2, first(ts ORDER BY co2 ASC, ts DESC) AS min_ts
FROM hourly_latest WHERE co2 IS NOT NULL GROUP BY room_id, day""",
        "hourly_latest",
    ),
)
def co2_extremes(spark, sf):
    """D17 over the hourly rows of each local day."""
    return TR.co2_extremes(hourly_latest(spark, sf).where(F.col("co2").isNotNull()))


_LINE_SQL = (
    "'Timestamp: ' || replace(substr(ts_raw, 1, 19), 'T', ' ') || ', CO₂: ' || coalesce(CAST(co2 AS VARCHAR), 'None') || "
    "' ppm, Temperature: ' || CAST(temperature AS VARCHAR) || '°C, Humidity: ' || CAST(humidity AS VARCHAR) || "
    "'%, Presence: ' || CASE WHEN presence THEN 'True' ELSE 'False' END"
)


@query(
    "context_table",
    with_(
        f"SELECT room_id, day, string_agg({_LINE_SQL}, chr(10) ORDER BY ts) AS context, count(*) AS n_lines "
        "FROM hourly_latest GROUP BY room_id, day",
        "hourly_latest",
    ),
)
def context_table(spark, sf):
    """The hourly rows of each local day as text lines, in time order.
    A group holds at most one row per hour (bounded)."""
    return EV.context_table(hourly_latest(spark, sf))


# ---------------------------------------------------------- F: order, top-k
@query("sort_by_time", with_("SELECT id, room_id, ts FROM clean ORDER BY room_id, ts, id", "clean"))
def sort_by_time(spark, sf):
    """cleaned readings ordered by room and time."""
    return O.sort_by_time(cleaned(spark, sf)).select("id", "room_id", "ts")


@query(
    "latest_reading",
    with_(
        f"SELECT {MCOLS} FROM measurements QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY ts_raw DESC, id DESC) = 1",
        "measurements",
    ),
)
def latest_reading(spark, sf):
    """first row of the newest-first (text-ordered) store scan, per room.
    Text order puts unparsable stamps first, as the store does."""
    return store.conform(O.latest_by(fx.measurements(spark, sf), ["ts_raw", "id"]))


@query(
    "latest_by_id",
    with_(f"SELECT {MCOLS} FROM measurements QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY id DESC) = 1", "measurements"),
)
def latest_by_id(spark, sf):
    """the reading with the highest id per room."""
    return store.conform(O.latest_by(fx.measurements(spark, sf), ["id"]))


@query(
    "head_tail",
    with_(
        """SELECT room_id, id, ts, 'head' AS part, row_number() OVER (PARTITION BY room_id ORDER BY ts, id) AS pos
FROM clean QUALIFY pos <= 5
UNION ALL
SELECT room_id, id, ts, 'tail' AS part, row_number() OVER (PARTITION BY room_id ORDER BY ts DESC, id DESC) AS pos
FROM clean QUALIFY pos <= 5""",
        "clean",
    ),
)
def head_tail(spark, sf):
    """first and last 5 readings per room."""
    return O.head_tail(cleaned(spark, sf).select("room_id", "id", "ts"))


# ------------------------------------------------------------------- G: sets
cte(
    "mean7_runs",
    """SELECT d.room_id, d.ds AS run_id, CAST(d.ds + CAST(g.h AS INT) AS DATE) AS ds, d.t7 AS pred_temp, d.c7 AS pred_co2
FROM (SELECT room_id, ds, avg(temp_mean) OVER w AS t7, avg(co2_mean) OVER w AS c7 FROM daily2
      WINDOW w AS (PARTITION BY room_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) d
CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS h) g""",
    "daily2",
)


@query(
    "union_runs",
    with_(
        f"""SELECT 'persistence' AS model, {RUN_OUT} FROM runs
UNION ALL
SELECT 'mean7', room_id, run_id, NULL, ds, {r6('pred_temp')}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       {r6('pred_co2')}, NULL FROM mean7_runs""",
        "runs",
        "mean7_runs",
    ),
)
def union_runs(spark, sf):
    """G1: runs of two forecasters with different record shapes."""
    d = daily_table(spark, sf)
    a = H.persistence_runs(d, weather_of(spark, sf)).withColumn("model", F.lit("persistence"))
    b = H.mean_runs(d).withColumn("model", F.lit("mean7"))
    return O.union_runs(a, b)


@query("latest_run_per_day", with_(f"SELECT {RUN_OUT} FROM latest_per_day", "latest_per_day"))
def latest_run_per_day(spark, sf):
    """For every forecast day, the row of the newest run covering it."""
    return O.latest_run_per_day(runs_table(spark, sf))


@query("seen_ids", with_(f"SELECT DISTINCT {MCOLS} FROM measurements", "measurements"))
def seen_ids(spark, sf):
    """A feed delivered twice; each id handled once."""
    m = fx.measurements(spark, sf)
    return store.conform(O.seen_ids(m.unionByName(m)))


# ------------------------------------------------------ A13-A15: run history
@query("latest_forecast", with_(f"SELECT {RUN_OUT} FROM latest_run", "latest_run"))
def latest_forecast(spark, sf):
    """The rows of the newest run per series."""
    return H.latest_run(runs_table(spark, sf))


@query(
    "last_n_runs",
    with_(
        f"""SELECT {RUN_OUT} FROM (SELECT r.* FROM runs r JOIN (
  SELECT room_id AS rk, run_id AS rid FROM (SELECT DISTINCT room_id, run_id FROM runs)
  QUALIFY dense_rank() OVER (PARTITION BY room_id ORDER BY run_id DESC) <= 4) k
ON r.room_id = k.rk AND r.run_id = k.rid) x""",
        "runs",
    ),
)
def last_n_runs(spark, sf):
    """A14 with limit_weeks = 4."""
    return H.last_n_runs(runs_table(spark, sf), n=4)


_REC = (
    "{'ds': strftime(ds, '%Y-%m-%dT%H:%M:%S'), 'pred_temp': floor(pred_temp * 100.0 + 0.5) / 100.0, 'outside_temp_max': outside_temp_max, "
    "'outside_temp_min': outside_temp_min, 'precipitation': precipitation, 'cloudcover': cloudcover, 'wind': wind, "
    "'solar_radiation': solar_radiation, 'is_weekend': is_weekend, 'is_holiday': is_holiday, "
    "'pred_co2': floor(pred_co2 * 100.0 + 0.5) / 100.0, 'advies': advies}"
)


@query(
    "records_json",
    with_(
        f"SELECT room_id, run_id, CAST(to_json(list({_REC} ORDER BY ds)) AS VARCHAR) AS records FROM runs GROUP BY room_id, run_id",
        "runs",
    ),
)
def records_json(spark, sf):
    """Each run (7 rows, a bounded group) as one JSON array of
    records in day order, predictions at 2 decimals."""
    return H.records_json(runs_table(spark, sf))


@query(
    "forecast_sink",
    with_(
        f"""SELECT room_id, strftime(ds, '%Y-%m-%dT%H:%M:%S') AS ds, {r6('pred_temp', 'pred_temp')},
       {r6('outside_temp_max', 'outside_temp_max')}, {r6('outside_temp_min', 'outside_temp_min')},
       {r6('precipitation', 'precipitation')}, CAST(cloudcover AS BIGINT) AS cloudcover, {r6('wind', 'wind')},
       {r6('solar_radiation', 'solar_radiation')}, is_weekend, is_holiday, {r6('pred_co2', 'pred_co2')}, advies
FROM latest_run""",
        "latest_run",
    ),
)
def forecast_sink(spark, sf):
    """The latest run per series in the 12-field file layout."""
    return H.sink_layout(H.latest_run(runs_table(spark, sf)))


# ------------------------------------------------ C: joins over forecasts
@query(
    "join_forecast_parts",
    with_(
        f"""SELECT t.room_id, t.ds, {r6('t.pred_temp', 'pred_temp')}, {r6('c.pred_co2', 'pred_co2')},
       {r6('w.outside_temp_max', 'outside_temp_max')}, CAST(w.cloudcover AS BIGINT) AS cloudcover
FROM (SELECT room_id, ds, pred_temp FROM latest_run) t
JOIN (SELECT room_id, ds, pred_co2 FROM latest_run) c ON t.room_id = c.room_id AND t.ds = c.ds
JOIN weather w ON w.ds = t.ds""",
        "latest_run",
        "weather",
    ),
)
def join_forecast_parts(spark, sf):
    """Temperature part, CO2 part and future weather, inner on (keys, ds)."""
    lr = H.latest_run(runs_table(spark, sf))
    t = lr.select("room_id", "ds", "pred_temp")
    c = lr.select("room_id", "ds", "pred_co2")
    w = weather_of(spark, sf).select("ds", "outside_temp_max", "cloudcover")
    return t.join(c, ["room_id", "ds"]).join(w, "ds")


cte(
    "actual_daily",
    f"SELECT room_id, CAST(local_ts AS DATE) AS day, avg(co2) AS actual_co2, {avg_exact_sql('temperature')} AS actual_temp FROM clean GROUP BY room_id, CAST(local_ts AS DATE)",
    "clean",
)


@query(
    "daily_actuals",
    with_(f"SELECT room_id, day, {r6('actual_co2', 'actual_co2')}, {r6('actual_temp', 'actual_temp')} FROM actual_daily", "actual_daily"),
)
def daily_actuals(spark, sf):
    """Per local day."""
    return D.daily_actuals(cleaned(spark, sf))


cte(
    "pred_daily",
    "SELECT room_id, ds AS day, avg(pred_co2) AS pred_co2, avg(pred_temp) AS pred_temp FROM runs GROUP BY room_id, ds",
    "runs",
)


@query(
    "daily_predictions",
    with_(f"SELECT room_id, day, {r6('pred_co2', 'pred_co2')}, {r6('pred_temp', 'pred_temp')} FROM pred_daily", "pred_daily"),
)
def daily_predictions(spark, sf):
    """Averaged over every run that covers the day."""
    return D.daily_predictions(runs_table(spark, sf))


@query(
    "eval_join",
    with_(
        f"""SELECT a.room_id, a.day, {r6('a.actual_co2', 'actual_co2')}, {r6('a.actual_temp', 'actual_temp')},
       {r6('t.pred_temp', 'pred_temp')}, {r6('c.pred_co2', 'pred_co2')}
FROM (SELECT room_id, ds AS day, co2_mean AS actual_co2, temp_mean AS actual_temp FROM daily WHERE ds >= DATE '{AS_OF}' - 7) a
LEFT JOIN (SELECT room_id, ds, pred_temp FROM latest_per_day) t ON a.room_id = t.room_id AND a.day = t.ds
LEFT JOIN (SELECT room_id, ds, pred_co2 FROM latest_per_day) c ON a.room_id = c.room_id AND a.day = c.ds""",
        "daily",
        "latest_per_day",
    ),
)
def eval_join(spark, sf):
    """Actual week, left join temperature and CO2 predictions (both by the UTC
    days that the model is fitted on)."""
    a = C.since_as_of(D.daily_actuals(cleaned(spark, sf), zone="UTC"), as_of=AS_OF, day="day")
    lp = O.latest_run_per_day(runs_table(spark, sf)).withColumnRenamed("ds", "day")
    return EV.eval_join(a, lp.select("room_id", "day", "pred_temp"), lp.select("room_id", "day", "pred_co2"))


@query(
    "forecast_warn_join",
    with_(
        f"""SELECT room_id, ds, {r6('pred_co2 + 300', 'pred_co2')}, {r6('pred_temp + 4', 'pred_temp')},
       {warning_sql('pred_co2 + 300', 'pred_temp + 4')} AS warning
FROM latest_per_day WHERE ds = DATE '{AS_OF}'""",
        "latest_per_day",
    ),
)
def forecast_warn_join(spark, sf):
    """C7 + H11: today's forecast row per series and its warning (day means
    shifted by +300 ppm / +4 C so that warnings occur)."""
    lp = O.latest_run_per_day(runs_table(spark, sf))
    t = EV.today_row(lp, as_of=AS_OF)
    t = t.withColumn("pred_co2", F.col("pred_co2") + 300).withColumn("pred_temp", F.col("pred_temp") + 4)
    return t.select("room_id", "ds", "pred_co2", "pred_temp", S.warning_text(F.col("pred_co2"), F.col("pred_temp")).alias("warning"))


@query(
    "daily_actual_vs_pred",
    with_(
        f"""SELECT coalesce(a.room_id, p.room_id) AS room_id, coalesce(a.day, p.day) AS day,
       {r6('a.actual_co2', 'actual_co2')}, {r6('a.actual_temp', 'actual_temp')},
       {r6('p.pred_co2', 'pred_co2')}, {r6('p.pred_temp', 'pred_temp')}
FROM actual_daily a FULL OUTER JOIN pred_daily p ON a.room_id = p.room_id AND a.day = p.day""",
        "actual_daily",
        "pred_daily",
    ),
)
def daily_actual_vs_pred(spark, sf):
    """Daily actuals full-outer-joined with daily predictions on (room, day)."""
    return EV.actual_vs_pred(D.daily_actuals(cleaned(spark, sf)), D.daily_predictions(runs_table(spark, sf)))


@query(
    "overlay_series",
    with_(
        f"""SELECT room_id, date_trunc('hour', local_ts) AS t, 'actual_co2' AS series, {r6('avg(co2)', 'value')}
FROM week GROUP BY room_id, date_trunc('hour', local_ts)
UNION ALL
SELECT room_id, CAST(day AS TIMESTAMP), 'pred_co2', {r6('pred_co2')} FROM pred_daily""",
        "week",
        "pred_daily",
    ),
)
def overlay_series(spark, sf):
    """Hourly actuals of the last week and daily predictions as one
    long (room_id, t, series, value) table."""
    return EV.overlay(C.last_n_days(cleaned(spark, sf)), D.daily_predictions(runs_table(spark, sf)))


# --------------------------------------------------- D14-D18: evaluation
cte(
    "pairs",
    """SELECT r.room_id, r.h, u.model, u.y, u.yhat FROM (
  SELECT r.room_id, r.h, d.co2_mean AS y_co2, r.pred_co2 AS p_co2, d.temp_mean AS y_temp, r.pred_temp AS p_temp
  FROM runs r JOIN daily2 d ON r.room_id = d.room_id AND r.ds = d.ds) r
CROSS JOIN LATERAL (VALUES ('co2', r.y_co2, r.p_co2), ('temp', r.y_temp, r.p_temp)) u(model, y, yhat)""",
    "runs",
    "daily2",
)
_METRICS = (
    f"count(*) AS n, {r6(avg_exact_sql('abs(y - yhat)'), 'mae')}, "
    f"{r6('sqrt(' + avg_exact_sql('(y - yhat) * (y - yhat)') + ')', 'rmse')}"
)


@query(
    "error_metrics",
    with_(f"SELECT room_id, model, {_METRICS} FROM pairs WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY room_id, model", "pairs"),
)
def error_metrics(spark, sf):
    """MAE and RMSE per (series, model) of the persistence runs."""
    return EV.error_metrics(EV.forecast_pairs(runs_table(spark, sf), daily_table(spark, sf)))


@query(
    "metrics_table",
    with_(
        f"""SELECT room_id, model, 'next_day' AS split, {_METRICS} FROM pairs
WHERE h = 1 AND y IS NOT NULL AND yhat IS NOT NULL GROUP BY room_id, model
UNION ALL
SELECT room_id, model, 'week' AS split, {_METRICS} FROM pairs
WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY room_id, model""",
        "pairs",
    ),
)
def metrics_table(spark, sf):
    """One table of metrics with a ``split`` column."""
    p = EV.forecast_pairs(runs_table(spark, sf), daily_table(spark, sf))
    return EV.metrics_table({"next_day": p.where(F.col("h") == 1), "week": p})


@query(
    "avg_temp_diff",
    with_(f"SELECT room_id, {r6('avg(temp_mean - outside_temp_max)', 'avg_temp_diff')} FROM feats GROUP BY room_id", "feats"),
)
def avg_temp_diff(spark, sf):
    """D16 over the training rows."""
    return EV.avg_temp_diff(feature_table(spark, sf))


@query(
    "residual_histogram",
    with_(
        f"""SELECT k.room_id, CAST(k.bin AS BIGINT) AS bin, {r6('k.lo + (k.bin - 1) * (k.hi - k.lo) / 15', 'edge_lo')},
       {r6('k.lo + k.bin * (k.hi - k.lo) / 15', 'edge_hi')}, coalesce(c.n, 0) AS n
FROM (SELECT room_id, lo, hi, unnest(generate_series(1, 15)) AS bin FROM
        (SELECT room_id, min(co2_mean - co2_lag1) AS lo, max(co2_mean - co2_lag1) AS hi FROM feats GROUP BY room_id)) k
LEFT JOIN (
  SELECT f.room_id, CASE WHEN b.hi = b.lo THEN 1
                         ELSE least(CAST(floor((f.co2_mean - f.co2_lag1 - b.lo) / (b.hi - b.lo) * 15) AS BIGINT) + 1, 15) END AS bin,
         count(*) AS n
  FROM feats f JOIN (SELECT room_id, min(co2_mean - co2_lag1) AS lo, max(co2_mean - co2_lag1) AS hi FROM feats GROUP BY room_id) b
    ON f.room_id = b.room_id
  GROUP BY ALL) c ON k.room_id = c.room_id AND k.bin = c.bin""",
        "feats",
    ),
)
def residual_histogram(spark, sf):
    """15 equal bins of the persistence residual per series, the
    maximum in the last bin, empty bins listed with n = 0."""
    f = feature_table(spark, sf)
    return EV.histogram(f.withColumn("r", F.col("co2_mean") - F.col("co2_lag1")), "r", bins=15)


@query(
    "season_reindex",
    with_(
        f"""SELECT k.room_id, k.season, {r6('a.co2_mean', 'co2_mean')} FROM
(SELECT DISTINCT room_id, unnest({SEASON_LIST}) AS season FROM clean) k
LEFT JOIN (SELECT room_id, list_extract({SEASON_LIST}, CAST(month(local_ts) % 12 // 3 + 1 AS INT)) AS season, avg(co2) AS co2_mean
           FROM clean GROUP BY ALL) a ON a.room_id = k.room_id AND a.season = k.season""",
        "clean",
    ),
)
def season_reindex(spark, sf):
    """C4: mean CO2 by season over all readings, aligned to the four
    seasons (missing ones NULL)."""
    c = cleaned(spark, sf).withColumn("season", cal.season_of(F.col("local_ts")))
    return TR.season_profile(c, metrics=("co2",))


@query(
    "history_append",
    with_(f"SELECT {RUN_OUT} FROM runs", "runs"),
)
def history_append(spark, sf):
    """Runs of two batches of rooms appended to one history folder (in the shared
    checkpoint folder); the newest run of one batch is written again, which
    replaces only itself.  Returns the history as read back."""
    from ..streaming.streams import stream_dir

    runs = runs_table(spark, sf)
    path = stream_dir(spark, "history") + "/history"
    even = F.col("room_id") % 2 == 0
    H.history_append(runs.where(even), path, "even")
    H.history_append(runs.where(~even), path, "odd")
    # the newest run of some rooms is written again: theirs is replaced, the others' stays
    newest = runs.where(even & (F.col("run_id") == runs.agg(F.max("run_id")).scalar()))
    H.history_append(newest, path, "even")
    return spark.read.schema(T.StructType([*runs.schema, T.StructField("batch", T.StringType())])).parquet(path).select(*runs.columns)


@query(
    "history_flatten",
    with_(
        f"""SELECT {RUN_OUT.replace('room_id, run_id,', 'room_id, wk, run_id,')},
       CAST(dense_rank() OVER (PARTITION BY room_id, wk ORDER BY run_id) - 1 AS BIGINT) AS run_pos,
       CAST(row_number() OVER (PARTITION BY room_id, run_id ORDER BY ds) - 1 AS BIGINT) AS day_pos
FROM (SELECT *, date_trunc('week', run_id)::DATE AS wk FROM runs)""",
        "runs",
    ),
)
def history_flatten(spark, sf):
    """Runs nested as (room, week) -> runs -> days (at most 7 x 7 per
    group), then flattened back with run and day positions."""
    runs = runs_table(spark, sf).withColumn("wk", F.to_date(F.date_trunc("week", "run_id")))
    per_run = runs.groupBy("room_id", "wk", "run_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ds", F.struct(*[c for c in runs.columns if c not in ("room_id", "wk")]).alias("r")))), lambda x: x["r"]).alias("days")
    )
    nested = per_run.groupBy("room_id", "wk").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("run_id", "days"))), lambda x: x["days"]).alias("history")
    )
    return H.flatten_history(nested)
