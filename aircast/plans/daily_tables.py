"""Queries over the day table: joins with weather, lag windows, calendar
columns, the feature matrix (K1) and per-day scalar rules (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import scalar as S
from ..operators import clean as C
from ..operators import windows as W
from ..operators.clean import temp_diff
from ..sources import fixtures as fx
from . import features as FE
from .readings import cleaned, daily_table
from .registry import cte, query, r6, with_

# ---------------------------------------------------------------- oracle CTEs
WCOLS = "outside_temp_max, outside_temp_min, precipitation, cloudcover, wind, solar_radiation"
cte(
    "joined",
    f"SELECT d.*, {', '.join('w.' + c for c in WCOLS.split(', '))}, d.temp_mean - w.outside_temp_max AS temp_diff "
    "FROM daily2 d JOIN weather w ON d.ds = w.ds",
    "daily2",
    "weather",
)
cte(
    "lagged",
    """SELECT *, lag(temp_mean, 1) OVER w AS tl1, lag(temp_mean, 2) OVER w AS tl2,
       lag(co2_mean, 1) OVER w AS cl1, lag(co2_mean, 2) OVER w AS cl2,
       co2_mean - lag(co2_mean, 1) OVER w AS co2_diff1
FROM joined WINDOW w AS (PARTITION BY room_id ORDER BY ds)""",
    "joined",
)
cte(
    "filled",
    """SELECT *, first_value(tl1 IGNORE NULLS) OVER f AS temp_lag1, first_value(tl2 IGNORE NULLS) OVER f AS temp_lag2,
       first_value(cl1 IGNORE NULLS) OVER f AS co2_lag1, first_value(cl2 IGNORE NULLS) OVER f AS co2_lag2
FROM lagged WINDOW f AS (PARTITION BY room_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "lagged",
)
cte(
    "years",
    "SELECT unnest(generate_series(year(min(ds)), year(max(ds)))) AS y FROM daily",
    "daily",
)
_EASTER = """
  SELECT y, make_date(CAST(y AS INT), CAST((h + l - 7 * m + 114) // 31 AS INT), CAST((h + l - 7 * m + 114) % 31 + 1 AS INT)) AS easter
  FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (
    SELECT *, (32 + 2 * e + 2 * (c // 4) - h - (c % 4)) % 7 AS l FROM (
      SELECT *, (19 * a + b - (b // 4) - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 AS h FROM (
        SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c, (y // 100) % 4 AS e FROM years))))"""
_FIXED = " UNION ALL ".join(
    f"SELECT make_date(CAST(y AS INT), {m}, {d}) AS ds, '{n.replace(chr(39), chr(39) * 2)}' AS holiday FROM years"
    for m, d, n in cal.FIXED_HOLIDAYS
)
_MOVABLE = " UNION ALL ".join(
    f"SELECT CAST(easter + {o} AS DATE) AS ds, '{n}' AS holiday FROM easter" for o, n in cal.EASTER_HOLIDAYS
)
cte("easter", _EASTER, "years")
cte("holidays", f"{_FIXED} UNION ALL {_MOVABLE}", "years", "easter")
_FEATS = """SELECT room_id, ds, co2_mean, temp_mean, hum_mean, presence_count, total_count, presence_ratio,
       outside_temp_max, outside_temp_min, precipitation, cloudcover, wind, solar_radiation, temp_diff,
       temp_lag1, temp_lag2, co2_lag1, co2_lag2, co2_diff1, coalesce(co2_diff1 > 100, false) AS rapid_rise,
       isodow(ds) - 1 >= 5 AS is_weekend, hd.hds IS NOT NULL AS is_holiday, isodow(ds) - 1 AS dayofweek,
       sin(2 * pi() * (isodow(ds) - 1) / 7.0) AS day_sin, cos(2 * pi() * (isodow(ds) - 1) / 7.0) AS day_cos
FROM filled LEFT JOIN (SELECT DISTINCT ds AS hds FROM holidays) hd ON filled.ds = hd.hds"""
cte("feats", f"SELECT * FROM ({_FEATS}) WHERE COLUMNS(*) IS NOT NULL", "filled", "holidays")

FEAT_OUT = ", ".join(
    [
        "room_id", "ds", r6("co2_mean", "co2_mean"), r6("temp_mean", "temp_mean"), r6("hum_mean", "hum_mean"),
        "presence_count", "total_count", r6("presence_ratio", "presence_ratio"),
        r6("outside_temp_max", "outside_temp_max"), r6("outside_temp_min", "outside_temp_min"),
        r6("precipitation", "precipitation"), "CAST(cloudcover AS BIGINT) AS cloudcover", r6("wind", "wind"),
        r6("solar_radiation", "solar_radiation"), r6("temp_diff", "temp_diff"), r6("temp_lag1", "temp_lag1"),
        r6("temp_lag2", "temp_lag2"), r6("co2_lag1", "co2_lag1"), r6("co2_lag2", "co2_lag2"),
        r6("co2_diff1", "co2_diff1"), "rapid_rise", "is_weekend", "is_holiday", "CAST(dayofweek AS BIGINT) AS dayofweek",
        r6("day_sin", "day_sin"), r6("day_cos", "day_cos"),
    ]
)


def weather_of(spark, sf):
    return fx.weather(spark, sf)


def feature_table(spark, sf, **kw):
    return FE.features(daily_table(spark, sf), weather_of(spark, sf), **kw)


def joined_table(spark, sf):
    return temp_diff(FE.join_weather(daily_table(spark, sf), weather_of(spark, sf)))


def half_even_sql(x: str, digits: int = 0) -> str:
    """Oracle twin of ``scalar.half_even``."""
    k = f"CAST({10 ** digits} AS DOUBLE)"
    x = f"CAST({x} AS DOUBLE)"
    r = f"({x} * {k})"
    f = f"floor({r})"
    odd = f"abs(CAST({f} AS BIGINT) % 2) = 1"
    if digits:
        high = f"(134217729.0::DOUBLE * {x} - (134217729.0::DOUBLE * {x} - {x}))"
        e = f"(({high} * {k} - {r}) + ({x} - {high}) * {k})"
        odd = f"({e} > 0 OR ({e} = 0 AND {odd}))"
    return f"(({f} + CASE WHEN {r} - {f} > 0.5 OR ({r} - {f} = 0.5 AND {odd}) THEN 1 ELSE 0 END) / {k})"


# --------------------------------------------------------------------- queries
@query(
    "join_weather",
    with_(
        "SELECT room_id, ds, {}, {}, {}, {}, {}, {}, CAST(cloudcover AS BIGINT) AS cloudcover, {}, {} FROM joined".format(
            r6("co2_mean", "co2_mean"), r6("temp_mean", "temp_mean"), r6("hum_mean", "hum_mean"),
            r6("presence_ratio", "presence_ratio"), r6("outside_temp_max", "outside_temp_max"),
            r6("outside_temp_min", "outside_temp_min"), r6("wind", "wind"), r6("solar_radiation", "solar_radiation"),
        ),
        "joined",
    ),
)
def join_weather(spark, sf):
    """Day table inner-joined with weather on ds (weather broadcast)."""
    return FE.join_weather(daily_table(spark, sf), weather_of(spark, sf)).select(
        "room_id", "ds", "co2_mean", "temp_mean", "hum_mean", "presence_ratio", "outside_temp_max",
        "outside_temp_min", "cloudcover", "wind", "solar_radiation",
    )


@query("temp_diff", with_(f"SELECT room_id, ds, {r6('temp_diff', 'temp_diff')} FROM joined", "joined"))
def temp_diff_q(spark, sf):
    """Indoor mean minus outdoor maximum per day."""
    return joined_table(spark, sf).select("room_id", "ds", "temp_diff")


@query(
    "lag_features",
    with_(
        f"SELECT room_id, ds, {r6('tl1', 'temp_lag1')}, {r6('tl2', 'temp_lag2')}, {r6('cl1', 'co2_lag1')}, {r6('cl2', 'co2_lag2')} FROM lagged",
        "lagged",
    ),
)
def lag_features(spark, sf):
    """E1 (no back-fill)"""
    return W.lag_features(joined_table(spark, sf)).select("room_id", "ds", *FE.LAG_COLS)


@query(
    "backfill",
    with_(
        "SELECT room_id, ds, {}, {}, {}, {} FROM filled".format(*[r6(c, c) for c in FE.LAG_COLS]),
        "filled",
    ),
)
def backfill(spark, sf):
    """Lag columns back-filled with the next non-null value of the series."""
    df = W.backfill(W.lag_features(joined_table(spark, sf)), cols=FE.LAG_COLS)
    return df.select("room_id", "ds", *FE.LAG_COLS)


@query("co2_diff", with_(f"SELECT room_id, ds, {r6('co2_diff1', 'co2_diff1')} FROM lagged", "lagged"))
def co2_diff(spark, sf):
    """Day-on-day change of mean CO2 per room."""
    return W.co2_diff(joined_table(spark, sf)).select("room_id", "ds", "co2_diff1")


@query(
    "rapid_rise",
    with_("SELECT room_id, ds, coalesce(co2_diff1 > 100, false) AS rapid_rise FROM lagged", "lagged"),
)
def rapid_rise(spark, sf):
    """The first day of a series is false, not NULL."""
    return W.rapid_rise(W.co2_diff(joined_table(spark, sf))).select("room_id", "ds", "rapid_rise")


@query(
    "calendar_flags",
    with_(
        """SELECT id, CAST(isodow(CAST(local_ts AS DATE)) - 1 AS BIGINT) AS dayofweek,
       isodow(CAST(local_ts AS DATE)) - 1 >= 5 AS is_weekend, CAST(hour(local_ts) AS BIGINT) AS hour FROM clean""",
        "clean",
    ),
)
def calendar_flags(spark, sf):
    """H1 on readings: local weekday (Mon=0), weekend flag, local hour."""
    df = cleaned(spark, sf).withColumn("day", F.to_date("local_ts"))
    return cal.calendar_flags(df, day="day", local_ts="local_ts").select("id", "dayofweek", "is_weekend", "hour")


@query(
    "day_cyclic",
    with_(
        "SELECT room_id, ds, {}, {} FROM daily".format(
            r6("sin(2 * pi() * (isodow(ds) - 1) / 7.0)", "day_sin"), r6("cos(2 * pi() * (isodow(ds) - 1) / 7.0)", "day_cos")
        ),
        "daily",
    ),
)
def day_cyclic(spark, sf):
    """H2: sin / cos of 2 pi weekday / 7 per day."""
    return cal.day_cyclic(cal.calendar_flags(daily_table(spark, sf))).select("room_id", "ds", "day_sin", "day_cos")


@query("holiday_dim", with_("SELECT ds, holiday FROM holidays", "holidays"))
def holiday_dim(spark, sf):
    """H3: holidays of every year the readings span."""
    return cal.holiday_dim(cal.years_of(daily_table(spark, sf)))


@query(
    "season_of",
    with_(
        "SELECT id, list_extract(['Winter', 'Spring', 'Summer', 'Autumn'], CAST(month(local_ts) % 12 // 3 + 1 AS INT)) AS season FROM clean",
        "clean",
    ),
)
def season_of(spark, sf):
    """H7: season name of every reading's local month."""
    return cleaned(spark, sf).select("id", cal.season_of(F.col("local_ts")).alias("season"))


@query("feature_matrix", with_(f"SELECT {FEAT_OUT} FROM feats", "feats"))
def feature_matrix(spark, sf):
    """K1: the day-level feature matrix per room (weather, lags, calendar, holidays), first day dropped."""
    return feature_table(spark, sf)


@query(
    "clip",
    with_(
        "SELECT room_id, ds, {} FROM joined".format(
            r6("CASE WHEN temp_mean + outside_temp_min + outside_temp_max IS NOT NULL "
               "THEN least(greatest(temp_mean, outside_temp_min + 15), outside_temp_max) END", "clipped")
        ),
        "joined",
    ),
)
def clip(spark, sf):
    """H4: bounds cross on some days (low > high): the upper bound wins."""
    df = joined_table(spark, sf)
    return df.select(
        "room_id", "ds", S.clip(F.col("temp_mean"), F.col("outside_temp_min") + 15, F.col("outside_temp_max")).alias("clipped")
    )


@query(
    "round_half_even",
    with_(
        "SELECT room_id, ds, CAST(round_even(co2_mean, 0) AS BIGINT) AS co2_r, {} FROM daily2".format(
            r6(half_even_sql("temp_mean", 1), "temp_r")
        ),
        "daily2",
    ),
)
def round_half_even(spark, sf):
    """H5: half-to-even rounding of day means (CO2 to 0, temperature to 1 decimal)."""
    df = daily_table(spark, sf)
    return df.select(
        "room_id", "ds", S.round_half_even(F.col("co2_mean")).cast("bigint").alias("co2_r"),
        S.round_half_even(F.col("temp_mean"), 1).alias("temp_r"),
    )


@query(
    "format_dates",
    with_(
        """SELECT id, strftime(local_ts, '%Y-%m-%d') AS day_text, strftime(local_ts, '%H:%M') AS clock,
       strftime(local_ts, '%B %d, %Y') AS long_day, strftime(local_ts, '%Y-%m-%dT%H:%M:%S')[:10] AS ds10
FROM clean""",
        "clean",
    ),
)
def format_dates(spark, sf):
    """H6: local times formatted as %Y-%m-%d, %H:%M, %B %d, %Y and ds[:10]."""
    df = cleaned(spark, sf)
    lt = F.col("local_ts")
    return df.select(
        "id", S.format_day(lt).alias("day_text"), S.format_clock(lt).alias("clock"),
        S.format_long_day(lt).alias("long_day"), F.substring(S.format_iso_seconds(lt), 1, 10).alias("ds10"),
    )


_ADVICE_SQL = """CASE WHEN {c} IS NULL OR {t} IS NULL THEN NULL
     WHEN concat_ws(' | ',
         CASE WHEN {c} > 1000 THEN '{v}' END,
         CASE WHEN {t} > 25 THEN '{w}' WHEN {t} < 18 THEN '{k}' END) = '' THEN '{f}'
     ELSE concat_ws(' | ', CASE WHEN {c} > 1000 THEN '{v}' END,
         CASE WHEN {t} > 25 THEN '{w}' WHEN {t} < 18 THEN '{k}' END) END"""


def advice_sql(c: str, t: str) -> str:
    return _ADVICE_SQL.format(
        c=c, t=t, v=S.ADVICE_VENTILATE, w=S.ADVICE_TOO_WARM, k=S.ADVICE_TOO_COLD, f=S.ADVICE_ALL_FINE
    )


@query(
    "advice",
    with_(
        f"SELECT room_id, ds, {advice_sql('co2_mean + 300', 'temp_mean + 4')} AS advies FROM daily2",
        "daily2",
    ),
)
def advice(spark, sf):
    """H9 on day means shifted into the advice range (+300 ppm, +4 C), so
    every branch occurs."""
    df = daily_table(spark, sf)
    return df.select("room_id", "ds", S.advice(F.col("co2_mean") + 300, F.col("temp_mean") + 4).alias("advies"))


def alert_sql(c: str) -> str:
    return "'" + S.ALERT_TEMPLATE.replace("%s", f"' || CAST({c} AS VARCHAR) || '") + "'"


@query(
    "alert_text",
    with_(
        f"SELECT id, room_id, ts, {alert_sql('co2')} AS alert FROM parsed WHERE co2 >= 900",
        "parsed",
    ),
)
def alert_text(spark, sf):
    """All readings at or over 900 ppm with their message (the raw ones: what the
    models leave out as an outlier, or has no readable time, is an alert all the same)."""
    df = C.parse_timestamp(fx.measurements(spark, sf)).where(F.col("co2") >= 900)
    return df.select("id", "room_id", "ts", S.alert_text(F.col("co2")).alias("alert"))


def warning_sql(c: str, t: str) -> str:
    co2 = S.WARN_CO2.replace("%s", "' || CAST(CAST(round_even({c}, 0) AS BIGINT) AS VARCHAR) || '").format(c=c)
    tmp = S.WARN_TEMP.replace("%s", "' || CAST(CAST(round_even({t}, 0) AS BIGINT) AS VARCHAR) || '").format(t=t)
    parts = f"concat_ws(' ', CASE WHEN {c} >= 1000 THEN '{co2}' END, CASE WHEN {t} >= 25 THEN '{tmp}' END)"
    return f"CASE WHEN {parts} <> '' THEN {parts} || '{S.WARN_TAIL}' END"


@query(
    "warning_text",
    with_(f"SELECT room_id, ds, {warning_sql('co2_mean + 300', 'temp_mean + 4')} AS warning FROM daily2", "daily2"),
)
def warning_text(spark, sf):
    """H11 on shifted day means (NULL when no limit is reached)."""
    df = daily_table(spark, sf)
    return df.select("room_id", "ds", S.warning_text(F.col("co2_mean") + 300, F.col("temp_mean") + 4).alias("warning"))


@query(
    "comfort_bands",
    with_(
        """SELECT room_id, ds, 18.0 AS temp_low, 25.0 AS temp_high, 1000.0 AS co2_limit,
       (temp_mean + 4) BETWEEN 18 AND 25 AS temp_in_band, (co2_mean + 300) <= 1000 AS co2_in_band FROM daily2""",
        "daily2",
    ),
)
def comfort_bands(spark, sf):
    """Comfort limits (18/25 C, 1000 ppm) beside shifted day means, with in-band flags."""
    df = daily_table(spark, sf)
    return df.select("room_id", "ds", *S.comfort_flags(F.col("temp_mean") + 4, F.col("co2_mean") + 300))


@query(
    "select_rename",
    with_(
        "SELECT ds, {}, {}, {}, {} FROM feats".format(
            r6("temp_mean", "y"), r6("outside_temp_max", "outside_temp_max"), r6("outside_temp_min", "outside_temp_min"),
            r6("temp_lag1", "temp_lag1"),
        ).replace("SELECT ds,", "SELECT room_id, ds,"),
        "feats",
    ),
)
def select_rename(spark, sf):
    """The model frame of one model: projection with rename (temp_mean -> y)."""
    return feature_table(spark, sf).select("room_id", "ds", F.col("temp_mean").alias("y"), "outside_temp_max", "outside_temp_min", "temp_lag1")
