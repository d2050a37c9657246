"""Queries over readings: scans (A1, A2), cleaning (B), day tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import daily as D
from ..sources import fixtures as fx
from ..sources import store
from .registry import LOCAL, query, r6, with_

AS_OF = "2024-01-30"
OFFICE_DAYS = ("2024-01-24", "2024-01-26")
MCOLS = "id, room_id, ts_raw, CAST(co2 AS BIGINT) AS co2, temperature, humidity, presence"


def cleaned(spark, sf):
    return C.clean(fx.measurements(spark, sf))


def daily_table(spark, sf):
    return D.presence_ratio(D.daily(cleaned(spark, sf)))


@query("scan_measurements", with_(f"SELECT {MCOLS} FROM measurements", "measurements"))
def scan_measurements(spark, sf):
    """A1: the store read with the fixed schema (never inferred)."""
    return store.conform(fx.measurements(spark, sf))


@query("scan_desc", with_(f"SELECT {MCOLS} FROM measurements ORDER BY ts_raw DESC, id DESC", "measurements"))
def scan_desc(spark, sf):
    """A2: whole table newest first, ordered on the text timestamp."""
    return store.scan_desc(fx.measurements(spark, sf))


@query("parse_timestamp", with_("SELECT id, ts_raw, ts FROM parsed", "parsed"))
def parse_timestamp(spark, sf):
    """B1: text timestamps parsed to instants (NULL when unparsable)."""
    return C.parse_timestamp(fx.measurements(spark, sf)).select("id", "ts_raw", "ts")


@query(
    "to_local_time",
    with_(f"SELECT id, ts, {LOCAL} AS local_ts FROM parsed WHERE ts IS NOT NULL", "parsed"),
)
def to_local_time(spark, sf):
    """B2: instants converted to Brussels wall time (DST-aware)."""
    df = C.drop_bad_timestamps(C.parse_timestamp(fx.measurements(spark, sf)))
    return C.to_local_time(df).select("id", "ts", "local_ts")


@query("drop_bad_timestamps", with_("SELECT id, room_id, ts FROM parsed WHERE ts IS NOT NULL", "parsed"))
def drop_bad_timestamps(spark, sf):
    """Readings whose timestamp parsed."""
    return C.drop_bad_timestamps(C.parse_timestamp(fx.measurements(spark, sf))).select("id", "room_id", "ts")


@query(
    "co2_outlier_filter",
    with_("SELECT id, CAST(co2 AS BIGINT) AS co2 FROM measurements WHERE (co2 > 5000) IS NOT TRUE", "measurements"),
)
def co2_outlier_filter(spark, sf):
    """Readings with co2 > 5000 dropped; NULL co2 kept."""
    return C.co2_outlier_filter(fx.measurements(spark, sf)).select("id", "co2")


@query(
    "presence_normalise",
    """SELECT event_id AS id,
       coalesce(try_cast(CASE event_type WHEN 'click' THEN 'true' WHEN 'purchase' THEN '1'
                              WHEN 'view' THEN 'false' WHEN 'error' THEN '0' ELSE 'maybe' END AS BOOLEAN), false)
         AS presence
FROM events""",
)
def presence_normalise(spark, sf):
    """Presence delivered as text (true/1/false/0/junk) -> boolean."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    txt = (
        F.when(F.col("event_type") == "click", "true")
        .when(F.col("event_type") == "purchase", "1")
        .when(F.col("event_type") == "view", "false")
        .when(F.col("event_type") == "error", "0")
        .otherwise("maybe")
    )
    df = ev.select(F.col("event_id").alias("id"), txt.alias("presence"))
    return C.presence_normalise(df)


@query(
    "quality_counts",
    with_(
        """SELECT room_id,
       CAST(count_if(ts IS NULL) AS BIGINT) AS bad_timestamps,
       CAST(count_if(ts IS NOT NULL AND coalesce(co2 > 5000, false)) AS BIGINT) AS outliers,
       CAST(count_if(ts IS NOT NULL AND NOT coalesce(co2 > 5000, false)) AS BIGINT) AS kept
FROM parsed GROUP BY room_id""",
        "parsed",
    ),
)
def quality_counts(spark, sf):
    """Bad timestamps, outliers and kept readings per room, one pass."""
    return C.quality_counts(fx.measurements(spark, sf))


_EXPECTED = ["id", "room_id", "ts_raw", "co2", "temperature", "humidity", "presence", "sleep_time_ratio"]


@query(
    "null_counts",
    with_(
        """SELECT column_name, CAST(n_null AS BIGINT) AS n_null, false AS missing FROM (
  SELECT count_if(id IS NULL) AS id, count_if(room_id IS NULL) AS room_id, count_if(ts_raw IS NULL) AS ts_raw,
         count_if(co2 IS NULL) AS co2, count_if(temperature IS NULL) AS temperature,
         count_if(humidity IS NULL) AS humidity, count_if(presence IS NULL) AS presence
  FROM measurements) UNPIVOT (n_null FOR column_name IN (id, room_id, ts_raw, co2, temperature, humidity, presence))
UNION ALL SELECT 'sleep_time_ratio', CAST(NULL AS BIGINT), true""",
        "measurements",
    ),
)
def null_counts(spark, sf):
    """NULLs per column and the missing-column check."""
    return C.null_counts(fx.measurements(spark, sf), expected=_EXPECTED)


@query(
    "drop_incomplete",
    with_(
        f"""SELECT {MCOLS} FROM measurements WHERE id IS NOT NULL AND room_id IS NOT NULL AND ts_raw IS NOT NULL
AND co2 IS NOT NULL AND temperature IS NOT NULL AND humidity IS NOT NULL AND presence IS NOT NULL""",
        "measurements",
    ),
)
def drop_incomplete(spark, sf):
    """Readings without a NULL in any column."""
    return C.drop_incomplete(fx.measurements(spark, sf))


@query(
    "last_n_days",
    with_(
        """SELECT c.id, c.room_id, c.ts FROM clean c
JOIN (SELECT room_id, max(ts) AS mx FROM clean GROUP BY room_id) m USING (room_id)
WHERE c.ts >= m.mx - INTERVAL 7 DAYS""",
        "clean",
    ),
)
def last_n_days(spark, sf):
    """Readings of the last 7 days of each room (event time)."""
    return C.last_n_days(cleaned(spark, sf)).select("id", "room_id", "ts")


_DAILY2 = (
    "room_id, ds, {co2}, {temp}, {hum}, presence_count, total_count, {ratio}".format(
        co2=r6("co2_mean", "co2_mean"),
        temp=r6("temp_mean", "temp_mean"),
        hum=r6("hum_mean", "hum_mean"),
        ratio=r6("presence_ratio", "presence_ratio"),
    )
)


@query("since_as_of", with_(f"SELECT {_DAILY2} FROM daily2 WHERE ds >= DATE '{AS_OF}' - 7", "daily2"))
def since_as_of(spark, sf):
    """Day rows of the 7 days up to as_of (an argument, not the clock)."""
    return C.since_as_of(daily_table(spark, sf), as_of=AS_OF)


@query(
    "local_today",
    with_(f"SELECT id, room_id, ts, local_ts FROM clean WHERE CAST(local_ts AS DATE) = DATE '{AS_OF}'", "clean"),
)
def local_today(spark, sf):
    """Readings of the local day as_of (UTC bounds, pushed to the scan)."""
    return C.local_today(cleaned(spark, sf), as_of=AS_OF).select("id", "room_id", "ts", "local_ts")


@query(
    "isin_split",
    with_(
        f"""SELECT id, room_id, CAST(local_ts AS DATE) AS day,
       CAST(local_ts AS DATE) IN (DATE '{OFFICE_DAYS[0]}', DATE '{OFFICE_DAYS[1]}') AS is_office
FROM clean""",
        "clean",
    ),
)
def isin_split(spark, sf):
    """Office-day flag of each reading's local day."""
    df = cleaned(spark, sf).withColumn("day", F.to_date("local_ts"))
    return C.isin_split(df, days=OFFICE_DAYS).select("id", "room_id", "day", "is_office")


@query(
    "ingest_round",
    with_("SELECT id, round(temperature, 2) AS temperature, round(humidity, 2) AS humidity FROM measurements", "measurements"),
)
def ingest_round(spark, sf):
    """Temperature and humidity rounded to 2 decimals."""
    return C.ingest_round(fx.measurements(spark, sf)).select("id", "temperature", "humidity")


_DAILY1 = "room_id, ds, {}, {}, {}, presence_count, total_count".format(
    r6("co2_mean", "co2_mean"), r6("temp_mean", "temp_mean"), r6("hum_mean", "hum_mean")
)


@query("daily_agg", with_(f"SELECT {_DAILY1} FROM daily", "daily"))
def daily_agg(spark, sf):
    """D1 (the minimum slice): measurements -> clean -> per room and UTC day."""
    return D.daily(cleaned(spark, sf))


@query("presence_ratio", with_(f"SELECT {_DAILY2} FROM daily2", "daily2"))
def presence_ratio(spark, sf):
    """Day table with presence_count = min(count + 8, 24) and presence_ratio."""
    return daily_table(spark, sf)
