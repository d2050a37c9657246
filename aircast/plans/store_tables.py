"""Queries: the store verbs (A3-A8) and weather sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..sources import store
from ..sources import weather as WX
from .daily_tables import weather_of
from .readings import MCOLS, daily_table
from .registry import query, r6, with_

WOUT = ", ".join(
    ["ds", r6("outside_temp_max", "outside_temp_max"), r6("outside_temp_min", "outside_temp_min"),
     r6("precipitation", "precipitation"), "CAST(cloudcover AS BIGINT) AS cloudcover", r6("wind", "wind"),
     r6("solar_radiation", "solar_radiation")]
)


@query(
    "append_with_id",
    with_(
        f"""SELECT {MCOLS} FROM measurements
UNION ALL
SELECT (SELECT max(id) FROM measurements) + row_number() OVER (ORDER BY ts_raw, id) AS id, room_id, ts_raw,
       CAST(co2 AS BIGINT), temperature, humidity, presence
FROM measurements""",
        "measurements",
    ),
)
def append_with_id(spark, sf):
    """A3: the feed posted again as a new batch; ids continue from max(id)
    in ingest (text timestamp, id) order."""
    m = fx.measurements(spark, sf)
    return store.append_with_id(m, m)


@query(
    "add_column_default",
    with_(
        f"""SELECT id, room_id, ts_raw, CAST(co2 AS BIGINT) AS co2, temperature, humidity, false AS presence FROM measurements
UNION ALL SELECT {MCOLS} FROM measurements""",
        "measurements",
    ),
)
def add_column_default(spark, sf):
    """A4: rows of the schema before ``presence`` existed plus current rows."""
    m = fx.measurements(spark, sf)
    return store.conform(store.add_column_default(m.drop("presence"), m))


_PAYLOAD_BAD = 997


def payloads(spark, sf):
    m = fx.measurements(spark, sf)
    body = F.to_json(
        F.struct(F.col("ts_raw").alias("timestamp"), "co2", "temperature", "humidity", "presence")
    )
    # a truncated body on a fixed stride of ids: malformed JSON in the feed
    body = F.when(F.col("id") % _PAYLOAD_BAD == 5, F.lit('{"timestamp": "2024-01-0')).otherwise(body)
    return m.select("id", "room_id", body.alias("payload"))


@query(
    "validate_payload",
    with_(
        f"""SELECT id, room_id,
       CASE WHEN id % {_PAYLOAD_BAD} = 5 OR co2 IS NULL THEN 'quarantine' ELSE 'ok' END AS status,
       CASE WHEN id % {_PAYLOAD_BAD} = 5 THEN 'malformed' WHEN co2 IS NULL THEN 'missing co2' END AS reason
FROM measurements""",
        "measurements",
    ),
)
def validate_payload(spark, sf):
    """A5: JSON payloads checked against the typed model; rejects are kept
    with a reason (quarantine), not dropped."""
    return store.validate_payload(payloads(spark, sf)).select("id", "room_id", "status", "reason")


@query(
    "delete_by_id",
    with_(
        f"SELECT {MCOLS} FROM measurements m WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.op = 'delete' AND c.id = m.id)",
        "measurements",
        "changes",
    ),
)
def delete_by_id(spark, sf):
    """The store without the ids deleted by the change feed (left anti join)."""
    ch = fx.changes(spark, sf).where(F.col("op") == "delete")
    return store.conform(store.delete_by_id(fx.measurements(spark, sf), ch))


@query(
    "update_presence",
    with_(
        """SELECT m.id, m.room_id, m.ts_raw, CAST(m.co2 AS BIGINT) AS co2, m.temperature, m.humidity,
       coalesce(u.p, m.presence) AS presence
FROM measurements m LEFT JOIN (
  SELECT id, arg_max(presence, seq) AS p FROM changes WHERE op = 'set_presence' GROUP BY id) u ON m.id = u.id""",
        "measurements",
        "changes",
    ),
)
def update_presence(spark, sf):
    """The store with presence set by the latest update of each id."""
    ch = fx.changes(spark, sf).where(F.col("op") == "set_presence")
    return store.conform(store.update_presence(fx.measurements(spark, sf), ch))


@query(
    "apply_changes",
    with_(
        """SELECT i.id, CASE WHEN u.upd_seq > i.ins_seq THEN u.upd_presence ELSE i.presence END AS presence,
       CAST(i.co2 AS BIGINT) AS co2
FROM (SELECT id, max(seq) AS ins_seq, arg_max(presence, seq) AS presence, arg_max(co2, seq) AS co2
      FROM changes WHERE op = 'insert' GROUP BY id) i
LEFT JOIN (SELECT id, max(seq) AS del_seq FROM changes WHERE op = 'delete' GROUP BY id) d ON i.id = d.id
LEFT JOIN (SELECT id, max(seq) AS upd_seq, arg_max(presence, seq) AS upd_presence
           FROM changes WHERE op = 'set_presence' GROUP BY id) u ON i.id = u.id
WHERE d.del_seq IS NULL OR d.del_seq < i.ins_seq""",
        "changes",
    ),
)
def apply_changes(spark, sf):
    """The change feed folded into the current store."""
    return store.apply_changes(fx.changes(spark, sf))


@query("weather_explode", with_(f"SELECT {WOUT} FROM weather", "weather"))
def weather_explode(spark, sf):
    """Weather responses (JSON, struct of parallel arrays, one per
    7-day request) back to rows."""
    return WX.weather_explode(WX.weather_responses(weather_of(spark, sf)))


@query(
    "weather_range",
    with_(
        f"SELECT {WOUT} FROM weather WHERE ds BETWEEN (SELECT min(ds) FROM daily) AND (SELECT max(ds) FROM daily)",
        "weather",
        "daily",
    ),
)
def weather_range(spark, sf):
    """A10: weather for the sensor table's day range."""
    return WX.weather_range(weather_of(spark, sf), daily_table(spark, sf))


@query(
    "ingest_stream",
    with_(
        f"""SELECT row_number() OVER (ORDER BY ts_raw, id) AS id, room_id, ts_raw, CAST(co2 AS BIGINT) AS co2, temperature, humidity, presence
FROM measurements WHERE id % {_PAYLOAD_BAD} <> 5 AND co2 IS NOT NULL""",
        "measurements",
    ),
)
def ingest_stream(spark, sf):
    """A5 + A3 + J6: the payload feed as a stream into the store: validated, numbered in ingest order, rejects in quarantine."""
    from ..streaming import streams as ST

    base = ST.stream_dir(spark, "ingest")
    payloads(spark, sf).withColumnRenamed("id", "seq").write.json(f"{base}/landing")
    feed = spark.readStream.schema("seq bigint, room_id bigint, payload string").json(f"{base}/landing")
    ST.ingest(feed, f"{base}/store", f"{base}/quarantine", f"{base}/_checkpoint").awaitTermination()
    return spark.read.schema(STORED).parquet(f"{base}/store").select("id", "room_id", "ts_raw", "co2", "temperature", "humidity", "presence")


STORED = "id bigint, room_id bigint, ts_raw string, co2 int, temperature double, humidity double, presence boolean, batch_id bigint"
#: The days of ``read_days``.
STORE_DAYS = ("2024-01-29", "2024-01-31")


@query(
    "read_days",
    with_(
        f"SELECT {MCOLS} FROM parsed WHERE CAST(ts AS DATE) BETWEEN DATE '{STORE_DAYS[0]}' AND DATE '{STORE_DAYS[1]}'",
        "parsed",
    ),
)
def read_days(spark, sf):
    """A1 on the partitioned store: written by day, read by partition (only those folders are listed)."""
    from ..streaming import streams as ST

    path = ST.stream_dir(spark, "store") + "/days"
    store.write_store(fx.measurements(spark, sf), path)
    return store.read_days(spark, path, *STORE_DAYS).drop("date")


@query("read_store", with_(f"SELECT {MCOLS} FROM measurements WHERE id % {_PAYLOAD_BAD} <> 5 AND co2 IS NOT NULL", "measurements"))
def read_store(spark, sf):
    """A1: records written as JSON lines and read back with the fixed schema."""
    from ..streaming import streams as ST

    path = ST.stream_dir(spark, "json") + "/records"
    m = fx.measurements(spark, sf).where((F.col("id") % _PAYLOAD_BAD != 5) & F.col("co2").isNotNull())
    store.conform(m).write.json(path)
    return store.read_store(spark, path, fmt="json", multiline=False)
