"""Queries: the presence latch (C6) and the stream forms (J1-J6).  Stream
queries run their Structured Streaming plan with ``availableNow`` over the
events file and return the sink as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clean as C
from ..operators import joins as JN
from ..operators import order as O
from ..sources import fixtures as fx
from ..streaming import live as LV
from ..streaming import streams as ST
from . import history as H
from .daily_tables import alert_sql, warning_sql
from .readings import cleaned
from .registry import avg_exact_sql, cte, query, r6, with_
from .trend_tables import runs_table

cte(
    "first_on",
    """SELECT room_id, date_trunc('hour', ts - INTERVAL 2 MINUTE) AS blk, min(ts) AS first_on FROM pings
WHERE contains(line, 'ON') AND minute(ts) <> 2 GROUP BY room_id, date_trunc('hour', ts - INTERVAL 2 MINUTE)""",
    "pings",
)


@query(
    "presence_latch",
    with_(
        """SELECT c.id, c.room_id, c.ts, coalesce(c.ts >= f.first_on, false) AS presence_latched
FROM clean c LEFT JOIN first_on f ON f.room_id = c.room_id AND f.blk = date_trunc('hour', c.ts - INTERVAL 2 MINUTE)""",
        "clean",
        "first_on",
    ),
)
def presence_latch(spark, sf):
    """Presence of each reading from the radar latch (ON since the last reset at minute 2)."""
    r = cleaned(spark, sf).select("id", "room_id", "ts")
    return JN.presence_latch(r, fx.pings(spark, sf))


def stream_readings(spark, sf):
    return C.clean(fx.measurements_of(fx.events_stream(spark, sf)))


def stream_raw(spark, sf):
    """Readings as they come: nothing filtered."""
    return C.parse_timestamp(fx.measurements_of(fx.events_stream(spark, sf)))


@query("stream_new_readings", with_("SELECT id, room_id, ts, CAST(co2 AS BIGINT) AS co2 FROM parsed", "parsed"))
def stream_new_readings(spark, sf):
    """J1 (stream) on the raw feed == batch dedup."""
    s = ST.new_readings(stream_raw(spark, sf)).select("id", "room_id", "ts", "co2")
    return ST.run_available_now(s, "new_readings")


@query("stream_co2_alerts", with_(f"SELECT id, room_id, ts, {alert_sql('co2')} AS alert FROM parsed WHERE co2 >= 900", "parsed"))
def stream_co2_alerts(spark, sf):
    """A Structured Streaming alert for every new reading at or over 900 ppm."""
    return ST.run_available_now(ST.co2_alerts(stream_raw(spark, sf)), "co2_alerts")


def warn_rows(spark, sf):
    lp = O.latest_run_per_day(runs_table(spark, sf))
    return lp.withColumn("warning", S.warning_text(F.col("pred_co2") + 300, F.col("pred_temp") + 4))


@query(
    "stream_forecast_warnings",
    with_(
        f"""SELECT DISTINCT c.room_id, CAST(c.local_ts AS DATE) AS day, {warning_sql('l.pred_co2 + 300', 'l.pred_temp + 4')} AS warning
FROM clean c JOIN latest_per_day l ON l.room_id = c.room_id AND l.ds = CAST(c.local_ts AS DATE)
WHERE {warning_sql('l.pred_co2 + 300', 'l.pred_temp + 4')} IS NOT NULL""",
        "clean",
        "latest_per_day",
    ),
)
def stream_forecast_warnings(spark, sf):
    """Stream of readings joined to the static forecast table."""
    s = ST.forecast_warnings(stream_readings(spark, sf), warn_rows(spark, sf))
    return ST.run_available_now(s, "forecast_warnings")


@query(
    "stream_hourly",
    with_(
        f"""SELECT room_id, date_trunc('hour', ts) AS window_start, CAST(last(co2 ORDER BY ts, id) AS BIGINT) AS latest_co2,
       max_by(id, (ts, id)) AS latest_id, {r6('avg(co2)', 'co2_mean')}, count(*) AS n
FROM parsed WHERE ts IS NOT NULL AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM parsed) - INTERVAL 10 MINUTE
GROUP BY room_id, date_trunc('hour', ts)""",
        "parsed",
    ),
)
def stream_hourly(spark, sf):
    """J4 on the raw feed (append mode: the windows that the watermark has closed)."""
    return ST.run_available_now(ST.hourly(stream_raw(spark, sf)), "hourly")


@query(
    "stream_presence_latch",
    with_(
        """SELECT room_id, date_trunc('hour', ts - INTERVAL 2 MINUTE) + INTERVAL 2 MINUTE AS block_start, min(ts) AS first_on, count(*) AS n_on
FROM pings WHERE contains(line, 'ON') AND minute(ts) <> 2
  AND date_trunc('hour', ts - INTERVAL 2 MINUTE) + INTERVAL 62 MINUTE <=
      (SELECT max(ts) FROM pings WHERE contains(line, 'ON') AND minute(ts) <> 2) - INTERVAL 10 MINUTE
GROUP BY room_id, date_trunc('hour', ts - INTERVAL 2 MINUTE)""",
        "pings",
    ),
)
def stream_presence_latch(spark, sf):
    """First ON line per latch block, live (the blocks that the watermark has closed)."""
    p = fx.pings_of(fx.events_stream(spark, sf))
    return ST.run_available_now(ST.presence_blocks(p), "presence_blocks")


@query("stream_append_store", with_("SELECT id, room_id, ts_raw, CAST(co2 AS BIGINT) AS co2 FROM measurements", "measurements"))
def stream_append_store(spark, sf):
    """The feed appended to a parquet store by ``foreachBatch``."""
    m = fx.measurements_of(fx.events_stream(spark, sf)).select("id", "room_id", "ts_raw", "co2")
    base = ST.stream_dir(spark, "store")
    ST.append_store(m, f"{base}/store", f"{base}/_checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/store").select("id", "room_id", "ts_raw", "co2")


@query("stream_presence_latch_rows", with_(
    """SELECT c.id, c.room_id, c.ts, coalesce(c.ts >= f.first_on, false) AS presence_latched
FROM clean c LEFT JOIN first_on f ON f.room_id = c.room_id AND f.blk = date_trunc('hour', c.ts - INTERVAL 2 MINUTE)""",
    "clean", "first_on"))
def stream_presence_latch_rows(spark, sf):
    """J5 per reading (keyed state) == C6."""
    p = fx.pings_of(fx.events_stream(spark, sf))
    s = ST.presence_latch_rows(stream_readings(spark, sf), p)
    return ST.run_available_now(s, "presence_latch_rows")


cte(
    "alive",
    """SELECT i.id, CASE WHEN u.upd_seq > i.ins_seq THEN u.upd_presence ELSE i.presence END AS presence
FROM (SELECT id, max(seq) AS ins_seq, arg_max(presence, seq) AS presence FROM changes WHERE op = 'insert' GROUP BY id) i
LEFT JOIN (SELECT id, max(seq) AS del_seq FROM changes WHERE op = 'delete' GROUP BY id) d ON i.id = d.id
LEFT JOIN (SELECT id, max(seq) AS upd_seq, arg_max(presence, seq) AS upd_presence
           FROM changes WHERE op = 'set_presence' GROUP BY id) u ON i.id = u.id
WHERE d.del_seq IS NULL OR d.del_seq < i.ins_seq""",
    "changes",
)


@query(
    "stream_daily",
    with_(
        f"""SELECT c.room_id, CAST(c.ts AS DATE) AS ds, {r6('avg(c.co2)', 'co2_mean')}, {r6(avg_exact_sql('c.temperature'), 'temp_mean')},
       {r6(avg_exact_sql('c.humidity'), 'hum_mean')}, CAST(sum(CAST(a.presence AS INT)) AS BIGINT) AS presence_count, count(c.co2) AS total_count
FROM clean c JOIN alive a ON a.id = c.id GROUP BY c.room_id, CAST(c.ts AS DATE)""",
        "clean",
        "alive",
    ),
)
def stream_daily(spark, sf):
    """D1 kept up to date from the change feed (inserts, deletes, presence updates) batch by batch."""
    base = ST.stream_dir(spark, "daily")
    feed = C.parse_timestamp(fx.change_feed_of(fx.events_stream(spark, sf)))
    LV.keep_daily(feed, f"{base}/kept", f"{base}/_checkpoint").awaitTermination()
    return LV.kept_daily(spark, f"{base}/kept")


@query(
    "stream_presence_join",
    with_(
        """SELECT c.id, c.room_id, c.ts, coalesce(c.ts >= f.first_on, false) AS presence_latched
FROM clean c LEFT JOIN first_on f ON f.room_id = c.room_id AND f.blk = date_trunc('hour', c.ts - INTERVAL 2 MINUTE)
WHERE date_trunc('hour', c.ts - INTERVAL 2 MINUTE) + INTERVAL 62 MINUTE <=
      least((SELECT max(ts) FROM clean), (SELECT max(ts) FROM pings WHERE contains(line, 'ON') AND minute(ts) <> 2)) - INTERVAL 10 MINUTE""",
        "clean",
        "first_on",
    ),
)
def stream_presence_join(spark, sf):
    """C6 as a join of two streams: the readings of all latch blocks that the watermark has closed."""
    events = fx.events_stream(spark, sf)
    s = LV.presence_join(stream_readings(spark, sf).select("id", "room_id", "ts"), fx.pings_of(events))
    got = ST.run_available_now(s, "presence_join")
    # a reading with an ON line comes out at once, one without when its block is closed: only closed blocks are whole
    return closed_blocks(spark, sf, got)


def closed_blocks(spark, sf, rows, delay="10 minutes"):
    on = fx.pings(spark, sf).where(F.col("line").contains("ON") & (F.minute("ts") != 2)).agg(F.max("ts").alias("ts"))
    seen = cleaned(spark, sf).agg(F.max("ts").alias("ts")).union(on).agg((F.min("ts") - F.expr(f"INTERVAL {delay}")).alias("mark"))
    return rows.where(JN.reset_block(F.col("ts"), 2) + F.expr("INTERVAL 62 MINUTES") <= seen.select("mark").scalar())


@query(
    "stream_live_warnings",
    with_(
        f"""SELECT DISTINCT c.room_id, CAST(c.local_ts AS DATE) AS day, l.run_id, {warning_sql('l.pred_co2', 'l.pred_temp')} AS warning
FROM clean c JOIN latest_per_day l ON l.room_id = c.room_id AND l.ds = CAST(c.local_ts AS DATE)
WHERE {warning_sql('l.pred_co2', 'l.pred_temp')} IS NOT NULL""",
        "clean",
        "latest_per_day",
    ),
)
def stream_live_warnings(spark, sf):
    """J3 against the run history as it is read anew in every micro-batch."""
    base = ST.stream_dir(spark, "live-warnings")
    H.history_append(runs_table(spark, sf), f"{base}/history", "weekly")
    LV.live_warnings(stream_readings(spark, sf), f"{base}/history", f"{base}/out", f"{base}/_checkpoint").awaitTermination()
    return spark.read.schema("room_id bigint, day date, run_id date, warning string").parquet(f"{base}/out/batch_id=*")
