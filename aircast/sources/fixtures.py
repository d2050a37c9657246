"""Projections of the driver's parquet tables onto the sensor schemas.

Each projection exists twice: as a Spark plan (column-pruned parquet scan)
and as SQL text that the DuckDB oracle inlines as a CTE.  Both are
deterministic: no random, no clock.  ``room_id`` is the series key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The prompt templates that cover every router branch and both
# date resolvers (n, prompt).
PROMPT_TEMPLATES = [
    (0, "play some jazz"),
    (1, "please pause the song"),
    (2, "continue"),
    (3, "skip this one"),
    (4, "stop music"),
    (5, "turn the light on"),
    (6, "switch off the light"),
    (7, "measure the air now"),
    (8, "run the forecast"),
    (9, "weather tomorrow?"),
    (10, "what is the weather day after tomorrow"),
    (11, "weather next week"),
    (12, "weather on may 25 2025"),
    (13, "weather 25 may"),
    (14, "weather on 05/25/2025"),
    (15, "weather on 13/25/2025"),
    (16, "forecast for tomorrow"),
    (17, "forecast on jan 31st"),
    (18, "give me the forecast"),
    (19, "how is the CO2 in my room?"),
    (20, "is this fair?"),
    (21, "tell me a joke"),
    (22, "weather last week"),
    (23, "weather february 30 2024"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Days that the weather table covers.
WEATHER_DAYS = 40

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events_stream(spark: SparkSession, sf_dir: str, *, max_files: int | None = None, glob: str = "events.parquet") -> DataFrame:
    """The events table as a file stream (the landing folder of the feed)."""
    r = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored readings: bad timestamps and outliers are injected on purpose."""
    return measurements_of(_read(spark, sf_dir, "events"))


def measurements_of(ev: DataFrame) -> DataFrame:
    """The measurement projection of an events frame (batch or stream)."""
    eid = F.col("event_id")
    k = F.expr("CAST(substr(props, 7, length(props) - 7) AS INT)")
    return ev.select(
        eid.alias("id"),
        F.col("user_id").alias("room_id"),
        F.when(eid % 500 == 499, F.lit("not-a-time"))
        .otherwise(F.col("ts").cast("string"))
        .alias("ts_raw"),
        F.when(eid % 1000 == 7, F.lit(9999))
        .when(eid % 400 == 11, F.lit(None).cast("int"))
        .otherwise(F.lit(400) + F.floor(F.col("value") * 10).cast("int"))
        .alias("co2"),
        ((F.lit(1500) + F.lit(13) * k).cast("double") / 100).alias("temperature"),
        ((F.lit(3000) + (eid * 37) % 3000).cast("double") / 100).alias("humidity"),
        F.col("event_type").isin("click", "purchase").alias("presence"),
    )


#: What becomes of the varied rooms' time (room_id modulo 6 -> days that their month is squeezed to, days that it is put off).
VARIED = {0: (6, 0), 1: (7, 0), 2: (13, 0), 3: (20, 0), 4: (30, 35), 5: (30, 65)}
VARIED_WEATHER_DAYS = 110
_FIRST_US = 1_704_067_200_000_000  # 2024-01-01


def varied_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of all rooms with their time squeezed or put off by room, and the stamps of every 50th one written with an offset."""
    ev = _read(spark, sf_dir, "events")
    room = F.pmod("user_id", F.lit(len(VARIED)))
    moved = F.lit(None).cast("bigint")
    for k, (days, off) in VARIED.items():
        squeezed = F.expr(f"(unix_micros(CAST(ts AS TIMESTAMP)) - {_FIRST_US}) * {days} DIV 30")
        moved = F.when(room == k, squeezed + off * 86_400_000_000).otherwise(moved)
    return _with_offsets(measurements_of(ev.withColumn("ts", F.timestamp_micros(moved + _FIRST_US).cast("timestamp_ntz"))))


def _with_offsets(m: DataFrame) -> DataFrame:
    ts = F.try_to_timestamp("ts_raw").cast("timestamp_ntz")
    later = F.concat(F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))
    return m.withColumn("ts_raw", F.when((F.col("id") % 50 == 17) & ts.isNotNull(), later).otherwise(F.col("ts_raw")))


def weather(spark: SparkSession, sf_dir: str, days: int = WEATHER_DAYS) -> DataFrame:
    """Daily weather from 2024-01-01 (30 observed days, 10 ahead), summed from all
    orders: each order reports for one of the days."""
    o = _read(spark, sf_dir, "orders")
    day = F.pmod(F.col("o_orderkey"), F.lit(days)).cast("int")
    q = o.groupBy(day.alias("day")).agg(F.sum(F.floor("o_totalprice").cast("bigint")).alias("p"))
    p = F.col("p")
    return q.select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("ds"),
        ((p % 250).cast("double") / 10).alias("outside_temp_max"),
        ((p % 250).cast("double") / 10 - (p % 70).cast("double") / 10).alias("outside_temp_min"),
        ((p % 90).cast("double") / 10).alias("precipitation"),
        (p % 101).cast("int").alias("cloudcover"),
        ((p % 400).cast("double") / 10).alias("wind"),
        ((p % 3000).cast("double") / 100).alias("solar_radiation"),
    )


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence-radar lines; ``ts`` is the instant (TIMESTAMP, UTC)."""
    return pings_of(_read(spark, sf_dir, "events"))


def pings_of(ev: DataFrame) -> DataFrame:
    ev = ev.where(F.col("event_type").isin("view", "error", "signup"))
    return ev.select(
        F.col("event_id").alias("ping_id"),
        F.col("user_id").alias("room_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "view", F.lit(" ON "))
        .when(F.col("event_type") == "error", F.lit("OFF"))
        .otherwise(F.lit(""))
        .alias("line"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """insert / delete / set_presence feed (has an update after a delete and
    a delete of an id that was never inserted)."""
    ev = _read(spark, sf_dir, "events")
    e = F.col("event_id")
    return ev.select(
        e.alias("seq"),
        F.when((e % 10).isin(3, 5), F.lit("delete"))
        .when(e % 10 == 6, F.lit("set_presence"))
        .otherwise(F.lit("insert"))
        .alias("op"),
        F.when(e % 10 == 3, e - 3)
        .when(e % 10 == 5, e - 2)
        .when(e % 20 == 6, e - 4)
        .when(e % 20 == 16, e - 6)
        .otherwise(e)
        .alias("id"),
        F.col("event_type").isin("click", "purchase").alias("presence"),
        F.when((e % 10).isin(3, 5, 6), F.lit(None).cast("int"))
        .otherwise(F.lit(400) + F.floor(F.col("value") * 10).cast("int"))
        .alias("co2"),
    )


def change_feed_of(ev: DataFrame) -> DataFrame:
    """The ``changes`` feed (batch or stream) with the whole reading in each insert; ``ts_raw`` is not parsed."""
    e = F.col("id")
    m = measurements_of(ev)
    insert = ~(e % 10).isin(3, 5, 6)
    target = F.when(e % 10 == 3, e - 3).when(e % 10 == 5, e - 2).when(e % 20 == 6, e - 4).when(e % 20 == 16, e - 6).otherwise(e)
    op = F.when((e % 10).isin(3, 5), F.lit("delete")).when(e % 10 == 6, F.lit("set_presence")).otherwise(F.lit("insert"))
    own = [F.when(insert, F.col(c)).alias(c) for c in ("room_id", "ts_raw", "co2", "temperature", "humidity")]
    return m.select(e.alias("seq"), op.alias("op"), target.alias("id"), *own, "presence")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all user turns of ``conversations``, and beside each one a prompt
    from the templates; the asking room is the conversation."""
    c = _read(spark, sf_dir, "conversations").where(F.col("role") == "user")
    t = spark.createDataFrame(PROMPT_TEMPLATES, "n int, prompt string")
    own = (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id")
    texts = c.select((own + 500).alias("prompt_id"), F.col("conv_id").alias("room_id"), F.col("text").alias("prompt"))
    c = c.select(own, F.col("conv_id").alias("room_id"), ((F.col("conv_id") * 7 + F.col("turn") * 3) % 24).cast("int").alias("n"))
    # the template table has 24 rows: a fixed, proven size
    return c.join(F.broadcast(t), "n").select("prompt_id", "room_id", "prompt").unionByName(texts)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


# ---------------------------------------------------------------------------
# The same projections as SQL text for the DuckDB oracle.

_PROMPT_VALUES = ",\n  ".join("(%d, '%s')" % (n, p) for n, p in PROMPT_TEMPLATES)

FIXTURE_SQL = {
    "measurements": """
SELECT event_id AS id,
       user_id AS room_id,
       CASE WHEN event_id % 500 = 499 THEN 'not-a-time' ELSE CAST(ts AS VARCHAR(40)) END AS ts_raw,
       CASE WHEN event_id % 1000 = 7 THEN 9999
            WHEN event_id % 400 = 11 THEN NULL
            ELSE 400 + CAST(floor(value * 10) AS INT) END AS co2,
       CAST(1500 + 13 * CAST(substr(props, 7, length(props) - 7) AS INT) AS DOUBLE) / 100 AS temperature,
       CAST(3000 + (event_id * 37) % 3000 AS DOUBLE) / 100 AS humidity,
       event_type IN ('click', 'purchase') AS presence
FROM events""",
    "weather": """
SELECT DATE '2024-01-01' + CAST(d AS INT) AS ds,
       CAST(p % 250 AS DOUBLE) / 10 AS outside_temp_max,
       CAST(p % 250 AS DOUBLE) / 10 - CAST(p % 70 AS DOUBLE) / 10 AS outside_temp_min,
       CAST(p % 90 AS DOUBLE) / 10 AS precipitation,
       CAST(p % 101 AS INT) AS cloudcover,
       CAST(p % 400 AS DOUBLE) / 10 AS wind,
       CAST(p % 3000 AS DOUBLE) / 100 AS solar_radiation
FROM (SELECT o_orderkey % 40 AS d, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS p FROM orders GROUP BY o_orderkey % 40) q""",
    "pings": """
SELECT event_id AS ping_id, user_id AS room_id, ts,
       CASE event_type WHEN 'view' THEN ' ON ' WHEN 'error' THEN 'OFF' ELSE '' END AS line
FROM events WHERE event_type IN ('view', 'error', 'signup')""",
    "changes": """
SELECT event_id AS seq,
       CASE WHEN event_id % 10 IN (3, 5) THEN 'delete'
            WHEN event_id % 10 = 6 THEN 'set_presence' ELSE 'insert' END AS op,
       CASE WHEN event_id % 10 = 3 THEN event_id - 3
            WHEN event_id % 10 = 5 THEN event_id - 2
            WHEN event_id % 20 = 6 THEN event_id - 4
            WHEN event_id % 20 = 16 THEN event_id - 6
            ELSE event_id END AS id,
       event_type IN ('click', 'purchase') AS presence,
       CASE WHEN event_id % 10 IN (3, 5, 6) THEN NULL ELSE 400 + CAST(floor(value * 10) AS INT) END AS co2
FROM events""",
    "prompts": """
SELECT c.conv_id * 1000 + c.turn AS prompt_id, c.conv_id AS room_id, t.prompt
FROM conversations c
JOIN (VALUES
  %s
) AS t(n, prompt) ON (c.conv_id * 7 + c.turn * 3) %% 24 = t.n
WHERE c.role = 'user'
UNION ALL
SELECT conv_id * 1000 + turn + 500, conv_id, text FROM conversations WHERE role = 'user'"""
    % _PROMPT_VALUES,
    "turns": "SELECT conv_id, turn, role, text FROM conversations",
}


_MOVED = "CASE user_id % 6 " + " ".join(
    f"WHEN {k} THEN make_timestamp({_FIRST_US} + (epoch_us(ts) - {_FIRST_US}) * {days} // 30 + {off * 86_400_000_000})" for k, (days, off) in VARIED.items()
) + " END"
_VARIED_MEASUREMENTS = f"""
SELECT id, room_id, CASE WHEN id % 50 = 17 AND try_cast(ts_raw AS TIMESTAMP) IS NOT NULL
                         THEN strftime(CAST(ts_raw AS TIMESTAMP) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') || '+02:00' ELSE ts_raw END AS ts_raw,
       co2, temperature, humidity, presence
FROM ({FIXTURE_SQL["measurements"].replace("FROM events", f"FROM (SELECT * REPLACE ({_MOVED} AS ts) FROM events) e")}) m"""


def varied_sql(sql: str) -> str:
    """An oracle's text with the varied rooms' readings and the longer weather, and stamps with an offset read as such."""
    sql = sql.replace(FIXTURE_SQL["measurements"].strip(), _VARIED_MEASUREMENTS.strip()).replace(FIXTURE_SQL["measurements"], _VARIED_MEASUREMENTS)
    sql = sql.replace("o_orderkey % 40", f"o_orderkey % {VARIED_WEATHER_DAYS}")
    stamp = "try_cast(regexp_replace(ts_raw, '[+-][0-9]{2}:[0-9]{2}$', '') AS TIMESTAMP)"
    return sql.replace("try_cast(ts_raw AS TIMESTAMP) AS ts", f"CASE WHEN ts_raw LIKE '%+02:00' THEN {stamp} - INTERVAL 2 HOUR ELSE try_cast(ts_raw AS TIMESTAMP) END AS ts")
