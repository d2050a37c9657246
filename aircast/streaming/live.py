"""Streams whose other side changes while they run.

``live_warnings`` (J3) reads the newest forecast runs in every micro-batch, ``fold_changes`` (J6
with A6 and A7) keeps the day table (D1) up to date from batches of changes without
rescanning the readings, and ``presence_join`` (C6, J5) is the latch as a join of two streams.

What a batch writes stands in a folder of its batch id, and what it reads is that of earlier
batches, so a batch that is replayed after a failure writes the same again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS
from ..functions import scalar as S
from ..operators import order as O
from ..operators.daily import day_of
from ..session import materialize
from .streams import presence_blocks


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that earlier batches may not have begun yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# ------------------------------------------------------------------ J3
def warn_batch(batch: DataFrame, batch_id: int, history_path: str, out_path: str, *, keys: Sequence[str] = DEFAULT_KEYS,
               co2: float = 1000.0, temp: float = 25.0) -> None:
    """Warnings of the (series, local day) pairs of one micro-batch of readings, by the forecast runs that
    are there now.  A pair is warned of again only when the newest run changes its warning."""
    spark, keys = batch.sparkSession, list(keys)
    kind = dict(batch.dtypes)
    own = ", ".join(f"`{k}` {kind[k]}" for k in keys)
    days = materialize(batch.where(F.col("local_ts").isNotNull()).select(*keys, F.to_date("local_ts").alias("day")).distinct())
    runs = read_or_empty(spark, history_path, f"{own}, ds date, pred_co2 double, pred_temp double, run_id date")
    newest = O.latest_run_per_day(runs, keys=keys).withColumnRenamed("ds", "day")
    newest = newest.select(*keys, "day", "run_id", S.warning_text(F.col("pred_co2"), F.col("pred_temp"), co2=co2, temp=temp).alias("warning"))
    now = days.join(newest, [*keys, "day"])
    said = read_or_empty(spark, out_path, f"{own}, day date, run_id date, warning string, batch_id bigint").where(F.col("batch_id") < batch_id)
    bounds = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    said = said.where(F.col("day").between(bounds.select("lo").scalar(), bounds.select("hi").scalar()))
    last = said.groupBy(*keys, "day").agg(F.max_by("warning", "batch_id").alias("_said"))
    news = now.join(last, [*keys, "day"], "left").where(~F.col("warning").eqNullSafe(F.col("_said"))).drop("_said")
    # a warning that no longer holds is taken back by a NULL
    news.select(*keys, "day", "run_id", "warning").write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")


def live_warnings(readings: DataFrame, history_path: str, out_path: str, checkpoint: str, **how):
    """J3 with a forecast that changes: ``warn_batch`` on every micro-batch of readings (with local_ts)."""
    return (
        readings.writeStream.foreachBatch(lambda b, i: warn_batch(b, i, history_path, out_path, **how))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# ------------------------------------------------------- D1 kept up to date
#: Ids of a state folder: a batch of changes reads only the folders of the ids it names.
BLOCK = 100_000
_ROW = "ts: timestamp, co2: int, temperature: double, humidity: double, presence: boolean"
_SUMS = "n_rows bigint, n_co2 bigint, s_co2 bigint, n_temp bigint, s_temp decimal(38,10), n_hum bigint, s_hum decimal(38,10), s_presence bigint"


def _later(a: Column, b: Column) -> Column:
    """The one of two structs (seq, ...) with the later seq; a missing one loses."""
    return F.when(b.isNull() | (a["seq"] > b["seq"]), a).otherwise(b)


def _alive(state: str) -> Column:
    ins, gone = F.col(f"{state}.ins"), F.col(f"{state}.del_seq")
    return ins.isNotNull() & (gone.isNull() | (gone < ins["seq"]))


def _reading(state: str, keys: Sequence[str]) -> list[Column]:
    ins, upd = F.col(f"{state}.ins"), F.col(f"{state}.upd")
    presence = F.when(upd["seq"] > ins["seq"], upd["presence"]).otherwise(ins["presence"])
    return [*[ins[c].alias(c) for c in (*keys, "ts", "co2", "temperature", "humidity")], presence.alias("presence")]


def fold_changes(changes: DataFrame, batch_id: int, base: str, *, keys: Sequence[str] = DEFAULT_KEYS, day_zone: str = "UTC",
                 co2_max: int = 5000) -> None:
    """Fold one batch of the change feed (seq, op insert / delete / set_presence, id, keys, ts, co2, temperature,
    humidity, presence) into the kept day table.

    Per id the state is the last insert, the last delete and the last update by seq, so batches may come in any order
    (A8's rules).  A batch looks up the old states of its own ids, and writes their new states and, per (series, day), what the day's
    sums change by: minus what the old state gave, plus what the new one gives."""
    spark, keys = changes.sparkSession, list(keys)
    kind = dict(changes.dtypes)
    own = "".join(f"`{k}` {kind[k]}, " for k in keys)
    state = f"struct<ins: struct<seq: bigint, {', '.join(f'`{k}`: {kind[k]}' for k in keys)}{', ' if keys else ''}{_ROW}>, del_seq: bigint, upd: struct<seq: bigint, presence: boolean>>"
    c = changes.withColumn("seq", F.col("seq").cast("bigint"))

    def last(op: str, *cols: str) -> Column:
        row = F.struct(F.col("seq").alias("seq"), *[F.col(x) for x in cols])
        return F.max_by(F.when(F.col("op") == op, row), F.when(F.col("op") == op, F.col("seq")))

    new = c.groupBy("id").agg(
        last("insert", *keys, "ts", "co2", "temperature", "humidity", "presence").alias("ins"),
        F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("del_seq"),
        last("set_presence", "presence").alias("upd"),
    )
    new = materialize(new.select("id", F.floor(F.col("id") / BLOCK).alias("block"), F.struct("ins", "del_seq", "upd").cast(state).alias("new")))
    kept = read_or_empty(spark, f"{base}/states", f"id bigint, state {state}, batch_id bigint, block bigint").where(F.col("batch_id") < batch_id)
    # the blocks of a batch prune the folders; at most as many as the batch has ids
    old = kept.join(F.broadcast(new.select("block").distinct()), "block", "left_semi").join(new.select("id"), "id", "left_semi")
    old = old.groupBy("id").agg(F.max_by("state", "batch_id").alias("old"))
    j = new.join(old, "id", "left")
    merged = F.struct(
        _later(F.col("new.ins"), F.col("old.ins")).alias("ins"),
        F.greatest("new.del_seq", "old.del_seq").alias("del_seq"),
        _later(F.col("new.upd"), F.col("old.upd")).alias("upd"),
    )
    j = materialize(j.withColumn("new", merged.cast(state)))
    j.select("id", "block", F.col("new").alias("state")).write.mode("overwrite").partitionBy("block").parquet(f"{base}/states/batch_id={batch_id}")

    sides = [F.when(_alive(s), F.struct(F.lit(sign).alias("sign"), *_reading(s, keys))) for s, sign in (("old", -1), ("new", 1))]
    rows = j.select(F.inline(F.filter(F.array(*sides), lambda x: x.isNotNull())))
    rows = rows.where(F.col("ts").isNotNull() & ((F.col("co2") > co2_max).isNull() | (F.col("co2") <= co2_max)))

    def total(x: Column, kind: str = "bigint") -> Column:
        return F.coalesce(F.sum(F.col("sign") * x), F.lit(0)).cast(kind)

    def known(col: str) -> Column:
        return total(F.col(col).isNotNull().cast("int"))

    change = rows.groupBy(*keys, day_of("ts", day_zone).alias("ds")).agg(
        total(F.lit(1)).alias("n_rows"), known("co2").alias("n_co2"), total(F.col("co2").cast("bigint")).alias("s_co2"),
        known("temperature").alias("n_temp"), total(F.col("temperature").cast("decimal(28,10)"), "decimal(38,10)").alias("s_temp"),
        known("humidity").alias("n_hum"), total(F.col("humidity").cast("decimal(28,10)"), "decimal(38,10)").alias("s_hum"),
        total(F.col("presence").cast("int")).alias("s_presence"),
    )
    change.write.mode("overwrite").parquet(f"{base}/sums/batch_id={batch_id}")


def _summed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [x.split()[0] for x in _SUMS.replace("decimal(38,10)", "decimal").split(", ")]
    kinds = {"s_temp": "decimal(38,10)", "s_hum": "decimal(38,10)"}
    return rows.groupBy(*keys, "ds").agg(*[F.sum(n).cast(kinds.get(n, "bigint")).alias(n) for n in names])


def _sums_of(spark: SparkSession, base: str, own: str) -> tuple[DataFrame, int]:
    """Rows to add up: the newest compacted table and the batches after it."""
    whole = read_or_empty(spark, f"{base}/daily", f"{own}ds date, {_SUMS}, upto bigint")
    upto = whole.agg(F.max("upto")).first()[0]
    since = read_or_empty(spark, f"{base}/sums", f"{own}ds date, {_SUMS}, batch_id bigint").where(F.col("batch_id") > F.lit(-1 if upto is None else upto))
    return whole.where(F.col("upto") == F.lit(upto)).drop("upto").union(since.drop("batch_id")), -1 if upto is None else upto


def compact(spark: SparkSession, base: str, upto: int, *, keys: str = "room_id bigint, ") -> None:
    """Add up the batches until ``upto`` once, so that later reads don't (``keys``: their schema)."""
    names = [k.split()[0] for k in keys.split(", ") if k]
    rows, done = _sums_of(spark, base, keys)
    if upto <= done:
        return
    since = read_or_empty(spark, f"{base}/sums", f"{keys}ds date, {_SUMS}, batch_id bigint")
    whole = read_or_empty(spark, f"{base}/daily", f"{keys}ds date, {_SUMS}, upto bigint").where(F.col("upto") == done).drop("upto")
    part = whole.union(since.where(F.col("batch_id").between(done + 1, upto)).drop("batch_id"))
    _summed(part, names).write.mode("overwrite").parquet(f"{base}/daily/upto={upto}")


def kept_daily(spark: SparkSession, base: str, *, keys: str = "room_id bigint, ") -> DataFrame:
    """D1 from the kept sums: what ``daily`` gives on the readings that are there now."""
    names = [k.split()[0] for k in keys.split(", ") if k]
    d = _summed(_sums_of(spark, base, keys)[0], names).where("n_rows > 0")
    return d.select(
        *names, "ds", F.try_divide(F.col("s_co2").cast("double"), F.col("n_co2")).alias("co2_mean"),
        F.try_divide(F.col("s_temp").cast("double"), F.col("n_temp")).alias("temp_mean"),
        F.try_divide(F.col("s_hum").cast("double"), F.col("n_hum")).alias("hum_mean"),
        F.col("s_presence").alias("presence_count"), F.col("n_co2").alias("total_count"),
    )


def keep_daily(changes: DataFrame, base: str, checkpoint: str, **how):
    """``fold_changes`` on every micro-batch of a change feed."""
    return (
        changes.writeStream.foreachBatch(lambda b, i: fold_changes(b, i, base, **how))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# ---------------------------------------------------------- C6 of two streams
def presence_join(readings: DataFrame, pings: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, reset_minute: int = 2,
                  delay: str = "10 minutes") -> DataFrame:
    """C6 as a left outer join of two streams, in Spark's own state: each latch block's first ON line (a windowed
    aggregate) meets the block's readings.  Both sides have a watermark and the block is in the join key, so a block's state goes
    when the watermark passes its end; its readings without an ON line come out then."""
    keys = list(keys)
    blocks = presence_blocks(pings, keys=keys, reset_minute=reset_minute, delay=delay, window=True)
    r = readings.where(F.col("ts").isNotNull())
    if readings.isStreaming:
        r = r.withWatermark("ts", delay)
    # the window is the side's event time; the instant itself is carried as a plain value
    instant = F.timestamp_micros(F.unix_micros("ts")).alias("ts")
    r = r.select("id", *keys, instant, F.window("ts", "1 hour", "1 hour", f"{reset_minute} minutes").alias("w"))
    j = r.join(blocks.select(*keys, "w", "first_on"), [*keys, "w"], "left_outer")
    return j.select("id", *keys, "ts", F.coalesce(F.col("ts") >= F.col("first_on"), F.lit(False)).alias("presence_latched"))
