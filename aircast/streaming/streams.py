"""J1-J6 as Structured Streaming plans.  Each function takes a DataFrame
that may be a stream or a batch (the batch twin is the test oracle)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS
from ..functions import scalar as S
from ..operators.joins import reset_block
from ..session import ensure_checkpoint_dir


def new_readings(readings: DataFrame, *, delay: str = "10 minutes", id_col: str = "id") -> DataFrame:
    """Each id handled once.  The watermark bounds the dedup state (the
    reference's seen-id set grows for ever).  Readings without a readable time can't be placed against a
    watermark; each of them passes."""
    timed, rest = readings.where(F.col("ts").isNotNull()), readings.where(F.col("ts").isNull())
    if readings.isStreaming:
        return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark([id_col]).unionByName(rest)
    return timed.dropDuplicates([id_col]).unionByName(rest)


def co2_alerts(readings: DataFrame, *, threshold: int = 900, delay: str = "10 minutes") -> DataFrame:
    """An alert row for every new reading at or over the threshold
    (the poll of the source only saw the newest id and missed the rest)."""
    r = new_readings(readings.where(F.col("co2") >= threshold), delay=delay)
    return r.select("id", "room_id", "ts", S.alert_text(F.col("co2")).alias("alert"))


def forecast_warnings(readings: DataFrame, today_rows: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS,
                      delay: str = "1 day") -> DataFrame:
    """Readings (the tick) joined to the static forecast rows of their
    local day; one warning per (series, day) when a limit is reached."""
    keys = list(keys)
    r = readings.where(F.col("ts").isNotNull()).withColumn("day", F.to_date("local_ts"))
    r = r.withColumn("day_ts", F.col("day").cast("timestamp"))
    f = today_rows.select(*keys, F.col("ds").alias("day"), "warning").where(F.col("warning").isNotNull())
    j = r.select(*keys, "day", "day_ts").join(f, [*keys, "day"])
    if readings.isStreaming:
        j = j.withWatermark("day_ts", delay).dropDuplicates([*keys, "day_ts"])
    else:
        j = j.dropDuplicates([*keys, "day_ts"])
    return j.select(*keys, "day", "warning")


def hourly(readings: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, delay: str = "10 minutes") -> DataFrame:
    """Latest reading and mean per hour, live.  In append mode a window
    is emitted once the watermark passes its end; rows later than the
    watermark are dropped."""
    r = readings.where(F.col("ts").isNotNull())
    if readings.isStreaming:
        r = r.withWatermark("ts", delay)
    g = r.groupBy(*keys, F.window("ts", "1 hour").alias("w")).agg(
        F.max_by(F.struct("co2", "id"), F.struct("ts", "id")).alias("latest"), F.avg("co2").alias("co2_mean"),
        F.count(F.lit(1)).alias("n"),
    )
    return g.select(*keys, F.col("w.start").alias("window_start"), F.col("latest.co2").alias("latest_co2"),
                    F.col("latest.id").alias("latest_id"), "co2_mean", "n")


def presence_blocks(pings: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, reset_minute: int = 2,
                    delay: str = "10 minutes", window: bool = False) -> DataFrame:
    """Per series and latch block (hourly tumbling window starting at
    minute ``reset_minute``) the first ON line; the block's readings are
    present from that instant on (see ``operators.joins.presence_latch``)."""
    p = pings.where(F.col("line").contains("ON") & (F.minute("ts") != reset_minute))
    if pings.isStreaming:
        p = p.withWatermark("ts", delay)
    g = p.groupBy(*keys, F.window("ts", "1 hour", "1 hour", f"{reset_minute} minutes").alias("w")).agg(
        F.min("ts").alias("first_on"), F.count(F.lit(1)).alias("n_on")
    )
    block = F.col("w") if window else F.col("w.start").alias("block_start")  # the window itself, for joins
    return g.select(*keys, block, "first_on", "n_on")


def stream_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"


def run_available_now(df: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Run a streaming plan over everything available, into parquet in the
    shared folder, and return the sink read as a batch DataFrame."""
    spark = df.sparkSession
    base = stream_dir(spark, name)
    q = (
        df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/_checkpoint")
        .option("path", f"{base}/out").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def append_store(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch to the store; a batch that is replayed
    after a failure overwrites its own ``batch_id`` folder (idempotent)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LATCH_OUT = "id long, room_id long, ts timestamp, presence_latched boolean"


#: Keys that the rooms of one latch block are dealt to.
LATCH_BUCKETS = 16
HOUR_US = 3_600_000_000


def _latch_processor_cls(reset_minute: int):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class PresenceLatch(StatefulProcessor):
        """Keyed by (latch block, bucket of rooms): state = first ON instant of each
        room of the bucket, two arrays for each block that a key has.  Each micro-batch of a key is
        one vectorised pandas frame: first ON per room, then a lookup for
        every reading (kind 1, and 2 where the room is unknown)."""

        def init(self, handle) -> None:
            self.handle = handle
            self.latch = handle.getMapState("latch", "blk bigint", "rooms array<bigint>, on_us array<bigint>")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            # the watermark passed the key's block: it is closed
            self.latch.clear()
            return iter([])

        def handleInputRows(self, key, rows, timerValues):
            pdf = pd.concat(list(rows), ignore_index=True)
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            blk = (us - reset_minute * 60_000_000) // HOUR_US
            on_rows = (pdf["kind"] == 0) & pdf["is_on"].eq(True)
            # rows may come late, so the first ON of every room is kept until the timer clears it
            kept = [(b, room, on) for (b,), (rooms, ons) in self.latch.iterator() for room, on in zip(rooms, ons)]
            new = pd.DataFrame({"blk": blk, "room": pdf["room_id"], "on": us})[on_rows]
            seen = pd.concat([pd.DataFrame(kept, columns=["blk", "room", "on"], dtype="int64"), new.astype("int64")])
            first = seen.groupby(["blk", "room"])["on"].min()
            for b in new["blk"].unique().tolist():
                own = first.loc[b]
                self.latch.updateValue((b,), (own.index.tolist(), own.tolist()))
            self.handle.registerTimer(int((blk.max() + 1) * HOUR_US // 1000 + reset_minute * 60_000))
            r, unknown = pdf["kind"] > 0, pdf["kind"] == 2
            f = pd.Series(float("nan"), index=pdf.index[r])
            if len(first):
                f[:] = first.reindex(pd.MultiIndex.from_arrays([blk[r], pdf.loc[r, "room_id"]])).to_numpy()
            yield pd.DataFrame({
                "id": pdf.loc[r, "id"].astype("int64"), "room_id": pdf.loc[r, "room_id"].astype("Int64").mask(unknown[r]),
                "ts": pdf.loc[r, "ts"], "presence_latched": (f <= us[r]) & ~unknown[r],
            })

        def close(self) -> None:
            pass

    return PresenceLatch


def presence_latch_rows(readings: DataFrame, pings: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS,
                        reset_minute: int = 2, delay: str = "10 minutes", buckets: int = LATCH_BUCKETS) -> DataFrame:
    """J5 per reading: readings and radar lines meet in keyed state
    (``transformWithStateInPandas``) keyed by latch block and a bucket of
    rooms, so a key costs a few state round trips however many rooms there
    are, and the work of an hour is spread over ``buckets`` keys; equals the batch C6
    result when rows arrive in event-time order (a reading of an unknown room has no ON line)."""
    others = [k for k in keys if k != "room_id"]
    room, ts = F.coalesce("room_id", F.lit(0)).alias("room_id"), F.col("ts").isNotNull()  # pandas' integers have no null
    ok = F.col("line").contains("ON") & (F.minute("ts") != reset_minute)
    p = pings.where(ts).select(*others, room, "ts", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), (ok & F.col("room_id").isNotNull()).alias("is_on"))
    kind = F.when(F.col("room_id").isNull(), 2).otherwise(1).alias("kind")
    r = readings.where(ts).select(*others, room, "ts", kind, F.col("id"), F.lit(None).cast("boolean").alias("is_on"))
    u = p.unionByName(r).withColumns({
        "block": F.unix_seconds(reset_block(F.col("ts"), reset_minute)), "bucket": F.pmod(F.xxhash64("room_id"), F.lit(buckets)),
    })
    if u.isStreaming:
        # event-time timers clear a key once the watermark passes its block
        u = u.withWatermark("ts", delay)
        mode = "EventTime"
    else:
        mode = "None"
    return u.groupBy(*others, "block", "bucket").transformWithStateInPandas(
        statefulProcessor=_latch_processor_cls(reset_minute)(), outputStructType=LATCH_OUT, outputMode="Append", timeMode=mode
    )


def ingest_batch(batch: DataFrame, batch_id: int, store_path: str, quarantine_path: str, *,
                 order: Sequence[str] = ("timestamp", "seq")) -> None:
    """One micro-batch of the ingestion path (landing files -> A5 -> A3 -> J6).

    Rejects go to the quarantine folder with their reason.  Accepted rows get
    ids continuing the store's autoincrement: max id of the *earlier*
    batches (from the high-water-mark table ``<store>_hwm``, one row per
    batch) + dense numbering in ingest ``order``.  A replayed batch thus
    reproduces its ids and overwrites only its own ``batch_id`` folder."""
    from ..sources import store as SS

    spark = batch.sparkSession
    v = SS.validate_payload(batch)
    v.where(F.col("status") != "ok").write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")
    ok = v.where(F.col("status") == "ok")
    # the highest id of the earlier batches comes from a one-row-per-batch
    # high-water-mark table, not from a scan of the whole store
    hwm_path = f"{store_path}_hwm"
    try:
        prior = spark.read.parquet(hwm_path).where(F.col("batch_id") < batch_id).agg(F.max("max_id")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # else: the first batch
            raise
        prior = 0
    numbered = SS.dense_number(ok, list(order))
    rows = numbered.select(
        (F.lit(prior) + F.col("_n")).cast("long").alias("id"), "room_id", F.col("timestamp").alias("ts_raw"), "co2",
        "temperature", "humidity", "presence",
    )
    out = f"{store_path}/batch_id={batch_id}"
    rows.write.mode("overwrite").parquet(out)
    top = spark.read.parquet(out).agg(F.coalesce(F.max("id"), F.lit(prior)).alias("max_id"))  # this batch only
    top.write.mode("overwrite").parquet(f"{hwm_path}/batch_id={batch_id}")


def ingest(payloads: DataFrame, store_path: str, quarantine_path: str, checkpoint: str, *,
           order: Sequence[str] = ("timestamp", "seq")):
    """The ingestion stream: ``ingest_batch`` on every micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, store_path, quarantine_path, order=order)

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
