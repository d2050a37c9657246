"""The presence latch as an as-of join within reset blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS


def reset_block(ts: Column, reset_minute: int = 2) -> Column:
    """The latch period an instant belongs to: it starts at minute
    ``reset_minute`` of each hour (date_trunc of ts - reset_minute)."""
    return F.date_trunc("hour", ts - F.expr(f"INTERVAL {reset_minute} MINUTES"))


def first_on(pings: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, reset_minute: int = 2, marker: str = "ON") -> DataFrame:
    """Earliest ``ON`` line per (series, block); lines read during the reset
    minute itself are ignored (the check does not read the radar then).
    A hash aggregate with partial combine: a hot series costs one row per
    block and task."""
    p = pings.where(F.col("line").contains(marker) & (F.minute("ts") != reset_minute))
    return p.groupBy(*keys, reset_block(F.col("ts"), reset_minute).alias("_blk")).agg(F.min("ts").alias("_on"))


def presence_latch(readings: DataFrame, pings: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, reset_minute: int = 2,
                   out: str = "presence_latched") -> DataFrame:
    """A reading is present when an ON line arrived in its block at or
    before its instant.  Equivalent to the as-of ``max(ping_ts)`` over a
    range frame, but as an equi-join on (keys, block) against one row per
    block -- no sort of a whole series, and a hot block is split by AQE's
    skew join."""
    on = first_on(pings, keys=keys, reset_minute=reset_minute)
    r = readings.withColumn("_blk", reset_block(F.col("ts"), reset_minute))
    j = r.join(on, [*keys, "_blk"], "left")
    return j.withColumn(out, F.coalesce(F.col("ts") >= F.col("_on"), F.lit(False))).drop("_blk", "_on")
