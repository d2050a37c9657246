"""F, G: ordering, latest rows, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS


def sort_by_time(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, ts: str = "ts") -> DataFrame:
    """output order only (range-partitioned sort)."""
    return df.orderBy(*keys, ts, "id")


def latest_by(df: DataFrame, order: Sequence[str], *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """the row with the greatest ``order`` per series, as an
    aggregate (``max_by``), not a sort."""
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return g.select(*keys, "r.*")


def head_tail(df: DataFrame, *, n: int = 5, keys: Sequence[str] = DEFAULT_KEYS, order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """first and last ``n`` rows per series.  ``row_number() <= n`` is
    planned with a per-partition group limit before the exchange, so only
    n rows per series and task are shuffled."""
    w = Window.partitionBy(*keys)
    up = df.withColumn("_rn", F.row_number().over(w.orderBy(*[F.col(c).asc() for c in order])))
    head = up.where(F.col("_rn") <= n).withColumn("part", F.lit("head"))
    down = df.withColumn("_rn", F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order])))
    tail = down.where(F.col("_rn") <= n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail).withColumnRenamed("_rn", "pos")


def union_runs(*runs: DataFrame) -> DataFrame:
    """G1: bag union by name; columns missing on one side become NULL."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def latest_run_per_day(fc: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Where runs overlap on a day keep the newest run (``max_by``)."""
    cols = [c for c in fc.columns if c not in (*keys, "ds")]
    g = fc.groupBy(*keys, "ds").agg(F.max_by(F.struct(*cols), F.col("run_id")).alias("r"))
    return g.select(*keys, "ds", "r.*")


def seen_ids(df: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Each id handled once."""
    return df.dropDuplicates([id_col])
