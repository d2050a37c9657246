"""Corpus counts in a fixed number of hashed groups.

Each task counts in an array, and sends it in packed blocks; Spark sums the blocks in
two steps, and a number of bytes that doesn't depend on the corpus comes to the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 14
#: Columns of the rows that ``rows`` makes.
SCHEMA = "block bigint, task bigint, total binary"


def rows(total: np.ndarray) -> dict[str, list]:
    """The task's counts as columns of ``SCHEMA``; empty blocks are left out."""
    blocks = total.reshape(-1, BLOCK)
    some = np.flatnonzero(blocks.any(1)).tolist()
    packed = [zlib.compress(blocks[i].tobytes(), 1) for i in some]
    return {"block": some, "task": [TaskContext.get().partitionId()] * len(some), "total": packed}


def add_up(parts: DataFrame, groups: int) -> np.ndarray:
    """The sum of all tasks' rows (``SCHEMA``)."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for c in t.column("total"):
            total += np.frombuffer(zlib.decompress(c.as_buffer()), np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "total": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "block bigint, total binary"
    parts = parts.groupBy("block", F.floor(F.col("task") / 64).alias("part")).applyInArrow(add, schema)
    out = np.zeros((groups // BLOCK, BLOCK), np.int64)
    for r in parts.groupBy("block").applyInArrow(add, schema).collect():
        out[r.block] = np.frombuffer(zlib.decompress(r.total), np.int64)
    return out.ravel()
