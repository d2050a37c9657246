"""Static 3-wise binary fuse filters with 8-bit fingerprints, in NumPy.

About 9 bits a key and one false positive in 256; built once for an immutable
set of distinct 64-bit keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import scan
from .textkit import U, column, mix

#: Largest filter that is broadcast.
BROADCAST_BYTES = 64 << 20
#: Distinct keys of one filter, about.
BUCKET_KEYS = 200_000
FILTER = "bucket bigint, seed bigint, segment bigint, segments bigint, bits binary"


@dataclass
class BinaryFuse:
    seed: int
    segment: int  # slots of a segment, a power of two
    segments: int
    table: np.ndarray  # uint8

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse":
        """``keys``: distinct uint64."""
        n = len(keys)
        segment = min(1 << 18, 1 << int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        segments = max(1, -(-round(n * factor) // segment) - 2) if n > 1 else 1
        for seed in range(1, 200):
            f = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if f._assign(keys):
                return f
        raise ValueError("binary fuse construction failed: the keys are not distinct")

    def _hashed(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys + U(self.seed) * mix(np.full(1, self.seed, U)))

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """(3, n) slots, one in each of three neighbouring segments."""
        first = (((h >> U(32)) * U(self.segments * self.segment)) >> U(32)).astype(np.int64)
        mask = U(self.segment - 1)
        second = (first + self.segment) ^ ((h >> U(18)) & mask).astype(np.int64)
        third = (first + 2 * self.segment) ^ (h & mask).astype(np.int64)
        return np.stack([first, second, third])

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> U(32))).astype(np.uint8)

    def _assign(self, keys: np.ndarray) -> bool:
        if not len(keys):
            return True
        h = self._hashed(keys)
        slots = self._slots(h)
        size = len(self.table)
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the keys at a slot
        ids = np.arange(len(keys))
        for row in slots:
            np.bitwise_xor.at(owner, row, ids)
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        front = np.flatnonzero(count == 1)
        left = len(keys)
        while len(front):
            key, at = np.unique(owner[front], return_index=True)
            rounds.append((key, front[at]))
            left -= len(key)
            touched = slots[:, key]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, key)
            touched = np.unique(touched)
            front = touched[count[touched] == 1]
        if left:
            return False
        prints = self._print(h)
        for key, slot in reversed(rounds):
            # the own slot is still 0; no other key of this round uses it
            s = slots[:, key]
            self.table[slot] = prints[key] ^ self.table[s[0]] ^ self.table[s[1]] ^ self.table[s[2]]
        return True

    def __contains__(self, key: int) -> bool:
        return bool(self.test(np.array([key], U))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for about 1 in 256 others."""
        h = self._hashed(keys)
        s = self._slots(h)
        return (self.table[s[0]] ^ self.table[s[1]] ^ self.table[s[2]]) == self._print(h)


def build_filters(keys: DataFrame) -> DataFrame:
    """One static filter for each bucket of ``keys`` (bucket, key bigint)."""

    def build(key: tuple, t: pa.Table) -> pa.Table:
        f = BinaryFuse.build(np.unique(np.asarray(t.column("key")).view(U)))
        return pa.table({
            "bucket": pa.array([key[0].as_py()], pa.int64()), "seed": pa.array([f.seed], pa.int64()),
            "segment": pa.array([f.segment], pa.int64()), "segments": pa.array([f.segments], pa.int64()),
            "bits": pa.array([f.table.tobytes()], pa.binary()),
        })

    return keys.select("bucket", "key").groupBy("bucket").applyInArrow(build, FILTER)


def load(row: dict) -> BinaryFuse:
    return BinaryFuse(row["seed"], row["segment"], row["segments"], np.frombuffer(row["bits"], np.uint8))


class Screen:
    """Filters over a set of 64-bit keys, small enough to broadcast."""

    def __init__(self, buckets: int, rows: list[dict]):
        self.buckets, self.rows = buckets, {r["bucket"]: r for r in rows}

    def test(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        at = keys.view(np.int64) % self.buckets
        for i in np.unique(at).tolist():
            if i in self.rows:
                own = np.flatnonzero(at == i)
                out[own] = load(self.rows[i]).test(keys[own])
        return out


def screen_of(keys: DataFrame, limit: int = BROADCAST_BYTES) -> Screen | None:
    """A screen over distinct ``keys`` (key bigint), or None where it would be
    larger than ``limit`` (then the caller joins all its rows)."""
    n = keys.count()
    if n * 1.3 + 1000 > limit:
        return None
    buckets = max(1, n // BUCKET_KEYS)
    rows = build_filters(keys.withColumn("bucket", F.pmod("key", F.lit(buckets)))).collect() if n else []
    return Screen(buckets, [r.asDict() for r in rows])


def semi_join(df: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose bigint column ``name`` is among ``keys`` (key): most others
    are screened out where they are read, and only the rest is shuffled."""
    screen = screen_of(keys)
    if screen is not None:
        held = df.sparkSession.sparkContext.broadcast(screen)
        names = df.columns

        def run(b: pa.RecordBatch) -> dict:
            keep = b.filter(pa.array(held.value.test(np.asarray(column(b, name)).view(U))))
            return {c: column(keep, c) for c in names}

        df = scan(df, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
    return df.join(keys.withColumnRenamed("key", name), name, "left_semi")
