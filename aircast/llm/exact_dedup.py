"""Exact duplicates of a batch against an immutable snapshot, screened by static filters.

Texts are equal when identical after deleting white space ``[\\x20\\x09-\\x0D]``.

- Every text gets the SHA-256 of its normalised bytes. The snapshot's distinct
  digests lie in buckets of the digest, each with one binary fuse filter
  (``fuse.BinaryFuse``), built once.
- The batch is first grouped by digest for itself.  Each of its distinct digests is
  screened by the filter of its bucket: most new texts end there.
- Positives join the snapshot's digests of the same bucket.  The bytes of every
  group of two or more rows are compared; the texts that may be needed are found by
  a screen over the shared digests, broadcast up to ``fuse.BROADCAST_BYTES`` (beyond
  that all texts go to the join).

Of equal texts the row with the most code points in the original text stays, then
the smallest doc_id (null last), then the earlier row of the table.  Null counts
as empty.  Two different texts with one SHA-256 stop the job.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import Scratch, scan
from .fuse import BUCKET_KEYS, build_filters, load, screen_of

WHITE = b" \t\n\x0b\x0c\r"


def normalised(arr: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Texts without white space, and the code points of the original ones."""
    raw, off = tk.text_bytes(arr)
    whole = raw.tobytes()
    points = tk.code_point_index(raw)[off]
    cut = off.tolist()
    return [whole[a:z].translate(None, WHITE) for a, z in zip(cut[:-1], cut[1:])], np.diff(points)


def keys_of(digests: list[bytes]) -> np.ndarray:
    """64 bits of each digest, as ``keyed`` has them."""
    return np.frombuffer(b"".join(d[8:16] for d in digests), ">u8").astype(np.uint64)


def digests(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """rid, doc_id, snap, digest, points, ones per row of ``docs`` (doc_id, text)."""

    def run(b: pa.RecordBatch) -> dict:
        texts, points = normalised(tk.column(b, "text"))
        return {
            "rid": tk.column(b, "rid"), "doc_id": tk.column(b, "doc_id"), "snap": tk.column(b, "snap"),
            "digest": [hashlib.sha256(t).digest() for t in texts], "points": points,
        }

    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(in_snapshot, F.lit(True)).alias("snap"), "text",
    )
    return scan(rows, run, "rid bigint, doc_id bigint, snap boolean, digest binary, points bigint")


def grouped(rows: DataFrame) -> DataFrame:
    """digest, size and the row that stays (``stay``)."""
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    return rows.groupBy("digest").agg(F.count("*").alias("size"), F.min(order).alias("stay"))


def keyed(df: DataFrame) -> DataFrame:
    """With 64 bits of the digest as ``key``."""
    return df.withColumn("key", F.conv(F.hex(F.substring("digest", 9, 8)), 16, -10).cast("bigint"))


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return keyed(df).withColumn("bucket", F.pmod("key", F.lit(buckets)))


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """Digests of the batch with ``maybe``: the bucket's filter may hold them."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        d = left.column("digest").combine_chunks()
        keys = np.asarray(left.column("key")).view(np.uint64)
        hit = load(right.to_pylist()[0]).test(keys) if right.num_rows and len(d) else np.zeros(len(d), bool)
        return pa.table({"digest": d, "maybe": pa.array(hit, pa.bool_())})

    return (
        batch.select("bucket", "key", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket"))
        .applyInArrow(probe, "digest binary, maybe boolean")
    )


def check_bytes(docs: DataFrame, shared: DataFrame) -> None:
    """Compare the normalised bytes of all rows whose digest is in ``shared``
    (digest); differing ones stop the job."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(screen_of(keyed(shared).select("key").distinct()))

    def run(b: pa.RecordBatch) -> dict:
        texts, _ = normalised(tk.column(b, "text"))
        d = [hashlib.sha256(t).digest() for t in texts]
        screen = held.value
        keep = screen.test(keys_of(d)) if screen else np.ones(len(d), bool)
        once: dict[bytes, bytes] = {}
        for i in np.flatnonzero(keep):
            if once.setdefault(d[i], texts[i]) != texts[i]:
                raise ValueError("two different texts have one SHA-256")
        return {"digest": list(once), "bytes": list(once.values())}

    found = scan(docs.select("text"), run, "digest binary, bytes binary").join(shared, "digest")
    # min and max are combined within a task first, so a large group sends one text for each task
    odd = found.groupBy("digest").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).where("lo != hi")
    if not odd.select("digest").isEmpty():
        raise ValueError("two different texts have one SHA-256")


def duplicates(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text).
    Rows where ``in_snapshot`` is true (or null) are the snapshot, the rest is the incoming batch."""
    with Scratch(docs.sparkSession, "exact") as scratch:
        rows = scratch.table(digests(docs, in_snapshot), "digests")
        buckets = max(1, rows.count() // BUCKET_KEYS)
        old = scratch.table(bucketed(grouped(rows.where("snap")), buckets), "snapshot")
        filters = scratch.table(build_filters(old), "filters")
        new = scratch.table(bucketed(grouped(rows.where("NOT snap")), buckets), "batch")
        maybe = scratch.table(screen(new, filters), "screened")
        positive = new.join(maybe.where("maybe"), "digest").join(old.select("digest"), "digest", "left_semi")
        cols = ("digest", "size", "stay")
        met = old.select(*cols).union(positive.select(*cols)).groupBy("digest").agg(F.sum("size").alias("size"), F.min("stay").alias("stay"))
        # what the filter or the exact bucket turned away is new
        fresh = new.join(positive.select("digest"), "digest", "left_anti").select(*cols)
        groups = scratch.table(met.union(fresh), "groups")
        check_bytes(docs, groups.where("size > 1").select("digest"))
        return scratch.keep(
            rows.join(groups, "digest").select(
                "doc_id",
                F.col("stay.d").alias("keep_id"),
                F.col("size").alias("group_size"),
                (F.col("stay.r") == F.col("rid")).alias("kept"),
                F.lower(F.hex("digest")).alias("text_sha256"),
            )
        )


def dedup(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """The rows of ``docs`` that stay, one for each group of equal texts, with all
    their columns.  ``docs`` must name its rows by doc_id: rows that repeat one
    doc_id and the same text count as one."""
    stay = duplicates(docs, in_snapshot).where("kept").select("keep_id").distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["keep_id"]), "left_semi").dropDuplicates(["doc_id", "text"])
