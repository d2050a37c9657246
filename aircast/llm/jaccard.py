"""Jaccard join of word 5-gram sets with an index of count vectors.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes).  Equal sets
   are one class; a class is one node from here on.
2. The shingles are hashed into groups.  Corpus counts of ``ORDER_GROUPS`` groups
   order all shingles from rare to frequent, and two sets that link must
   share one of their floor(n/4)+1 rarest shingles (prefix filter, exact for any
   order).  That deals the points to the leaves of the index: classes that
   share such a shingle.
3. Each class is a point: its counts in ``GROUPS`` groups.  The overlap of two sets is
   at most the sum over the groups of the smaller count.  A tree node holds a
   group of linked classes (built from the first links, ``links.link_components``) with
   the largest count of each coordinate; two nodes whose bound is
   below the overlap that any two of their members would need are not opened, nor is a
   point that can't reach the other node's box.  The points of opened nodes are compared block by block.
4. The surviving pairs of points are verified on the full sets: of two nodes the pair with the most
   overlap to spare first, the others only where that one doesn't link them.

A tree packed by coordinates alone would compare all leaves of a size band
with each other (count vectors of unrelated texts overlap in every coordinate), which
is quadratic; the rare-shingle leaves keep the work in proportion to the input.

Defined results: a null text, or one without words, has no shingles and is linked
with nothing; fewer than five words are one shingle; a repeated doc_id gets one result
row for each input row; the smallest doc_id ignores nulls.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counts as counting
from . import textkit as tk
from .frames import Scratch, scan, scan_state
from .fuse import semi_join
from .links import ACROSS, Entries, link_components, shared_keys

WORDS = 5
#: Groups of the count vectors (the coordinates of a point).
GROUPS = 256
#: Groups whose corpus counts order the shingles (a power of two).
ORDER_BITS = 18
ORDER_GROUPS = 1 << ORDER_BITS
#: Points of a group that make a block, and points of other groups that meet a block at once.
PART = 256
MEET = 1024
#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def needed(na, nb):
    """Least overlap of linked sets: 100 I >= 75 (na + nb - I)."""
    return -(-3 * (na + nb) // 7)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text")


def _sets(b: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Sorted shingles of each text, their numbers, and two hashes of each set."""
    raw, off = tk.text_bytes(tk.column(b, "text"))
    h, _, _, first = tk.words(raw, off, tk.NOT_SPACE)
    sets = tk.window_sets(h, first, WORDS)
    n = np.array([len(s) for s in sets], np.int64)
    cut = np.concatenate([[0], np.cumsum(n)])
    flat = np.concatenate([*sets, np.zeros(1, tk.U)])
    sums = [np.concatenate([np.zeros(1, tk.U), np.cumsum(tk.mix(flat ^ tk.U(salt)), dtype=tk.U)]) for salt in (1, 2)]
    cls, chk = (tk.mix((s[cut[1:]] - s[cut[:-1]]) + n.astype(tk.U)).view(np.int64) for s in sums)
    return sets, n, cls, chk


def _new(sets: list[np.ndarray], cls: np.ndarray, seen: set[int]) -> list[int]:
    """Places of the sets that this task meets for the first time."""
    out = []
    for i, c in enumerate(cls.tolist()):
        if len(sets[i]) and c not in seen:
            seen.add(c)
            out.append(i)
    return out


def describe(docs: DataFrame) -> DataFrame:
    """One row for each text: doc_id, n, cls (hash of its set), chk (a second one)
    and, for the first text of a class in each task, its count vector.  Then rows of
    the task's counts in the order groups (block, task, total)."""

    def make():
        seen: set[int] = set()
        total = np.zeros(ORDER_GROUPS, np.int64)

        def fn(b: pa.RecordBatch) -> dict:
            sets, n, cls, chk = _sets(b)
            counts: list = [None] * len(sets)
            for i in (new := _new(sets, cls, seen)):
                counts[i] = np.bincount((sets[i] >> tk.U(56)).astype(np.int64), minlength=GROUPS).astype(np.uint32).tobytes()
            flat = np.concatenate([np.zeros(0, tk.U), *(sets[i] for i in new)])
            np.add(total, np.bincount((flat & tk.U(ORDER_GROUPS - 1)).astype(np.int64), minlength=ORDER_GROUPS), out=total)
            none = [None] * len(sets)
            return {"doc_id": tk.column(b, "doc_id"), "n": n, "cls": cls, "chk": chk, "counts": counts, "block": none, "task": none, "total": none}

        def close() -> dict:
            own = counting.rows(total)
            none = [None] * len(own["block"])
            return {"doc_id": none, "n": none, "cls": none, "chk": none, "counts": none, **own}

        return fn, close

    return scan_state(docs, make, f"doc_id bigint, n bigint, cls bigint, chk bigint, counts binary, {counting.SCHEMA}")


def rare_shingles(docs: DataFrame, counts: np.ndarray, entries: int) -> DataFrame:
    """``links.SHARED`` rows: the rarest floor(n/4)+1 shingles of each class that
    another class has among its rarest too."""
    rank = np.empty(ORDER_GROUPS, tk.U)
    rank[np.argsort(counts, kind="stable")] = np.arange(ORDER_GROUPS, dtype=tk.U)
    ranks = docs.sparkSession.sparkContext.broadcast(rank)

    def keys() -> Callable[[pa.RecordBatch], Entries]:
        seen: set[int] = set()

        def fn(b: pa.RecordBatch) -> Entries:
            sets, n, cls, _ = _sets(b)
            new, rank, out = _new(sets, cls, seen), ranks.value, [np.zeros(0, tk.U)]
            for s in (sets[i] for i in new):
                # the rank of the group stands before the rest of the hash: one-to-one, and sorts by rarity
                k = (rank[(s & tk.U(ORDER_GROUPS - 1)).astype(np.int64)] << tk.U(64 - ORDER_BITS)) | (s >> tk.U(ORDER_BITS))
                p = len(k) // 4 + 1
                out.append(np.sort(np.partition(k, p - 1)[:p]))
            sizes = np.array([len(k) for k in out[1:]], np.int64)
            n = np.repeat(n[new], sizes)
            # no overlap is larger than what is left from the first shared shingle on
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            return np.concatenate(out), np.repeat(cls[new], sizes), n.astype(np.int32), (n - place).astype(np.int32)

        return fn

    return shared_keys(docs.select("text"), keys, entries)


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """cls and all sorted shingles of the classes ``nodes`` (cls, doc), made again
    from the text of one of their documents."""
    texts = semi_join(docs, "doc_id", nodes.select(F.col("doc").alias("key")).distinct())

    def run(b: pa.RecordBatch) -> dict:
        sets, _, cls, _ = _sets(b)
        return {"cls": cls, "tokens": tk.binary(sets)}

    found = scan(texts, run, "cls bigint, tokens binary")
    # rows may repeat a doc_id
    return found.join(nodes.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def may_link(lo1, hi1, room1, lo2, hi2, room2):
    """Sizes within 3/4 of each other, and room for the overlap that is needed."""
    return (4 * hi1 >= 3 * lo2) & (4 * hi2 >= 3 * lo1) & (7 * F.least(room1, room2) >= 3 * (lo1 + lo2))


def _vectors(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(len(col), GROUPS).astype(np.int64)


def _bounded(pairs: DataFrame, sizes: tuple[str, str], schema: str) -> DataFrame:
    """Pairs whose summed coordinate minima reach the overlap they need."""
    na, nb = sizes

    def run(b: pa.RecordBatch) -> dict:
        bound = np.minimum(_vectors(tk.column(b, "v1")), _vectors(tk.column(b, "v2"))).sum(1)
        need = needed(np.asarray(tk.column(b, na)), np.asarray(tk.column(b, nb)))
        keep = b.filter(pa.array(bound >= need))
        return {c: tk.column(keep, c) for c in (x.split()[0] for x in schema.split(", "))}

    return scan(pairs, run, schema)


def _links(points: DataFrame, docs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are links: bound first, then the full sets."""
    a, b = (points.select("cls", "n", "counts").toDF(x, f"n{i}", f"v{i}") for x, i in (("a", 1), ("b", 2)))
    near = pairs.join(a, "a").join(b, "b")
    near = scratch.table(_bounded(near, ("n1", "n2"), "a bigint, b bigint"), f"near{uuid.uuid4().hex}", brief=True)
    nodes = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
    sets = scratch.table(full_sets(docs, points.select("cls", "doc").join(nodes, "cls")), f"sets{uuid.uuid4().hex}", brief=True)
    full = near.join(sets.toDF("a", "t1"), "a").join(sets.toDF("b", "t2"), "b")

    def run(batch: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(tk.column(batch, "t1"), tk.column(batch, "t2")):
            x, y = np.frombuffer(x.as_buffer(), tk.U), np.frombuffer(y.as_buffer(), tk.U)
            s = np.sort(np.concatenate([x, y]), kind="stable")  # two runs: merged
            both = int((s[1:] == s[:-1]).sum())
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        out = batch.filter(pa.array(keep, pa.bool_()))
        return {c: tk.column(out, c) for c in ("a", "b")}

    return scan(full, run, "a bigint, b bigint")


BOX = "comp bigint, lo int, hi int, v binary"


def _box(key: tuple, t: pa.Table) -> pa.Table:
    """The box around points or boxes: sizes, and the largest count of each coordinate."""
    v = np.zeros(GROUPS, np.int64)
    for b in t.to_batches():
        v = np.maximum(v, _vectors(tk.column(b, "v")).max(0)) if b.num_rows else v
    lo, hi = np.asarray(t.column("lo")).min(), np.asarray(t.column("hi")).max()
    return pa.table({"comp": pa.array([key[0].as_py()], pa.int64()), "lo": pa.array([lo], pa.int32()), "hi": pa.array([hi], pa.int32()), "v": pa.array([v.astype(np.uint32).tobytes()], pa.binary())})


def _boxes(points: DataFrame, members: DataFrame, comps: DataFrame) -> DataFrame:
    """The boxes (``BOX``) of ``comps`` (comp)."""
    own = points.select(F.col("cls").alias("node"), F.col("n").alias("lo"), F.col("n").alias("hi"), F.col("counts").alias("v"))
    sized = members.join(comps, "comp", "left_semi").groupBy("comp").agg(F.count("*").alias("size"))
    rows = members.join(sized, "comp").join(own, "node")
    alone = rows.where("size = 1").select("comp", "lo", "hi", "v")
    # a large group is summed in parts of about 1000 first, so no task gets all of it
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / 1000))
    parts = rows.where("size > 1").withColumn("part", part).groupBy("comp", "part").applyInArrow(_box, BOX)
    return alone.union(parts.groupBy("comp").applyInArrow(_box, BOX))


def _meet(t: pa.Table) -> pa.Table:
    """The pairs of points of each block whose summed coordinate minima reach the overlap they need, and what they have to spare."""
    many, part, chunk, node, n = (np.asarray(t.column(c)) for c in ("many", "part", "chunk", "node", "n"))
    few, alone = t.column("few").combine_chunks(), np.asarray(t.column("few").is_valid())
    v = _vectors(t.column("v"))
    order = np.lexsort((chunk, part, many))
    new = np.any([x[order][1:] != x[order][:-1] for x in (many, part, chunk)], axis=0)
    cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(order)]]).tolist()
    own, other, spare = ([np.zeros(0, np.int64)] for _ in range(3))
    for a, z in zip(cut[:-1], cut[1:]):
        rows = order[a:z]
        points = rows[~alone[rows]]
        held, sizes = v[points], n[points]
        for i in rows[alone[rows]].tolist():
            left = np.minimum(held, v[i]).sum(1) - needed(sizes, n[i])
            keep = np.flatnonzero(left >= 0)
            own.append(np.full(len(keep), i))
            other.append(points[keep])
            spare.append(left[keep])
    own, other, spare = (np.concatenate(x) for x in (own, other, spare))
    return pa.table({"c1": few.take(pa.array(own)), "c2": many[other], "a": node[own], "b": node[other], "spare": spare})


def _descend(points: DataFrame, pairs: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """From pairs of tree nodes (c1, c2) to pairs of points (``links.ACROSS``): first box against box,
    then the points of the smaller group against the other's box, then against its points.  These stay in blocks of about ``PART``, and
    about ``MEET`` points of smaller groups come to a block at once, so that no row is made for a pair that the bound excludes."""
    wanted = pairs.select(F.col("c1").alias("comp")).union(pairs.select("c2")).distinct()
    boxes = scratch.table(_boxes(points, members, wanted), "boxes", brief=True)
    x, y = (boxes.toDF(f"c{i}", f"lo{i}", f"hi{i}", f"v{i}") for i in (1, 2))
    fits = "4 * hi1 >= 3 * lo2 AND 4 * hi2 >= 3 * lo1"
    near = _bounded(pairs.join(x, "c1").join(y, "c2").where(fits), ("lo1", "lo2"), "c1 bigint, c2 bigint")
    near = scratch.table(near, "open", brief=True)
    sizes = members.groupBy("comp").agg(F.count("*").alias("size"))
    near = near.join(sizes.toDF("c1", "s1"), "c1").join(sizes.toDF("c2", "s2"), "c2")
    first = F.col("s1") <= F.col("s2")
    near = near.select(F.when(first, F.col("c1")).otherwise(F.col("c2")).alias("few"), F.when(first, F.col("c2")).otherwise(F.col("c1")).alias("many"), F.greatest("s1", "s2").alias("size"))
    own = points.select(F.col("cls").alias("node"), "n", F.col("counts").alias("v"))
    rows = near.join(members.toDF("node", "few"), "few").join(own.select("node", F.col("n").alias("lo1"), F.col("n").alias("hi1"), F.col("v").alias("v1")), "node")
    rows = rows.join(boxes.toDF("many", "lo2", "hi2", "v2"), "many").where(fits)
    some = _bounded(rows, ("lo1", "lo2"), "few bigint, many bigint, size bigint, node bigint, lo1 int, v1 binary")
    some = scratch.table(some, "some", brief=True)
    blocks = some.groupBy("many").agg(F.count("*").alias("met"), F.ceil(F.max("size") / PART).alias("parts"), F.ceil(F.count("*") / MEET).alias("chunks"), F.max("size").alias("size"))
    blocks = scratch.table(blocks, "blocks", brief=True)
    rows = blocks.agg(F.sum(F.col("met") * F.col("parts") + F.col("size") * F.col("chunks"))).first()[0] or 0
    blocks = blocks.select("many", "parts", "chunks")
    part, chunk = (F.pmod(F.xxhash64("node"), c) for c in ("parts", "chunks"))
    each_part, each_chunk = (F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)) for c in ("parts", "chunks"))
    guests = some.select("few", "many", "node", F.col("lo1").alias("n"), F.col("v1").alias("v")).join(blocks, "many").withColumn("chunk", chunk).withColumn("part", each_part)
    hosts = members.toDF("node", "many").join(blocks, "many").join(own, "node").withColumn("few", F.lit(None).cast("bigint")).withColumn("part", part).withColumn("chunk", each_chunk)
    cols = ("many", "part", "chunk", "few", "node", "n", "v")
    both = guests.select(*cols).union(hosts.select(*cols))
    task = F.pmod(F.xxhash64("many", "part", "chunk"), F.lit(1 + int(rows) // (2 * MEET)))
    return both.withColumn("task", task).groupBy("task").applyInArrow(_meet, ACROSS)


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    with Scratch(spark, "jaccard") as scratch:
        texts = _texts(docs)
        told = scratch.table(describe(texts), "told")
        rows = told.where("block IS NULL").select("doc_id", "n", "cls")
        known = told.where("n > 0").groupBy("cls").agg(
            F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("doc"),
            F.max("n").cast("int").alias("n"), F.min("chk").alias("c1"), F.max("chk").alias("c2"))
        doc = F.when(F.col("c1") == F.col("c2"), F.coalesce("doc", F.lit(NO_ID))).otherwise(F.raise_error(F.lit("two shingle sets have one hash")).cast("bigint"))
        classes = scratch.table(known.select("cls", doc.alias("doc"), "n"), "classes")
        entries = classes.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
        counts = counting.add_up(told.where("block IS NOT NULL").select("block", "task", "total"), ORDER_GROUPS)
        keys = scratch.table(rare_shingles(texts, counts, int(entries)), "keys")
        shared = keys.select(F.col("node").alias("cls")).distinct()
        # one row for each class that shares a shingle
        points = told.where("counts IS NOT NULL").select("cls", "counts").join(shared, "cls", "left_semi").dropDuplicates(["cls"])
        points = scratch.table(points.join(classes, "cls").select("cls", "n", "doc", "counts"), "points")
        rows = scratch.table(rows, "rows")
        scratch.drop("told")
        linked = link_components(
            keys,
            may=may_link,
            verify=lambda pairs: _links(points, texts, pairs, scratch),
            descend=lambda pairs, members: _descend(points, pairs, members, scratch),
            scratch=scratch,
        )
        doc = F.when(F.col("doc") != NO_ID, F.col("doc"))
        root = classes.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select("cls", doc.alias("doc"), F.coalesce("comp", "cls").alias("comp"))
        ids = root.groupBy("comp").agg(F.min("doc").alias("component_id"))
        ids = root.join(ids, "comp").select("cls", "component_id")
        own = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
        return scratch.keep(
            rows.select(own.alias("doc_id"), "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
            .join(ids, "cls", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        )
