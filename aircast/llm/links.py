"""Connected groups of nodes that share keys, without listing all pairs of a key.

``shared_keys`` finds the (key, node) rows of keys that two or more nodes have.
``link_components`` then works in rounds.  The first test each node against
the hubs (smallest nodes) of its keys and join the true links into
components: the smallest hub of all, then the others that it hasn't joined.  ``MORE_HUBS`` rounds may do the same with other hubs.  The last one
looks only at keys whose nodes are still in different
components, and tests the pairs across them: of two components the likeliest pair first, the others
only where it doesn't link them.  So every pair that shares
a key is linked, tested, or already connected; a key shared by one large group of
similar nodes costs a few tests for each node.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import Scratch, scan_state

#: (key, node) entries held by a task before they are dealt to buckets.
FLUSH = 1 << 17
#: Entries of one bucket (24 bytes each).
BUCKET = 250_000
#: A key with so many nodes in one flush is linked where it is found, and only its hub travels.
HOT = 512

#: Rounds with another hub for each key, before the pairs that are left (each costs one more pass).
MORE_HUBS = 1

#: What a batch contributes: keys (uint64), nodes (int64), and for each entry the node's
#: size and its room (int32), an upper bound that the key gives for any overlap.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_TYPES = (np.uint64, np.int64, np.int32, np.int32)
#: (n1 least, n1 most, room1, n2 least, n2 most, room2) -> may nodes of such sizes that share the key be linked?
May = Callable[[Column, Column, Column, Column, Column, Column], Column]

SHARED = "key bigint, node bigint, n int, room int, hub bigint, hub_n int"
#: Nodes a and b of the components c1 and c2 that may be linked; the more they have to ``spare`` the likelier.
ACROSS = "c1 bigint, c2 bigint, a bigint, b bigint, spare bigint"


def shared_keys(df: DataFrame, keys: Callable[[], Callable[[pa.RecordBatch], Entries]], entries: int) -> DataFrame:
    """``SHARED`` rows for keys of two or more nodes; ``hub`` is the smallest of a key.

    ``keys()`` makes a task's function from batches to entries; ``entries`` is their
    number in all, from which the number of buckets follows.  Entries travel as packed arrays, one row for each task and
    bucket, sorted by node (which packs well).  A hot key's nodes are linked
    to a local hub within the task and dealt to any bucket, so no task
    receives all nodes of a key."""
    buckets = max(1, -(-entries // BUCKET))

    def make():
        held: list[Entries] = []
        size, of = 0, keys()

        def flush() -> dict | None:
            nonlocal size
            if not size:
                held.clear()
                return None
            k, v, n, room = (np.concatenate(x) for x in zip(*held))
            held.clear()
            size = 0
            order = np.argsort(k, kind="stable")
            k, v, n, room = k[order], v[order], n[order], room[order]
            first = heads(k)
            count = np.diff(np.append(first, len(k)))
            hub = np.repeat(np.minimum.reduceat(v, first), count)
            hot = np.repeat(count >= HOT, count)
            # a hub's entry meets other tasks' in the key's bucket; a second one is its own
            # row, which it must have even if it meets none there
            own = np.append(np.arange(len(k)), np.flatnonzero(hot & (v == hub)))
            near = hot & (v != hub)  # linked here
            near = np.append(near, np.ones(len(own) - len(k), bool))
            hub_n = np.zeros(len(k), np.int32)
            if near.any():
                hub_n = np.repeat(np.maximum.reduceat(np.where(v == hub, n, 0), first), count).astype(np.int32)
            room = n - room  # packs well: often none
            k, v, n, room, hub, hub_n = (x[own] for x in (k, v, n, room, hub, hub_n))
            bucket = (tk.mix(k) % tk.U(buckets)).astype(np.int64)
            bucket[near] = (tk.mix(v[near].view(np.uint64)) % tk.U(buckets)).astype(np.int64)
            order = np.lexsort((v, near, bucket))
            bucket, near, cols = bucket[order], near[order], [x[order] for x in (k, v, n, room, hub, hub_n)]
            cut = np.append(heads(bucket), len(k)).tolist()
            out: dict = {c: [] for c in ("bucket", "k", "v", "n", "room", "hub", "hub_n")}
            for a, z in zip(cut[:-1], cut[1:]):
                m = a + int(np.searchsorted(near[a:z], True))
                out["bucket"].append(int(bucket[a]))
                for c, x in zip(("k", "v", "n", "room"), cols):
                    out[c].append(x[a:z].tobytes())
                for c, x in zip(("hub", "hub_n"), cols[4:]):  # of the last rows, which are linked
                    out[c].append(x[m:z].tobytes())
            return out

        def fn(b: pa.RecordBatch) -> dict | None:
            nonlocal size
            held.append(of(b))
            size += len(held[-1][0])
            return flush() if size >= FLUSH else None

        return fn, flush

    packed = scan_state(df, make, "bucket bigint, k binary, v binary, n binary, room binary, hub binary, hub_n binary")

    def meet(t: pa.Table) -> pa.Table:
        def unpack(c: str, kind: type) -> list[np.ndarray]:
            return [np.frombuffer(x.as_buffer(), kind) for x in t.column(c)]

        cols = [unpack(c, kind) for c, kind in zip(("k", "v", "n", "room"), _TYPES)]
        cols[3] = [n - x for n, x in zip(cols[2], cols[3])]
        hubs, hub_ns = unpack("hub", np.int64), unpack("hub_n", np.int32)
        free = [len(k) - len(h) for k, h in zip(cols[0], hubs)]
        k, v, n, room = (np.concatenate([x[:m] for x, m in zip(c, free)]) for c in cols)
        order = np.lexsort((v, k))
        k, v, n, room = k[order], v[order], n[order], room[order]
        keep = np.ones(len(k), bool)
        keep[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        k, v, n, room = k[keep], v[keep], n[keep], room[keep]
        first = heads(k)
        count = np.diff(np.append(first, len(k)))
        many = np.repeat(count > 1, count)
        met = [x[many] for x in (k, v, n, room, np.repeat(v[first], count), np.repeat(n[first], count))]
        linked = [np.concatenate([x[m:] for x, m in zip(c, free)]) for c in cols] + [np.concatenate(hubs), np.concatenate(hub_ns)]
        k, v, n, room, hub, hub_n = (np.concatenate(x) for x in zip(met, linked))
        return pa.table({"key": k.view(np.int64), "node": v, "n": n, "room": room, "hub": hub, "hub_n": hub_n})

    return packed.groupBy("bucket").applyInArrow(meet, SHARED)


def heads(k: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b); comp is the smallest node
    that can be reached.  Alternating large-star and small-star steps; each round
    is checkpointed, and the edges end as stars around the smallest node."""
    e = _oriented(edges).checkpoint()
    size = _size(e)
    while size[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select("b", "m").toDF("a", "b")
        e2 = _oriented(large)
        low = e2.groupBy("a").agg(F.min("b").alias("m"))
        small = e2.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = _oriented(small).checkpoint()
        if (now := _size(e)) == size:
            break
        size = now
    top = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(top)


def _oriented(e: DataFrame) -> DataFrame:
    return e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _size(e: DataFrame) -> tuple:
    """Equal for equal sets of edges (an order-free checksum of one row)."""
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def _placed(keys: DataFrame, comp: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """The entries with their components so far.  ``keys``: a table of entries, which is read no more then."""
    rows = keys.select("key", "node", "n", "room").join(comp, "node", "left").select("key", "node", "n", "room", F.coalesce("comp", "node").alias("comp"))
    return scratch.table(rows, f"placed{k}")


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (node, comp) after further links (a, b).  Only the components are joined: two of them are one
    edge however many links they have, and nodes that are joined already are not walked again."""
    of_a, of_b = (comp.select(F.col("node").alias(v), F.col("comp").alias(f"c{v}")) for v in "ab")
    edges = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = components(edges)
    moved = comp.join(new.toDF("comp", "top"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return moved.union(new.join(comp, "node", "left_anti"))


def _more(comp: DataFrame, verify: Callable[[DataFrame], DataFrame], pairs: DataFrame, scratch: Scratch, step: int) -> DataFrame:
    """The components after the true links among ``pairs``."""
    found = scratch.table(verify(pairs), f"links{step}")
    scratch.forget()
    if found.isEmpty():
        return comp
    return scratch.table(joined(comp, found), f"comp{step}")


def link_components(
    keys: DataFrame,
    may: May,
    verify: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    descend: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    hubs: bool = False,
) -> DataFrame:
    """(node, comp) of nodes with links.  ``keys``: a table of ``SHARED`` rows.
    ``verify``: pairs (a, b) -> the true links among them.  ``descend``: (pairs of
    components (c1, c2) that share a key, all their (node, comp)) -> ``ACROSS``, the pairs
    of nodes across them that may be linked; without it, those that share a key.  ``hubs``: only the
    pairs of nodes and the smallest hubs, for a caller that finds all pairs across components by itself."""
    n, hub_n, room = (F.col(c) for c in ("n", "hub_n", "room"))
    stars = keys.where("node != hub").where(may(n, n, room, hub_n, hub_n, room))
    stars = scratch.table(_oriented(stars.select(F.col("node").alias("a"), F.col("hub").alias("b"))), "stars")
    # a node's keys may have many hubs: the smallest first, the others only where that one hasn't joined them
    first = stars.groupBy("a").agg(F.min("b").alias("b"))
    edges = scratch.table(verify(first), "links0")
    scratch.forget()
    comp = scratch.table(components(edges), "comp0")
    of_a, of_b = (comp.select(F.col("node").alias(v), F.col("comp").alias(f"c{v}")) for v in "ab")
    rest = stars.join(first, ["a", "b"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left")
    rest = scratch.table(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "rest")
    tested, step = stars, 1
    comp = _more(comp, verify, rest, scratch, step)
    if hubs:
        return scratch.keep(comp)
    placed = _placed(keys, comp, scratch, step)
    for name in ("keys", "rest"):  # read no more
        scratch.drop(name)
    for k in range(MORE_HUBS):
        # another hub for each key: the node that a hash of the nodes puts first, the same one in all keys that it has
        other = placed.groupBy("key").agg(F.min_by(F.struct("node", "n", "room", "comp"), F.xxhash64("node", F.lit(k))).alias("h"))
        met = placed.join(other, "key").where(F.col("comp") != F.col("h.comp")).where(may(n, n, room, F.col("h.n"), F.col("h.n"), F.col("h.room")))
        pairs = _oriented(met.select(F.col("node").alias("a"), F.col("h.node").alias("b"))).join(tested, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, f"hubs{k}")
        if pairs.isEmpty():
            break
        tested, step = tested.union(pairs), step + 1
        comp = _more(comp, verify, pairs, scratch, step)
        placed = _placed(placed, comp, scratch, step)
        scratch.drop(f"placed{step - 1}")

    at = placed.repartition("key").groupBy("key", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("room").alias("room"))
    x, y = at.alias("x"), at.alias("y")
    sides = [F.col(f"{t}.{c}") for t in "xy" for c in ("lo", "hi", "room")]
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & may(*sides))
    met = scratch.table(met.select(F.col("x.key").alias("key"), F.col("x.comp").alias("c1"), F.col("y.comp").alias("c2")), "met")
    if met.isEmpty():
        return scratch.keep(comp)
    if descend:
        pairs = scratch.table(met.select("c1", "c2").distinct(), "pairs")
        across = descend(pairs, placed.select("node", "comp").distinct())
    else:
        a, b = (placed.select("key", F.col("node").alias(v), F.col("comp").alias(c), F.col("n").alias(f"n{v}"), F.col("room").alias(f"r{v}")) for v, c in (("a", "c1"), ("b", "c2")))
        across = met.join(a, ["key", "c1"]).join(b, ["key", "c2"])
        across = across.where(may(*(F.col(c) for c in ("na", "na", "ra", "nb", "nb", "rb"))))
        across = across.groupBy("c1", "c2", "a", "b").agg(F.count("*").alias("spare"))  # the keys that they share
    across = across.select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2"), F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "spare")
    across = scratch.table(across.join(tested, ["a", "b"], "left_anti"), "across")
    # of two components the likeliest pair first, the others only where it doesn't link them
    best = across.groupBy("c1", "c2").agg(F.max(F.struct("spare", "a", "b")).alias("x")).select("x.a", "x.b")
    best = scratch.table(best, "best")
    step += 1
    comp = _more(comp, verify, best, scratch, step)
    of_a, of_b = (comp.select(F.col("node").alias(v), F.col("comp").alias(f"n{v}")) for v in "ab")
    left = across.join(best, ["a", "b"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left")
    left = scratch.table(left.where(F.coalesce("na", "a") != F.coalesce("nb", "b")).select("a", "b"), "left")
    more = scratch.table(verify(left), "links_across")
    scratch.forget()
    if more.isEmpty():
        return scratch.keep(comp)
    return scratch.keep(joined(comp, more))
