"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time.

The index holds, for blocks of ``BLOCK`` documents, the postings of the queries' terms
(term by term, documents ascending) and each document's number of terms.
It is built in one scan of the texts; corpus counts (documents, terms, documents of a
term) are summed from it.  Documents stay where they are: every task searches its own
blocks for all queries and sends its best ``k`` of each, which are merged in two steps.

In a block, a query's short lists are summed term by term into accumulators, which
then are one more iterator, bounded by their largest sum, beside the long lists.
The iterators that can't reach the query's ``k``-th best score so far even together
(by the sums of their largest contributions in the block) are not walked: candidates come from the
others, document by document in one sorted sweep, and a candidate is looked up in the skipped lists only
while what is left could still lift it to that score.

Terms are compared as bytes, never by a hash.  Queries are taken in slices of bounded
bytes (one slice is the usual case), each with an index for its terms.

Defined results: a null or empty text, or one without a term, has no postings and doesn't
count as a document; an item without terms has no rows; equal scores go by ascending
doc_id, null last; rows that repeat a doc_id are documents of their own, and items that repeat an
item_id are queries of their own; a very long text is read whole; empty tables give no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import counts
from . import textkit as tk
from .frames import Scratch, prepare, scan_state

K = 20
#: Documents of an index block.
BLOCK = 2048
#: Lists of at most one posting in so many documents are short.
SHORT = 32
#: Bytes of query texts that are searched at once.
SLICE_BYTES = 4 << 20
#: Tasks whose results are merged first.
FAN = 256
NULL_ID = np.iinfo(np.int64).max

INDEX = "n_docs bigint, n_terms bigint, doc_id binary, size binary, term binary, doc binary, tf binary"


def terms(arr: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms, first): term strings (binary) of all texts; those of text i are
    [first[i], first[i + 1])."""
    raw, off = tk.text_bytes(arr)
    low = tk.LOWER[raw]
    start, end = tk.spans(low, off, tk.ALNUM)
    size = end - start
    total = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = low[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(total), pa.py_buffer(flat)]), np.searchsorted(start, off)


class Queries:
    """Items of one slice: their distinct terms, and for each item (term, repeats)."""

    def __init__(self, ids: list, texts: list):
        words, first = terms(pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        self.ids, self.vocabulary = ids, coded.dictionary
        code = np.asarray(coded.indices)
        self.own = [np.unique(code[a:z], return_counts=True) for a, z in zip(first[:-1], first[1:])]


def build_index(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """``INDEX`` rows, one for each block of documents that have terms."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        parts: list[tuple] = []
        waiting = 0

        def flush() -> dict | None:
            nonlocal waiting
            if not waiting:
                return None
            doc_id, size, term, tf = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 4))
            base = np.cumsum([0] + [len(p[0]) for p in parts])
            doc = np.concatenate([p[3] + b for p, b in zip(parts, base)])
            order = np.lexsort((doc, term))
            out = {"n_docs": [len(doc_id)], "n_terms": [int(size.sum())], "doc_id": [doc_id.tobytes()], "size": [size.tobytes()]}
            out |= {c: [x[order].astype(np.int32).tobytes()] for c, x in (("term", term), ("doc", doc), ("tf", tf))}
            parts.clear()
            waiting = 0
            return out

        def fn(b: pa.RecordBatch) -> dict | None:
            nonlocal waiting
            words, first = terms(tk.column(b, "text"))
            size = np.diff(first).astype(np.int64)
            term = np.asarray(pc.fill_null(pc.index_in(words, value_set=held.value), -1)).astype(np.int64)
            some = np.flatnonzero(size)  # documents with terms
            place = np.cumsum(size > 0) - 1
            doc = place[np.repeat(np.arange(len(size)), size)]
            known = term >= 0
            n = max(len(some), 1)
            key, tf = np.unique(term[known] * n + doc[known], return_counts=True)
            ids = np.asarray(pc.fill_null(tk.column(b, "doc_id"), NULL_ID))[some]
            parts.append((ids, size[some], key // n, key % n, tf))
            waiting += len(some)
            return flush() if waiting >= BLOCK else None

        return fn, flush

    return scan_state(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make, INDEX)


def document_counts(index: DataFrame, n: int) -> np.ndarray:
    """Documents of each of the ``n`` terms."""
    groups = -(-max(n, 1) // counts.BLOCK) * counts.BLOCK

    def make():
        total = np.zeros(groups, np.int64)

        def fn(b: pa.RecordBatch) -> None:
            for x in tk.column(b, "term"):
                total[:] += np.bincount(np.frombuffer(x.as_buffer(), np.int32), minlength=groups)

        return fn, lambda: counts.rows(total)

    return counts.add_up(scan_state(index.select("term"), make, counts.SCHEMA), groups)[:n]


class Ranking:
    """The corpus' part of a score, in 64-bit integers."""

    def __init__(self, n_docs: int, n_terms: int, df: np.ndarray):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1.0))).astype(np.int64)

    def contributions(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each posting (``size``: terms of its document), for one occurrence in the query."""
        distinct, at = np.unique(size, return_inverse=True)
        m = np.array([75 + 25 * int(s) * self.n_docs // self.n_terms for s in distinct], np.int64)[at]
        tf = tf.astype(np.int64)
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Best:
    """A query's best ``k`` documents so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a document must have at least; 1 while there are fewer than ``k``."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.append(self.score, score), np.append(self.doc, doc)
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


def _sums(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending documents and the sums of their values."""
    if not len(doc):
        return doc, value
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return doc[first], np.add.reduceat(value[order], first)


def _look_up(docs: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(docs, asked), len(docs) - 1)
    return np.where(docs[at] == asked, values[at], 0)


class Block:
    """One block of the index, with the contributions of its postings."""

    def __init__(self, row: dict, ranking: Ranking):
        self.doc_id, size = (np.frombuffer(row[c], np.int64) for c in ("doc_id", "size"))
        term, self.doc, tf = (np.frombuffer(row[c], np.int32) for c in ("term", "doc", "tf"))
        self.value = ranking.contributions(term, tf, size[self.doc])
        n = len(ranking.weight)
        self.first = np.searchsorted(term, np.arange(n + 1))
        self.most = np.zeros(n, np.int64)
        some = np.flatnonzero(np.diff(self.first))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.value, self.first[some])

    def gather(self, term: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All postings of some terms: documents, contributions."""
        size = self.first[term + 1] - self.first[term]
        before = np.cumsum(size) - size
        at = np.repeat(self.first[term] - before, size) + np.arange(size.sum())
        return self.doc[at], self.value[at] * np.repeat(repeats, size)

    def search(self, term: np.ndarray, repeats: np.ndarray, best: Best) -> None:
        size = self.first[term + 1] - self.first[term]
        short = (size > 0) & (size * SHORT <= len(self.doc_id))
        long = np.flatnonzero((size > 0) & ~short)
        # term at a time: accumulators of the short lists, from here on one iterator
        docs, sums = _sums(*self.gather(term[short], repeats[short]))
        iterators = [(int(sums.max(initial=0)), -1)] if len(docs) else []
        iterators += [(int(self.most[term[i]] * repeats[i]), int(i)) for i in long]
        iterators.sort()
        bound = np.cumsum([x for x, _ in iterators], dtype=np.int64)
        least = best.least
        skipped = int(np.searchsorted(bound, least))  # too weak, even together
        walked = iterators[skipped:]
        if not walked:
            return
        # document at a time over the others
        own = np.array([i for _, i in walked if i >= 0], np.int64)
        doc, value = self.gather(term[own], repeats[own])
        if any(i < 0 for _, i in walked):
            doc, value = np.append(doc, docs), np.append(value, sums)
        doc, value = _sums(doc, value)
        for k in range(skipped - 1, -1, -1):
            keep = value + bound[k] >= least
            doc, value = doc[keep], value[keep]
            if not len(doc):
                return
            i = iterators[k][1]
            if i < 0:
                value = value + _look_up(docs, sums, doc)
            else:
                a, z = self.first[term[i]], self.first[term[i] + 1]
                value = value + _look_up(self.doc[a:z], self.value[a:z], doc) * repeats[i]
        keep = value >= least
        if keep.any():
            best.add(value[keep], self.doc_id[doc[keep]])


def _search_slice(docs: DataFrame, queries: Queries, k: int, scratch: Scratch, name: str) -> DataFrame | None:
    """(query, doc_id, score, part): each task's best ``k``."""
    if not len(queries.vocabulary):
        return None
    index = scratch.table(build_index(docs, queries.vocabulary), name)
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return None
    ranking = Ranking(n_docs, n_terms, document_counts(index, len(queries.vocabulary)))
    held = docs.sparkSession.sparkContext.broadcast((queries.own, ranking))

    def make() -> tuple[Callable, Callable]:
        own, ranking = held.value
        best = [Best(k) for _ in own]

        def fn(b: pa.RecordBatch) -> None:
            for row in b.to_pylist():
                block = Block(row, ranking)
                for (term, repeats), top in zip(own, best):
                    if len(term):
                        block.search(term, repeats, top)

        def close() -> dict:
            query = np.repeat(np.arange(len(best)), [len(x.doc) for x in best])
            doc = np.concatenate([x.doc for x in best])
            return {
                "query": query, "doc_id": pa.array(doc, mask=doc == NULL_ID), "score": np.concatenate([x.score for x in best]),
                "part": np.full(len(doc), TaskContext.get().partitionId()),
            }

        return fn, close

    return scan_state(index.drop("n_docs", "n_terms"), make, "query bigint, doc_id bigint, score bigint, part bigint")


def _slices(items: DataFrame, slice_bytes: int) -> list[DataFrame]:
    """Items dealt by a hash of their row, half-filled on average."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= slice_bytes:
        return [items]
    n = -(-2 * size // slice_bytes)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(part == i) for i in range(n)]


def search(docs: DataFrame, items: DataFrame, k: int = K, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each row of
    ``items`` (item_id, text) that have a score above 0."""
    spark = prepare(docs.sparkSession)
    kind = items.schema["item_id"].dataType
    found = None
    with Scratch(spark, "search") as scratch:
        for i, part in enumerate(_slices(items.select("item_id", "text"), slice_bytes)):
            rows = part.collect()  # bounded by slice_bytes
            hits = _search_slice(docs, Queries([r.item_id for r in rows], [r.text for r in rows]), k, scratch, f"index{i}")
            if hits is None:
                continue
            order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
            top = hits
            for group in ([F.col("query"), F.floor(F.col("part") / FAN)], [F.col("query")]):
                top = top.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
            names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(rows)], f"query bigint, item_id {kind.simpleString()}")
            top = scratch.keep(top.select("query", "rank", "doc_id", "score").join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
            scratch.drop(f"index{i}")
            found = top if found is None else found.union(top)
    if found is None:
        found = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    return found
