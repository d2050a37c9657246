"""Benchmark decontamination: a broadcast hash set of normalised test n-grams,
scanned against every word window of the training texts.

A window is ``n`` consecutive words of an item; an item of fewer words (not
none) is one window of its own length.  The windows of the benchmark are a
sorted array of 64-bit hashes, broadcast in slices of at most ``slice_windows``
windows: one slice is the usual case, a larger benchmark takes one scan for each slice.
Every hash hit is verified by comparing the words themselves.

Defined results: a null or empty text has no words and is never contaminated; a
null item has no windows; a null item_id is the id ""; items that repeat an id count once; extra columns
of either table are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import textkit as tk
from .frames import prepare, scan, spare

#: Window length in words.
WINDOW = 10
#: Windows broadcast at once: 8 bytes of hash and about 100 bytes of words each.
SLICE_WINDOWS = 500_000

HITS = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"


def item_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct (words, n, item_id) of the benchmark; ``words`` is the window joined by spaces."""

    def run(b: pa.RecordBatch) -> dict:
        raw, off = tk.text_bytes(tk.column(b, "text"))
        low = tk.LOWER[raw].tobytes()
        start, end = tk.spans(np.frombuffer(low, np.uint8), off, tk.ALNUM)
        first = np.searchsorted(start, off)
        out: list[tuple] = []
        for i, item in enumerate(tk.column(b, "item_id").to_pylist()):
            w = [low[s:e] for s, e in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])]
            k = min(n, len(w))
            out += [(b" ".join(w[j : j + k]).decode(), k, item) for j in range(len(w) - k + 1 if k else 0)]
        return {"words": [x[0] for x in out], "n": [x[1] for x in out], "item_id": [x[2] for x in out]}

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return scan(rows, run, "words string, n int, item_id string").distinct()


class Slice:
    """Some benchmark windows: hashes sorted by length, and what they stand for."""

    def __init__(self, rows: list):
        self.by_n: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.items: dict[str, list[str]] = {}
        for r in rows:
            self.items.setdefault(r.words, []).append(r.item_id)
        for n in {r.n for r in rows}:
            texts = sorted(w for w in self.items if w.count(" ") == n - 1)
            raw, off = tk.text_bytes(pa.array(texts))
            h, _, _, first = tk.words(raw, off, tk.ALNUM)
            keys = np.unique(tk.windows(h, n)[first[:-1]])
            self.by_n[n] = keys, np.bincount((keys & tk.U(0xFFFFF)).astype(np.int64), minlength=1 << 20) > 0

    def hits(self, h: np.ndarray, n: int) -> np.ndarray:
        """Places where the window of n words may be one of the benchmark's."""
        keys, screen = self.by_n[n]
        w = tk.windows(h, n)
        at = np.flatnonzero(screen[(w & tk.U(0xFFFFF)).astype(np.int64)])
        found = np.searchsorted(keys, w[at])
        return at[keys[np.minimum(found, len(keys) - 1)] == w[at]]


def _scan_slice(docs: DataFrame, s: Slice) -> DataFrame:
    b = docs.sparkSession.sparkContext.broadcast(s)
    names = docs.columns

    def run(batch: pa.RecordBatch) -> dict:
        s = b.value
        raw, off = tk.text_bytes(tk.column(batch, "text"))
        h, start, end, first = tk.words(raw, off, tk.ALNUM)
        low = tk.LOWER[raw].tobytes()
        found: list[dict[int, int]] = [{} for _ in range(len(first) - 1)]
        items: list[set[str]] = [set() for _ in found]
        for n in s.by_n:
            at = s.hits(h, n)
            doc = np.searchsorted(first, at, "right") - 1
            for i, d in zip(at.tolist(), doc.tolist()):
                if i + n <= first[d + 1]:
                    text = b" ".join(low[x:y] for x, y in zip(start[i : i + n], end[i : i + n])).decode("utf-8", "replace")
                    if text in s.items:  # else the hashes met by chance
                        k = i - int(first[d])
                        found[d][k] = max(found[d].get(k, 0), k + n)
                        items[d].update(s.items[text])
        out = {c: tk.column(batch, c) for c in names}
        out["n_words"] = np.diff(first)
        out["spans"] = [[{"first": a, "last": z} for a, z in merge(sorted(f.items()))] for f in found]
        out["items"] = [sorted(x) for x in items]
        return out

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return scan(docs, run, f"{kept}, {HITS}")


def merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of sorted half-open intervals."""
    out: list[list[int]] = []
    for a, z in intervals:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def slices(items: DataFrame, n: int, slice_windows: int) -> Iterator[Slice]:
    """Windows dealt to slices by hash; one slice at a time is in the driver."""
    w = item_windows(items, n)
    count = w.count()
    if count <= slice_windows:
        yield Slice(w.collect())
        return
    # half-filled on average, so that an uneven deal stays within the bound
    k = -(-2 * count // slice_windows)
    w = materialize(w.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(k))))
    for i in range(k):
        yield Slice(w.where(F.col("part") == i).drop("part").collect())


def find(docs: DataFrame, items: DataFrame, n: int = WINDOW, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """``docs`` (with a ``text`` column) plus n_words, spans (word intervals
    [first, last) that are hit, merged) and items (ids with occurring windows), which
    replace columns of these names."""
    prepare(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in ("n_words", "spans", "items")])
    spans, found = spare(docs, "spans_"), spare(docs, "items_")
    out = None
    for s in slices(items, n, slice_windows):
        if out is None:
            out = _scan_slice(docs, s)
        else:
            out = _scan_slice(out.withColumnsRenamed({"spans": spans, "items": found}).drop("n_words"), s).select(
                *docs.columns, "n_words",
                _union_spans(F.concat(spans, "spans")).alias("spans"),
                F.array_sort(F.array_union(found, "items")).alias("items"),
            )
    return out


def _union_spans(c):
    """Merge an array of intervals (it has at most one entry for each window of a text)."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))),
        )
        return F.when((F.size(acc) > 0) & (x["first"] <= last["last"]), joined).otherwise(F.concat(acc, F.array(x)))

    empty = F.from_json(F.lit("[]"), "array<struct<first:bigint,last:bigint>>")
    return F.aggregate(F.array_sort(c), empty, step)


def remove_spans(texts: list[str | None], spans: list[list[dict]]) -> list[str | None]:
    """Texts without the hit words and what stands between them."""
    out = []
    for text, hit in zip(texts, spans):
        if not hit:
            out.append(text)
            continue
        raw = text.encode()
        buf = np.frombuffer(raw, np.uint8)
        start, end = tk.spans(tk.LOWER[buf], np.array([0, len(raw)]), tk.ALNUM)
        kept, at = [], 0
        for s in hit:
            kept.append(raw[at : start[s["first"]]])
            at = end[s["last"] - 1]
        out.append(b"".join([*kept, raw[at:]]).decode())
    return out


def _kept(docs: DataFrame, items: DataFrame, n: int, slice_windows: int) -> tuple[DataFrame, str]:
    """``docs`` with all its own columns and the spans under a name of their own."""
    names, aside = docs.columns, {}
    for c in ("n_words", "spans", "items"):
        if c in names:
            aside[c] = spare(docs, c + "_")
    hit = spare(docs.withColumnsRenamed(aside), "hit_")
    rows = find(docs.withColumnsRenamed(aside), items, n, slice_windows).withColumnRenamed("spans", hit).drop("n_words", "items")
    return rows.withColumnsRenamed({v: k for k, v in aside.items()}).select(*names, hit), hit


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", n: int = WINDOW,
                  slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """``mode="documents"``: contaminated rows go.  ``mode="spans"``: the hit
    words are cut out and the rest of the text stays."""
    names = docs.columns
    if mode == "documents":
        rows, hit = _kept(docs, items, n, slice_windows)
        return rows.where(F.size(hit) == 0).drop(hit)
    if mode != "spans":
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    hit, spans = _kept(docs, items, n, slice_windows)

    def run(b: pa.RecordBatch) -> dict:
        out = {c: tk.column(b, c) for c in names}
        out["text"] = remove_spans(tk.column(b, "text").to_pylist(), tk.column(b, spans).to_pylist())
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return scan(hit, run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The per-document report of ``find``."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


