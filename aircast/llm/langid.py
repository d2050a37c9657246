"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the 1- to 3-grams (letters, with spaces as word borders) of every
training text, language by language, in ``BUCKETS`` buckets; each task sends packed
counts, which are summed in Spark.  The matrix of log probabilities has a fixed number
of rows and one column for each language; it is broadcast (its size is checked) and
texts are scored in batches.

Defined results: rows with a null language don't train; a text that is null or has
no letter is ``und`` with score 0; with nothing to learn from, every text is ``und``; ties
go to the alphabetically first language; repeated rows count as often as they occur.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chargrams as cg
from . import textkit as tk
from .frames import held_out, scan, scan_state

BITS = 15
BUCKETS = 1 << BITS
ORDERS = 3
SMOOTHING = 0.5
#: Largest broadcast matrix: 64 MB are 500 languages.
MATRIX_BYTES = 64 << 20
UNKNOWN = "und"


def grams(points: np.ndarray, a: int, z: int):
    """Buckets of the n-grams that end at each place of [a, z); BUCKETS marks none."""
    packed, whole, any_letter = np.zeros(z - a, np.uint64), np.ones(z - a, bool), np.zeros(z - a, bool)
    for k in range(ORDERS):
        c = cg.shifted(points, a, z, -k)
        packed |= c << np.uint64(21 * k)
        whole &= c != 0
        any_letter |= c > cg.SPACE
        yield np.where(whole & any_letter, cg.bucket(packed, k + 1, BITS), BUCKETS)


def count(rows: DataFrame) -> DataFrame:
    """lang, docs and packed n-gram counts of ``rows`` (text, lang)."""

    def make():
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def fn(b: pa.RecordBatch) -> None:
            points, start, end = cg.letters(tk.column(b, "text"))
            langs = tk.column(b, "lang").to_pylist()
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs])
            for x in langs:
                docs[x] = docs.get(x, 0) + 1
            found = np.zeros(len(names) * (BUCKETS + 1), np.int64)
            for a in range(0, len(points), cg.STEP):
                z = min(a + cg.STEP, len(points))
                row = of[np.searchsorted(start, np.arange(a, z), "right") - 1] * (BUCKETS + 1)
                for g in grams(points, a, z):
                    found += np.bincount(row + g, minlength=len(found))
            for i, x in enumerate(names):
                own = found.reshape(len(names), -1)[i, :BUCKETS]
                total[x] = total[x] + own if x in total else own

        def close() -> dict:
            task = [TaskContext.get().partitionId()] * len(total)
            return {"lang": list(total), "task": task, "docs": [docs[x] for x in total], "counts": [zlib.compress(c.tobytes(), 1) for c in total.values()]}

        return fn, close

    schema = "lang string, task bigint, docs bigint, counts binary"

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for c in t.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_buffer()), np.int64)
        return pa.table({"lang": pa.array([key[0].as_py()]), "task": pa.array([0], pa.int64()), "docs": pa.array([sum(t.column("docs").to_pylist())], pa.int64()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = scan_state(rows, make, schema)
    parts = parts.groupBy("lang", F.floor(F.col("task") / 64).alias("part")).applyInArrow(add, schema)
    return parts.groupBy("lang").applyInArrow(add, schema)


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray  # (L,)
    log_p: np.ndarray  # (BUCKETS + 1, L), float32; the last row is zero

    def score(self, arr: pa.Array) -> tuple[list[str], np.ndarray]:
        points, start, end = cg.letters(arr)
        total = np.zeros((len(start), len(self.langs)))
        seen = np.zeros(len(start), np.int64)
        if not self.langs:
            return [UNKNOWN] * len(start), np.zeros(len(start))
        for a in range(0, len(points), cg.STEP):
            z = min(a + cg.STEP, len(points))
            first = int(np.searchsorted(start, a, "right")) - 1
            last = int(np.searchsorted(start, z, "left"))
            cut = np.maximum(start[first:last], a) - a
            for k, g in enumerate(grams(points, a, z)):
                total[first:last] += np.add.reduceat(self.log_p[g], cut, axis=0)
                if not k:
                    seen[first:last] += np.add.reduceat((g < BUCKETS).astype(np.int64), cut)
        total += self.prior
        best = total.argmax(1)
        odds = np.exp(total - total.max(1, keepdims=True))
        score = np.where(seen > 0, 1 / odds.sum(1), 0.0)
        return [self.langs[i] if n else UNKNOWN for i, n in zip(best.tolist(), seen.tolist())], score


def fit(rows: DataFrame) -> Model:
    """The model of all ``rows`` (text, lang); one row for each language comes to the driver."""
    rows = rows.where("lang IS NOT NULL")
    n = rows.select("lang").distinct().count()
    if n * BUCKETS * 4 > MATRIX_BYTES:
        raise ValueError(f"{n} languages make a matrix of more than {MATRIX_BYTES} bytes")
    got = sorted(count(rows.select("text", "lang")).collect(), key=lambda r: r.lang)
    if not got:
        return Model([], np.zeros(0), np.zeros((BUCKETS + 1, 0), np.float32))
    c = np.stack([np.frombuffer(zlib.decompress(r.counts), np.int64) for r in got], 1) + SMOOTHING
    log_p = np.zeros((BUCKETS + 1, len(got)), np.float32)
    log_p[:BUCKETS] = np.log(c / c.sum(0))
    docs = np.array([r.docs for r in got], float)
    return Model([r.lang for r in got], np.log(docs / docs.sum()), log_p)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with ``text``) plus lang_pred and score, which replace columns of these names."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*names)

    def run(b: pa.RecordBatch) -> dict:
        langs, score = held.value.score(tk.column(b, "text"))
        return {c: tk.column(b, c) for c in names} | {"lang_pred": langs, "score": score}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return scan(kept, run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the rows that aren't held out train."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", held_out().alias("held_out"))
    model = fit(rows.where("NOT held_out"))
    return predict(rows.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")
