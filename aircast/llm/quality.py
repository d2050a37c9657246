"""Quality classifier by co-training on two views of a document.

The content view sees the text alone: the share of every byte value, how many words
and lines are distinct, the length of words.  The metadata view sees what a page
record says about it: language, source, recorded length, number and length of lines.
Each view has a logistic regression.  In every round each one labels the documents of
an unlabelled pool that it is most confident about, and hands them to the other one as
training rows.  In the end each view is calibrated on labelled rows that neither has
trained on, and a logistic regression over the two calibrated log odds, fitted on
the same rows, weighs them; it scores all documents.

Training is bounded: at most ``PER_CLASS`` labelled documents of either class and
``POOL`` unlabelled ones, in the order of a hash of doc_id.

Defined results: null or empty texts have zero shares; null metadata is a value of its own;
conflicting labels of a doc_id count as good; without labels of both classes there is
nothing to reject by, and every score is 1.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import held_out, labelled, scan

#: Bounds of the training sample: bad and good documents, and the unlabelled pool.
PER_CLASS = (2000, 2000)
POOL = 3000
ROUNDS = 4
#: Pseudo-labels that a view hands over in a round, for each class, and how sure it must be.
HANDED = 100
SURE = 0.95
#: Rows of a class that a quarter of the labelled ones must hold to calibrate alone.
CALIBRATE = 30
SOURCES, LANGS = 32, 16
#: Features of the content view.
CONTENT = 264
#: Visible ASCII characters beyond letters, digits and the usual marks of prose.
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = True


def content(arr: pa.Array) -> np.ndarray:
    """(texts, CONTENT): shares of bytes (square roots, so that rare ones count), distinct
    words and lines, word length, the share of the most frequent word, and the shares of rare signs,
    of signs that repeat the one before, of digits and of words that repeat the one before."""
    raw, off = tk.text_bytes(arr)
    size = np.diff(off)
    out = np.zeros((len(size), CONTENT), np.float32)
    sign = _SIGN[raw]
    twice = np.append(False, sign[1:] & (raw[1:] == raw[:-1])) if len(raw) else sign
    digit = (raw >= 0x30) & (raw <= 0x39)
    h, start, end, first = tk.words(raw, off, tk.NOT_SPACE)
    for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if z == a:
            continue
        out[i, :256] = np.sqrt(np.bincount(raw[a:z], minlength=256) / (z - a))
        own = h[first[i] : first[i + 1]]
        if len(own):
            _, n = np.unique(own, return_counts=True)
            lines = raw[a:z].tobytes().split(b"\n")
            # distinct words among up to about 100 are the rule, and fewer the longer the text is
            out[i, 256:260] = len(n) / len(own) ** 0.8, len(set(lines)) / len(lines), np.log1p((end - start)[first[i] : first[i + 1]].mean()), n.max() / len(own)
            out[i, 263] = np.sqrt((own[1:] == own[:-1]).sum() / len(own))
        out[i, 260:263] = np.sqrt([sign[a:z].mean(), twice[a:z].mean(), digit[a:z].mean()])
    return out


def metadata(lang: list, source: list, n_chars: list, arr: pa.Array) -> np.ndarray:
    raw, off = tk.text_bytes(arr)
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    lines = 1 + breaks[off[1:]] - breaks[off[:-1]]
    chars = np.array([np.nan if c is None else max(float(c), 0.0) for c in n_chars])
    known = ~np.isnan(chars)
    size = np.log1p(np.where(known, chars, 0))
    out = np.zeros((len(lines), LANGS + SOURCES + 5), np.float32)
    for i, (x, y) in enumerate(zip(lang, source)):
        out[i, zlib.crc32(str(x).encode()) % LANGS] = 1
        out[i, LANGS + zlib.crc32(str(y).encode()) % SOURCES] = 1
    out[:, LANGS + SOURCES :] = np.stack([known, size, size**2 / 10, np.log(lines), size - np.log(lines)], 1)
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3e-2) -> np.ndarray:
    """Weights (the last one is the offset), by Newton's method with classes of equal weight."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        g = x.T @ (share * (p - y)) + pull * w
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.diag(pull), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class View:
    mean: np.ndarray
    wide: np.ndarray
    weights: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds."""
        z = ((x - self.mean) / self.wide) @ self.weights[:-1] + self.weights[-1]
        return self.scale[0] * np.clip(z, -30, 30) + self.scale[1]


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    mean, wide = x.mean(0), x.std(0) + 1e-2
    return View(mean, wide, logistic((x - mean) / wide, y))


@dataclass
class Model:
    views: list[View] | None
    mix: np.ndarray | None

    def odds(self, xs: list[np.ndarray]) -> np.ndarray:
        return np.stack([v.odds(x) for v, x in zip(self.views, xs)], 1)

    def score(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of each view, combined probability) that a document is good."""
        if self.views is None:
            return np.ones((len(xs[0]), 2)), np.ones(len(xs[0]))
        z = self.odds(xs)
        return sigmoid(z), sigmoid(z @ self.mix[:-1] + self.mix[-1])


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights with the classes as they are, lightly held whatever the scale of x."""
    wide = np.maximum(x.std(0), 1e-6)
    x = np.hstack([x / wide, np.ones((len(x), 1))])
    pull = np.full(x.shape[1], 1e-2)
    pull[-1] = 1e-4
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
    return np.append(w[:-1] / wide, w[-1])


def exchange(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> list[View]:
    """The two views after so many rounds in which each labels the other's rows."""
    train, target = [[x] for x in labelled], [[y], [y]]
    free = [np.ones(len(pool[0]), bool) for _ in pool]  # not yet handed to this view
    views = [fit_view(x, y) for x in labelled]
    for _ in range(rounds):
        for teacher, pupil in ((0, 1), (1, 0)):
            p = sigmoid(views[teacher].odds(pool[teacher])) if len(pool[0]) else np.zeros(0)
            for cls, sure in ((0.0, 1 - p), (1.0, p)):
                best = np.argsort(-np.where(free[pupil], sure, -1), kind="stable")[:HANDED]
                best = best[free[pupil][best] & (sure[best] >= SURE)]
                free[pupil][best] = False
                train[pupil].append(pool[pupil][best])
                target[pupil].append(np.full(len(best), cls))
        views = [fit_view(np.concatenate(t), np.concatenate(z)) for t, z in zip(train, target)]
    return views


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], share: float | None = None, rounds: int = ROUNDS) -> Model:
    """``labelled`` and ``pool``: the two views' features.  ``share``: of good documents
    among all labelled ones, where the sample is balanced otherwise.

    A quarter of the rows isn't trained on and calibrates; where that is fewer than
    ``CALIBRATE`` rows of a class, each quarter is scored by views trained on the others, and all
    rows calibrate views trained on all."""
    y = np.asarray(y, float)
    if len(set(y.tolist())) < 2:
        return Model(None, None)
    quarter = np.empty(len(y), np.int64)  # each with its share of either class
    quarter[np.argsort(y, kind="stable")] = np.arange(len(y)) % 4
    rest = quarter == 0
    few = min((y[rest] == c).sum() for c in (0, 1)) < CALIBRATE
    if not few:
        views = exchange([x[~rest] for x in labelled], y[~rest], pool, rounds)
        z, truth = np.stack([v.odds(x[rest]) for v, x in zip(views, labelled)], 1), y[rest]
    else:
        views, z, truth = exchange(labelled, y, pool, rounds), np.zeros((len(y), 2)), y
        for k in range(4):
            own = quarter == k
            others = views if len(set(y[~own].tolist())) < 2 else exchange([x[~own] for x in labelled], y[~own], pool, rounds)
            z[own] = np.stack([v.odds(x[own]) for v, x in zip(others, labelled)], 1)
    for i, v in enumerate(views):
        a, b = curve(z[:, i : i + 1], truth)
        v.scale = float(max(a, 0.0)), float(b)
        z[:, i] = v.scale[0] * z[:, i] + v.scale[1]
    mix = curve(z, truth)
    if share is not None:
        mix[-1] += np.log(share / (1 - share)) - np.log(truth.mean() / (1 - truth.mean()))
    return Model(views, mix)


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _views(b: pa.RecordBatch) -> list[np.ndarray]:
    text = tk.column(b, "text")
    return [content(text), metadata(*(tk.column(b, c).to_pylist() for c in ("lang", "source", "n_chars")), text)]


def _features(docs: DataFrame, extra: str) -> pd.DataFrame:
    """The features of a bounded sample, on the driver."""

    def run(b: pa.RecordBatch) -> dict:
        xs = _views(b)
        return {"rank": tk.column(b, "rank"), "label": tk.column(b, "label"), "x0": tk.binary(list(xs[0])), "x1": tk.binary(list(xs[1]))}

    rows = docs.withColumn("rank", F.xxhash64("doc_id", "text")).withColumn("label", F.expr(extra).cast("int"))
    return scan(rows, run, "rank bigint, label int, x0 binary, x1 binary").toPandas().sort_values(["rank", "x0"])


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, pool: int = POOL) -> Model:
    """Co-train on ``docs`` (``COLUMNS``) with ``labels`` (doc_id, quality)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *COLUMNS[1:])
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where("quality IS NOT NULL")
    own = _features(labelled(docs, known, "quality", per_class), "label")
    free = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().join(known.select("doc_id"), "doc_id", "left_anti")
    free = free.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pool)
    spare = _features(docs.join(F.broadcast(free), "doc_id"), "NULL")
    share = known.agg(F.avg("quality")).first()[0]

    def arrays(f: pd.DataFrame) -> list[np.ndarray]:
        widths = (CONTENT, LANGS + SOURCES + 5)
        return [np.frombuffer(b"".join(f[c]), np.float32).reshape(-1, w) for c, w in zip(("x0", "x1"), widths)]

    return co_train(arrays(own), own["label"].to_numpy(), arrays(spare), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus content_score, meta_score and score (probability of good
    quality), which replace columns of these names."""
    new = ("content_score", "meta_score", "score")
    names = [c for c in docs.columns if c not in new]
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*names)

    def run(b: pa.RecordBatch) -> dict:
        each, both = held.value.score(_views(b))
        return {c: tk.column(b, c) for c in names} | {"content_score": each[:, 0], "meta_score": each[:, 1], "score": both}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return scan(rows, run, f"{schema}, content_score double, meta_score double, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``."""
    return score(docs, model).where(F.col("score") >= least).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, the views' scores, score, keep; held-out rows don't train."""
    model = fit(docs, labels.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *COLUMNS[1:], held_out().alias("held_out"))
    return score(rows, model).select("doc_id", "held_out", "content_score", "meta_score", "score", (F.col("score") >= 0.5).alias("keep"))
