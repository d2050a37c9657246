"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character 3- to 7-grams (with its borders)
and of the whole word, hashed into ``BUCKETS`` buckets, so an unseen misspelling or
compound shares most of its vectors with the word it comes from.  A text is the
mean of its words; a linear softmax over it gives the odds.  Vectors and softmax are
trained jointly (Adam, full batches, in NumPy); a fifth of the sample isn't
trained on and calibrates the score.

Training takes a bounded sample of labelled rows: at most ``PER_CLASS`` texts of
the two classes, in the order of a hash of their id, of at most ``MAX_CHARS`` characters.  Every row is scored on its whole text:
once trained, a bucket needs only its dot product with the softmax, one number.

Defined results: conflicting labels of a doc_id count as toxic; null labels don't
count; a null or empty text, or one without a word, has the score of a text without
any evidence; with one class only there is nothing to learn and every score is 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chargrams as cg
from . import textkit as tk
from .frames import held_out, labelled, scan

BITS = 16
BUCKETS = 1 << BITS
ORDERS = (3, 4, 5, 6, 7)
#: Words without evidence that every text is averaged with.
PAD = 8.0
DIM = 4
#: Occurrences of a bucket that its log odds are shrunk by.
SHRINK = 10.0
#: Standard deviations by which a bucket must stand out to start with odds.
SURE = 5.0
#: And by which it must stand out to have a vector at all.
SOME = 2.0
#: Texts of the sample that are taken apart at once.
AT_ONCE = 100
#: Bounds of the training sample: clean and toxic texts.
PER_CLASS = (3000, 1500)
#: And the longest text that is trained on (longer ones are scored like all others).
MAX_CHARS = 20_000
EPOCHS = 20
RATE = 0.02
SEED = 7
LONGER_WORD = re.compile(r"[^\W\d_]{4,}")


@dataclass
class Words:
    """The words of a batch: their subword buckets (flat), and the words of each text."""

    grams: np.ndarray  # buckets, grouped by word
    size: np.ndarray  # buckets of each word
    first: np.ndarray  # words of text i are first[i]:first[i+1]


def words_of(arr: pa.Array) -> Words:
    points, start, end = cg.letters(arr)
    letter = points > cg.SPACE
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    begin, stop = edge[::2], edge[1::2]
    if not len(begin):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(start) + 1, np.int64))
    whole = tk.hash_spans(points, begin, stop)
    grams, owner = [(whole >> np.uint64(64 - BITS)).astype(np.int64)], [np.arange(len(begin))]
    for a in range(0, len(points), cg.STEP):
        z = min(a + cg.STEP, len(points))
        at = np.flatnonzero(letter[a:z]) + a
        word = np.searchsorted(begin, at, "right") - 1
        c = [points[np.minimum(at + k, len(points) - 1)].astype(np.uint64) for k in range(-1, ORDERS[-1] - 1)]
        fits = np.ones(len(at), bool)
        packed = c[0] | c[1] << np.uint64(21)
        for order in ORDERS:
            # the n-gram begins before its word's letter ``at``; only its ends may be borders
            if order > 3:
                fits = fits & (c[order - 2] > cg.SPACE)
                packed = tk.mix(packed)
            packed = packed ^ (c[order - 1] << np.uint64(42))
            grams.append(cg.bucket(packed, order, BITS)[fits])
            owner.append(word[fits])
    g, o = np.concatenate(grams), np.concatenate(owner)
    order_ = np.argsort(o, kind="stable")
    first = np.searchsorted(begin, start)
    return Words(g[order_], np.bincount(o, minlength=len(begin)), np.append(first, len(begin)))


def means(x: np.ndarray, cut: np.ndarray, total: int) -> np.ndarray:
    """Means of the runs of x (rows) that begin at ``cut``; no run is empty."""
    size = np.diff(np.append(cut, total))
    sums = np.add.reduceat(x, cut, axis=0)
    return sums / (size[:, None] if x.ndim == 2 else size)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: its vector times the softmax
    bias: float
    scale: tuple[float, float]  # calibration
    constant: float | None = None

    def odds(self, arr: pa.Array) -> np.ndarray:
        """Log odds before calibration; without words, the bias alone."""
        w = words_of(arr)
        out = np.full(len(w.first) - 1, self.bias)
        if len(w.size):
            word = means(self.weight[w.grams], np.cumsum(w.size) - w.size, len(w.grams))
            has = np.flatnonzero(np.diff(w.first))
            n = np.diff(w.first)[has]
            out[has] += means(word, w.first[has], len(word)) * n / (n + PAD)
        return out

    def score(self, arr: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(arr), self.constant)
        a, b = self.scale
        return sigmoid(a * self.odds(arr) + b)


def text_grams(texts: list[str]):
    """For some texts at a time: their number, and (text, bucket, weight) of each
    bucket that a text holds; weights sum to n / (n + PAD) over its n words."""
    for a in range(0, len(texts), AT_ONCE):
        own = texts[a : a + AT_ONCE]
        w = words_of(pa.array(own, pa.string()))
        n = np.diff(w.first)
        word = np.repeat(np.arange(len(w.size)), w.size)
        text = np.repeat(np.arange(len(own)), n)[word] if len(word) else word
        key, at = np.unique(text * BUCKETS + w.grams, return_inverse=True)
        weight = np.bincount(at, 1 / w.size[word] / (n[text] + PAD), len(key))
        yield len(own), key // BUCKETS, key % BUCKETS, weight


def misspelt(text: str, rng: np.random.Generator) -> str:
    """The text with one letter of each longer word doubled, left out or swapped with the one before."""

    def one(m: re.Match) -> str:
        w = m.group()
        k = int(rng.integers(1, len(w)))
        return (w[:k] + w[k - 1 :], w[:k] + w[k + 1 :], w[: k - 1] + w[k] + w[k - 1] + w[k + 1 :])[rng.integers(3)]

    return LONGER_WORD.sub(one, text)


def train(texts: list[str], labels: np.ndarray, share: float | None = None, seed: int = SEED) -> Model:
    """Fit vectors and softmax on labelled texts; a fifth of them calibrates.

    Every text is there twice, once with misspelt words, so that the odds of a
    word also come to rest on the n-grams that a misspelling leaves.

    A text's mean is linear in the vectors, so each text is one sparse row of bucket
    weights.  Buckets that occur in toxic texts about as often as in others
    (within ``SOME`` standard deviations) stay at zero.  The others' vectors start along the
    softmax at their shrunken log odds, plus noise; then vectors and softmax learn
    together.  ``share``: of toxic texts among all (the sample holds relatively
    more of them); by default that of the sample."""
    labels = np.asarray(labels, float)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, (1.0, 0.0), constant=0.0)
    fit = np.arange(len(texts)) % 5 != 0
    fit |= not (set(labels[fit].tolist()) == set(labels[~fit].tolist()) == {0.0, 1.0})
    rng = np.random.default_rng(seed)
    texts = [*texts, *(misspelt(t, rng) for t in texts)]
    labels, fit = np.tile(labels, 2), np.tile(fit, 2)
    own, y = [t for t, f in zip(texts, fit) if f], labels[fit]

    held = np.zeros((2, BUCKETS))  # clean and toxic texts that hold a bucket
    at = 0
    for n, text, bucket, _ in text_grams(own):
        for c in (0, 1):
            held[c] += np.bincount(bucket[y[at + text] == c], minlength=BUCKETS)
        at += n
    expected = held.sum(0) * y.mean()
    apart = np.abs(held[1] - expected) / np.sqrt(expected + 1)
    odds = np.where(apart >= SURE, np.log((held[1] + SHRINK) / (expected + SHRINK)), 0)
    some = np.flatnonzero(apart >= SOME)
    place = np.full(BUCKETS, -1)
    place[some] = np.arange(len(some))

    rows, cols, values, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], 0
    for n, text, bucket, weight in text_grams(own):
        keep = place[bucket] >= 0
        rows.append(at + text[keep])
        cols.append(place[bucket[keep]])
        values.append(weight[keep])
        at += n
    row, col, value = (np.concatenate(x) for x in (rows, cols, values))
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))

    def product(to: np.ndarray, other: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """The sparse matrix (or its transpose) times x."""
        return np.stack([np.bincount(to, value * x[other, d], n) for d in range(x.shape[1])], 1)

    rng = np.random.default_rng(seed)
    way = np.eye(DIM)[0]
    params = {"E": odds[some][:, None] * way + rng.normal(0, 0.01, (len(some), DIM)), "W": np.zeros((DIM, 2)), "b": np.zeros(2)}
    slope, offset = calibrate(product(row, col, params["E"], len(y))[:, 0], y)
    params["W"] += np.outer(way, [-slope / 2, slope / 2]) + rng.normal(0, 0.01, (DIM, 2))
    params["b"] += [-offset / 2, offset / 2]
    m1, m2 = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    rate = {"E": RATE, "W": RATE * max(slope, 1), "b": RATE}
    for epoch in range(EPOCHS):
        s = product(row, col, params["E"], len(y))
        logits = s @ params["W"] + params["b"]
        dz = weight * (sigmoid(logits[:, 1] - logits[:, 0]) - y)
        dl = np.stack([-dz, dz], 1)
        grad = {"E": product(col, row, dl @ params["W"].T, len(some)), "W": s.T @ dl, "b": dl.sum(0)}
        for k, g in grad.items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            step = (m1[k] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(m2[k] / (1 - 0.99 ** (epoch + 1))) + 1e-7)
            params[k] = params[k] - rate[k] * step
    gap = params["W"][:, 1] - params["W"][:, 0]
    bucket_weight = np.zeros(BUCKETS, np.float32)
    bucket_weight[some] = params["E"] @ gap
    model = Model(bucket_weight, float(params["b"][1] - params["b"][0]), (1.0, 0.0))
    rest = [t for t, f in zip(texts, fit) if not f] or own
    truth = labels[~fit] if not fit.all() else y
    z = np.concatenate([model.odds(pa.array(rest[a : a + AT_ONCE], pa.string())) for a in range(0, len(rest), AT_ONCE)])
    slope, offset = calibrate(z, truth)
    if share is not None:
        offset += np.log(share / (1 - share)) - np.log(truth.mean() / (1 - truth.mean()))
    model.scale = slope, float(offset)
    return model


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (z, y), lightly held to a finite slope."""
    mid, wide = float(np.median(z)), float(z.std()) or 1.0
    x = np.stack([(z - mid) / wide, np.ones(len(z))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-4])
        w = w - np.linalg.solve(h, x.T @ (p - y) + np.array([1e-2, 1e-4]) * w)
    if w[0] <= 0:  # nothing learnt
        return 0.0, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    return float(w[0] / wide), float(w[1] - w[0] * mid / wide)


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> Model:
    """The model of the labelled rows of ``docs`` (doc_id, text) that aren't held out."""
    labels = labels.select("doc_id", "toxic").where(~held_out() & F.col("toxic").isNotNull())
    short = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= MAX_CHARS)
    rows = labelled(short, labels, "toxic", per_class)
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").toPandas()
    share = labels.agg(F.avg("toxic")).first()[0]
    return train([t or "" for t in got["text"]], got["label"].to_numpy(), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> dict:
        s = held.value.score(tk.column(b, "text"))
        return {"doc_id": tk.column(b, "doc_id"), "held_out": tk.column(b, "held_out"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return scan(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")
