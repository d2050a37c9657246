"""The classifiers against plain re-scoring, text by text and letter by letter."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from aircast.llm import chargrams, langid, quality, textkit, toxicity
from aircast.llm.queries import QUERIES

from .helpers import docs_of

SF = "/root/testdata/sf0.001"
M64 = 2**64 - 1
TEXTS = ["", None, " ", "Ünïcode ß straße", "a", "one two  three", "12 34", "x" * 300 + " yz", "İstanbul 中文 🙂 word", "the cat sat on the mat\nthe cat", "a_b-c d'e"]


def bucket(packed, order, bits):
    return (((packed ^ (order * 0x5851F42D4C957F2D & M64)) * 0x9E3779B97F4A7C15) & M64) >> (64 - bits)


def plain_letters(text):
    return [ord(c) if c.isalpha() else 32 for c in f" {(text or '').lower()} "]


# ------------------------------------------------------------------ 5
def plain_grams(text):
    p, out = plain_letters(text), []
    for k in range(3):
        for i in range(k, len(p)):
            own = p[i - k : i + 1][::-1]
            if any(c > 32 for c in own):
                out.append(bucket(sum(c << (21 * j) for j, c in enumerate(own)), k + 1, langid.BITS))
    return out


def test_language_id_against_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, SF).collect()}
    counts, n = {}, Counter()
    for d in docs:
        if d.lang is not None and not held[d.doc_id].held_out:
            n[d.lang] += 1
            counts.setdefault(d.lang, Counter()).update(plain_grams(d.text))
    langs = sorted(n)
    size = {x: sum(counts[x].values()) + langid.SMOOTHING * langid.BUCKETS for x in langs}
    for d in docs[:60]:
        g = Counter(plain_grams(d.text))
        odds = [math.log(n[x] / sum(n.values())) + sum(k * math.log((counts[x][b] + langid.SMOOTHING) / size[x]) for b, k in g.items()) for x in langs]
        best = max(range(len(langs)), key=lambda i: odds[i])
        score = 1 / sum(math.exp(o - odds[best]) for o in odds)
        r = held[d.doc_id]
        assert r.lang_pred == (langs[best] if g else "und") and abs(r.score - (score if g else 0)) < 1e-2


def test_language_grams_of_odd_texts():
    for text in TEXTS:
        points, _, _ = chargrams.letters(pa.array([text], pa.string()))
        got = sorted(b for g in langid.grams(points, 0, len(points)) for b in g.tolist() if b < langid.BUCKETS)
        assert got == sorted(plain_grams(text)), text


# ------------------------------------------------------------------ 4
def mix(x):
    return int(textkit.mix(np.array([x], np.uint64))[0])


def plain_words(text):
    """The subword buckets of every word."""
    p, words, now = plain_letters(text), [], []
    for c in p:
        if c > 32:
            now.append(c)
        elif now:
            words.append(now)
            now = []
    out = []
    for w in words:
        whole = int(textkit.hash_spans(np.array(w, np.uint32), np.array([0]), np.array([len(w)]))[0])
        own, edged = [whole >> (64 - toxicity.BITS)], [32, *w, 32]
        for start in range(len(edged) - 2):
            packed = edged[start] | edged[start + 1] << 21
            for order in toxicity.ORDERS:
                if start + order > len(edged):
                    break
                packed = (mix(packed) if order > 3 else packed) ^ edged[start + order - 1] << 42
                own.append(bucket(packed, order, toxicity.BITS))
        out.append(own)
    return out


def plain_toxicity(m, text):
    words = plain_words(text)
    z = m.bias
    if words:
        z += sum(sum(float(m.weight[b]) for b in w) / len(w) for w in words) / len(words) * len(words) / (len(words) + toxicity.PAD)
    return 1 / (1 + math.exp(-(m.scale[0] * z + m.scale[1])))


def test_toxicity_against_plain_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"))
    assert np.count_nonzero(model.weight) > 0
    rows = docs.limit(30).union(docs_of(spark, TEXTS, [-i - 1 for i in range(len(TEXTS))]).select("doc_id", "text"))
    want = {r.doc_id: plain_toxicity(model, r.text) for r in rows.collect()}
    for r in toxicity.score(rows, model).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-4 and r.predicted == (r.score >= 0.5)


def test_misspellings_change_one_letter():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = "grumble the snarlish".split(), toxicity.misspelt("grumble the snarlish", rng).split()
        assert b[1] == "the" and all(abs(len(x) - len(y)) <= 1 and len(set(x) ^ set(y)) <= 1 for x, y in zip(a, b))


# ----------------------------------------------------------------- 10
def plain_content(text):
    raw = (text or "").encode()
    out = [0.0] * quality.CONTENT
    if not raw:
        return out
    for b, k in Counter(raw).items():
        out[b] = math.sqrt(k / len(raw))
    words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ")
    words = [w.lower() if w.isascii() else w.translate({i: i + 32 for i in range(65, 91)}) for w in words if w]
    if words:
        lines = raw.split(b"\n")
        n = Counter(words)
        out[256] = len(n) / len(words) ** 0.8
        out[257] = len(set(lines)) / len(lines)
        out[258] = math.log1p(sum(len(w.encode()) for w in words) / len(words))
        out[259] = max(n.values()) / len(words)
        out[263] = math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / len(words))
    sign = [0x21 <= b < 0x7F and not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-" for b in raw]
    out[260] = math.sqrt(sum(sign) / len(raw))
    out[261] = math.sqrt(sum(s and a == b for s, a, b in zip(sign[1:], raw[1:], raw)) / len(raw))
    out[262] = math.sqrt(sum(0x30 <= b <= 0x39 for b in raw) / len(raw))
    return out


def test_quality_against_plain_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"))
    rows = docs.limit(40).collect() + docs_of(spark, [*TEXTS, "Ab ab ab\n%%% $$", "##x##"]).collect()
    texts = pa.array([r.text for r in rows], pa.string())
    assert np.allclose(quality.content(texts), [plain_content(r.text) for r in rows], atol=1e-5)
    got = {(r.doc_id, r.text): r for r in quality.score(spark.createDataFrame(rows, docs.schema), model).collect()}
    meta = quality.metadata([r.lang for r in rows], [r.source for r in rows], [r.n_chars for r in rows], texts)
    for r, m in zip(rows, meta):
        z = []
        for view, x in zip(model.views, (plain_content(r.text), m)):
            raw = sum((a - b) / w * c for a, b, w, c in zip(x, view.mean, view.wide, view.weights)) + view.weights[-1]
            z.append(view.scale[0] * min(max(raw, -30), 30) + view.scale[1])
        p = 1 / (1 + math.exp(-(z[0] * model.mix[0] + z[1] * model.mix[1] + model.mix[2])))
        assert abs(got[r.doc_id, r.text].score - p) < 1e-4


@pytest.mark.parametrize("n", [40, 400])
def test_few_labels_calibrate_all_rows(n):
    """Small samples are calibrated by cross-fitting: separable classes come out on their sides."""
    r = np.random.default_rng(n)
    y = (np.arange(n) % 8 > 0).astype(float)
    a, b = (r.normal(size=(n, 12)) + np.outer(y, np.eye(12)[0]) * s for s in (6, 3))
    m = quality.co_train([a, b], y, [a[:10], b[:10]])
    assert ((m.score([a, b])[1] >= 0.5) == y).mean() >= 0.97
