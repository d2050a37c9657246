"""Packing, ranked search and tokenizer alignment against plain versions, and on edge tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aircast.llm import alignment, packing, search
from aircast.llm.mphf import PerfectHash
from aircast.llm.queries import QUERIES

from .helpers import docs_of, edge_docs, empty_docs

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = list("abzABZ019.,;:'\"-_=<>|/ \n\t\x0b\x0c\r\x1c\x00\x7f") + [
    "é", "É", "ß", "×", "ª", "µ", "́", "̸", " ", "\u0085", " ", "　", "中", "の", "א", "🙂", "‍", "İ", "Σ", "ﬁ",
    "½", "٣", "'s", "'re", "'LL", " 's", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "endoftext", "▁", "  ", "<s>", "<0x0A>",
]


def odd_texts(seed, n=3000):
    r = random.Random(seed)
    return ["".join(r.choices(ODD, k=r.randint(0, 40))) for _ in range(n)] + [None, "", " ", "<|endoftext|>", "A<|endoftext|>B c", "x" * 5000]


@pytest.fixture
def finely(spark):
    """Many small tasks."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    yield spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(11)
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


# ------------------------------------------------------------------ 11
def token_ids(texts):
    t = Tokenizer.from_file(packing.MODEL)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_words_encoded_once_give_the_tokenizers_ids():
    with open(packing.MODEL, encoding="utf-8") as f:
        own = packing.Tokens(f.read())
    for seed in (1, 2):
        texts = odd_texts(seed)
        ids, off = own.of(pa.array(texts, pa.string()))
        for i, want in enumerate(token_ids(texts)):
            assert ids[off[i] : off[i + 1]].tolist() == want, texts[i]
    own.of(pa.array(["only new words here"]))
    packing.WORDS, old = 10, packing.WORDS
    try:  # a forgotten word is encoded again
        for k in range(4):
            ids, off = own.of(pa.array([f"some words {k} are remembered", "others not"]))
            assert ids.tolist() == sum(token_ids([f"some words {k} are remembered", "others not"]), [])
    finally:
        packing.WORDS = old


def check_pieces(pieces, ids_of, size):
    """Every id in one piece, gapless sequences, and padding only where no power of two is left."""
    seen, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids_of[p.doc_id]
        assert p.doc_tokens == len(own) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
        seen[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert seen.keys() == ids_of.keys()
    for d, spans in seen.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == len(ids_of[d])
    used = []
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= size
        used.append(at)
    total = sum(map(len, ids_of.values()))
    assert sum(u == size for u in used) == total // size
    assert sorted(u for u in used if u != size) == [1 << b for b in range(size.bit_length() - 1) if total % size >> b & 1]


def test_packing_against_the_tokenizer(spark, finely):
    rows = finely.collect()
    ids = {r.doc_id: own + [2] for r, own in zip(rows, token_ids([r.text for r in rows]))}
    check_pieces(packing.pack(finely).collect(), ids, 4096)
    check_pieces(QUERIES["op11_packing"](spark, SF).collect(), ids, 4096)


@pytest.mark.parametrize("size,windows", [(64, 1), (64, 4), (256, 8)])
def test_packing_merges_as_a_tree(spark, size, windows, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 3)
    r = random.Random(size + windows)
    texts = [" ".join(r.choices(["and", "the", "zebra", "house"], k=r.choice([0, 1, 5, 30, 300]))) for _ in range(120)]
    df = docs_of(spark, texts).repartition(20)
    ids = {i: own + [2] for i, own in enumerate(token_ids(texts))}
    rows = packing.pack(df, size=size, open_windows=windows, with_ids=True)
    check_pieces(rows.collect(), ids, size)
    assert all(p.ids == ids[p.doc_id][p.start : p.start + p.length] for p in rows.collect())
    whole = packing.sequences(rows, size=size, pad=9).collect()
    assert sum(s.n_used for s in whole) == sum(map(len, ids.values()))
    assert all(len(s.ids) in (size, s.n_used) for s in whole)


def test_best_fit_keeps_documents_whole():
    p = packing.Packer(10, 2)
    for i, n in enumerate([6, 7, 3, 4]):
        p.add(i, 0, np.arange(n), n)
    assert [[(d, len(x)) for d, _, x, _ in w] for w in p.take()] == [[(1, 7), (2, 3)], [(0, 6), (3, 4)]]
    for i, n in enumerate([5, 6, 7]):  # none fits: the fullest is filled with the next one's head
        p.add(i, 0, np.arange(n), n)
    assert [[(d, s, len(x)) for d, s, x, _ in w] for w in p.take()] == [[(1, 0, 6), (2, 0, 4)]]
    assert len(p.room) == 1 and sum(len(x) for _, _, x, _ in p.pour()) == 8 and not p.take()


def test_packing_edges(spark):
    assert packing.pack(empty_docs(spark)).count() == 0
    rows = packing.pack(edge_docs(spark).withColumns({c: F.lit("x") for c in ("part", "ids", "offset", "start", "up")})).collect()
    assert sum(r.length for r in rows if r.doc_id == 0) == 1 and sum(r.length for r in rows if r.doc_id == 5) == 1
    assert sum(r.doc_id == 4 and r.start == 0 for r in rows) == 2  # rows that repeat an id are documents of their own
    assert sum(r.doc_id is None and r.start == 0 for r in rows) == 2  # documents without an id


# ------------------------------------------------------------------ 12
def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_ranking(docs, items, k=20):
    tf = [(d, Counter(words(t))) for d, t in docs]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    N, L = len(tf), sum(n for *_, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in tf:
            m = 100 - 25 + (25 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,short,k", [(4, 2, 3), (16, 8, 5), (2048, 32, 20)])
def test_search_against_brute_force(spark, block, short, k, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "SHORT", short)
    r = random.Random(block)
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in "aeiouy"] + ["the", "THE", "é", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))][::-1]
    docs = [(i if i % 17 else None, " ".join(r.choices(vocabulary, weights, k=r.choice([0, 1, 3, 20, 200])))) for i in range(150)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(2000, None), (2001, " .,- ")]  # ties
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 8, 40])))) for i in range(12)] + [(50, None), (51, "nowhere"), (3, "the the the ba")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id bigint, text string")
    want = plain_ranking(docs, items, k)
    assert sorted(map(tuple, search.search(d, q, k=k).collect()), key=str) == want
    assert sorted(map(tuple, search.search(d, q, k=k, slice_bytes=60).collect()), key=str) == want  # several slices


def test_skipped_lists_change_nothing(spark):
    """Pruning by bounds: one long document list after the other is skipped once twenty good ones are known."""
    docs = [(i, "rare " * (i < 25) + "common often usual " * 3) for i in range(5000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    q = spark.createDataFrame([("a", "rare common often"), ("b", "usual")], "item_id string, text string")
    assert sorted(map(tuple, search.search(d, q).collect()), key=str) == plain_ranking(docs, [("a", "rare common often"), ("b", "usual")])


def test_search_edges(spark):
    items = spark.createDataFrame([(1, "one two"), (None, "w5"), (2, "")], "item_id bigint, text string")
    assert search.search(empty_docs(spark), items).count() == 0
    assert search.search(edge_docs(spark), items.limit(0)).count() == 0
    rows = search.search(edge_docs(spark).withColumns({c: F.lit("x") for c in ("query", "part", "rank", "term", "tf")}), items.withColumn("score", F.lit(1))).collect()
    assert [(r.rank, r.doc_id) for r in sorted(rows, key=lambda r: r.rank) if r.item_id == 1] == [(1, 4), (2, 4)]
    assert [r.doc_id for r in rows if r.item_id is None] == [3]


# ------------------------------------------------------------------ 13
def test_perfect_hash():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        h = PerfectHash.build(keys)
        assert h.n == len(keys) and sorted(h.numbers(keys).tolist()) == list(range(len(keys)))
        assert len(h.packed) * 8 <= 5 * len(keys) + 600
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([7, 7], np.uint64))


def plain_alignment(texts):
    m = alignment.Models.read()
    t = alignment.Tokenizers(m)
    letters = alignment._byte_letters()
    spelled_a = {i: bytes(letters[c] for c in w) for w, i in t.a.get_vocab(with_added_tokens=False).items()}

    def one(text):
        if not text:
            return None
        raw = (" " + text).encode()
        a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
        x, y = [spelled_a[i] for i in a], [t.of_b.tokens[i] for i in b]
        if b"".join(x) != raw or b"".join(y) != raw:
            return None
        end_a, end_b = np.cumsum([len(v) for v in x]).tolist(), np.cumsum([len(v) for v in y]).tolist()
        pairs, j = [], 0
        for i, e in enumerate(end_a):
            s = end_a[i - 1] if i else 0
            while end_b[j] <= s:
                j += 1
            k = j
            while k < len(b) and (end_b[k - 1] if k else 0) < e:
                pairs.append((a[i], b[k]))
                k += 1
        groups, p, q = [], 0, 0
        for c in sorted(set(end_a) & set(end_b)):
            u, v = end_a.index(c, p) + 1, end_b.index(c, q) + 1
            groups.append(",".join(map(str, a[p:u])) + "|" + ",".join(map(str, b[q:v])))
            p, q = u, v
        return len(a), len(b), len(groups), pairs, ";".join(groups)

    found = [one(x) for x in texts]
    count = Counter(p for f in found if f for p in set(f[3]))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*f[:3], len(f[3]), sum(count[p] == top[p[0]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(f[4].encode()).hexdigest()))
    return out


def test_alignment_against_brute_force(spark, finely):
    rows = finely.limit(250).collect()
    texts = [r.text for r in rows] + odd_texts(7, 600)
    ids = [r.doc_id for r in rows] + [-i - 1 for i in range(len(texts) - len(rows))]
    df = docs_of(spark, texts, ids).repartition(5)
    want = dict(zip(ids, plain_alignment(texts)))
    for slice_pairs in (alignment.SLICE_PAIRS, 2000):
        got = {r.doc_id: tuple(r)[1:] for r in alignment.digest(alignment.align(df, slice_pairs=slice_pairs)).collect()}
        assert got == want


def test_alignment_forgets_and_finds_again(spark, monkeypatch):
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdeé.,'", k=r.randint(1, 6))) for _ in range(200)) for _ in range(30)]
    a = alignment.Aligner(alignment.Models.read(), texts=True)
    monkeypatch.setattr(alignment, "MEMORY", 300)
    monkeypatch.setattr(alignment, "TOGETHER", 7)
    for text, want in zip(texts, plain_alignment(texts)):
        code, _ = a.batch(pa.array([text]))
        assert (a.n_a[code].sum(), a.n_b[code].sum(), a.n_groups[code].sum(), a.pairs.size(code).sum()) == want[:4]
        assert hashlib.sha256(a.groups.take(code).tobytes()[:-1]).hexdigest() == want[6]


def test_alignment_edges(spark):
    assert alignment.align(empty_docs(spark)).count() == 0
    rows = alignment.digest(alignment.align(edge_docs(spark).withColumns({c: F.lit("x") for c in ("groups", "n_a", "bucket", "data")}))).collect()
    assert len(rows) == 9
    assert all((r.n_a, r.n_links, r.groups_sha256) == (0, 0, "") for r in rows if r.doc_id in (0, 1, 6))  # 6 holds U+2581
    assert len({tuple(r) for r in rows if r.doc_id == 4}) == 1
    assert all(r.n_groups <= min(r.n_a, r.n_b) and r.n_links >= max(r.n_a, r.n_b) and 0 <= r.n_best <= r.n_links for r in rows)
