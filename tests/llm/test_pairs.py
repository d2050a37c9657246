"""Similarity joins and duplicates against brute force."""

import hashlib
import itertools
import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aircast.llm import exact_dedup, jaccard, lines, links
from aircast.llm.frames import Scratch
from aircast.llm.fuse import BinaryFuse, screen_of, semi_join

from .helpers import LOWER, Groups, docs_of, near_copies


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_groups(texts):
    sets = [shingles(t) for t in texts]
    g = Groups(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            g.join(a, b)
    return [(len(s), g.find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_against_brute_force(spark, seed):
    texts = near_copies(seed, families=25, size=6) + ["", None, "a b", "A  B", "a b c", "x y z u v", "X Y\tz u\nv"]
    texts += [" ".join(f"p{i}" for i in range(40)) + f" t{k} u{k} v{k}" for k in range(8)]  # a shared passage
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_groups(texts)


@pytest.mark.parametrize("part, meet", [(256, 1024), (7, 4)])
def test_groups_are_not_expanded_into_pairs(spark, monkeypatch, part, meet):
    """Texts that are linked with a few of a group, none of them its hub: the likeliest pair joins them, the others aren't tested."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(300)]

    def copy(k, own):  # k words replaced, none beside another
        at = {30 * i + r.randrange(20) for i in r.sample(range(10), k)}
        return " ".join(f"{own}x{i}" if i in at else w for i, w in enumerate(base))

    texts = [copy(k, f"d{n}") for n, k in enumerate([4] * 50 + [3] * 4 + [5] * 30)]
    tested, plain = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda points, docs, pairs, scratch: tested.append(pairs.count()) or plain(points, docs, pairs, scratch))
    monkeypatch.setattr(jaccard, "PART", part, raising=False)
    monkeypatch.setattr(jaccard, "MEET", meet, raising=False)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_groups(texts)
    assert sum(tested) < 2 * len(texts)


def test_jaccard_chain_through_round_two(spark):
    """A chain whose links mostly miss the hub of their keys."""
    words = [f"c{i}" for i in range(90)]
    texts = [" ".join(words[3 * k : 3 * k + 60]) for k in range(11)]
    got = {r.doc_id: r.component_id for r in jaccard.components_of(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in jaccard_groups(texts)]


def test_hot_keys_are_linked_within_tasks(spark, monkeypatch):
    monkeypatch.setattr(links, "HOT", 3)
    monkeypatch.setattr(links, "FLUSH", 50)
    monkeypatch.setattr(links, "BUCKET", 40)
    texts = near_copies(3, families=6, size=9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_groups(texts)


def test_hub_of_hot_keys_keeps_its_row(spark):
    """One task, one flush, and every shared key of the group is hot."""
    words = " ".join(f"w{i}" for i in range(200))
    docs = docs_of(spark, [f"{words} own{i}" for i in range(600)]).coalesce(1)
    assert {r.component_id for r in jaccard.components_of(docs).collect()} == {0}


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    g = Groups({x for e in edges for x in e})
    for a, b in edges:
        if a != b:
            g.join(a, b)
    got = links.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.comp for r in got} == {x: g.find(x) for e in edges if e[0] != e[1] for x in e}


def test_joined_components_are_walked_once(spark, monkeypatch):
    """Many links between two components are one edge, and their members are not walked again."""
    comp = [(i, 0) for i in range(40)] + [(100 + i, 100) for i in range(40)] + [(200, 200), (201, 200)]
    more = [(100 + i, j) for i in range(40) for j in range(40)] + [(7, 8), (500, 201), (600, 601), (601, 602)]
    seen, plain = [], links.components
    monkeypatch.setattr(links, "components", lambda e: seen.append(links._oriented(e).count()) or plain(e))
    got = links.joined(spark.createDataFrame(comp, "node bigint, comp bigint"), spark.createDataFrame(more, "a bigint, b bigint")).collect()
    want = {n: 0 for n, _ in comp[:80]} | {200: 200, 201: 200, 500: 200, 600: 600, 601: 600, 602: 600}
    assert sorted((r.node, r.comp) for r in got) == sorted(want.items())
    assert seen == [4]


def test_fuse_filter():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 1000, 40_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        f = BinaryFuse.build(keys)
        assert f.test(keys).all()
        assert f.test(rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.01


def test_semi_join_with_and_without_screen(spark):
    rows = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    keys = spark.range(0, 4000, 7).select((F.col("id") - 100).alias("key"))
    want = sorted(r.k for r in rows.collect() if r.k in {x.key for x in keys.collect()})
    assert sorted(r.k for r in semi_join(rows, "k", keys).collect()) == want
    assert screen_of(keys, limit=10) is None


def test_exact_against_brute_force(spark):
    r = random.Random(2)
    base = ["ab c", "a b c d", "", "é x", "long text " * 50]
    texts = [t.replace(" ", r.choice([" ", "  ", "\n", ""])) for t in r.choices(base, k=60)] + [f"only {i}" for i in range(40)] + [None]
    ids = r.sample(range(1000), len(texts))
    rows = exact_dedup.duplicates(docs_of(spark, texts, ids), F.col("doc_id") < 400).collect()
    norm = {i: re.sub("[\x20\x09-\x0d]", "", t or "") for i, t in zip(ids, texts)}
    size = {i: len(t or "") for i, t in zip(ids, texts)}
    for x in rows:
        same = [i for i in ids if norm[i] == norm[x.doc_id]]
        keep = min(same, key=lambda i: (-size[i], i))
        assert (x.keep_id, x.group_size, x.kept) == (keep, len(same), keep == x.doc_id)
        assert x.text_sha256 == hashlib.sha256(norm[x.doc_id].encode()).hexdigest()


def test_exact_keeps_rows(spark):
    docs = docs_of(spark, ["a b", "ab", "c", "c"], [5, 3, 7, 7])
    assert sorted(r.doc_id for r in exact_dedup.dedup(docs, F.col("doc_id") < 5).collect()) == [5, 7]


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            c = [i + 1]
            for j, y in enumerate(b):
                c.append(min(p[j] + (x != y), p[j + 1] + 1, c[-1] + 1))
            p = c
        return p[-1]

    r = random.Random(0)
    for _ in range(500):
        a = "".join(r.choices("abc", k=r.randint(0, 24)))
        b = a[: r.randint(0, 9)] + "".join(r.choices("abc", k=r.randint(0, 14)))
        most = r.randint(0, 12)
        assert lines.edit_distance(a, b, most) == min(plain(a, b), most + 1)


def test_lines_keep_one_of_each_group(spark):
    a = "the quick brown fox jumps over the lazy dog near the river bank today"
    b = a.replace("lazy", "lazi")  # alike
    c = "an entirely different line about something else that nobody else has written"
    texts = [f"{a}\n{c}\nshort", f"{b}\nshort\nOnly here, in this very document, stands this line.", f"{a.upper()}!\n{a}", None, ""]
    rows = {r.doc_id: r for r in lines.dedup(docs_of(spark, texts)).collect()}
    assert rows[0].text == texts[0] and rows[0].n_dropped == 0
    assert rows[1].text == "short\nOnly here, in this very document, stands this line."
    assert rows[2].text == "" and rows[2].n_dropped == 2 and rows[2].n_lines == 2
    assert rows[3].text is None and rows[4].text == ""


def test_lines_against_brute_force(spark):
    own = [t for t in near_copies(4, families=40, size=4, words=30) if len(t.split()) >= 16]
    r = random.Random(1)
    texts = ["\n".join(r.sample(own, 3)) for _ in range(40)]
    rows = {x.doc_id: x.n_dropped for x in lines.dedup(docs_of(spark, texts)).collect()}
    distinct = sorted({line for t in texts for line in t.split("\n")})
    g = Groups(range(len(distinct)))
    for i, j in itertools.combinations(range(len(distinct)), 2):
        if lines.alike(distinct[i], distinct[j]):
            g.join(i, j)
    seen, want = set(), {}
    for d, t in enumerate(texts):
        for line in t.split("\n"):
            k = g.find(distinct.index(line))
            want[d] = want.get(d, 0) + (k in seen)
            seen.add(k)
    # blocks are exact for two replaced words; a pair with more may be missed
    assert sum(want.values()) * 0.97 <= sum(rows.values()) <= sum(want.values())
    assert all(rows[d] <= n for d, n in want.items())


def shared_lines(a, b, need, bits=10.0):
    """How many of ``a`` share a key with the line of ``b`` at the same place."""
    told = np.full(lines.WORD_GROUPS, bits, np.float32)
    keys = []
    for texts in (a, b):
        x = lines.Lines(pa.array(texts))
        key, line = x.blocks(told, need)
        keys.append(set(zip(x.row[line].tolist(), key.tolist())))
    return len({row for row, _ in keys[0] & keys[1]})


def retyped(line, r, words):
    """``line`` with one letter changed in so many words."""
    w = line.split()
    for i in r.sample(range(len(w)), words):
        w[i] = "#" + w[i] if len(w[i]) < 2 else w[i][:-1] + ("q" if w[i][-1] != "q" else "x")
    return " ".join(w)


def test_lines_have_keys_whatever_the_corpus():
    r = random.Random(6)
    for n, words, need in ((7, 1, 24), (7, 1, 45), (12, 1, 45), (17, 2, 33), (22, 2, 33)):
        a = [" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) for _ in range(200)]
        assert shared_lines(a, [retyped(x, r, words) for x in a], need) >= 200 - 10 * (words - 1), (n, words, need)


def test_blocks_follow_the_length_of_the_line():
    r = random.Random(7)
    for n, words in ((30, 4), (66, 10), (200, 30)):
        a = [" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) for _ in range(200)]
        assert shared_lines(a, [retyped(x, r, words) for x in a], 24, bits=14.0) >= 190, (n, words)


def test_lines_of_few_words(spark):
    """Equal short lines are one group; text without spaces is compared by its characters."""
    han = "".join(chr(0x4E00 + 37 * i) for i in range(40)) + "。" + "".join(chr(0x5000 + 41 * i) for i in range(40))
    texts = ["Read more here\nonly one", f"read  MORE here!\n{han}", f"{han[:30]}的{han[31:]}\nshort", f"short\n{han[::-1]}"]
    rows = {r.doc_id: r.text for r in lines.dedup(docs_of(spark, texts)).collect()}
    assert rows == {0: texts[0], 1: han, 2: "short", 3: texts[3]}


def test_line_places():
    y = lines.Lines(pa.array(["a b\n", "one two three four five\n\n", "x\nsix seven eight nine ten"]))
    assert y.row.tolist() == [1, 2] and y.place.tolist() == [0, 1]
    x = lines.Lines(pa.array(["", "a\n\none two three four five six", None, "seven eight nine ten eleven\nb"]))
    assert x.row.tolist() == [1, 3] and x.place.tolist() == [2, 0]
    assert [x.text(i) for i in range(2)] == ["one two three four five six", "seven eight nine ten eleven"]


def test_scratch_is_removed(spark, tmp_path):
    import os

    with Scratch(spark, "test") as s:
        s.table(spark.range(3), "x")
        root = s.root.replace("file:", "")
        assert os.path.isdir(root)
    assert not os.path.exists(root)


def edited(line, r, edits):
    """``line`` with so many letters replaced, inserted or deleted at places all over it."""
    out = list(line)
    for k in sorted(r.sample(range(1, len(line) - 1), edits), reverse=True):
        how = r.choice("rid")
        if line[k] == " ":
            how = "r" if line[k - 1] != " " != line[k + 1] else "i"
        out[k : k + 1] = {"r": [r.choice("abcdefgh")], "i": [line[k], r.choice("abcdefgh")] if line[k] != " " else [" ", "q"], "d": []}[how]
    return " ".join("".join(out).split())


def line_groups(texts):
    g = Groups(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if lines.alike(texts[i], texts[j]):
            g.join(i, j)
    return [g.find(i) for i in range(len(texts))]


def test_lines_whose_edits_touch_all_blocks(spark):
    """As many edits as are allowed, in different words."""
    r = random.Random(8)
    texts = []
    for n in (2, 6, 10, 20, 40, 80) * 5:
        a = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 8))) for _ in range(n))
        texts += [a, edited(a, r, max(0, len(a) // 10 - 1)), edited(a, r, len(a) // 10)]
    texts = list(dict.fromkeys(texts))
    want = line_groups(texts)
    got = {x.doc_id: x.n_dropped for x in lines.dedup(docs_of(spark, texts)).collect()}
    assert sum(g != i for i, g in enumerate(want)) > 50
    assert got == {i: int(g != i) for i, g in enumerate(want)}


@pytest.mark.parametrize("common", [(2, 4, 8, 16, 32, 64, 128), ()])
def test_pairs_of_blocks_against_brute_force(spark, monkeypatch, common):
    """Small blocks, many rounds; texts of few letters, so that runs are common; text without spaces; each link once."""
    from aircast.llm import line_pairs

    monkeypatch.setattr(line_pairs, "LETTERS", 1500)
    monkeypatch.setattr(line_pairs, "ROUND", 1)
    monkeypatch.setattr(line_pairs, "HITS", 200)
    monkeypatch.setattr(line_pairs, "COMMON", common)
    r = random.Random(9)
    texts = []
    for n in (9, 10, 11, 19, 20, 29, 30, 39, 40, 59, 60, 61, 100, 140) * 4:
        base = "".join(r.choices("ab" if n % 2 else "abcé語", k=n))
        texts += [base] + ["".join(c if r.random() > 0.06 else r.choice("abx") for c in base) for _ in range(4)] + [base[: n - n // 10]]
    texts = list(dict.fromkeys(t for t in texts if len(t) >= 6))
    with Scratch(spark, "test") as scratch:
        rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node bigint, comp bigint, words string")
        found = line_pairs.all_links(rows, lines.alike, scratch)
        assert len(found) > 3
        got = sorted(tuple(sorted(x)) for t in found for x in t.collect())
    assert got == [p for p in itertools.combinations(range(len(texts)), 2) if lines.alike(texts[p[0]], texts[p[1]])]


def test_pairs_within_a_component_are_not_tested(spark):
    from aircast.llm import line_pairs

    a = "one line of many words that others are like"
    rows = spark.createDataFrame([(1, 1, a), (2, 1, a + "s"), (3, 3, a[1:])], "node bigint, comp bigint, words string")
    with Scratch(spark, "test") as scratch:
        found = [tuple(sorted(x)) for t in line_pairs.all_links(rows, lines.alike, scratch) for x in t.collect()]
    assert sorted(found) == [(1, 3), (2, 3)]


def test_scratch_tables_leave_no_shuffle_files(spark, monkeypatch):
    """They go when a table is written, whenever the driver's garbage is collected; the session's setting stays as it was."""
    monkeypatch.setattr(Scratch, "release", lambda self: None)
    dirs = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {p.name for d in dirs for p in Path(d).rglob("shuffle_*.data")}

    before = files()
    with Scratch(spark, "test") as scratch:
        rows = scratch.table(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "rows")
        end = time.time() + 20
        while files() - before and time.time() < end:
            time.sleep(0.2)
        assert not files() - before
        assert sorted(r.k for r in rows.collect()) == list(range(7))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
