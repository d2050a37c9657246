"""Every operator on empty tables, and on nulls, long texts, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

from aircast.llm import decontaminate, exact_dedup, jaccard, langid, lines, pieces, quality, secrets, toxicity, urls

from .helpers import docs_of, edge_docs, empty_docs

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def edge(spark):
    return edge_docs(spark).cache()


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_secrets_edges(spark, edge):
    assert secrets.digest(secrets.find(empty_docs(spark))).count() == 0
    rows = secrets.digest(secrets.find(edge)).collect()
    assert len(rows) == 9 and all(r.spans == "" and r.n_hex == 0 for r in rows)


def test_urls_edges(spark):
    schema = "page_id bigint, url string, fetched_on date, blocked string"
    feed = spark.createDataFrame([], "kind string, key string, category string, seq int, on_date date, action string")
    caps = spark.createDataFrame([(1, None, None, "x"), (2, "no url", None, None), (3, "http://a.b/", None, None), (3, "http://a.b/", None, None)], schema)
    out = urls.judge(caps, feed).collect()
    assert len(out) == 4 and not any(r.blocked for r in out) and {r.host for r in out} == {"", "a.b"}
    assert urls.judge(spark.createDataFrame([], schema), feed).count() == 0


def test_jaccard_edges(spark, edge):
    assert jaccard.components_of(empty_docs(spark)).count() == 0
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components_of(edge).collect() if r.doc_id is not None)
    assert [g[1:] for g in got if g[1] in (0, 1, 5)] == [(0, 0, 0), (1, 0, 1), (5, 0, 5)]
    assert [g[1:] for g in got if g[1] == 4] == [(4, 6, 4)] * 2
    none = [r for r in jaccard.components_of(edge).collect() if r.doc_id is None]
    assert sorted((r.n_shingles, r.component_id) for r in none) == [(0, None), (8, None)]


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 1), (None, 1, 1), (0, None, None)], LABELS)
    model = toxicity.fit(edge, labels)  # one class only
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == 9 and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.score(empty_docs(spark), model).count() == 0


def test_langid_edges(spark, edge):
    assert langid.identify(empty_docs(spark)).count() == 0
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(edge).collect()}
    assert {(0, "und"), (1, "und"), (5, "und"), (None, "und"), (4, "en")} <= got
    bare = langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in bare} == {("und", 0.0)}


def test_exact_edges(spark, edge):
    assert exact_dedup.duplicates(empty_docs(spark), F.lit(True)).count() == 0
    for snapshot in (F.lit(True), F.lit(False), F.col("doc_id") < 4, F.lit(None).cast("boolean")):
        rows = exact_dedup.duplicates(edge, snapshot).collect()
        white = [r for r in rows if r.text_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"]
        assert len(rows) == 9 and len(white) == 4
        assert {(r.keep_id, r.group_size) for r in white} == {(5, 4)} and sum(r.kept for r in white) == 1
        assert [r.kept for r in rows if r.doc_id == 4].count(True) == 1


def test_lines_edges(spark, edge):
    assert lines.dedup(empty_docs(spark)).count() == 0
    rows = lines.dedup(edge).collect()
    assert len(rows) == 9 and all(r.n_dropped == 0 for r in rows)  # equal rows are one document
    assert sum(r.text is None for r in rows) == 2 and rows[0].asDict().keys() >= {"rid", "row", "drop"}


def test_decontaminate_edges(spark, edge):
    none = items_of(spark, [])
    assert decontaminate.digest(decontaminate.find(edge, none)).where("contaminated").count() == 0
    items = items_of(spark, [(1, None), (2, ""), (3, "w0 w1"), (None, "w5"), (3, "w0 w1")])
    assert decontaminate.find(empty_docs(spark), items).count() == 0
    rows = {r.doc_id: r for r in decontaminate.digest(decontaminate.find(edge, items)).collect()}
    assert rows[3].contaminated and rows[3].n_items == 2 and not rows[4].contaminated
    assert decontaminate.decontaminate(edge, items).columns == edge.columns


def test_pieces_edges(spark, edge):
    v = pieces.load()
    assert pieces.with_pieces(empty_docs(spark), v).count() == 0
    back = pieces.with_text(pieces.with_pieces(edge, v), v, to="again").select("text", "again", "pieces").collect()
    assert len(back) == 9 and all(r.text == r.again for r in back)
    assert [r.pieces for r in back if r.text is None] == [None] * 2


def test_quality_edges(spark, edge):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 1), (3, None, 0)], LABELS)
    model = quality.fit(edge, labels)
    assert quality.score(edge, model).where("score = 1").count() == 9
    assert quality.keep_good(empty_docs(spark), model).count() == 0
    both = spark.createDataFrame([(4, 1, 0), (3, 0, 0), (0, 0, 0), (6, 1, 0)], LABELS)
    assert quality.score(edge, quality.fit(edge, both)).where("score BETWEEN 0 AND 1").count() == 9


def test_docs_helper(spark):
    assert docs_of(spark, ["a", None]).count() == 2


def test_internal_names_may_be_taken(spark):
    """Columns with the names that operators use inside keep their values."""
    names = ("id_", "row_", "lines_", "_id_", "key_", "_key_", "hit_", "spans_", "items_", "url_", "at_", "_url_", "n_", "c_", "__drop", "__id", "__row", "__key", "__in_spans", "__spans", "__items")
    df = spark.createDataFrame([(1, "a line of some five words", "a line of some five words"), (2, "a line of some five words", "x")], "doc_id bigint, text string, spans string")
    df = df.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})

    def same(out, *but):
        for r in out.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names if n not in but)
        return out

    assert same(lines.dedup(df)).where("n_dropped = 1").count() == 1
    same(pieces.with_text(pieces.with_pieces(df, pieces.load()), pieces.load()))
    items = items_of(spark, [(1, "some five words"), (2, "a line of"), (3, "of some")])
    same(decontaminate.find(df, items))
    same(decontaminate.find(df, items, slice_windows=1))
    kept = same(decontaminate.decontaminate(df, items, mode="spans"))
    assert kept.columns == df.columns and {r.spans for r in kept.collect()} == {"a line of some five words", "x"}
    assert decontaminate.decontaminate(df, items).count() == 0
    caps = df.withColumns({"url": F.lit("http://a.b/c"), "fetched_on": F.lit("2024-01-05").cast("date")})
    feed = spark.createDataFrame([("host", "a.b", "l", 1, "2024-01-01", "add")], "kind string, key string, category string, seq int, on_date string, action string")
    assert same(urls.judge(caps, feed.withColumn("on_date", F.col("on_date").cast("date")))).where("blocked").count() == 2


URLS = [
    ("http://bad.com/x", "bad.com", True), ("http://bad.com./x", "bad.com", True), ("http://b%61d.com/x", "bad.com", True), (" \thttp://bad.com/x\n", "bad.com", True),
    ("//bad.com/x", "bad.com", True), ("HTTP://user:pw@BAD.com:80/x", "bad.com", True), ("http://a@b@bad.com/", "bad.com", True), ("http://[2001:db8::1]:80/a", "[2001:db8::1]", True),
    ("http://ok.com/a/../x/y", "ok.com", True), ("http://ok.com/./%78", "ok.com", True), ("http://ok.com//x//", "ok.com", True), ("http://ok.com/a/x", "ok.com", False),
    ("http://ok.com/%2fx", "ok.com", False), ("http://ok.com/%zz/x", "ok.com", False), ("http://ok.com/../../x", "ok.com", True), ("http://notbad.com/x", "notbad.com", False),
    ("http://sub.bad.com/", "sub.bad.com", False), ("http://deep.evil.org/", "deep.evil.org", True), ("bad.com/x", "", False), ("http://ok.com/a+b", "ok.com", True),
]


def test_url_forms(spark):
    feed = [("host", "bad.com."), ("host", "[2001:db8::1]"), ("prefix", "ok.com/x"), ("domain", "Evil.org"), ("prefix", "ok.com/a+b")]
    feed = spark.createDataFrame([(k, v, "l", 1, "add") for k, v in feed], "kind string, key string, category string, seq int, action string").withColumn("on_date", F.lit("2024-01-01").cast("date"))
    caps = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(URLS)], "page_id int, url string").withColumn("fetched_on", F.lit("2024-02-01").cast("date"))
    for r in urls.judge(caps, feed).collect():
        assert (r.host, r.blocked) == URLS[r.page_id][1:], r.url


def test_very_long_urls(spark):
    """Prefixes and domains are made only as deep as the list's own keys."""
    import time

    rows = [(1, "http://ok.com/" + "a/" * 200_000), (2, "http://" + "a." * 100_000 + "evil.org/"), (3, "http://ok.com/" + "../" * 50_000 + "x")]
    feed = spark.createDataFrame([("prefix", "ok.com/a/a", "l", 1, "add"), ("domain", "evil.org", "l", 1, "add"), ("prefix", "ok.com/x", "l", 1, "add")], "kind string, key string, category string, seq int, action string")
    feed = feed.withColumn("on_date", F.lit("2024-01-01").cast("date"))
    caps = spark.createDataFrame(rows, "page_id int, url string").withColumn("fetched_on", F.lit("2024-02-01").cast("date"))
    began = time.time()
    assert all(r.blocked and r.n_entries == 1 for r in urls.judge(caps, feed).select("page_id", "blocked", "n_entries").collect())
    assert time.time() - began < 60
