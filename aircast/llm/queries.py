"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, exact_dedup, jaccard, langid, lines, packing, pieces, quality, search, secret_sql, secrets, toxicity, urls
from .frames import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return deco


@query("op8_benchmark_decontamination", """
WITH low AS (
  SELECT doc_id AS id, 0 AS side, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT item_id, 1, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT id, side, coalesce(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM low),
item AS (
  SELECT DISTINCT id AS item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM w WHERE side = 1 AND len(ws) > 0) q),
lens AS (SELECT DISTINCT n FROM item),
dwin AS (
  SELECT id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lens WHERE side = 0 AND len(ws) >= n) q),
hit AS (SELECT d.id, d.i, d.n, b.item_id FROM dwin d JOIN item b ON b.n = d.n AND b.win = d.win),
pos AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT id, i, n FROM hit) a) b GROUP BY id),
its AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM hit) q GROUP BY id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos ON pos.id = w.id LEFT JOIN its ON its.id = w.id
WHERE side = 0
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.digest(decontaminate.find(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op6_exact_dedup", """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
           FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM k
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    # ids are given in order of arrival: the first half is the snapshot, the second the incoming batch
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return exact_dedup.duplicates(docs, F.col("doc_id") <= F.lit(((lo or 0) + (hi or 0)) // 2))


@query("op1_secret_scan", secret_sql.sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents", "doc_id", "text")))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *quality.COLUMNS)
    return quality.classify(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


@query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op2_url_filter", """
WITH cap AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 400 AS INT) AS fetched_on,
                    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1) AS host,
                    list_filter(string_split(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg
             FROM pages),
hosts AS (SELECT *, string_split(host, '.') AS lab FROM cap WHERE host <> ''),
keys AS (
  SELECT page_id, 'host' AS kind, host AS key FROM hosts
  UNION SELECT page_id, 'domain', array_to_string(lab[i:], '.') FROM (SELECT *, unnest(range(1, len(lab))) AS i FROM hosts) a
  UNION SELECT page_id, 'prefix', host || '/' || array_to_string(seg[1:i], '/') FROM (SELECT *, unnest(range(1, len(seg) + 1)) AS i FROM hosts) b),
hk AS (SELECT DISTINCT kind, key, length(key) * 37 + ascii(substr(key, 1, 1)) * 11 + coalesce(ascii(nullif(substr(key, 5, 1), '')), 0) * 17
         + coalesce(ascii(nullif(substr(key, 8, 1), '')), 0) * 29 AS h FROM keys),
feed AS (
  SELECT kind, key, 1 AS seq, h % 300 AS d, 'add' AS action FROM hk WHERE h % 3 = 0
  UNION ALL SELECT kind, key, 2, h % 300 + 20 + h % 90, 'remove' FROM hk WHERE h % 3 = 0 AND h % 2 = 0
  UNION ALL SELECT kind, key, 3, h % 300 + 60 + h % 90, 'add' FROM hk WHERE h % 3 = 0 AND h % 5 = 0),
iv AS (SELECT kind, key, action, DATE '2024-01-01' + CAST(d AS INT) AS valid_from,
              lead(DATE '2024-01-01' + CAST(d AS INT)) OVER (PARTITION BY kind, key ORDER BY d, seq) AS valid_to FROM feed),
hit AS (SELECT c.page_id, count(DISTINCT (k.kind, k.key)) AS n_entries, string_agg(DISTINCT 'list-' || k.kind, ',' ORDER BY 'list-' || k.kind) AS categories
        FROM cap c JOIN keys k ON k.page_id = c.page_id JOIN iv ON iv.kind = k.kind AND iv.key = k.key
        WHERE iv.action = 'add' AND iv.valid_from <= c.fetched_on AND (iv.valid_to IS NULL OR c.fetched_on < iv.valid_to) GROUP BY c.page_id)
SELECT cap.page_id, fetched_on, host, n_entries IS NOT NULL AS blocked, CAST(coalesce(n_entries, 0) AS BIGINT) AS n_entries, coalesce(categories, '') AS categories
FROM cap LEFT JOIN hit ON hit.page_id = cap.page_id
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    # the pages have no fetch time of their own: one is given to each by its id
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(400)).cast("int"))
    return urls.judge(pages.withColumn("fetched_on", day), urls.example_entries(pages)).drop("url")


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = pieces.load()
    coded = pieces.with_pieces(table(spark, sf_dir, "documents", "doc_id", "text"), v)
    back = pieces.with_text(coded, v, to="decoded")
    return back.select(
        "doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op12_ranked_search", """
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) a, total),
p AS (SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nn) // ll)))) AS v
      FROM tf JOIN size USING (doc_id) JOIN w USING (term), total),
s AS (SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 20
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(alignment.align(table(spark, sf_dir, "documents", "doc_id", "text")))
