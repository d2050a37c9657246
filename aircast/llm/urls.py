"""URL filters over time: dated list entries, as-of joined to captures.

A list is a feed of dated entries (kind, key, category, seq, on_date, action): 'add' puts a
key on the list, 'remove' takes it off.  Each 'add' becomes a validity interval
that ends at the key's next entry; the last one is open.  A capture is judged by the
intervals that hold its fetch time, whatever the list says today.

Kinds: ``host`` (the host itself), ``domain`` (a host and all below it), ``prefix`` (host and
leading path segments).  The join is on (kind, key, month): an interval is laid into
the months that it covers up to the last capture, so a key that goes on and off the
list for years meets only the intervals of the capture's own month.  Equal captures
(url, time) are joined once, and the judgement is joined back.

URLs are compared without white space around them, with percent-encoding, dot segments, a trailing
dot of the host and the case undone; two leading slashes count as http.  (Internationalised hosts are compared as they are written.)

Defined results: a null or unparsable URL has no host and is never blocked; a null fetch
time meets no interval; entries of one key and date count in the order of seq, so the last one
holds and an interval of no length is none; null keys or dates are no entries; repeated
entries change nothing; an empty list blocks nothing; other columns of captures stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .frames import spare

# The host and the path of a lower-cased URL.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]*)"
PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"


def plain(url: Column) -> Column:
    """The URL as it is compared: lower case, without white space and control characters around it, and with
    a scheme where it begins with two slashes."""
    text = F.lower(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return F.when(F.startswith(text, F.lit("//")), F.concat(F.lit("http:"), text)).otherwise(text)


def decoded(text: Column) -> Column:
    """Percent-encoded characters as themselves (a slash stays encoded); malformed ones stay."""
    safe = F.replace(F.replace(text, F.lit("%2f"), F.lit("%252f")), F.lit("+"), F.lit("%2b"))
    return F.when(F.contains(text, F.lit("%")), F.lower(F.coalesce(F.try_url_decode(safe), text))).otherwise(text)


def host_of(url: Column) -> Column:
    host = decoded(F.regexp_extract(plain(url), HOST, 1))
    return F.coalesce(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def segments_of(url: Column) -> Column:
    """Path segments, decoded, without empty and dot segments."""
    raw = F.transform(F.split(F.regexp_extract(plain(url), PATH, 1), "/"), decoded)
    segments = F.filter(raw, lambda s: ~s.isin("", "."))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    climbed = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.when(F.exists(segments, lambda s: s == ".."), climbed).otherwise(segments)


def keys_of(url: Column, labels_deep: Column | None = None, segments_deep: Column | None = None) -> Column:
    """All (kind, key) that a list may have for a URL: with bounds, only domains of at most so many labels
    and prefixes of at most so many segments (a list has none beyond its own longest key)."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    segments = segments_of(url)

    def entry(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    def between(first: Column, last: Column) -> Column:
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    one, n = F.lit(1), F.size(labels)
    begin = one if labels_deep is None else F.greatest(one, n - labels_deep + 1)
    deep = F.size(segments) if segments_deep is None else F.least(F.size(segments), segments_deep)
    domains = F.transform(between(begin, n - 1), lambda i: entry("domain", F.array_join(F.slice(labels, i, n), ".")))
    prefixes = F.transform(between(one, deep), lambda i: entry("prefix", F.concat_ws("/", host, F.array_join(F.slice(segments, one, i), "/"))))
    found = F.array_distinct(F.concat(F.array(entry("host", host)), domains, prefixes))
    return F.when(host != "", found).otherwise(F.slice(found, 1, 0))


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, category, valid_from, valid_to (null: still on the list)."""
    key = F.lower(F.trim("key"))
    key = F.when(F.col("kind") == "prefix", key).otherwise(F.regexp_replace(key, r"\.+$", ""))
    known = entries.where("key IS NOT NULL AND on_date IS NOT NULL").withColumn("key", key)
    w = W.partitionBy("kind", "key", "category").orderBy("on_date", "seq", "action")
    rows = known.withColumn("valid_to", F.lead("on_date").over(w)).where("action = 'add'")
    return rows.where("valid_to IS NULL OR valid_to > on_date").select("kind", "key", "category", F.col("on_date").alias("valid_from"), "valid_to").distinct()


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_on") -> DataFrame:
    """``captures`` plus host, blocked, n_entries and categories (sorted), which replace columns of
    these names."""
    names = [c for c in captures.columns if c not in ("host", "blocked", "n_entries", "categories")]
    captures = captures.select(*names)
    u, t = spare(captures, "url_"), spare(captures, "at_")
    once = captures.select(F.col(url).alias(u), F.col(at).alias(t)).distinct()
    # the last day held, not past the last capture
    last = once.agg(F.max(t)).scalar()
    until = F.least(F.coalesce(F.date_sub("valid_to", 1), last), last)
    month = F.explode(F.sequence(F.trunc("valid_from", "MM"), F.trunc(F.col("until"), "MM"), F.expr("INTERVAL 1 MONTH")))
    held = intervals(entries)
    laid = held.withColumn("until", until).where("until >= valid_from")
    laid = laid.select("kind", "key", "category", "valid_from", "valid_to", month.alias("month"))
    # no longer keys are made than the list has (a URL may have thousands of segments)
    deep = held.agg(
        F.max(F.when(F.col("kind") == "domain", F.size(F.split("key", r"\.")))).alias("labels"),
        F.max(F.when(F.col("kind") == "prefix", F.size(F.split("key", "/")) - 1)).alias("segments"),
    ).first()
    labels, segments = (F.lit(x or 0) for x in deep)
    asked = once.select(u, t, F.explode(keys_of(F.col(u), labels, segments)).alias("k")).select(u, t, "k.*", F.trunc(t, "MM").alias("month"))
    hits = (
        asked.join(laid, ["kind", "key", "month"])
        .where((F.col("valid_from") <= F.col(t)) & (F.col("valid_to").isNull() | (F.col(t) < F.col("valid_to"))))
        .groupBy(u, t)
        .agg(F.count_distinct("kind", "key", "category").alias(spare(captures, "n_")), F.array_join(F.array_sort(F.collect_set("category")), ",").alias(spare(captures, "c_")))
    )
    n, c = F.col(spare(captures, "n_")), F.col(spare(captures, "c_"))
    met = captures.join(hits, (F.col(url) == F.col(u)) & (F.col(at) == F.col(t)), "left")
    return met.select(
        *names, host_of(F.col(url)).alias("host"), n.isNotNull().alias("blocked"),
        F.coalesce(n, F.lit(0)).alias("n_entries"), F.coalesce(c, F.lit("")).alias("categories"),
    )


def example_entries(captures: DataFrame, url: str = "url") -> DataFrame:
    """A list feed derived from the captures' own keys, so that it grows with them: a
    third of the keys is put on the list on some day of 2024, some are taken off
    again, and some of those come back."""
    keys = captures.select(F.explode(keys_of(F.col(url))).alias("k")).select("k.*").distinct()

    def letter(i: int) -> Column:
        return F.ascii(F.substring("key", i, 1))

    h = F.length("key") * 37 + letter(1) * 11 + letter(5) * 17 + letter(8) * 29
    day = F.lit("2024-01-01").cast("date")
    first = F.pmod(F.col("h"), F.lit(300))
    off = first + 20 + F.pmod(F.col("h"), F.lit(90))
    feed = F.array(
        F.struct(F.lit(1).alias("seq"), first.alias("d"), F.lit("add").alias("action")),
        F.struct(F.lit(2).alias("seq"), F.when(F.col("h") % 2 == 0, off).alias("d"), F.lit("remove").alias("action")),
        F.struct(F.lit(3).alias("seq"), F.when(F.col("h") % 5 == 0, off + 40).alias("d"), F.lit("add").alias("action")),
    )
    rows = keys.withColumn("h", h).where("h % 3 = 0").select("kind", "key", F.explode(feed).alias("e")).select("kind", "key", "e.*").where("d IS NOT NULL")
    return rows.select("kind", "key", F.concat(F.lit("list-"), "kind").alias("category"), "seq", F.date_add(day, F.col("d")).alias("on_date"), "action")
