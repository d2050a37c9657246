"""B: parsing, cleaning, projections and filters on readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS, ZONE


def instant_of(text: Column) -> Column:
    """The instant of a text that begins with a date (a bare clock time has none)."""
    dated = F.trim(text).rlike(r"^\d{4}-\d{1,2}-\d{1,2}")
    return F.when(dated, F.try_to_timestamp(text))


def parse_timestamp(df: DataFrame, *, src: str = "ts_raw", out: str = "ts") -> DataFrame:
    """B1: ISO text with or without offset -> instant; unparsable -> NULL.

    Naive text is read in the session zone, which ``configure`` pins to UTC.
    """
    return df.withColumn(out, instant_of(F.col(src)))


def local_time(ts: Column, zone: str = ZONE) -> Column:
    """Wall-clock time of an instant in ``zone`` as TIMESTAMP_NTZ."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def to_local_time(df: DataFrame, *, zone: str = ZONE, ts: str = "ts", out: str = "local_ts") -> DataFrame:
    """B2: instant -> local wall time (DST-aware)."""
    return df.withColumn(out, local_time(F.col(ts), zone))


def drop_bad_timestamps(df: DataFrame, *, ts: str = "ts") -> DataFrame:
    """B3"""
    return df.where(F.col(ts).isNotNull())


def co2_outlier_filter(df: DataFrame, *, co2_max: int = 5000, keep_null: bool = True) -> DataFrame:
    """Drop co2 > co2_max.  A NULL reading stays (a comparison with a
    missing value is not true); ``keep_null=False`` gives the old variant."""
    over = F.col("co2") > co2_max
    return df.where(~over) if not keep_null else df.where(over.isNull() | ~over)


def presence_normalise(df: DataFrame, *, col: str = "presence") -> DataFrame:
    """Presence as boolean; text input goes through ``try_cast``."""
    c = F.col(col)
    dtype = dict(df.dtypes)[col]
    if dtype == "boolean":
        return df
    return df.withColumn(col, F.coalesce(c.try_cast("boolean"), F.lit(False)))


def clean(df: DataFrame, *, zone: str = ZONE, co2_max: int = 5000, keep_null: bool = True) -> DataFrame:
    """A1 + B1-B5: parsed, filtered readings with ``ts`` (instant) and
    ``local_ts`` (wall time in ``zone``)."""
    out = parse_timestamp(df)
    out = drop_bad_timestamps(out)
    out = co2_outlier_filter(out, co2_max=co2_max, keep_null=keep_null)
    out = presence_normalise(out)
    return to_local_time(out, zone=zone)


def quality_counts(raw: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, co2_max: int = 5000) -> DataFrame:
    """Bad timestamps, outliers and kept rows per series, one pass."""
    ts = instant_of(F.col("ts_raw"))
    good = ts.isNotNull()
    over = F.coalesce(F.col("co2") > co2_max, F.lit(False))
    return raw.groupBy(*keys).agg(
        F.count_if(~good).alias("bad_timestamps"),
        F.count_if(good & over).alias("outliers"),
        F.count_if(good & ~over).alias("kept"),
    )


def null_counts(df: DataFrame, *, columns: Sequence[str] | None = None, expected: Sequence[str] = ()) -> DataFrame:
    """NULL count per column as (column_name, n_null) rows plus expected
    columns that are missing (n_null NULL, missing true)."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "n_null").withColumn("missing", F.lit(False))
    miss = [c for c in expected if c not in df.columns]
    if miss:
        spark = df.sparkSession
        extra = spark.createDataFrame([(c,) for c in miss], "column_name string").select(
            "column_name", F.lit(None).cast("bigint").alias("n_null"), F.lit(True).alias("missing")
        )
        long = long.unionByName(extra)
    return long


def drop_incomplete(df: DataFrame, *, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any (or any listed) column."""
    return df.dropna("any", subset=list(subset) if subset else None)


def per_key_bound(df: DataFrame, keys: Sequence[str], expr: Column, name: str) -> DataFrame:
    """Attach one per-series aggregate (e.g. the last timestamp) to every row.

    The aggregate is a hash aggregate with map-side partial combine (one row
    per series and task), joined back on the key.  No window over raw rows:
    a hot series would land in one task.  The joined side has one row per
    series; AQE broadcasts it at runtime when its measured size is under the
    threshold and shuffles (with skew-split) otherwise."""
    if not keys:
        # one global value: a scalar subquery, planned once
        return df.withColumn(name, df.agg(expr).scalar())
    return df.join(df.groupBy(*keys).agg(expr.alias(name)), list(keys), "inner")


def last_n_days(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, ts: str = "ts", days: int = 7,
                partition_col: str | None = None) -> DataFrame:
    """Rows with ts >= max(ts) - days per series (event time, inclusive).

    The readings are read twice: once for each series' last instant (a column-pruned aggregate, one row per
    series), once for the rows.  The bound is laid out as the series' own days (days + 1 rows per
    series), so rows meet it on (series, day): a busy series is dealt by its days, and a silent
    one costs the others nothing.  With ``partition_col`` (the store's UTC ``date``) the earliest
    bound becomes a runtime partition filter too, so the scan lists only the recent partitions."""
    span = F.expr(f"INTERVAL {days} DAYS")
    if not keys:
        # one global value: a scalar subquery, planned once
        return df.where(F.col(ts) >= df.agg(F.max(ts)).scalar() - span)
    last = df.groupBy(*keys).agg(F.max(ts).alias("_mx"))

    def day(c: Column) -> Column:
        return F.to_date(c.cast("timestamp_ntz"))

    if partition_col:
        earliest = last.agg(F.min("_mx") - span).scalar()
        df = df.where(F.col(partition_col) >= day(earliest))
    bound = last.where(F.col("_mx").isNotNull()).select(
        *keys, (F.col("_mx") - span).alias("_from"), F.explode(F.sequence(day(F.col("_mx") - span), day(F.col("_mx")))).alias("_day")
    )
    rows = df.withColumn("_day", day(F.col(ts))).join(bound, [*keys, "_day"])
    return rows.where(F.col(ts) >= F.col("_from")).select(*df.columns)


def since_as_of(df: DataFrame, *, as_of: str, day: str = "ds", days: int = 7) -> DataFrame:
    """Rows with day >= as_of - days; ``as_of`` is an argument, never
    the clock."""
    return df.where(F.col(day) >= F.date_sub(F.lit(as_of).cast("date"), days))


def local_day_bounds(as_of: str, zone: str = ZONE) -> tuple[Column, Column]:
    """UTC instants [lo, hi) of the local calendar day ``as_of``."""
    d = F.lit(as_of).cast("date")
    lo = F.to_utc_timestamp(d.cast("timestamp"), zone)
    hi = F.to_utc_timestamp(F.date_add(d, 1).cast("timestamp"), zone)
    return lo, hi


def local_today(df: DataFrame, *, as_of: str, zone: str = ZONE, ts: str = "ts") -> DataFrame:
    """Readings of the local day ``as_of``.

    The predicate is stated on the raw instant (UTC bounds of the local day,
    DST-aware), so it reaches a scan as a pushed range filter."""
    lo, hi = local_day_bounds(as_of, zone)
    c = F.col(ts)
    return df.where((c >= lo) & (c < hi))


def isin_split(df: DataFrame, *, days: Sequence[str], day_col: str = "day", out: str = "is_office") -> DataFrame:
    """``day.isin(days)`` as a flag; both halves are a filter on it."""
    return df.withColumn(out, F.col(day_col).isin([F.lit(d).cast("date") for d in days]))


def ingest_round(df: DataFrame, *, cols: Sequence[str] = ("temperature", "humidity"), digits: int = 2) -> DataFrame:
    """B13"""
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df


def temp_diff(df: DataFrame) -> DataFrame:
    """Indoor mean minus outdoor maximum."""
    return df.withColumn("temp_diff", F.col("temp_mean") - F.col("outside_temp_max"))
