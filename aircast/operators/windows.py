"""E: window operators.  Every window here runs over a *day-level* table
(one row per series and day), or over a bounded group (one conversation,
one series' test rows); raw readings are never windowed whole per series.

``neighbours`` gives the same values without any window over a whole series: rows are dealt by
(series, block of days), and what crosses a block's border comes from a carry table with one
row per block.  The operators take it with ``block_days``, for series too long for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS


def series_window(keys: Sequence[str], order: str = "ds"):
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return w.orderBy(order)


def neighbours(df: DataFrame, *, keys: Sequence[str], lags: dict[str, tuple[str, int]] | None = None, fill: Sequence[str] = (),
               number: str | None = None, count: str | None = None, leads: dict[str, str] | None = None,
               order: str = "ds", block_days: int = 1024) -> DataFrame:
    """Rows with values of their series' other rows, as a two-level scan.

    ``lags``: new column -> (column, n), the value n rows before; ``leads``: new column -> column, the
    next row's value; ``fill``: columns whose gaps take the next known value; ``number`` and ``count``: names for
    the row's number (from 1) and the series' rows.  ``order`` is a date, unique in a series.

    Inside a block (``block_days`` days) these are windows over (series, block).  A block's carry holds the last
    rows before it, the first row and known values after it, and the rows before it; it is made from one row per block: its number
    of rows, its first and last rows and its first known values."""
    keys, lags, leads = list(keys), dict(lags or {}), dict(leads or {})
    deep = max([n for _, n in lags.values()], default=0)
    ahead = list(dict.fromkeys([*fill, *leads.values()]))
    back = list(dict.fromkeys(c for c, _ in lags.values()))
    d = df.withColumn("_blk", F.floor(F.unix_date(F.col(order)) / block_days))
    inner = Window.partitionBy(*keys, "_blk").orderBy(order)

    # one row per block (a block's rows are bounded by its days)
    rows = F.sort_array(F.collect_list(F.struct(order, *[F.col(c) for c in dict.fromkeys([*back, *leads.values()]) if c != order])))
    known = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_first_{c}") for c in fill]
    b = d.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"), rows.alias("_rows"), *known)
    b = b.withColumn("_tail", F.slice("_rows", -F.least(F.lit(max(deep, 1)), F.size("_rows")), F.lit(max(deep, 1)))).withColumn("_head", F.col("_rows")[0]).drop("_rows")
    outer = Window.partitionBy(*keys).orderBy("_blk")
    earlier, later = outer.rowsBetween(Window.unboundedPreceding, -1), outer.rowsBetween(1, Window.unboundedFollowing)
    # a block has a row at least, so the tails of as many blocks as the deepest lag hold enough rows
    tails = [F.coalesce(F.lag("_tail", k).over(outer), F.slice("_tail", F.lit(1), F.lit(0))) for k in range(deep, 0, -1)]
    carry = b.select(
        *keys, "_blk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"),
        *([F.concat(*tails).alias("_tails")] if deep else []),
        F.lead("_head").over(outer).alias("_next"),
        *[F.first(f"_first_{c}", ignorenulls=True).over(later).alias(f"_later_{c}") for c in fill],
    )
    j = d.withColumn("_i", F.row_number().over(inner))
    j = j.withColumns({f"_in_{n}": F.lag(c, k).over(inner) for n, (c, k) in lags.items()})
    j = j.withColumns({f"_in_{n}": F.lead(F.struct(F.col(c).alias("v"))).over(inner) for n, c in leads.items()})
    following = inner.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    j = j.withColumns({f"_in_{c}": F.first(c, ignorenulls=True).over(following) for c in fill})
    # the carry is joined by equality, null keys included
    c = carry.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, "_blk"]})
    on = None
    for k in [*keys, "_blk"]:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    j = j.join(c, on)
    out = {}
    for name, (col, n) in lags.items():
        out[name] = F.when(F.col("_i") > n, F.col(f"_in_{name}")).otherwise(F.get("_tails", F.size("_tails") - (n - F.col("_i") + 1))[col])
    for name, col in leads.items():
        out[name] = F.when(F.col(f"_in_{name}").isNotNull(), F.col(f"_in_{name}.v")).otherwise(F.col("_next")[col])
    for col in fill:
        out[col] = F.coalesce(f"_in_{col}", f"_later_{col}")
    if number:
        out[number] = (F.col("_before") + F.col("_i")).cast("int")
    if count:
        out[count] = F.col("_all")
    return j.withColumns(out).select(*df.columns, *[n for n in out if n not in df.columns])


def lag_features(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, lags: Sequence[int] = (1, 2),
                 cols: dict[str, str] | None = None, order: str = "ds", block_days: int | None = None) -> DataFrame:
    """Lag n of each column, by row (not by calendar).  All lags share
    one window spec, so Spark plans one exchange and one sort."""
    cols = cols or {"temp_mean": "temp_lag", "co2_mean": "co2_lag"}
    if block_days:
        return neighbours(df, keys=keys, lags={f"{p}{n}": (c, n) for c, p in cols.items() for n in lags}, order=order, block_days=block_days)
    w = series_window(keys, order)
    return df.select("*", *[F.lag(c, n).over(w).alias(f"{p}{n}") for c, p in cols.items() for n in lags])


def backfill(df: DataFrame, *, cols: Sequence[str], keys: Sequence[str] = DEFAULT_KEYS, order: str = "ds",
             block_days: int | None = None) -> DataFrame:
    """The next non-null value of the series fills a gap."""
    if block_days:
        return neighbours(df, keys=keys, fill=cols, order=order, block_days=block_days).select(*df.columns)
    w = series_window(keys, order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.select(
        *[F.first(c, ignorenulls=True).over(w).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def co2_diff(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, col: str = "co2_mean", out: str = "co2_diff1",
             order: str = "ds", block_days: int | None = None) -> DataFrame:
    """Day-on-day change."""
    if block_days:
        d = neighbours(df, keys=keys, lags={"_prev": (col, 1)}, order=order, block_days=block_days)
        return d.withColumn(out, F.col(col) - F.col("_prev")).drop("_prev")
    return df.withColumn(out, F.col(col) - F.lag(col, 1).over(series_window(keys, order)))


def rapid_rise(df: DataFrame, *, threshold: float = 100, diff: str = "co2_diff1", out: str = "rapid_rise") -> DataFrame:
    """Change > threshold; an unknown change counts as false."""
    return df.withColumn(out, F.coalesce(F.col(diff) > threshold, F.lit(False)))
