"""Trend tables over readings.  All are hash aggregates
(partial combine before the exchange), so a hot series does not pile up in
one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS
from ..functions import calendar as cal
from .clean import last_n_days
from .daily import avg_exact


def trend_columns(df: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """hour, weekend, holiday and season of each reading (local time)."""
    d = df.withColumn("_day", F.to_date("local_ts"))
    d = cal.with_holiday(d, holidays, day="_day")
    return (
        d.withColumn("hour", F.hour("local_ts"))
        .withColumn("is_weekend", cal.weekday(F.col("_day")) >= 5)
        .withColumn("season", cal.season_of(F.col("local_ts")))
        .drop("_day")
    )


def _means(metrics: Sequence[str]):
    return [avg_exact(m).alias(f"{m}_mean") for m in metrics]


def profile(df: DataFrame, by: str, *, keys: Sequence[str] = DEFAULT_KEYS, metrics=("co2", "temperature")) -> DataFrame:
    """Mean metrics by one trend column."""
    return df.groupBy(*keys, by).agg(*_means(metrics))


def season_profile(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, metrics=("co2", "temperature")) -> DataFrame:
    """D6 + C4: all four seasons per series, a missing season as NULL.
    The season list is generated per series by ``explode`` (no cross join)
    and the aggregate is left-joined to it."""
    agg = df.groupBy(*keys, "season").agg(*_means(metrics))
    dim = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(s) for s in cal.SEASONS])).alias("season"))
    return dim.join(agg, [*keys, "season"], "left")


SLICES = ("hour", "is_weekend", "is_holiday", "season")


def trend_slices(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, metrics=("co2", "temperature")) -> DataFrame:
    """D3-D6 for all metrics in one pass: GROUPING SETS
    ((k, hour), (k, is_weekend), (k, is_holiday), (k, season)) with a
    ``slice`` label from ``grouping``; one scan, one exchange."""
    sets = [[*[F.col(k) for k in keys], F.col(s)] for s in SLICES]
    g = df.groupingSets(sets, *keys, *SLICES).agg(*_means(metrics), *[F.grouping(s).alias(f"_g_{s}") for s in SLICES])
    label = F.when(F.col("_g_hour") == 0, "hour").when(F.col("_g_is_weekend") == 0, "weekend")
    label = label.when(F.col("_g_is_holiday") == 0, "holiday").otherwise("season")
    return g.withColumn("slice", label).drop(*[f"_g_{s}" for s in SLICES])


def office_vs_home(df: DataFrame, *, office_days: Sequence[str], keys: Sequence[str] = DEFAULT_KEYS, days: int = 7) -> DataFrame:
    """Mean co2 by local hour on the listed days and on the others, over
    the last ``days`` days of each series."""
    d = last_n_days(df, keys=keys, days=days)
    office = F.to_date("local_ts").isin([F.lit(x).cast("date") for x in office_days])
    return d.groupBy(*keys, F.hour("local_ts").alias("hour")).agg(
        F.avg(F.when(office, F.col("co2"))).alias("co2_office"),
        F.avg(F.when(~office, F.col("co2"))).alias("co2_home"),
    )


def distinct_days(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """The local days present per series (sorted on output)."""
    return df.select(*keys, F.to_date("local_ts").alias("day")).distinct().orderBy(*keys, "day")


def latest_per_hour(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """E5: the last reading of each local hour (ties: higher id).

    ``max_by`` on (ts, id) is an aggregate with map-side combine: no sort of
    a whole series, unlike ``row_number`` over a window."""
    cols = [c for c in df.columns if c not in keys]
    d = df.withColumn("day", F.to_date("local_ts")).withColumn("hour", F.hour("local_ts"))
    g = d.groupBy(*keys, "day", "hour").agg(
        F.max_by(F.struct(*cols), F.struct("ts", "id")).alias("r")
    )
    return g.select(*keys, "day", "hour", "r.*")


def co2_extremes(hourly: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Highest and lowest reading per (series, day); on ties the one
    first in newest-first order wins (the newest)."""
    newest_first = -F.unix_micros(F.col("ts"))
    return hourly.groupBy(*keys, "day").agg(
        F.max_by(F.struct("co2", "ts"), F.struct("co2", "ts")).alias("hi"),
        F.min_by(F.struct("co2", "ts"), F.struct("co2", newest_first)).alias("lo"),
    ).select(
        *keys, "day", F.col("hi.co2").alias("max_co2"), F.col("hi.ts").alias("max_ts"),
        F.col("lo.co2").alias("min_co2"), F.col("lo.ts").alias("min_ts"),
    )
