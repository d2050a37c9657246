"""Day-level aggregates per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS, ZONE
from .clean import local_time


def day_of(ts: str = "ts", day_zone: str = "UTC"):
    """Calendar day of an instant in ``day_zone`` (the model table uses the
    UTC day, the comparison tables the local day)."""
    if day_zone == "UTC":
        return F.to_date(F.col(ts).cast("timestamp_ntz"))
    return F.to_date(local_time(F.col(ts), day_zone))


def avg_exact(col, scale: int = 10):
    """Mean of readings.

    The sum runs in DECIMAL with ``scale`` places, which no sensor exceeds, so the
    mean does not depend on how rows are split over tasks (float sums do)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast(f"decimal(28,{scale})")).cast("double") / F.count(c)


def daily(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, day_zone: str = "UTC") -> DataFrame:
    """Per (series, day): mean co2 / temperature / humidity, presence
    count and the number of non-null co2 readings.  Partial aggregation runs
    map-side, so a hot series costs one small row per task and day."""
    return df.groupBy(*keys, day_of("ts", day_zone).alias("ds")).agg(
        F.avg("co2").alias("co2_mean"),
        avg_exact("temperature").alias("temp_mean"),
        avg_exact("humidity").alias("hum_mean"),
        F.sum(F.col("presence").cast("bigint")).alias("presence_count"),
        F.count("co2").alias("total_count"),
    )


def presence_ratio(df: DataFrame, *, sleep_hours: int = 8, cap: int | None = 24) -> DataFrame:
    """presence_count := min(presence_count + sleep_hours, cap);
    ratio = presence_count / total_count (hours over readings, as in the
    source: it may exceed 1).  ``sleep_hours=0, cap=None`` is the old form."""
    p = F.col("presence_count") + F.lit(sleep_hours)
    if cap is not None:
        p = F.when(p.isNotNull(), F.least(p, F.lit(cap)))
    return df.withColumn("presence_count", p.cast("bigint")).withColumn(
        "presence_ratio", F.try_divide(F.col("presence_count").cast("double"), F.col("total_count"))
    )


def span_days(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, day: str = "ds") -> DataFrame:
    """First day, last day and span in days per series."""
    return df.groupBy(*keys).agg(
        F.min(day).alias("first_ds"),
        F.max(day).alias("last_ds"),
        F.date_diff(F.max(day), F.min(day)).cast("bigint").alias("span_days"),
        F.count(F.lit(1)).alias("n_days"),
    )


def min_days_guard(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, min_days: int = 7, strict: bool = False) -> DataFrame:
    """Per-series status ``ok`` / ``too_few_days``.  ``strict`` raises
    if any series is short (the only driver action is one boolean)."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days")).withColumn(
        "status", F.when(F.col("n_days") < min_days, F.lit("too_few_days")).otherwise(F.lit("ok"))
    )
    if strict and out.where(F.col("status") != "ok").isEmpty() is False:
        raise ValueError(f"fewer than {min_days} days of data in at least one series")
    return out


def daily_actuals(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, zone: str = ZONE) -> DataFrame:
    """Per local day: mean co2 and temperature."""
    return df.groupBy(*keys, day_of("ts", zone).alias("day")).agg(
        F.avg("co2").alias("actual_co2"), avg_exact("temperature").alias("actual_temp")
    )


def daily_predictions(fc: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Per day: mean predictions (averages over runs if given the
    whole history)."""
    return fc.groupBy(*keys, F.col("ds").alias("day")).agg(
        F.avg("pred_co2").alias("pred_co2"), F.avg("pred_temp").alias("pred_temp")
    )
