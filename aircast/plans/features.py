"""K1-K3: the feature matrix, one row per series and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS
from ..functions import calendar as cal
from ..operators import windows as W
from ..operators.clean import temp_diff

LAG_COLS = ["temp_lag1", "temp_lag2", "co2_lag1", "co2_lag2"]

FEATURE_COLUMNS = [
    "ds", "co2_mean", "temp_mean", "hum_mean", "presence_count", "total_count", "presence_ratio",
    "outside_temp_max", "outside_temp_min", "precipitation", "cloudcover", "wind", "solar_radiation",
    "temp_diff", "temp_lag1", "temp_lag2", "co2_lag1", "co2_lag2", "co2_diff1", "rapid_rise",
    "is_weekend", "is_holiday", "dayofweek", "day_sin", "day_cos",
]


def join_weather(daily: DataFrame, weather: DataFrame) -> DataFrame:
    """Inner equi join on ds.  Weather has one row per calendar day (a
    proven bound), so it is broadcast and the daily table is not shuffled."""
    return daily.join(weather, "ds", "inner")


def features(daily: DataFrame, weather: DataFrame, holidays: DataFrame | None = None, *,
             keys: Sequence[str] = DEFAULT_KEYS, rise: float = 100, backfill: bool = True,
             sleep_ratio: bool = False, block_days: int | None = None) -> DataFrame:
    """K1: C1, B14, E1-E4, H1-H3 and B8 in one plan over one (keys, ds)
    window spec.  Loses exactly the first day of each series (its
    co2_diff1 is unknown); with ``backfill=False`` (old variant) two.  ``block_days``: no window over a
    whole series, but over blocks of so many days (``windows.neighbours``)."""
    df = temp_diff(join_weather(daily, weather))
    df = W.lag_features(df, keys=keys, block_days=block_days)
    if block_days:
        # before the gaps are filled, the first lag is the day before
        df = df.withColumn("co2_diff1", F.col("co2_mean") - F.col("co2_lag1"))
    if backfill:
        df = W.backfill(df, cols=LAG_COLS, keys=keys, block_days=block_days)
    if not block_days:
        df = W.co2_diff(df, keys=keys)
    df = W.rapid_rise(df, threshold=rise)
    df = cal.calendar_flags(df)
    df = cal.with_holiday(df, holidays)  # default: holiday flag as an expression of ds
    df = cal.day_cyclic(df)
    if sleep_ratio:
        df = df.withColumn("sleep_time_ratio", F.lit(8 / 24))
    cols = [*keys, *FEATURE_COLUMNS] + (["sleep_time_ratio"] if sleep_ratio else [])
    return df.select(*cols).dropna("any")


def future_calendar(df: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Calendar, holiday and cyclic columns for scaffold rows."""
    return cal.day_cyclic(cal.with_holiday(cal.calendar_flags(df), holidays))
