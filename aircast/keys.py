"""Joins on the series key that also work for the single-series case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kjoin(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)``; with ``keys=[]`` (one series) the
    per-series side has a single row and is joined on a constant key."""
    keys = list(keys)
    if keys:
        return left.join(right, keys, how)
    k = "_series"
    return left.withColumn(k, F.lit(0)).join(right.withColumn(k, F.lit(0)), k, how).drop(k)
