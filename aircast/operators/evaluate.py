"""Evaluation and presentation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS
from ..keys import kjoin
from .daily import avg_exact


def wall_clock(raw):
    """The date and time that a stored text itself shows (not converted)."""
    return F.replace(F.substring(raw, 1, 19), F.lit("T"), F.lit(" "))


def context_line(df: DataFrame):
    """One reading as the prompt line (Python's text of each value)."""
    return F.concat(
        F.lit("Timestamp: "), wall_clock(F.col("ts_raw")),
        F.lit(", CO₂: "), F.coalesce(F.col("co2").cast("string"), F.lit("None")),
        F.lit(" ppm, Temperature: "), F.col("temperature").cast("string"),
        F.lit("°C, Humidity: "), F.col("humidity").cast("string"),
        F.lit("%, Presence: "), F.when(F.col("presence"), "True").otherwise("False"),
    )


def ordered_text(line, order, sep: str = "\n"):
    """Aggregate: lines joined by ``sep`` in ``order`` (for bounded groups)."""
    return F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), sep
    )


def context_table(hourly: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Per (series, day) the hourly rows as text lines in time order."""
    return hourly.groupBy(*keys, "day").agg(
        ordered_text(context_line(hourly), F.col("ts")).alias("context"), F.count(F.lit(1)).alias("n_lines")
    )


def eval_join(actual: DataFrame, temp_pred: DataFrame, co2_pred: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Actuals left join each prediction part on (keys, day)."""
    on = [*keys, "day"]
    return actual.join(temp_pred, on, "left").join(co2_pred, on, "left")


def today_row(fc: DataFrame, *, as_of: str) -> DataFrame:
    """The forecast row of the day ``as_of`` per series."""
    return fc.where(F.col("ds") == F.lit(as_of).cast("date"))


def actual_vs_pred(actual: DataFrame, pred: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Full outer join on (keys, day)."""
    return actual.join(pred, [*keys, "day"], "full_outer")


def overlay(readings: DataFrame, pred_daily: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Hourly actual means and daily predictions as one long series."""
    a = readings.groupBy(*keys, F.date_trunc("hour", "local_ts").cast("timestamp_ntz").alias("t")).agg(
        F.avg("co2").alias("value")
    ).withColumn("series", F.lit("actual_co2"))
    p = pred_daily.select(*keys, F.col("day").cast("timestamp_ntz").alias("t"), F.col("pred_co2").alias("value")).withColumn(
        "series", F.lit("pred_co2")
    )
    return a.unionByName(p)


def forecast_pairs(runs: DataFrame, daily: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """(keys, h, model, y, yhat) for each predicted day that has an actual."""
    j = runs.join(daily.select(*keys, "ds", "co2_mean", "temp_mean"), [*keys, "ds"])
    u = F.explode(
        F.array(
            F.struct(F.lit("co2").alias("model"), F.col("co2_mean").alias("y"), F.col("pred_co2").alias("yhat")),
            F.struct(F.lit("temp").alias("model"), F.col("temp_mean").alias("y"), F.col("pred_temp").alias("yhat")),
        )
    )
    return j.select(*keys, "h", u.alias("p")).select(*keys, "h", "p.*")


def error_metrics(pairs: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, by: Sequence[str] = ("model",), exact: bool = True) -> DataFrame:
    """MAE and RMSE from one pass of sums (n, sum|r|, sum r^2).  ``exact``: decimal sums, for errors
    of the size of readings (a model's may be any size)."""
    mean = avg_exact if exact else F.avg
    p = pairs.where(F.col("y").isNotNull() & F.col("yhat").isNotNull()).withColumn("_r", F.col("y") - F.col("yhat"))
    return p.groupBy(*keys, *by).agg(
        F.count(F.lit(1)).alias("n"), mean(F.abs("_r")).alias("mae"), F.sqrt(mean(F.col("_r") * F.col("_r"))).alias("rmse")
    )


def metrics_table(splits: Mapping[str, DataFrame], *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """D14 per split, unioned with a ``split`` column."""
    out = None
    for name, pairs in splits.items():
        m = error_metrics(pairs, keys=keys).withColumn("split", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def avg_temp_diff(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """mean(indoor - outdoor max) per series."""
    return feats.groupBy(*keys).agg(F.avg(F.col("temp_mean") - F.col("outside_temp_max")).alias("avg_temp_diff"))


def histogram(df: DataFrame, col: str, *, bins: int = 15, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Equal-width bins between the series' min and max; the maximum
    falls in the last bin (plain ``width_bucket`` would give it bins+1);
    empty bins are listed with n = 0 (per-series ``explode`` of the bin
    numbers, then a left join of the counts)."""
    b = df.groupBy(*keys).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    x = kjoin(df.where(F.col(col).isNotNull()), b, keys)
    width = F.col("hi") - F.col("lo")
    bin_ = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col(col) - F.col("lo")) / width * bins) + 1, F.lit(bins))
    )
    counts = x.groupBy(*keys, bin_.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dim = b.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    dim = dim.withColumn("bin", F.col("bin").cast("bigint"))
    out = dim.join(counts, [*keys, "bin"], "left")
    return out.select(
        *keys, "bin",
        (F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins).alias("edge_lo"),
        (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("edge_hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )

