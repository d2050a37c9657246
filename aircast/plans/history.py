"""Forecast runs: the persistence forecaster (every day of every series
issues a 7-day run predicting its own day means) gives a run history that
grows with the data; model runs from ``plans.forecast`` have the same shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS
from ..functions import calendar as cal
from ..functions import scalar as S
from ..schemas import WEATHER_FIELDS


#: Columns of ``persistence_runs`` and of the stored history.
RUN_SCHEMA = (
    "room_id bigint, run_id date, batch string, h int, ds date, pred_temp double, outside_temp_max double, outside_temp_min double, "
    "precipitation double, cloudcover int, wind double, solar_radiation double, is_weekend boolean, is_holiday boolean, "
    "pred_co2 double, advies string"
)


def persistence_runs(daily: DataFrame, weather: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, horizon: int = 7) -> DataFrame:
    """One run per (series, day): ds = run day + 1..horizon.  The fan-out is
    a bounded ``explode`` (horizon rows per day), not a join."""
    base = daily.select(*keys, F.col("ds").alias("run_id"), "co2_mean", "temp_mean")
    rows = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn(
        "ds", F.date_add("run_id", F.col("h"))
    )
    rows = rows.join(weather, "ds", "left")
    rows = cal.with_holiday(rows)
    rows = rows.withColumn("is_weekend", cal.weekday(F.col("ds")) >= 5)
    rows = rows.withColumn("pred_temp", F.col("temp_mean")).withColumn("pred_co2", F.col("co2_mean"))
    rows = rows.withColumn("advies", S.advice(F.col("pred_co2"), F.col("pred_temp")))
    return rows.select(
        *keys, "run_id", "h", "ds", "pred_temp", *WEATHER_FIELDS, "is_weekend", "is_holiday", "pred_co2", "advies"
    )


def mean_runs(daily: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, horizon: int = 7, window: int = 7) -> DataFrame:
    """A second forecaster (trailing ``window``-day mean) in the short
    record shape: keys, run_id, ds, pred_temp, pred_co2."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("ds").rowsBetween(-(window - 1), 0)
    base = daily.select(
        *keys, F.col("ds").alias("run_id"), F.avg("temp_mean").over(w).alias("pred_temp"),
        F.avg("co2_mean").over(w).alias("pred_co2"),
    )
    rows = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return rows.select(*keys, "run_id", F.date_add("run_id", F.col("h")).alias("ds"), "pred_temp", "pred_co2")


def latest_run(runs: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Rows of the newest run per series (per-series max joined back)."""
    from ..operators.clean import per_key_bound

    return per_key_bound(runs, keys, F.max("run_id"), "_mr").where(F.col("run_id") == F.col("_mr")).drop("_mr")


def last_n_runs(runs: DataFrame, *, n: int = 4, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """The last ``n`` runs per series; ``n = 0`` returns all (as the
    ``[-0:]`` slice does).  Runs are ranked in the small distinct
    (keys, run_id) table, which is then joined back."""
    from pyspark.sql import Window

    if n == 0:
        return runs
    ids = runs.select(*keys, "run_id").distinct()
    w = Window.partitionBy(*keys).orderBy(F.col("run_id").desc())
    keep = ids.withColumn("_rk", F.dense_rank().over(w)).where(F.col("_rk") <= n).drop("_rk")
    return runs.join(keep, [*keys, "run_id"], "left_semi")


def sink_layout(runs: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """The 12-field record layout with ds as 'yyyy-MM-ddTHH:mm:ss'."""
    from ..schemas import FORECAST_FIELDS

    out = runs.withColumn("ds", S.format_iso_seconds(F.col("ds").cast("timestamp_ntz")))
    return out.select(*keys, *FORECAST_FIELDS)


def write_forecast(runs: DataFrame, path: str, *, keys: Sequence[str] = DEFAULT_KEYS) -> None:
    """A11 sink: overwrite the latest forecast as JSON lines."""
    sink_layout(latest_run(runs, keys=keys), keys=keys).write.mode("overwrite").json(path)


def history_append(runs: DataFrame, path: str, batch: str) -> None:
    """Append runs to the history, partitioned by (run_id, batch).  A batch
    that is written again replaces only itself (dynamic overwrite); another
    batch of the same day, say of other rooms, stays."""
    # Spark splits a large run over tasks (and files) and joins small ones
    rows = runs.withColumn("batch", F.lit(batch)).hint("rebalance", "run_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch").parquet(path)


def read_history(spark, path: str) -> DataFrame:
    """History in both record shapes: a missing history reads as empty, an
    unreadable one fails; shapes are merged by name (missing fields NULL)."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN_SCHEMA)


def records_json(runs: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Each run as one JSON array of its records in day order.  A run
    has ``horizon`` rows: a bounded group."""
    rec = F.struct(
        S.format_iso_seconds(F.col("ds").cast("timestamp_ntz")).alias("ds"),
        S.round_ieee(F.col("pred_temp"), 2).alias("pred_temp"),
        *[F.col(c) for c in WEATHER_FIELDS], "is_weekend", "is_holiday",
        S.round_ieee(F.col("pred_co2"), 2).alias("pred_co2"), "advies",
    )
    g = runs.groupBy(*keys, "run_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ds").alias("_o"), rec.alias("r")))).alias("a"))
    return g.select(
        *keys, "run_id",
        F.to_json(F.transform("a", lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("records"),
    )


def flatten_history(nested: DataFrame, *, runs_col: str = "history") -> DataFrame:
    """Nested runs x days -> flat rows; the outer position is the run
    order.  Works for both record shapes (fields absent in one are NULL)."""
    r = nested.select("*", F.posexplode(runs_col).alias("run_pos", "run")).drop(runs_col)
    d = r.select("*", F.posexplode("run").alias("day_pos", "rec")).drop("run")
    return d.select(*[c for c in d.columns if c != "rec"], "rec.*")
