"""Physical-plan properties that matter at scale (checked on sf0.001)."""

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_daily_partial_aggregation(spark):
    p = plan(spark, "daily_agg")
    assert "partial_avg" in p and "partial_count" in p  # map-side combine before the exchange


def test_latch_is_a_join_not_a_window(spark):
    p = plan(spark, "presence_latch")
    assert "Window" not in p and "HashAggregate" in p


def test_latest_per_hour_is_an_aggregate(spark):
    p = plan(spark, "latest_per_hour")
    assert "Window" not in p and "max_by" in p


def test_top_k_limits_before_shuffle(spark):
    assert plan(spark, "head_tail").count("WindowGroupLimit") >= 4  # partial + final, head and tail


def test_trend_slices_single_pass(spark):
    p = plan(spark, "trend_slices")
    assert "Expand" in p  # one grouping-sets aggregate instead of one per slice


@pytest.mark.parametrize("name", ["feature_matrix", "trend_slices", "presence_latch", "apply_changes", "route_prompt",
                                  "trim_history", "forecast_lookup", "eval_join"])
def test_no_cross_products(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_prunes_columns(spark):
    q = plan(spark, "weather_range")
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in q  # 2 of the 6 order columns
    assert "PushedFilters: []" in q  # all orders report


def test_local_day_filter_pushes_to_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from aircast.operators import clean as C

    df = spark.createDataFrame([(1, "2025-04-22 22:30:00")], "id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    p = str(tmp_path / "r")
    df.write.parquet(p)
    q = C.local_today(spark.read.parquet(p), as_of="2025-04-23")
    pl = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in pl and "GreaterThanOrEqual(ts" in pl and q.count() == 1


@pytest.mark.parametrize("name", ["feature_matrix", "trend_slices", "future_scaffold"])
def test_holiday_flag_needs_no_join(spark, name):
    p = plan(spark, name)
    assert "_hd" not in p  # the holiday flag is an expression of the date, not a dimension join
