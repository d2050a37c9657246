"""Series windows by blocks of days equal the plain windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from aircast.operators import windows as W
from aircast.plans import features as FE
from aircast.plans.daily_tables import daily_table, weather_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def days(spark):
    r, rows = random.Random(2), []
    for room in (None, 1, 2, 3, 4):
        start = dt.date(1969, 12, 1) if room == 2 else dt.date(2024, 1, 1)
        n = {None: 30, 1: 1, 2: 200, 3: 90, 4: 2}[room]
        for i in sorted(r.sample(range(n * 3), n)):  # gaps in the calendar
            rows.append((room, start + dt.timedelta(days=i), r.choice([None, None, r.random()]), r.choice([None, r.random()])))
    return spark.createDataFrame(rows, "room_id int, ds date, a double, b double").repartition(4).cache()


@pytest.mark.parametrize("block", [1, 3, 30, 1000])
@pytest.mark.parametrize("keys", [["room_id"], []])
def test_blocks_equal_windows(days, block, keys):
    if not keys:
        days = days.where("room_id = 2").drop("room_id")
    w = Window.partitionBy(*keys).orderBy("ds")
    got = W.neighbours(days, keys=keys, lags={"a1": ("a", 1), "a4": ("a", 4), "b2": ("b", 2)}, number="rn", count="n", leads={"nb": "b", "nd": "ds"}, block_days=block)
    want = days.select("*", F.lag("a", 1).over(w).alias("a1"), F.lag("a", 4).over(w).alias("a4"), F.lag("b", 2).over(w).alias("b2"),
                       F.lead("b").over(w).alias("nb"), F.lead("ds").over(w).alias("nd"), F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    got = W.backfill(days, cols=["a", "b"], keys=keys, block_days=block)
    assert sorted(map(str, got.collect())) == sorted(map(str, W.backfill(days, cols=["a", "b"], keys=keys).collect()))
    got = W.co2_diff(days, col="b", keys=keys, block_days=block)
    assert sorted(map(str, got.collect())) == sorted(map(str, W.co2_diff(days, col="b", keys=keys).collect()))


def test_empty_table(days):
    assert W.neighbours(days.limit(0), keys=["room_id"], lags={"x": ("a", 1)}, fill=["b"], number="rn").count() == 0


def test_no_window_holds_a_whole_series(spark):
    f = FE.features(daily_table(spark, SF), weather_of(spark, SF), block_days=8)
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows
    for x in windows:
        if "unix_date" not in x and "_blk" not in x.split("], [")[1]:
            # over the carry: one row per block
            assert "_before" in x or "_n#" in x or "_tail" in x or "_head" in x or "_first_" in x, x
