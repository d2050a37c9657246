"""Streams whose other side changes: several batches, late rows, replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from aircast.operators import clean as C
from aircast.operators import daily as D
from aircast.operators import joins as JN
from aircast.plans import history as H
from aircast.streaming import live as LV
from aircast.streaming import streams as ST

CHANGE = "seq bigint, op string, id bigint, room_id bigint, ts timestamp, co2 int, temperature double, humidity double, presence boolean"


def runs(spark, run_id, co2, temp=20.0):
    rows = [(1, dt.date(2025, 5, run_id), dt.date(2025, 5, 10), co2, temp), (1, dt.date(2025, 5, run_id), dt.date(2025, 5, 11), 500.0, 20.0)]
    return spark.createDataFrame(rows, "room_id bigint, run_id date, ds date, pred_co2 double, pred_temp double")


def tick(spark, *days):
    return spark.createDataFrame([(1, dt.datetime(2025, 5, d, 9)) for d in days], "room_id bigint, local_ts timestamp")


def test_a_new_run_changes_the_warning(spark, tmp_path):
    hist, out = str(tmp_path / "history"), str(tmp_path / "out")
    LV.warn_batch(tick(spark, 10), 0, hist, out)  # no run yet: silence
    H.history_append(runs(spark, 8, 1200.0), hist, "b")
    LV.warn_batch(tick(spark, 10, 11), 1, hist, out)
    LV.warn_batch(tick(spark, 10), 2, hist, out)  # said already
    H.history_append(runs(spark, 9, 1400.0, 26.0), hist, "b")
    LV.warn_batch(tick(spark, 10), 3, hist, out)
    LV.warn_batch(tick(spark, 10), 3, hist, out)  # replayed
    H.history_append(runs(spark, 10, 900.0), hist, "b")
    LV.warn_batch(tick(spark, 10), 4, hist, out)  # taken back
    said = [(r.batch_id, r.day.day, r.warning) for r in spark.read.parquet(out).orderBy("batch_id").collect()]
    assert [s[:2] for s in said] == [(1, 10), (3, 10), (4, 10)]
    assert "1200 ppm" in said[0][2] and "1400 ppm" in said[1][2] and "26 degrees" in said[1][2] and said[2][2] is None


def test_warnings_as_a_stream(spark, tmp_path):
    hist, feed = str(tmp_path / "history"), str(tmp_path / "feed")
    H.history_append(runs(spark, 8, 1200.0), hist, "b")
    for day, co2 in ((10, None), (10, 1300.0)):
        if co2:
            H.history_append(runs(spark, 9, co2), hist, "b")
        tick(spark, day).coalesce(1).write.mode("append").parquet(feed)
        s = spark.readStream.schema("room_id bigint, local_ts timestamp").parquet(feed)
        LV.live_warnings(s, hist, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.batch_id for r in spark.read.parquet(str(tmp_path / "out")).where("warning IS NOT NULL").collect()) == [0, 1]


def feed(seed=0, n=400):
    """Changes with deletes, updates, missing values, outliers, unreadable times and ops on unknown ids."""
    r, rows, made = random.Random(seed), [], []
    for seq in range(n):
        op = r.choices(["insert", "delete", "set_presence"], [6, 2, 2])[0]
        if op == "insert" or not made:
            i = seq * 37_000 + r.randrange(5)
            made.append(i)
            ts = None if r.random() < 0.05 else dt.datetime(2025, 1, 1) + dt.timedelta(minutes=r.randrange(6 * 1440))
            rows.append((seq, "insert", i, r.randrange(3), ts, r.choice([None, 9000, 600, 700, 812]), r.choice([None, 20.125, 21.5]), 40.0 + r.randrange(9), r.random() < 0.5))
        else:
            i = r.choice([*made[-30:], -5])
            rows.append((seq, op, i, None, None, None, None, None, r.random() < 0.5 if op != "delete" else None))
    return rows


def plain_daily(rows):
    ins, gone, upd = {}, {}, {}
    for x in rows:
        table = {"insert": ins, "delete": gone, "set_presence": upd}[x[1]]
        if x[2] not in table or table[x[2]][0] < x[0]:
            table[x[2]] = x
    days = {}
    for i, x in ins.items():
        if (i in gone and gone[i][0] > x[0]) or x[4] is None or (x[5] or 0) > 5000:
            continue
        p = upd[i][8] if i in upd and upd[i][0] > x[0] else x[8]
        days.setdefault((x[3], x[4].date()), []).append((x[5], x[6], x[7], p))
    mean = lambda v: sum(v) / len(v) if v else None
    return {k: (*[mean([y[c] for y in v if y[c] is not None]) for c in range(3)], sum(y[3] for y in v), sum(y[0] is not None for y in v)) for k, v in days.items()}


def same(spark, base, rows):
    got = {(r.room_id, r.ds): tuple(r)[2:] for r in LV.kept_daily(spark, base).collect()}
    want = plain_daily(rows)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got[k], w)), (k, got[k], w)


def test_days_follow_deletes_updates_and_replays(spark, tmp_path):
    rows, base = feed(), str(tmp_path / "kept")
    assert LV.kept_daily(spark, base).count() == 0
    cuts = [0, 150, 151, 330, 400]
    for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = spark.createDataFrame(rows[a:z], CHANGE)
        LV.fold_changes(part, i, base)
        if i == 1:
            LV.fold_changes(part, i, base)  # replayed after a failure
        same(spark, base, rows[:z])
    LV.compact(spark, base, 2)
    LV.compact(spark, base, 2)
    same(spark, base, rows)
    LV.fold_changes(spark.createDataFrame([(900, "delete", rows[0][2], None, None, None, None, None, None)], CHANGE), 4, base)
    same(spark, base, [*rows, (900, "delete", rows[0][2], None, None, None, None, None, None)])
    assert spark.read.parquet(base + "/states").select("block").distinct().count() > 1


def test_batches_may_come_out_of_order(spark, tmp_path):
    rows, base = feed(1, 120), str(tmp_path / "kept")
    for i, part in enumerate((rows[60:], rows[:60])):
        LV.fold_changes(spark.createDataFrame(part, CHANGE), i, base)
    same(spark, base, rows)


def test_kept_days_equal_the_daily_operator(spark, tmp_path):
    rows, base = [x for x in feed(2, 200) if x[1] == "insert"], str(tmp_path / "kept")
    df = spark.createDataFrame(rows, CHANGE)
    LV.fold_changes(df, 0, base)
    want = D.daily(C.co2_outlier_filter(df.where("ts IS NOT NULL"))).collect()
    got = {(r.room_id, r.ds): tuple(r)[2:] for r in LV.kept_daily(spark, base).collect()}
    assert {(r.room_id, r.ds): tuple(r)[2:] for r in want} == got


@pytest.fixture
def two_feeds(spark, tmp_path):
    """Readings and radar lines of three batches; some of either side come a batch late."""
    r, base = random.Random(4), dt.datetime(2025, 1, 1)
    readings = [(i, i % 3, base + dt.timedelta(minutes=r.randrange(1440))) for i in range(300)]
    pings = [(i % 3, base + dt.timedelta(minutes=r.randrange(1440)), r.choice([" ON ", "OFF"])) for i in range(80)]

    def batch(ts, late):
        b = ts.hour // 8
        return min(b + 1, 2) if late and ts.minute % 60 > 2 and ts.hour % 8 == 7 else b

    for k in range(3):
        a = [x for x in readings if batch(x[2], x[0] % 5 == 0) == k]
        b = [x for x in pings if batch(x[1], x[1].minute % 4 == 0) == k]
        spark.createDataFrame(a, "id bigint, room_id bigint, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"readings/b={k}"))
        spark.createDataFrame(b, "room_id bigint, ts timestamp, line string").coalesce(1).write.parquet(str(tmp_path / f"pings/b={k}"))
    return tmp_path


def test_latch_of_two_streams_with_late_rows(spark, two_feeds):
    def stream(name, schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(two_feeds / name))

    readings = stream("readings", "id bigint, room_id bigint, ts timestamp")
    pings = stream("pings", "room_id bigint, ts timestamp, line string")
    got = ST.run_available_now(LV.presence_join(readings, pings, delay="2 hours"), "t_two").collect()
    r = spark.read.parquet(str(two_feeds / "readings")).drop("b")
    p = spark.read.parquet(str(two_feeds / "pings")).drop("b")
    want = {x.id: (x.presence_latched, x.ts) for x in JN.presence_latch(r, p).collect()}
    assert all(want[x.id][0] == x.presence_latched for x in got) and len({x.id for x in got}) == len(got)
    on = p.where(F.col("line").contains("ON") & (F.minute("ts") != 2)).agg(F.max("ts")).first()[0]
    mark = min(max(t for _, t in want.values()), on) - dt.timedelta(hours=2)
    closed = {i for i, (_, t) in want.items() if (t - dt.timedelta(minutes=2)).replace(minute=0, second=0) + dt.timedelta(minutes=62) <= mark}
    assert len(closed) > 200 and closed <= {x.id for x in got}
