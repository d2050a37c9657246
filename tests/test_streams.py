"""Stream equals batch when the feed arrives in several micro-batches."""

from pyspark.sql import functions as F

from aircast.operators import clean as C
from aircast.operators import joins as JN
from aircast.sources import fixtures as fx
from aircast.streaming import streams as ST

SF = "/root/testdata/sf0.001"


def _landing(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    cut = "2024-01-15 00:00:00"
    d = tmp_path / "landing"
    ev.where(F.col("ts") < cut).coalesce(1).write.parquet(str(d / "a"))
    ev.where(F.col("ts") >= cut).coalesce(1).write.parquet(str(d / "b"))
    # one file per trigger, in event-time order
    import glob
    import shutil

    out = tmp_path / "feed"
    out.mkdir()
    for i, part in enumerate(["a", "b"]):
        f = glob.glob(str(d / part / "*.parquet"))[0]
        shutil.copy(f, out / f"events-{i}.parquet")
    return str(out)


def test_latch_stream_two_batches_equals_batch(spark, tmp_path):
    feed = _landing(spark, tmp_path)
    s_ev = lambda: fx.events_stream(spark, feed, max_files=1, glob="events-*.parquet")
    readings = C.clean(fx.measurements_of(s_ev()))
    got = ST.run_available_now(ST.presence_latch_rows(readings, fx.pings_of(s_ev())), "t_latch")
    batch = JN.presence_latch(C.clean(fx.measurements(spark, SF)).select("id", "room_id", "ts"), fx.pings(spark, SF))
    a = {(r.id, r.presence_latched) for r in got.collect()}
    b = {(r.id, r.presence_latched) for r in batch.collect()}
    assert a == b and len(a) > 900


def test_dedup_stream_two_batches(spark, tmp_path):
    feed = _landing(spark, tmp_path)
    s = C.clean(fx.measurements_of(fx.events_stream(spark, feed, max_files=1, glob="events-*.parquet")))
    got = ST.run_available_now(ST.new_readings(s).select("id"), "t_dedup")
    assert got.count() == C.clean(fx.measurements(spark, SF)).count()


def test_append_store_idempotent(spark, tmp_path):
    feed = _landing(spark, tmp_path)
    m = fx.measurements_of(fx.events_stream(spark, feed, max_files=1, glob="events-*.parquet")).select("id")
    ST.append_store(m, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    st = spark.read.parquet(str(tmp_path / "store"))
    assert st.count() == 1000 and st.select("batch_id").distinct().count() == 2


def test_ingest_path(spark, tmp_path):
    """landing JSON files -> validation -> ids -> idempotent store."""
    m = fx.measurements(spark, SF)
    body = F.to_json(F.struct(F.col("ts_raw").alias("timestamp"), "co2", "temperature", "humidity", "presence"))
    pay = m.select(F.col("id").alias("seq"), "room_id", body.alias("payload"))
    land = tmp_path / "land"
    pay.where("seq < 500").coalesce(1).write.json(str(land / "p1"))
    pay.where("seq >= 500").coalesce(1).write.json(str(land / "p2"))
    import glob
    import shutil

    feed = tmp_path / "feed"
    feed.mkdir()
    for i, d in enumerate(["p1", "p2"]):
        shutil.copy(glob.glob(str(land / d / "*.json"))[0], feed / f"payload-{i}.json")
    s = spark.readStream.schema("seq long, room_id long, payload string").option("maxFilesPerTrigger", 1).json(str(feed))
    ST.ingest(s, str(tmp_path / "store"), str(tmp_path / "quarantine"), str(tmp_path / "ck")).awaitTermination()
    st = spark.read.parquet(str(tmp_path / "store"))
    q = spark.read.parquet(str(tmp_path / "quarantine"))
    n_bad = m.where(F.col("co2").isNull()).count()
    assert q.count() == n_bad and st.count() == 1000 - n_bad
    ids = sorted(r.id for r in st.select("id").collect())
    assert ids == list(range(1, len(ids) + 1))
    assert st.select("batch_id").distinct().count() == 2


def test_hourly_stream_equals_batch_for_closed_windows(spark, tmp_path):
    feed = _landing(spark, tmp_path)
    s = C.clean(fx.measurements_of(fx.events_stream(spark, feed, max_files=1, glob="events-*.parquet")))
    got = ST.run_available_now(ST.hourly(s), "t_hourly")
    batch = ST.hourly(C.clean(fx.measurements(spark, SF)))
    g = {(r.room_id, r.window_start): (r.latest_id, r.n, round(r.co2_mean or 0, 6)) for r in got.collect()}
    b = {(r.room_id, r.window_start): (r.latest_id, r.n, round(r.co2_mean or 0, 6)) for r in batch.collect()}
    assert g and set(g) <= set(b)
    assert all(g[k] == b[k] for k in g)
    # what the stream holds back is only the newest windows (still open at the watermark)
    last = max(k[1] for k in b)
    assert all((last - k[1]).total_seconds() <= 3600 * 2 for k in set(b) - set(g))


def test_ingest_batch_replay_is_idempotent(spark, tmp_path):
    m = fx.measurements(spark, SF)
    body = F.to_json(F.struct(F.col("ts_raw").alias("timestamp"), "co2", "temperature", "humidity", "presence"))
    pay = m.select(F.col("id").alias("seq"), "room_id", body.alias("payload"))
    st, qu = str(tmp_path / "store"), str(tmp_path / "quarantine")
    ST.ingest_batch(pay.where("seq < 400"), 0, st, qu)
    ST.ingest_batch(pay.where("seq >= 400"), 1, st, qu)
    first = sorted((r.id, r.ts_raw) for r in spark.read.parquet(st).collect())
    ST.ingest_batch(pay.where("seq >= 400"), 1, st, qu)  # replay after a failure
    again = sorted((r.id, r.ts_raw) for r in spark.read.parquet(st).collect())
    assert first == again and [i for i, _ in first] == list(range(1, len(first) + 1))
