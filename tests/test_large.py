"""Numbers and tables larger than the usual ones."""

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aircast.functions import scalar as S
from aircast.plans import gram as G
from aircast.plans import prompts as P
from aircast.plans.series import each_series
from aircast.streaming import streams as ST

HUGE = 1.8106230517939356e20
DAY = dt.date(2024, 1, 31)


def test_int_text_beyond_bigint(spark):
    x = [0.5, 2.5, -0.4, HUGE, -HUGE, 2.0**63, -(2.0**63), 2.0**125 * 1.75, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", S.int_text(F.col("x")).alias("t"))
    assert dict(rows.collect()) == {i: None if v is None else str(round(v)) for i, v in enumerate(x)}
    big = spark.createDataFrame([(1e300,), (float("inf"),), (float("nan"),)], "x double").select(S.int_text(F.col("x")))
    assert [r[0] for r in big.collect()] == ["1" + "0" * 300, "Infinity", "NaN"]


def test_warning_of_an_explosive_model(spark):
    df = spark.createDataFrame([(HUGE, 20.0), (-HUGE, 25.5)], "c double, t double")
    got = [r[0] for r in df.select(S.warning_text(F.col("c"), F.col("t"))).collect()]
    assert got[0].startswith("The CO₂ is expected to reach 181062305179393556480 ppm today")
    assert got[1].startswith("The indoor temperature may rise to 26 degrees")


def _forecast(spark):
    return spark.createDataFrame(
        [(1, DAY, HUGE, 21.25, 3.0, 1.0, 0.0, 2.0, 5, "x")],
        "room_id bigint, ds date, pred_co2 double, pred_temp double, outside_temp_max double, solar_radiation double, "
        "precipitation double, wind double, cloudcover int, advies string",
    )


def test_context_and_answer_of_an_explosive_model(spark):
    p = spark.createDataFrame([(7, 1, "give me the forecast")], "prompt_id bigint, room_id bigint, prompt string")
    text = P.forecast_context(p, _forecast(spark)).first()["context"]
    assert "2024-01-31 → Predicted CO2: 181062305179393556480 ppm, Predicted Temp: 21.2°C" in text
    looked = P.forecast_lookup(p, _forecast(spark), as_of=str(DAY))
    assert "Predicted CO₂: 181062305179393556480 ppm" in P.day_answer(looked).first()["answer"]


def test_latch_stream_by_blocks(spark, tmp_path):
    """Several rooms in one bucket, an unknown room, late lines and a block that goes on in the next batch."""
    at = lambda h, m: dt.datetime(2024, 1, 5, h, m)
    # kind, id, room, ts
    first = [("p", 0, 1, at(10, 5)), ("p", 1, 2, at(10, 30)), ("r", 2, 1, at(10, 4)), ("r", 3, 1, at(10, 5)), ("r", 4, 2, at(10, 20)),
             ("r", 5, None, at(10, 40)), ("p", 6, None, at(10, 6)), ("r", 7, 2**53 + 1, at(10, 41))]
    second = [("r", 8, 2, at(10, 50)), ("r", 9, 1, at(11, 1)), ("r", 10, 1, at(11, 3)), ("p", 11, 1, at(10, 45)), ("r", 12, 3, at(11, 4)), ("p", 13, 3, at(11, 3))]
    schema = "kind string, id bigint, room_id bigint, ts timestamp"
    feed = tmp_path / "feed"
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(feed / f"n={i}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{feed}/n=*")
    pings = s.where("kind = 'p'").select("room_id", "ts", F.lit(" ON ").alias("line"))
    out = ST.presence_latch_rows(s.where("kind = 'r'").select("id", "room_id", "ts"), pings, buckets=1)
    got = {r.id: (r.room_id, r.presence_latched) for r in ST.run_available_now(out, "t_latch_blocks").collect()}
    assert got == {2: (1, False), 3: (1, True), 4: (2, False), 5: (None, False), 7: (2**53 + 1, False), 8: (2, True),
                   9: (1, True), 10: (1, False), 12: (3, True)}


def test_latch_keys_do_not_grow_with_the_rooms(spark, tmp_path):
    """A key costs state round trips: the rooms of a block share a few of them."""
    rows = spark.range(3000).select("id", F.col("id").alias("room_id"), F.lit("2024-01-05 10:05:00").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "feed"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "feed"))
    out = ST.presence_latch_rows(s, s.select("room_id", "ts", F.lit(" ON ").alias("line")))
    q = out.writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = max(int(o["numRowsTotal"]) for p in q.recentProgress for o in p["stateOperators"])
    assert 0 < kept <= 10 * ST.LATCH_BUCKETS  # states and timers; one for each room before


def test_sums_are_solved_a_bounded_number_at_once(spark):
    """A task holds so many matrices, not those of its whole partition."""
    wide, rooms = 63, 3000
    x = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: F.when(i == 0, 1.0).otherwise(((F.col("room_id") * 31 + F.col("day") * 7 + i * i) % 11).cast("double")))
    df = spark.range(rooms * 2).select((F.col("id") % rooms).alias("room_id"), F.floor(F.col("id") / rooms).alias("day"))
    df = df.withColumn("x", x).withColumn("y", (F.col("room_id") % 5 - F.col("day")).cast("double")).repartition(3, "day")

    def solver(cols, g, xty, yty):
        return {"together": np.full(len(g), len(g)), "xx": g[:, 1, 2], "xy": xty[:, 3], "yy": yty, "top": cols["top"][:, 0]}

    schema = "together bigint, xx double, xy double, yy double, top double"
    got = G.fit(df, ["room_id"], solver, schema, greatest=["y"])
    want = df.groupBy("room_id").agg(
        F.count("*").alias("n"), F.sum(F.col("x")[1] * F.col("x")[2]).alias("xx"), F.sum(F.col("x")[3] * F.col("y")).alias("xy"),
        F.sum(F.col("y") * F.col("y")).alias("yy"), F.max(F.abs("y")).alias("top"),
    )
    assert got.agg(F.max("together")).first()[0] <= G.NUMBERS // (wide + 1) ** 2
    assert got.count() == rooms and got.drop("together").exceptAll(want.select("room_id", "n", "xx", "xy", "yy", "top")).isEmpty()
    one = G.fit(df, [], solver, schema, greatest=["y"]).collect()
    assert [(r.n, r.together, r.top) for r in one] == [(rooms * 2, 1, 4.0)]


def test_fits_get_batches_bounded_by_their_bytes(spark):
    """Wide rows: a worker holds few of them at once, however many a partition has."""
    rows = spark.range(100_000).select(F.floor(F.col("id") / 10).alias("room_id"), "id", F.repeat(F.lit("x"), F.lit(1000)).alias("wide"))

    def fn(t, first):
        return {"room_id": t.column("room_id").combine_chunks().take(pa.array(first[:-1])), "held": np.full(len(first) - 1, t.nbytes)}

    got = each_series(rows, ["room_id"], "id", fn, "room_id bigint, held bigint").agg(F.countDistinct("room_id"), F.count("*"), F.max("held")).first()
    assert got[:2] == (10_000, 10_000)
    assert got[2] < 1.1 * G.BATCH_BYTES
