"""Hand rows for answers that were once wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aircast.functions import scalar as S
from aircast.operators import clean as C
from aircast.operators import daily as D
from aircast.operators import evaluate as EV
from aircast.plans import prompts as P
from aircast.streaming import streams as ST


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_missing_values_stay_missing(spark):
    null = F.lit(None).cast("double")
    assert one(spark, S.clip(null, F.lit(18.0), F.lit(25.0)))[0] is None
    assert one(spark, S.clip(F.lit(30.0), F.lit(18.0), null))[0] is None
    assert one(spark, S.clip(F.lit(30.0), F.lit(18.0), F.lit(25.0)))[0] == 25.0
    assert one(spark, S.advice(null, F.lit(20.0)))[0] is None
    assert one(spark, S.advice(F.lit(900.0), null))[0] is None
    assert one(spark, S.advice(F.lit(900.0), F.lit(20.0)))[0] == S.ADVICE_ALL_FINE


def test_a_clock_time_alone_is_no_instant(spark):
    rows = spark.createDataFrame([("12:30:00",), ("2025-01-02 12:30:00",), ("2025-01-02T12:30:00+02:00",), (" x",), (None,)], "ts_raw string")
    got = [r.t for r in C.parse_timestamp(rows).select(F.col("ts").cast("timestamp_ntz").alias("t")).collect()]
    assert got == [None, dt.datetime(2025, 1, 2, 12, 30), dt.datetime(2025, 1, 2, 10, 30), None, None]


def test_means_lose_no_digit(spark):
    rows = spark.createDataFrame([(20.004,), (20.004,), (None,)], "x double")
    assert rows.select(D.avg_exact("x")).first()[0] == 20.004


def test_alerts_come_from_raw_readings(spark):
    rows = spark.createDataFrame([(1, 1, "2025-01-02 10:00:00", 9999), (2, 1, "not a time", 950), (3, 1, "2025-01-02 10:01:00", 899), (4, 1, None, None)],
                                 "id bigint, room_id bigint, ts_raw string, co2 int")
    assert sorted(r.id for r in ST.co2_alerts(C.parse_timestamp(rows)).collect()) == [1, 2]


def test_context_shows_the_stored_clock(spark):
    rows = spark.createDataFrame([("2025-01-02T10:00:00+02:00", 600, 20.5, 40.0, True)], "ts_raw string, co2 int, temperature double, humidity double, presence boolean")
    assert rows.select(EV.context_line(rows)).first()[0].startswith("Timestamp: 2025-01-02 10:00:00, CO₂: 600 ppm")


def test_a_day_without_a_maximum_is_still_known(spark):
    prompts = spark.createDataFrame([(1, "weather tomorrow?")], "prompt_id int, prompt string")
    schema = "ds date, outside_temp_max double, outside_temp_min double, cloudcover int, wind double, precipitation double"
    weather = spark.createDataFrame([(dt.date(2025, 1, 2), None, 1.0, 5, 2.0, 0.0)], schema)
    got = {r.prompt_id: r.answer for r in P.weather_answer(prompts, weather, as_of="2025-01-01").collect()}
    assert "Max temp: None" in got[1]
    assert P.weather_answer(prompts, weather.where("false"), as_of="2025-01-01").first().answer == "Sorry, er zijn geen weergegevens beschikbaar voor deze datum."


class _Map:
    def __init__(self):
        self.rows = {}

    def iterator(self):
        return iter(list(self.rows.items()))

    def updateValue(self, k, v):
        self.rows[k] = v

    def clear(self):
        self.rows.clear()


class _Handle:
    def __init__(self):
        self.map = _Map()

    def getMapState(self, *a):
        return self.map

    def registerTimer(self, t):
        self.timer = t


def test_late_rows_keep_the_latch():
    """ON at 10:05, a late reading of 09:58, then a reading of 10:31: still on."""
    import pandas as pd

    latch, handle = ST._latch_processor_cls(2)(), _Handle()
    latch.init(handle)

    def batch(*rows):
        pdf = pd.DataFrame([{"room_id": 1, "ts": pd.Timestamp(f"2025-01-01 {t}"), "kind": kind, "id": i, "is_on": on} for t, kind, i, on in rows])
        return pd.concat(list(latch.handleInputRows((1, dt.date(2025, 1, 1)), iter([pdf]), None)))["presence_latched"].tolist()

    assert batch(("10:05", 0, None, True)) == []
    assert batch(("09:58", 1, 1, None)) == [False]
    assert batch(("10:31", 1, 2, None), ("10:04", 1, 3, None)) == [True, False]
    latch.handleExpiredTimer(None, None, None)
    assert handle.map.rows == {}


def test_unreadable_mark_stops_the_ingestion(spark, tmp_path):
    store = tmp_path / "store"
    (tmp_path / "store_hwm").mkdir()
    (tmp_path / "store_hwm" / "x.parquet").write_text("not parquet")
    rows = spark.createDataFrame([(1, "2025-01-02T10:00:00", 600, 20.0, 40.0, True, 1)], "room_id bigint, timestamp string, co2 int, temperature double, humidity double, presence boolean, seq int")
    with pytest.raises(Exception):
        ST.ingest_batch(rows, 3, str(store), str(tmp_path / "q"))


def test_rounding_is_pythons(spark):
    values = [0.35, 1.15, 0.25, 0.75, 2.675, 21.05, 21.15, 21.25, -0.35, -1.15, -0.25, 1e15 + 0.5, 0.05, 19.949999999999999, 123.45, 0.0, 5.55, 1005.5, 1006.5]
    import random

    r = random.Random(1)
    values += [round(r.uniform(-50, 50), 2) for _ in range(3000)] + [r.uniform(0, 3000) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2):
        got = [x[0] for x in rows.select(S.half_even(F.col("x"), digits)).collect()]
        assert got == [round(v, digits) + 0.0 for v in values]
    assert S.round_half_even is S.half_even
    assert one(spark, S.half_even(F.lit(None).cast("double"), 1))[0] is None


def test_payload_numbers_may_be_text(spark):
    from aircast.sources import store

    body = '{{"timestamp": "2025-01-01", "co2": {}, "temperature": {}, "humidity": 40, "presence": {}}}'
    cases = {
        ("612", "21.5", "true"): ("ok", None), ('"612"', '"21.5"', '"yes"'): ("ok", None), ("612.0", "21", "1"): ("ok", None), ('" 612 "', "2e1", '"off"'): ("ok", None),
        ("612.5", "21.5", "true"): ("quarantine", "invalid co2"), ('"many"', "21.5", "true"): ("quarantine", "invalid co2"), ("612", '"warm"', "true"): ("quarantine", "invalid temperature"),
        ("612", "21.5", "2"): ("quarantine", "invalid presence"), ("null", '"warm"', "true"): ("quarantine", "missing co2"), ("[1]", "1", "true"): ("quarantine", "invalid co2"),
    }
    raw = spark.createDataFrame([(i, body.format(*c)) for i, c in enumerate(cases)] + [(99, "[]"), (98, "no json"), (97, None)], "id int, payload string")
    got = {r.id: r for r in store.validate_payload(raw).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i].status, got[i].reason) == want, i
    assert [got[i].co2 for i in range(4)] == [612] * 4 and [got[i].presence for i in range(4)] == [True, True, True, False]
    assert got[1].temperature == 21.5 and all(got[i].status == "quarantine" for i in (97, 98, 99))


def test_every_named_day_is_tried(spark):
    from aircast.functions import text as X

    prompts = ["forecast for feb 31 or mar 2", "forecast 31 feb, 5 mar and 6 mar", "on may 99 or tomorrow", "jun 31", "feb 31 and 5 mar"]
    rows = spark.createDataFrame([(p,) for p in prompts], "p string")
    got = [r[0] for r in rows.select(X.forecast_date(F.col("p"), F.lit("2025-01-30").cast("date"))).collect()]
    assert got == [dt.date(2025, 3, 2), dt.date(2025, 3, 5), dt.date(2025, 1, 31), None, dt.date(2025, 3, 5)]


def test_last_days_by_series(spark):
    t0 = dt.datetime(2025, 1, 20, 12)
    rows = [(1, t0), (1, t0 - dt.timedelta(days=7)), (1, t0 - dt.timedelta(days=7, microseconds=1)), (2, t0 - dt.timedelta(days=300)), (2, t0 - dt.timedelta(days=304)), (3, None), (None, t0)]
    df = spark.createDataFrame(rows, "room_id int, ts timestamp").withColumn("_day", F.lit("mine"))
    got = sorted((r.room_id or 0, r.ts) for r in C.last_n_days(df.drop("_day")).collect())
    assert got == [(1, t0 - dt.timedelta(days=7)), (1, t0), (2, t0 - dt.timedelta(days=304)), (2, t0 - dt.timedelta(days=300))]
    assert C.last_n_days(df.drop("_day", "room_id"), keys=[]).count() == 3
    plan = C.last_n_days(df.drop("_day"))._jdf.queryExecution().analyzed().toString()
    assert "_day" in plan and "Window" not in plan
