"""Weather responses (struct of parallel arrays) and range reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas

# response field -> table column (fixed names of the weather service)
RESPONSE_FIELDS = [
    ("temperature_2m_max", "outside_temp_max"),
    ("temperature_2m_min", "outside_temp_min"),
    ("precipitation_sum", "precipitation"),
    ("cloudcover_mean", "cloudcover"),
    ("wind_speed_10m_max", "wind"),
    ("shortwave_radiation_sum", "solar_radiation"),
]


def _field(name: str):
    return lambda x: x[name]


def weather_responses(weather: DataFrame, *, days: int = 7, start: str = "2024-01-01") -> DataFrame:
    """Render weather rows as API responses, one JSON body per ``days``-day
    request window (the landing-folder form of the HTTP pull).  Each group
    holds at most ``days`` rows."""
    chunk = F.floor(F.date_diff(F.col("ds"), F.lit(start).cast("date")) / days).alias("request")
    rows = weather.select(chunk, F.struct("ds", *[c for _, c in RESPONSE_FIELDS]).alias("r"))
    g = rows.groupBy("request").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    daily = F.struct(
        F.transform("rs", lambda x: F.date_format(x["ds"], "yyyy-MM-dd")).alias("time"),
        *[F.transform("rs", _field(c)).alias(f) for f, c in RESPONSE_FIELDS],
    )
    return g.select("request", F.to_json(F.struct(daily.alias("daily"))).alias("body"))


def weather_explode(responses: DataFrame, *, body: str = "body") -> DataFrame:
    """``from_json`` with the fixed schema, then ``inline(arrays_zip)``."""
    d = responses.select(F.from_json(F.col(body), schemas.WEATHER_RESPONSE)["daily"].alias("d"))
    z = d.select(F.inline(F.arrays_zip(*[F.col("d")[f].alias(c) for f, c in [("time", "ds")] + RESPONSE_FIELDS])))
    return z.withColumn("ds", F.to_date("ds"))


def weather_range(weather: DataFrame, daily: DataFrame, *, day: str = "ds") -> DataFrame:
    """A10: weather for min(ds) .. max(ds) of the sensor table.  The bounds
    are scalar subqueries, so the filter is a plain range predicate on the
    weather scan (pushed down), not a join."""
    b = daily.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    lo = b.select("lo").scalar()
    hi = b.select("hi").scalar()
    return weather.where((F.col("ds") >= lo) & (F.col("ds") <= hi))
