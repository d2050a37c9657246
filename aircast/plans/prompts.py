"""Answers and prompt texts built from the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS
from ..keys import kjoin
from ..functions import calendar as cal
from ..functions import scalar as S
from ..functions import text as X
from ..operators.evaluate import context_line, ordered_text

# Answer and prompt texts.
NO_FORECAST = "Sorry, I don't have forecast data for %s."
DATE_INVALID = "Sorry, the date you provided is not valid."
TOO_FAR = "Sorry, ik kan geen weerdata ophalen voor zo ver in de toekomst. Vraag iets binnen de komende 15 dagen 💨."
NO_WEATHER = "Sorry, er zijn geen weergegevens beschikbaar voor deze datum."
GENERAL = "The user asked: %s\nRespond as Luna, a helpful and emotional human assistant."
CLIMATE_HEAD = "Here is today's climate data, sorted by time:\n"
CLIMATE_TAIL = (
    "Please use this data to answer the user's question in a clear and helpful way.\n"
    "Do not use any formatting such as bold, italic, or special markdown. Your answer must be in plain text only.\n"
    "If you were about to use symbols like * or **, replace them with nothing. Just write plain headings or dashes."
)
FORECAST_HEAD = (
    "You are Luna, a helpful assistant giving future indoor climate forecasts based on predicted CO₂, indoor temperature, and outdoor weather data.\n"
    "For each day, include:\n"
    "- Date\n"
    "- Forecast: Indoor CO₂ (ppm), indoor temperature (°C), and outdoor values: max temperature, solar radiation, wind, rain, and cloud cover.\n"
    "- Advice: Give specific ventilation or heating tips using both indoor and outdoor context. Always explain *why*, based on outdoor temp, wind, cloud cover, solar radiation, or rain. For example, mention if it's good to ventilate early morning due to cool air, or avoid it if it's rainy or too hot.\n"
    "Do not use formatting like ** or *.\n\n"
)
FORECAST_TAIL = "Write the 7-day forecast using the format above."


def with_intent(prompts: DataFrame, as_of: str) -> DataFrame:
    d = F.lit(as_of).cast("date")
    return prompts.withColumn("intent", X.route(F.col("prompt"), d))


def forecast_lookup(prompts: DataFrame, forecast: DataFrame, *, as_of: str, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Each prompt's target day (I6, default ``as_of``) matched to the
    forecast row of its series for that day; unmatched prompts kept."""
    d = F.lit(as_of).cast("date")
    p = prompts.withColumn("target_date", F.coalesce(X.forecast_date(F.col("prompt"), d), d))
    fc = forecast.select(*keys, F.col("ds").alias("target_date"), "pred_co2", "pred_temp", "advies")
    return p.join(fc, [*keys, "target_date"], "left")


def day_answer(lookup: DataFrame) -> DataFrame:
    """One-day forecast text, or the no-data text."""
    day = F.date_format("target_date", "yyyy-MM-dd")
    name = cal.day_name(F.col("prompt"), F.col("target_date"))
    text = F.concat(
        F.lit("Forecast for "), name, F.lit(" ("), day, F.lit("):\nPredicted CO₂: "),
        S.int_text(F.col("pred_co2")),
        F.lit(" ppm\nPredicted Temperature: "), S.half_even(F.col("pred_temp"), 1).cast("string"),
        F.lit("°C\nAdvice: "), F.coalesce(F.col("advies"), F.lit("No specific advice available")),
    )
    missing = F.format_string(NO_FORECAST, day)
    return lookup.withColumn("answer", F.when(F.col("pred_co2").isNull() & F.col("pred_temp").isNull(), missing).otherwise(text))


def weather_answer(prompts: DataFrame, weather: DataFrame, *, as_of: str) -> DataFrame:
    """I8 with I3-I5: one-day weather text for each weather prompt."""
    d = F.lit(as_of).cast("date")
    target, status = X.weather_target(F.col("prompt"), d)
    p = prompts.withColumn("target_date", target).withColumn("status", status)
    w = weather.select(F.col("ds").alias("target_date"), "outside_temp_max", "outside_temp_min", "cloudcover", "wind", "precipitation", F.lit(True).alias("_known"))
    j = p.join(w, "target_date", "left")
    text = F.concat(
        F.lit("📅 Weather forecast for "), F.date_format("target_date", "MMMM dd, yyyy"), F.lit(" in Brussels:\n"),
        F.lit("- 🌡️ Max temp: "), S.py_text(F.col("outside_temp_max")), F.lit("°C\n"),
        F.lit("- 🌡️ Min temp: "), S.py_text(F.col("outside_temp_min")), F.lit("°C\n"),
        F.lit("- ☁️ Cloud cover: "), S.py_text(F.col("cloudcover")), F.lit("%\n"),
        F.lit("- 💨 Wind: "), S.py_text(F.col("wind")), F.lit(" km/h\n"),
        F.lit("- 🌧️ Precipitation: "), S.py_text(F.col("precipitation")), F.lit(" mm\n"),
    )
    ans = (
        F.when(F.col("status") == "invalid", DATE_INVALID)
        .when(F.col("status") == "too_far", TOO_FAR)
        .when(F.col("_known").isNull(), NO_WEATHER)
        .otherwise(text)
    )
    return j.withColumn("answer", ans).drop("_known")


def climate_context(prompts: DataFrame, hourly: DataFrame, *, as_of: str, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """today's hourly rows of the prompt's series plus its highest and
    lowest reading, as one prompt text (fallback text without data).  The
    per-day group has at most one row per hour."""
    today = hourly.where(F.col("day") == F.lit(as_of).cast("date"))
    ok = today.where(F.col("co2").isNotNull())
    newest_first = -F.unix_micros(F.col("ts"))
    ctx = today.groupBy(*keys).agg(ordered_text(context_line(today), F.col("ts")).alias("table"))
    ext = ok.groupBy(*keys).agg(
        F.max_by(F.struct("co2", "ts_raw"), F.struct("co2", "ts")).alias("hi"),
        F.min_by(F.struct("co2", "ts_raw"), F.struct("co2", newest_first)).alias("lo"),
    )
    j = kjoin(kjoin(prompts, ctx, keys, "left"), ext, keys, "left")
    text = F.concat(
        F.lit(CLIMATE_HEAD), F.col("table"), F.lit("\n\nImportant data:\nHighest CO₂ level: "),
        F.col("hi.co2").cast("string"), F.lit(" ppm at "), F.substring("hi.ts_raw", 12, 5),
        F.lit("\nLowest CO₂ level: "), F.col("lo.co2").cast("string"), F.lit(" ppm at "), F.substring("lo.ts_raw", 12, 5),
        F.lit("\n\nUser question: "), F.col("prompt"), F.lit("\n"), F.lit(CLIMATE_TAIL),
    )
    fallback = F.format_string(GENERAL, F.col("prompt"))
    return j.withColumn("context", F.when(F.col("hi").isNull(), fallback).otherwise(text)).drop("table", "hi", "lo")


def forecast_line(df: DataFrame):
    return F.concat(
        F.date_format("ds", "yyyy-MM-dd"), F.lit(" → Predicted CO2: "), S.int_text(F.col("pred_co2")),
        F.lit(" ppm, Predicted Temp: "), S.half_even(F.col("pred_temp"), 1).cast("string"),
        F.lit("°C, Outside max: "), S.py_text(F.col("outside_temp_max")), F.lit("°C, Solar: "), S.py_text(F.col("solar_radiation")),
        F.lit(", Rain: "), S.py_text(F.col("precipitation")), F.lit(" mm, Wind: "), S.py_text(F.col("wind")),
        F.lit(" km/h, Clouds: "), S.py_text(F.col("cloudcover")), F.lit("%, Advice: "), F.coalesce(F.col("advies"), F.lit("—")),
    )


def forecast_context(prompts: DataFrame, forecast: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """The series' latest forecast (one run: 7 rows) as one prompt."""
    t = forecast.groupBy(*keys).agg(ordered_text(forecast_line(forecast), F.col("ds")).alias("table"))
    j = kjoin(prompts, t, keys, "left")
    text = F.concat(
        F.lit(FORECAST_HEAD + "Forecast data:\n"), F.col("table"), F.lit("\n\nUser question: "), F.col("prompt"),
        F.lit("\n" + FORECAST_TAIL),
    )
    fallback = F.format_string(GENERAL, F.col("prompt"))
    return j.withColumn("context", F.when(F.col("table").isNull(), fallback).otherwise(text)).drop("table")


def word_count(text):
    """len(text.split()): whitespace-separated words."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def trim_history(turns: DataFrame, *, max_tokens: int = 16385, buffer: int = 1000, conv: str = "conv_id",
                 order: str = "turn", block: int = 1024, pin_system: bool = False) -> DataFrame:
    """Keep the newest turns while their words + buffer fit the budget.
    The running sum (newest first) equals the reference's early break
    because word counts are never negative.

    The sum is computed in blocks of ``block`` turns: block totals (one row
    per block) get a suffix sum per conversation, and the running sum inside
    a block is a window over (conversation, block).  A very long
    conversation is thus spread over many tasks.  ``pin_system`` keeps
    system turns whatever the budget (the reference may drop them)."""
    t = turns.withColumn("n_words", word_count(F.col("text")).cast("bigint")).withColumn(
        "_blk", F.floor(F.col(order) / block)
    )
    tot = t.groupBy(conv, "_blk").agg(F.sum("n_words").alias("_bs"))
    newer = Window.partitionBy(conv).orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_prior", F.coalesce(F.sum("_bs").over(newer), F.lit(0))).drop("_bs")
    inner = Window.partitionBy(conv, "_blk").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = t.join(tot, [conv, "_blk"]).withColumn("running", F.col("_prior") + F.sum("n_words").over(inner))
    kept = F.col("running") + buffer <= max_tokens
    if pin_system:
        kept = kept | (F.col("role") == "system")
    return out.drop("_blk", "_prior").withColumn("kept", kept)
