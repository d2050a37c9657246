"""Prompt classification and date resolution as columns.

All tests are built-in string / regex expressions (Java regex in Spark);
one CASE chain per decision, evaluated in the reference's order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic keywords.
CLIMATE_WORDS = ["temperature", "humidity", "co2", "air", "climate", "room", "indoor"]
FORECAST_WORDS = ["forecast"]
WEATHER_WORDS = ["weather"]

# Month names and abbreviations with their numbers.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}

# The weather-date patterns (month-day, day-month, numeric MM/DD).
_MONTH_ALT = (
    "january|february|march|april|may|june|july|august|september|october|november|december|"
    "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
)
WEATHER_DATE_PATTERNS = [
    r"(" + _MONTH_ALT + r")\s+(\d{1,2})(?:\s+(\d{4}))?",
    r"(\d{1,2})\s+(" + _MONTH_ALT + r")(?:\s+(\d{4}))?",
    r"(\d{1,2})[/\-](\d{1,2})(?:[/\-](\d{4}))?",
]

# The forecast-date patterns, tested in this order.
_ABBR = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
FORECAST_DATE_PATTERNS = [
    r"\b(?:on\s+)?(" + _ABBR + r")[a-z]*\s+(\d{1,2})(?:st|nd|rd|th)?\b",
    r"\b(?:on\s+)?(\d{1,2})(?:st|nd|rd|th)?\s+(" + _ABBR + r")[a-z]*\b",
    r"\btomorrow\b",
    r"\btoday\b",
    r"\byesterday\b",
]

# Relative-date phrases in test order (phrase, day offset).
RELATIVE_DATES = [
    ("tomorrow", 1),
    ("yesterday", -1),
    ("today", 0),
    ("day after tomorrow", 2),
    ("overmorrow", 2),
    ("day before yesterday", -2),
    ("next week", 7),
    ("last week", -7),
]

# Exact music commands of the listener.
MUSIC_COMMANDS = {
    "stop": ["stop music", "stop song"],
    "pause": ["pause", "pause music", "pause song"],
    "resume": ["resume", "resume music", "resume song"],
    "next": ["next song", "skip song", "next"],
}
WAKE_PHRASE = "hey luna"


def has(text: Column, word: str, mode: str = "reference") -> Column:
    """Substring test (``reference``) or whole-word test (``strict``: 'air'
    no longer hits 'fair', 'on' no longer hits 'one')."""
    if mode == "strict":
        return text.rlike(r"\b" + word + r"\b")
    return text.contains(word)


def _any(text: Column, words, mode: str = "reference") -> Column:
    out = F.lit(False)
    for w in words:
        out = out | has(text, w, mode)
    return out


def is_climate(prompt: Column, mode: str = "reference") -> Column:
    return _any(F.lower(prompt), CLIMATE_WORDS, mode)


def is_forecast(prompt: Column, mode: str = "reference") -> Column:
    return _any(F.lower(prompt), FORECAST_WORDS, mode)


def is_weather(prompt: Column, mode: str = "reference") -> Column:
    return _any(F.lower(prompt), WEATHER_WORDS, mode)


def _month_number(m: Column) -> Column:
    mp = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    return mp[F.lower(m)]


def _valid_date(y: Column, m: Column, d: Column) -> Column:
    """date(y, m, d) or NULL when the parts do not form a date."""
    return F.try_to_date(F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string")), "yyyy-M-d")


def _first_valid(p: Column, pattern: str, month: int, day: int, year: Column) -> Column:
    """The first match of a day-and-month pattern that is a date (all matches are tried in order)."""
    parts = F.arrays_zip(F.regexp_extract_all(p, F.lit(pattern), F.lit(month)).alias("m"), F.regexp_extract_all(p, F.lit(pattern), F.lit(day)).alias("d"))
    dates = F.transform(parts, lambda x: _valid_date(year, _month_number(x["m"]), x["d"].try_cast("int")))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), 0)


def forecast_date(prompt: Column, as_of: Column) -> Column:
    """The date a forecast question asks for, NULL if none is named.
    Patterns in order, every match of each; the first valid date wins."""
    p = F.lower(prompt)
    year = F.year(as_of)
    md, dm, tomorrow, today, yesterday = FORECAST_DATE_PATTERNS
    return F.coalesce(
        _first_valid(p, md, 1, 2, year),
        _first_valid(p, dm, 2, 1, year),
        F.when(p.rlike(tomorrow), F.date_add(as_of, 1)),
        F.when(p.rlike(today), as_of),
        F.when(p.rlike(yesterday), F.date_sub(as_of, 1)),
    )


def route(prompt: Column, as_of: Column, mode: str = "reference") -> Column:
    """Intent label, first hit wins; the first nine tests are
    case-sensitive on the raw prompt.  ``mode="strict"`` matches whole words
    and lets weather / forecast questions through the music tests (so
    'weather next week' is weather, not skip)."""
    p = prompt
    h = lambda w: has(p, w, mode)
    fc = is_forecast(p, mode)
    topical = (is_weather(p, mode) | fc) if mode == "strict" else F.lit(False)
    return (
        F.when(p.startswith("play "), "play")
        .when(~topical & h("pause"), "pause")
        .when(~topical & (h("resume") | h("continue")), "resume")
        .when(~topical & (h("skip") | h("next")), "skip")
        .when(h("stop music") | h("stop song"), "stop_music")
        .when(h("light") & h("on"), "light_on")
        .when(h("light") & h("off"), "light_off")
        .when(h("measure") & h("now"), "measure")
        .when(h("forecast") & h("run"), "run_forecast")
        .when(is_weather(p, mode), "weather")
        .when(fc & forecast_date(p, as_of).isNotNull(), "forecast_day")
        .when(fc, "forecast")
        .when(is_climate(p, mode), "climate")
        .otherwise("general")
    )


def relative_offset(prompt: Column, mode: str = "reference") -> Column:
    """Day offset of the first relative phrase in test order, or NULL.
    ``mode="strict"`` tests the longest phrase first ('day after tomorrow'
    is +2, not +1)."""
    p = F.lower(prompt)
    out = None
    phrases = RELATIVE_DATES if mode == "reference" else sorted(RELATIVE_DATES, key=lambda x: -len(x[0]))
    for phrase, off in phrases:
        out = F.when(p.contains(phrase), F.lit(off)) if out is None else out.when(p.contains(phrase), F.lit(off))
    return out


def absolute_date(prompt: Column, as_of: Column) -> tuple[Column, Column]:
    """I4: (date, matched) from the first weather-date pattern that matches
    the prompt without punctuation; numeric dates read as MM/DD; the year
    defaults to the year of ``as_of``.  ``matched`` and a NULL date mean an
    invalid date."""
    p = F.regexp_replace(F.lower(prompt), r"[?!.,;]", "")
    p1, p2, p3 = WEATHER_DATE_PATTERNS
    y_of = lambda pat, g: F.coalesce(F.nullif(F.regexp_extract(p, pat, g), F.lit("")).try_cast("int"), F.year(as_of))
    d = (
        F.when(p.rlike(p1), _valid_date(y_of(p1, 3), _month_number(F.regexp_extract(p, p1, 1)), F.regexp_extract(p, p1, 2).try_cast("int")))
        .when(p.rlike(p2), _valid_date(y_of(p2, 3), _month_number(F.regexp_extract(p, p2, 2)), F.regexp_extract(p, p2, 1).try_cast("int")))
        .when(p.rlike(p3), _valid_date(y_of(p3, 3), F.regexp_extract(p, p3, 1).try_cast("int"), F.regexp_extract(p, p3, 2).try_cast("int")))
    )
    matched = p.rlike(p1) | p.rlike(p2) | p.rlike(p3)
    return d, matched


def weather_target(prompt: Column, as_of: Column, *, horizon: int = 15, mode: str = "reference") -> tuple[Column, Column]:
    """I3 + I4 + I5: (target date, status) for a weather question.
    status: ok / invalid / too_far."""
    off = relative_offset(prompt, mode)
    ad, matched = absolute_date(prompt, as_of)
    target = F.when(off.isNotNull(), F.date_add(as_of, off)).when(matched, ad).otherwise(as_of)
    status = (
        F.when(off.isNull() & matched & ad.isNull(), "invalid")
        .when(target > F.date_add(as_of, horizon), "too_far")
        .otherwise("ok")
    )
    return target, status


def wake_label(text: Column, *, wake: str = WAKE_PHRASE) -> Column:
    """Wake phrase present in the (lower-cased) transcript."""
    return F.lower(text).contains(wake)


def command_label(text: Column) -> Column:
    """Exact-match music command, else NULL."""
    t = F.lower(F.trim(text))
    out = None
    for label, words in MUSIC_COMMANDS.items():
        out = F.when(t.isin(words), label) if out is None else out.when(t.isin(words), label)
    return out
