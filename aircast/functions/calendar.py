"""H1-H3, H7, H8: calendar columns and the public-holiday dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Belgian public holidays, as (month, day, name) for fixed
# dates and (days after Easter Sunday, name) for movable feasts.
FIXED_HOLIDAYS = [
    (1, 1, "New Year's Day"),
    (5, 1, "Labour Day"),
    (7, 21, "National Day"),
    (8, 15, "Assumption Day"),
    (11, 1, "All Saints' Day"),
    (11, 11, "Armistice Day"),
    (12, 25, "Christmas Day"),
]
EASTER_HOLIDAYS = [
    (0, "Easter Sunday"),
    (1, "Easter Monday"),
    (39, "Ascension Day"),
    (49, "Whit Sunday"),
    (50, "Whit Monday"),
]

# Season names by index month % 12 // 3 + 1
SEASONS = ["Winter", "Spring", "Summer", "Autumn"]


def weekday(d: Column) -> Column:
    """Monday = 0 ... Sunday = 6 (not ``dayofweek``, where Sunday = 1)."""
    return F.weekday(d)


def calendar_flags(df: DataFrame, *, day: str = "ds", local_ts: str | None = None) -> DataFrame:
    """H1: weekday, weekend flag and (for readings) the local hour."""
    out = df.withColumn("dayofweek", weekday(F.col(day))).withColumn(
        "is_weekend", weekday(F.col(day)) >= 5
    )
    if local_ts:
        out = out.withColumn("hour", F.hour(local_ts))
    return out


def day_cyclic(df: DataFrame, *, dow: str = "dayofweek") -> DataFrame:
    """H2: sin / cos of 2*pi*dow/7."""
    a = F.lit(2 * math.pi) * F.col(dow) / F.lit(7.0)
    return df.withColumn("day_sin", F.sin(a)).withColumn("day_cos", F.cos(a))


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter Sunday of ``year`` by integer arithmetic
    (anonymous Gregorian algorithm)."""
    y = year
    a = y % 19
    b = F.floor(y / 100)
    c = y % 100
    d = F.floor(b / 4)
    e = b % 4
    f = F.floor((b + 8) / 25)
    g = F.floor((b - f + 1) / 3)
    h = (a * 19 + b - d - g + 15) % 30
    i = F.floor(c / 4)
    k = c % 4
    l_ = (e * 2 + i * 2 - h - k + 32) % 7
    m = F.floor((a + h * 11 + l_ * 22) / 451)
    n = h + l_ - m * 7 + 114
    month = F.floor(n / 31)
    day = n % 31 + 1
    return F.make_date(y.cast("int"), month.cast("int"), day.cast("int"))


def holiday_dim(years: DataFrame, *, year: str = "y") -> DataFrame:
    """H3: (ds, holiday) for every year in ``years``.

    12 rows per year: a proven size bound, so callers broadcast it."""
    y = F.col(year).cast("int")
    fixed = [F.struct(F.make_date(y, F.lit(mo), F.lit(dd)).alias("ds"), F.lit(nm).alias("holiday")) for mo, dd, nm in FIXED_HOLIDAYS]
    easter = easter_sunday(y)
    movable = [F.struct(F.date_add(easter, off).alias("ds"), F.lit(nm).alias("holiday")) for off, nm in EASTER_HOLIDAYS]
    return years.select(F.inline(F.array(*fixed, *movable)))


def is_holiday(d: Column) -> Column:
    """H3 membership as a pure expression of the date itself: fixed
    (month, day) holidays, or a day offset from its own year's Easter
    Sunday.  No dimension table, no join, no scan to find the years."""
    md = F.month(d) * 100 + F.dayofmonth(d)
    fixed = md.isin([m * 100 + dd for m, dd, _ in FIXED_HOLIDAYS])
    off = F.date_diff(d, easter_sunday(F.year(d)))
    return fixed | off.isin([o for o, _ in EASTER_HOLIDAYS])


def years_of(df: DataFrame, *, day: str = "ds") -> DataFrame:
    """The calendar years spanned by ``df`` (one bounds row, exploded)."""
    b = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return b.select(F.explode(F.sequence(F.year("lo"), F.year("hi"))).alias("y"))


def with_holiday(df: DataFrame, holidays: DataFrame | None = None, *, day: str = "ds", out: str = "is_holiday") -> DataFrame:
    """Holiday flag.  Without a table: the pure expression ``is_holiday``
    (the default; no join).  With a caller's holiday table (e.g. another
    country): a left join with its distinct days, which Spark broadcasts where their measured size allows."""
    if holidays is None:
        return df.withColumn(out, is_holiday(F.col(day)))
    h = holidays.groupBy(F.col("ds").alias("_hd")).agg(F.lit(True).alias(out))
    return df.join(h, F.col(day) == F.col("_hd"), "left").drop("_hd").withColumn(
        out, F.coalesce(F.col(out), F.lit(False))
    )


def season_of(d: Column) -> Column:
    """H7: month % 12 // 3 + 1 -> Winter, Spring, Summer, Autumn."""
    idx = F.floor((F.month(d) % 12) / 3) + 1
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), idx.cast("int"))


def day_name(prompt: Column, target: Column) -> Column:
    """H8: 'today' / 'tomorrow' if the prompt says so, else the weekday name."""
    p = F.lower(prompt)
    return (
        F.when(p.contains("today"), F.lit("today"))
        .when(p.contains("tomorrow"), F.lit("tomorrow"))
        .otherwise(F.date_format(target, "EEEE"))
    )
