"""Scalar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Advice texts (rule H9), alert and warning texts.
ADVICE_VENTILATE = "💨 Ventileer: CO₂ > 1000 ppm"
ADVICE_TOO_WARM = "🔥 Zet verwarming lager (te warm)"
ADVICE_TOO_COLD = "❄️ Bijverwarmen aanbevolen (te koud)"
ADVICE_ALL_FINE = "✅ Alles binnen comfort en luchtkwaliteit"
ALERT_TEMPLATE = "Warning: the CO₂-level is now at %s ppm. Please ventilate the room!"
WARN_CO2 = "The CO₂ is expected to reach %s ppm"
WARN_TEMP = "The indoor temperature may rise to %s degrees"
WARN_TAIL = " today. Please prepare to ventilate or keep your room cool."

# comfort limits (guide lines of the charts)
TEMP_LOW, TEMP_HIGH, CO2_LIMIT = 18.0, 25.0, 1000.0


def clip(x: Column, low: Column, high: Column) -> Column:
    """H4: bound to [low, high]; when low > high the upper bound wins.  A missing
    value stays missing, and so it is with a missing bound."""
    known = x.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(known, F.least(F.greatest(x, low), high))


def round_ieee(x: Column, digits: int) -> Column:
    """Round half up in binary floating point: floor(x * 10^d + 0.5) / 10^d.
    The result depends only on the double itself, so every engine gives
    the same digits (decimal ``round`` implementations break ties apart)."""
    k = float(10**digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def product_error(x: Column, k: float, product: Column) -> Column:
    """x * k - product, exactly, where ``product`` is x * k rounded (Dekker's splitting of x)."""
    wide = F.lit(134217729.0) * x  # 2^27 + 1
    high = wide - (wide - x)
    return (high * F.lit(k) - product) + (x - high) * F.lit(k)


def half_even(x: Column, digits: int = 0) -> Column:
    """H5: Python's round(x, d), by the exact value of the double: half to even where x is a tie, else to the
    nearest.  x * 10^d may round to a tie that x isn't (0.35, 1.15); the product's error tells."""
    k = float(10**digits)
    r = x * F.lit(k)
    f = F.floor(r)
    diff = r - f
    odd = F.abs(f % 2) == 1
    if digits:
        e = product_error(x, k, r)
        tie_up = (e > 0) | ((e == 0) & odd)
    else:
        tie_up = odd
    up = (diff > 0.5) | ((diff == 0.5) & tie_up)
    # from 2^52 on there is nothing left to round
    return F.when(F.abs(r) >= float(1 << 52), x).otherwise((f + F.when(up, 1).otherwise(0)).cast("double") / F.lit(k))


#: H5 by its other name.
round_half_even = half_even


def py_text(x: Column) -> Column:
    """str() of a Python number or None."""
    return F.coalesce(x.cast("string"), F.lit("None"))


def int_text(x: Column) -> Column:
    """Text of round(x) as Python prints an int: all its digits to 2^126, from there on the 17 that tell doubles
    apart and zeros.  A prediction of a model whose errors grow without bound may pass the range of
    bigint; infinite and missing numbers, which have no int, are named."""
    r = half_even(x)
    unit, size = float(1 << 63), F.abs(r)
    high = F.floor(size / F.lit(unit))  # exact, as is the rest: both are parts of the double's own bits
    low = (size - high.cast("double") * F.lit(unit)).try_cast("bigint")
    high, low = (F.when(size < unit * unit, v).cast("decimal(19,0)") for v in (high, low))
    whole = F.concat(F.when(r < 0, "-").otherwise(""), (high * F.lit(1 << 62).cast("decimal(19,0)") * F.lit(2) + low).cast("string"))
    return F.when(size < unit, r.try_cast("bigint").cast("string")).when(size < unit * unit, whole).when(size >= unit * unit, F.format_string("%.0f", r))


def advice(pred_co2: Column, pred_temp: Column, *, co2: float = CO2_LIMIT, low: float = TEMP_LOW, high: float = TEMP_HIGH,
           texts: tuple[str, str, str, str] = (ADVICE_VENTILATE, ADVICE_TOO_WARM, ADVICE_TOO_COLD, ADVICE_ALL_FINE)) -> Column:
    """H9: strict thresholds; parts joined by ' | '; none -> all fine.  Without both
    predictions there is no advice."""
    vent, warm, cold, fine = texts
    parts = F.concat_ws(
        " | ",
        F.when(pred_co2 > co2, F.lit(vent)),
        F.when(pred_temp > high, F.lit(warm)).when(pred_temp < low, F.lit(cold)),
    )
    text = F.coalesce(F.nullif(parts, F.lit("")), F.lit(fine))
    return F.when(pred_co2.isNotNull() & pred_temp.isNotNull(), text)


def alert_text(co2: Column) -> Column:
    """Message for a reading at or over the threshold."""
    return F.format_string(ALERT_TEMPLATE, co2.cast("string"))


def warning_text(pred_co2: Column, pred_temp: Column, *, co2: float = 1000.0, temp: float = 25.0) -> Column:
    """NULL when neither limit is reached (inclusive limits)."""
    parts = F.concat_ws(
        " ",
        F.when(pred_co2 >= co2, F.format_string(WARN_CO2, int_text(pred_co2))),
        F.when(pred_temp >= temp, F.format_string(WARN_TEMP, int_text(pred_temp))),
    )
    return F.when(parts != "", F.concat(parts, F.lit(WARN_TAIL)))


def format_day(d: Column) -> Column:
    """H6 '%Y-%m-%d'"""
    return F.date_format(d, "yyyy-MM-dd")


def format_clock(ts: Column) -> Column:
    """H6 '%H:%M'"""
    return F.date_format(ts, "HH:mm")


def format_long_day(d: Column) -> Column:
    """H6 '%B %d, %Y'"""
    return F.date_format(d, "MMMM dd, yyyy")


def format_iso_seconds(ts: Column) -> Column:
    """'%Y-%m-%dT%H:%M:%S' (forecast file)"""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def comfort_flags(temp: Column, co2: Column) -> list[Column]:
    """The chart guide lines as columns plus in-band flags."""
    return [
        F.lit(TEMP_LOW).alias("temp_low"),
        F.lit(TEMP_HIGH).alias("temp_high"),
        F.lit(CO2_LIMIT).alias("co2_limit"),
        temp.between(TEMP_LOW, TEMP_HIGH).alias("temp_in_band"),
        (co2 <= CO2_LIMIT).alias("co2_in_band"),
    ]
