"""Queries on rooms whose data reach the branches that a month of one season doesn't: series of 6, 7, 13 and 20 days,
a week with a holiday and the change to summer time, a week across two seasons, and stamps with an offset."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import daily as D
from ..operators import trends as TR
from ..session import materialize
from ..sources import fixtures as fx
from . import features as FE
from . import models as M
from .daily_tables import feature_table
from .registry import ORACLE, query


def varied_readings(spark, sf):
    return C.clean(fx.varied_measurements(spark, sf))


def varied_daily(spark, sf):
    return D.presence_ratio(D.daily(varied_readings(spark, sf)))


def varied_features(spark, sf):
    return FE.features(varied_daily(spark, sf), fx.weather(spark, sf, days=fx.VARIED_WEATHER_DAYS))


def varied(name: str) -> str:
    """The oracle of ``name`` on the varied rooms."""
    return fx.varied_sql(ORACLE[name])


def week(spark, sf):
    return TR.trend_columns(C.last_n_days(varied_readings(spark, sf)))


@query("daily_agg_varied", varied("daily_agg"))
def daily_agg(spark, sf):
    """D1 with stamps that carry an offset (B1)."""
    return D.daily(varied_readings(spark, sf))


@query("hourly_profile_varied", varied("hourly_profile"))
def hourly_profile(spark, sf):
    """D3 over weeks that hold the change to summer time (B2)."""
    return TR.profile(week(spark, sf), "hour")


@query("holiday_profile_varied", varied("holiday_profile"))
def holiday_profile(spark, sf):
    """D5 over weeks that hold Easter Monday."""
    return TR.profile(week(spark, sf), "is_holiday")


@query("season_profile_varied", varied("season_profile"))
def season_profile(spark, sf):
    """D6 over weeks in two seasons."""
    return TR.season_profile(week(spark, sf))


@query("min_days_guard_varied", varied("min_days_guard"))
def min_days_guard(spark, sf):
    """D11 where some rooms have fewer than 7 days."""
    return D.min_days_guard(varied_daily(spark, sf))


@query("regressor_gate_varied", varied("regressor_gate"))
def regressor_gate(spark, sf):
    """K2 on spans under and over 21 and 30 days."""
    return M.regressor_gate(varied_features(spark, sf)).select("room_id", "span_days", "n_regressors", "weekly", "n_changepoints", "warn_small")


#: Days of a block in the queries below: short, so that the month has borders.
BLOCK_DAYS = 8


@query("feature_matrix_blocks", ORACLE["feature_matrix"])
def feature_matrix_blocks(spark, sf):
    """K1 (E1-E4) by blocks of days with a carry table: no window over a whole series."""
    return feature_table(spark, sf, block_days=BLOCK_DAYS)


@query("expanding_slices_blocks", ORACLE["expanding_slices"])
def expanding_slices_blocks(spark, sf):
    """E11 by blocks of days."""
    return M.expanding_slices(feature_table(spark, sf), block_days=BLOCK_DAYS)


@query("small_data_eval_varied")
def small_data_eval(spark, sf):
    """K19 where the span is short enough to need it."""
    return M.small_data_eval(materialize(varied_features(spark, sf)))


@query("holdout_eval_varied")
def holdout_eval(spark, sf):
    """K11 with series that are too short for it."""
    return M.holdout_eval(materialize(varied_features(spark, sf))).withColumn("variant", F.lit("default"))
