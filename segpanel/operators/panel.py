"""Dense zero-filled segment panels and the dates that split them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEEK = timedelta(weeks=1)
SEGMENT_COLUMNS = ("first_week", "last_week", "observed_weeks", "total")


@dataclass(frozen=True)
class PanelDates:
    """Observed horizon and evaluation windows; all are Mondays."""

    first: date
    last: date
    backtest_start: date
    backtest_end: date
    validation_start: date | None
    validation_end: date | None

    @property
    def forecast(self) -> date:
        return self.last + WEEK

    @classmethod
    def split(cls, first: date, last: date, backtest_weeks: int = 52, validation_weeks: int = 52,
              include_latest: bool = False) -> PanelDates:
        """The latest week may be partial, so it is left out of the backtest unless asked for.
        Windows are clamped to the data; there is no validation window without room for one."""
        if backtest_weeks <= 0 or validation_weeks <= 0:
            raise ValueError("window lengths must be positive")
        end = scoring_end(first, last, include_latest)
        start = max(first, end - WEEK * (backtest_weeks - 1))
        val_end = start - WEEK
        if val_end < first:
            return cls(first, last, start, end, None, None)
        return cls(first, last, start, end, max(first, val_end - WEEK * (validation_weeks - 1)), val_end)


def scoring_end(first: date, last: date, include_latest: bool = False) -> date:
    """Last week to score: the one before the latest, if there is one."""
    if include_latest or last - WEEK < first:
        return last
    return last - WEEK


def panel_dates(weekly: DataFrame, week: str = "week", **options) -> PanelDates:
    """Read first and last week (one row) and split the horizon."""
    row = weekly.agg(F.min(week).alias("first"), F.max(week).alias("last")).first()
    if row is None or row["first"] is None:
        raise ValueError("the weekly table has no dated rows")
    return PanelDates.split(row["first"], row["last"], **options)


def dense_panel(weekly: DataFrame, keys: Sequence[str], end: date, last_observed: date,
                week: str = "week", value: str = "n") -> DataFrame:
    """One row per segment and week from the segment's first week to ``end``.

    Unobserved weeks are 0 up to ``last_observed`` and NULL after it. ``weekly`` must hold one
    row per week and segment. Every observed row fills the gap up to the next observed row, so
    the panel needs one shuffle by segment and no join with a calendar; later windows over the
    same keys reuse that partitioning. Segment columns cover all weeks of ``weekly``.
    """
    whole = Window.partitionBy(*keys)
    ahead = whole.orderBy(week)
    profiled = weekly.select(
        week, *keys, F.col(value).cast("double").alias(value),
        F.lead(week).over(ahead).alias("__next"),
        F.min(week).over(whole).alias("first_week"),
        F.max(week).over(whole).alias("last_week"),
        F.count(F.lit(1)).over(whole).alias("observed_weeks"),
        F.sum(value).over(whole).cast("bigint").alias("total"),
    ).filter(F.col(week) <= F.lit(end))
    until = F.least(F.coalesce(F.date_sub("__next", 7), F.lit(end)), F.lit(end))
    filled = profiled.withColumn("__week", F.explode(F.sequence(F.col(week), until, F.expr("INTERVAL 7 DAYS"))))
    amount = (
        F.when(F.col("__week") > F.lit(last_observed), F.lit(None))
        .when(F.col("__week") == F.col(week), F.col(value))
        .otherwise(0.0)
    )
    return filled.select(F.col("__week").alias(week), *keys, amount.alias(value), *SEGMENT_COLUMNS)


def join_observed(grid: DataFrame, weekly: DataFrame, keys: Sequence[str], week: str = "week",
                  value: str = "n") -> DataFrame:
    """Attach observed values to a given grid of segment weeks; missing cells become 0."""
    observed = weekly.select(week, *keys, F.col(value).cast("double").alias("__v"))
    return grid.join(observed, [week, *keys], "left").withColumn(
        value, F.coalesce(F.col("__v"), F.lit(0.0))
    ).drop("__v")
