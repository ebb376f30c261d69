"""Raw text rows to typed, flagged events. One projection per stage and no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segpanel.functions import expr as E
from segpanel.roles import QualityConfig

RAW_COLUMNS = (
    "event_id", "start_date_text", "start_time_text", "end_date_text", "end_time_text",
    "report_date_text", "grp_text", "area_text", "cat_text", "cls_text", "x_text", "y_text",
)

# Flag names in output order.
FLAGS = (
    "flag_missing_start", "flag_old_start", "flag_future_start", "flag_future_end",
    "flag_end_before_start", "flag_report_before_start", "flag_missing_grp", "flag_missing_area",
    "flag_missing_cat", "flag_missing_xy", "flag_zero_xy", "flag_outside_xy", "flag_invalid_cls",
)

XY_FLAGS = ("flag_missing_xy", "flag_zero_xy", "flag_outside_xy")


def prepare(raw: DataFrame) -> DataFrame:
    """Normalise text; labels in upper case."""
    upper = {"grp_text", "cat_text", "cls_text"}
    return raw.select(*[
        (E.upper_normalize(c) if c in upper else E.normalize_text(c)).alias(c) for c in RAW_COLUMNS
    ])


def type_rows(prepared: DataFrame, config: QualityConfig) -> DataFrame:
    """Parse dates, times, numbers; keep only allowed labels. The raw class stays for its flag."""
    return prepared.select(
        "event_id",
        E.parse_date("start_date_text").alias("start_day"),
        E.parse_date("end_date_text").alias("end_day"),
        E.parse_date("report_date_text").alias("report_day"),
        E.parse_datetime("start_date_text", "start_time_text").alias("start_ts"),
        E.parse_datetime("end_date_text", "end_time_text").alias("end_ts"),
        F.col("start_time_text").alias("start_time"),
        E.allow_list("grp_text", config.allowed_groups).alias("grp"),
        E.try_int("area_text").alias("area"),
        F.col("cat_text").alias("cat"),
        E.allow_list("cls_text", config.allowed_classes).alias("cls"),
        F.col("cls_text").alias("cls_raw"),
        E.try_double("x_text").alias("x"),
        E.try_double("y_text").alias("y"),
    )


def _or_false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def eligible(time: Column | str, config: QualityConfig) -> Column:
    """Dated and inside the accepted range; never NULL."""
    day = E.col(time)
    return _or_false((day >= F.lit(config.min_day)) & (day <= F.lit(config.as_of)))


def flag_columns(config: QualityConfig) -> dict[str, Column]:
    start, end, report = F.col("start_day"), F.col("end_day"), F.col("report_day")
    start_ts, end_ts = F.col("start_ts"), F.col("end_ts")
    backwards = F.when(start_ts.isNotNull() & end_ts.isNotNull(), end_ts < start_ts).otherwise(
        _or_false(end < start)
    )
    rules = (
        start.isNull(),
        _or_false(start < F.lit(config.min_day)),
        _or_false(start > F.lit(config.as_of)),
        _or_false(end > F.lit(config.as_of)),
        backwards,
        _or_false(report < start),
        F.col("grp").isNull(),
        F.col("area").isNull(),
        F.col("cat").isNull(),
        E.missing_xy("x", "y"),
        E.zero_xy("x", "y"),
        E.outside_xy("x", "y", config.box),
        ~_or_false(F.col("cls_raw").isin(list(config.allowed_classes))),
    )
    return dict(zip(FLAGS, rules))


def quality_flags(typed: DataFrame, config: QualityConfig) -> DataFrame:
    """Add the thirteen row flags and the eligibility flag in one projection."""
    return typed.select(
        "*", *[rule.alias(name) for name, rule in flag_columns(config).items()],
        eligible("start_day", config).alias("is_eligible"),
    )


def clean_events(raw: DataFrame, config: QualityConfig) -> DataFrame:
    return quality_flags(type_rows(prepare(raw), config), config)


def project_allowed(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Keep allow-listed columns only; anything else never leaves the scan."""
    return df.select(*[c for c in df.columns if c in set(allowed)])
