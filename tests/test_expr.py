from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from segpanel.functions import expr as E
from segpanel.roles import Box


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {v}" for k, v in _types(values).items()))
    return df.select(column.alias("r")).first()[0]


def _types(values):
    kinds = {str: "string", float: "double", int: "bigint", bool: "boolean", dt.date: "date", dt.datetime: "timestamp_ntz"}
    return {k: kinds.get(type(v), "string") for k, v in values.items()}


def test_round_works_on_the_scaled_double(spark):
    assert one(spark, E.dround("v", 2), v=1.005) == 1.0
    assert one(spark, E.dround("v", 2), v=0.285) == 0.28
    assert one(spark, E.dround("v", 0), v=-2.5) == -3.0


def test_stable_round_ignores_the_last_bits(spark):
    assert one(spark, E.sround("v", 5), v=0.9993749999999999) == one(spark, E.sround("v", 5), v=0.999375) == 0.99938


def test_text_normalisation(spark):
    rows = spark.createDataFrame([(" a \t b ",), (" (NULL) ",), ("n/a",), ("",), (None,), ("nano",)], "t string")
    out = [r[0] for r in rows.select(E.normalize_text("t")).collect()]
    assert out == ["a b", None, None, None, None, "nano"]
    assert one(spark, E.upper_normalize("t"), t=" ab  c ") == "AB C"


def test_dates_and_times(spark):
    assert one(spark, E.parse_date("t"), t="1/5/2020") == dt.date(2020, 1, 5)
    assert one(spark, E.parse_date("t"), t="02/30/2020") is None
    assert one(spark, E.parse_date("t"), t="2020-01-05") is None
    assert one(spark, E.parse_datetime("d", "c"), d="01/05/2020", c="23:59:01") == dt.datetime(2020, 1, 5, 23, 59, 1)
    assert one(spark, E.parse_datetime("d", "c"), d="01/05/2020", c="24:00:00") is None
    assert one(spark, E.valid_time("t"), t="24:00:00") is False
    assert one(spark, E.valid_time("t"), t="09:30:00") is True


def test_numbers(spark):
    assert one(spark, E.try_int("t"), t="12.5") == 13
    assert one(spark, E.try_int("t"), t="1e2") == 100
    assert one(spark, E.try_int("t"), t="99999999999") is None
    assert one(spark, E.try_double("t"), t="x") is None
    assert one(spark, E.canonical_number("v", 2), v=float("nan")) is None
    assert one(spark, E.canonical_number("v", 2), v=float("-inf")) is None


def test_hour_boundaries(spark):
    a, b = dt.datetime(2020, 1, 1, 0, 59), dt.datetime(2020, 1, 1, 1, 1)
    assert one(spark, E.boundary_hours(F.col("a"), F.col("b")), a=a, b=b) == 1
    assert one(spark, E.boundary_hours(F.col("b"), F.col("a")), a=a, b=b) == -1


def test_points_and_cells(spark):
    box = Box(-74.3, -73.6, 40.4, 41.0)
    rows = spark.createDataFrame([(None, 40.5), (0.0, 40.5), (-80.0, 40.5), (-74.0, 40.5)], "x double, y double")
    assert [r[0] for r in rows.select(E.classify_xy("x", "y", box)).collect()] == ["missing", "zero", "outside", "valid"]
    assert [r[0] for r in rows.select(E.valid_xy("x", "y", box)).collect()] == [False, False, False, True]
    assert one(spark, E.grid_snap("v", 0.01), v=-73.951) == -73.955
    assert one(spark, E.grid_aligned("v", 0.01), v=-73.955) is True
    assert one(spark, E.grid_aligned("v", 0.01), v=-73.951) is False


def test_lag_classes_and_labels(spark):
    rows = spark.createDataFrame([(-3,), (0,), (7,), (8,), (365,), (366,), (None,)], "d int")
    out = [r[0] for r in rows.select(E.bucketize("d", E.LAG_EDGES, E.LAG_LABELS)).collect()]
    assert out == ["negative", "same day", "1-7 days", "8-30 days", "31-365 days", "over 365 days", None]
    label = E.location_label(F.lit("grid"), F.lit(None).cast("string"), F.col("g"), F.lit(-73.95), F.lit(40.7))
    assert one(spark, label, g="NORTH") == "GRID 40.7000, -73.9500 · NORTH"
    assert one(spark, E.location_key("a"), a="017") is None
    assert one(spark, E.location_key("a"), a="17") == "area:17"
    assert one(spark, E.is_unknown("a"), a=" (null) ") is True
    assert one(spark, E.label_match("a", "north "), a=" North") is True
