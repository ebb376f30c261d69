from __future__ import annotations

from datetime import date

import pytest

from segpanel.operators import quality as q
from segpanel.operators.clean import FLAGS, RAW_COLUMNS, clean_events, project_allowed
from segpanel.roles import AnomalyConfig, Box, GrainLimits, QualityConfig

CONFIG = QualityConfig(date(2006, 1, 1), date(2024, 12, 31), Box(-74.3, -73.6, 40.4, 41.0), ("NORTH", "SOUTH"), ("A", "B"))
GOOD = dict(event_id="1", start_date_text="01/02/2020", start_time_text="10:00:00", end_date_text="01/02/2020",
            end_time_text="11:00:00", report_date_text="01/03/2020", grp_text="north", area_text="7", cat_text="theft  x",
            cls_text="a", x_text="-73.9", y_text="40.7")


def flags(spark, **changes):
    row = {**GOOD, **changes}
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    df = spark.createDataFrame([tuple(row[c] for c in RAW_COLUMNS)], schema)
    out = clean_events(df, CONFIG).first().asDict()
    return {f for f in FLAGS if out[f]}, out


def test_a_good_row_has_no_flag(spark):
    found, row = flags(spark)
    assert found == set() and row["is_eligible"] and row["area"] == 7 and row["cat"] == "THEFT X" and row["grp"] == "NORTH"


@pytest.mark.parametrize("changes, expected, eligible", [
    (dict(start_date_text="(null)"), {"flag_missing_start"}, False),
    (dict(start_date_text="01/01/1990"), {"flag_old_start"}, False),
    (dict(start_date_text="01/01/2030"), {"flag_future_start", "flag_end_before_start", "flag_report_before_start"}, False),
    (dict(end_date_text="01/01/2030"), {"flag_future_end"}, True),
    (dict(end_time_text="09:00:00"), {"flag_end_before_start"}, True),
    (dict(end_time_text=None), set(), True),
    (dict(end_date_text="01/01/2020", end_time_text=None), {"flag_end_before_start"}, True),
    (dict(report_date_text="01/01/2020"), {"flag_report_before_start"}, True),
    (dict(grp_text="ATLANTIS"), {"flag_missing_grp"}, True),
    (dict(area_text="x"), {"flag_missing_area"}, True),
    (dict(cat_text="NaN"), {"flag_missing_cat"}, True),
    (dict(x_text=None), {"flag_missing_xy"}, True),
    (dict(x_text="0"), {"flag_zero_xy", "flag_outside_xy"}, True),
    (dict(y_text="50"), {"flag_outside_xy"}, True),
    (dict(cls_text="Z"), {"flag_invalid_cls"}, True),
    (dict(cls_text=None), {"flag_invalid_cls"}, True),
])
def test_each_rule(spark, changes, expected, eligible):
    found, row = flags(spark, **changes)
    assert found == expected and row["is_eligible"] is eligible


def test_projection_is_an_allow_list(spark):
    df = spark.createDataFrame([(1, "secret")], "event_id int, suspect string")
    assert project_allowed(df, ["event_id", "grp"]).columns == ["event_id"]


def test_flag_overlap(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (None, True)], "a boolean, b boolean")
    assert q.flag_overlap(df, ["a", "b"]).first().asDict() == {
        "rows": 4, "flag_total": 4, "rows_with_flag": 3, "rows_with_overlap": 1, "max_flags_per_row": 2, "rows_with_null_flag": 1}


def test_signal_status_fails_closed(spark):
    from pyspark.sql import functions as F
    facts = spark.createDataFrame([(None, 5)], "age int, rows int")
    rules = [(F.col("age") > 1, "stale", "too old")]
    assert q.signal_status(facts, rules, F.col("rows") == 0).first()["status"] == "stale"
    fresh = spark.createDataFrame([(0, 0)], "age int, rows int")
    assert q.signal_status(fresh, rules, F.col("rows") == 0).first()["status"] == "empty"


def test_code_consistency(spark):
    df = spark.createDataFrame([("1", "b"), ("1", "a"), ("1", "b"), ("2", "c")], "code string, name string")
    assert [tuple(r) for r in q.code_consistency(df, "code", "name").collect()] == [("1", 2, 3, "a | b")]


def test_configs_reject_bad_thresholds():
    with pytest.raises(ValueError):
        AnomalyConfig(z=(3.0, 2.0, 3.5, 4.5))
    with pytest.raises(ValueError):
        AnomalyConfig(min_prior_weeks=20)
    with pytest.raises(ValueError):
        GrainLimits(10, 1, 1, 9, 5)
    with pytest.raises(ValueError):
        Box(1, 0, 0, 1)
    with pytest.raises(ValueError):
        QualityConfig(date(2021, 1, 1), date(2020, 1, 1), CONFIG.box, (), ())
