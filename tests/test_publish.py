from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from segpanel.operators import forecast as fc
from segpanel.operators import publish as pb
from segpanel.operators import quality as q
from segpanel.operators.association import cramers_v

MONDAY = date(2024, 1, 1)
KEYS = ["grp", "area", "cat", "cls"]


def week(i):
    return MONDAY + timedelta(weeks=i)


@pytest.fixture(scope="module")
def weekly(spark):
    rows = [(week(i), g, a, c, "k", n) for i in range(12) for g, a, c, n in
            [("n", "7", "x", i + 1), ("s", "8", "x", 3), ("s", "7", "y", 1), ("n", "UNKNOWN", "y", 2)] if (i, g) != (5, "n")]
    return spark.createDataFrame(rows, "week date, grp string, area string, cat string, cls string, n bigint").cache()


def forecast(spark):
    rows = [("n", "7", "x", 4.0, 2.0), ("n", "7", "y", 1.0, None), ("s", "8", "x", 3.0, 3.0), ("s", "7", "x", 9.0, 1.0),
            ("n", "UNKNOWN", "x", 5.0, 1.0), ("s", "99", "x", 6.0, 1.0), ("s", "8", "UNKNOWN", 0.0, 0.0)]
    return spark.createDataFrame([(week(12), g, a, c, "k", p, b) for g, a, c, p, b in rows],
                                 "week date, grp string, area string, cat string, cls string, predicted double, baseline double")


def tagged(spark, weekly):
    f = forecast(spark)
    changes = fc.expected_change(f.drop("baseline"), f.drop("predicted"), KEYS)
    return changes, fc.tag_publishable(changes, pb.canonical_groups(weekly))


def test_canonical_group_is_the_larger_one(weekly):
    assert {r["area"]: r["canonical_grp"] for r in pb.canonical_groups(weekly).collect()} == {"7": "n", "8": "s"}
    assert sorted(map(tuple, pb.areas_by_group(weekly).collect())) == [("n", "7"), ("n", "UNKNOWN"), ("s", "8")]


def test_published_and_withheld_rows_make_up_the_source(spark, weekly):
    changes, rows = tagged(spark, weekly)
    summary = fc.publish_summary(rows).first()
    assert (summary["source_rows"], summary["published_rows"], summary["withheld_unmappable"], summary["withheld_mismatch"]) == (7, 4, 2, 1)
    assert summary["source_total"] == summary["predicted_total"] + summary["withheld_total"] == 28.0
    assert summary["zero_rows"] == 1 and summary["unknown_cat_rows"] == 1 and summary["published_areas"] == 2
    audit = q.forecast_reconcile(rows.filter("withheld_reason IS NULL"), changes, fc.publish_summary(rows)).first().asDict()
    assert all(v is True for k, v in audit.items() if k.endswith(("up", "matches"))) and audit["wrong_change_rows"] == 0
    broken = rows.filter("withheld_reason IS NULL").withColumn("change", F.col("change") + 1)
    assert q.forecast_reconcile(broken, changes, fc.publish_summary(rows)).first()["wrong_change_rows"] == 3


def test_area_totals_need_complete_baselines(spark, weekly):
    areas = {r["area"]: r for r in fc.area_forecast(tagged(spark, weekly)[1].filter("withheld_reason IS NULL")).collect()}
    assert areas["7"]["predicted"] == 5.0 and areas["7"]["baseline"] is None and areas["7"]["direction"] == "unavailable"
    assert areas["8"]["baseline"] == 3.0 and areas["8"]["change"] == 0.0 and areas["8"]["direction"] == "approximately equal"
    assert areas["8"]["location_key"] == "area:8"


def test_levels(spark):
    rows = [("a", 0.0, 0.0), ("b", 1.0, 0.5), ("c", 2.0, -1.0), ("d", 4.0, 3.0)]
    df = spark.createDataFrame(rows, "id string, predicted double, change double").withColumns(
        {"total_rows": F.lit(2), "baseline_rows": F.when(F.col("id") == "b", 1).otherwise(2)})
    cap = spark.createDataFrame([(4.0,)], "value double")
    assert [r["level"] for r in fc.volume_levels(df, cap).orderBy("id").collect()] == ["zero", "positive-1", "positive-2", "positive-4"]
    out = fc.change_levels(df, spark.createDataFrame([(3.0,)], "value double")).orderBy("id").collect()
    assert [(r["coverage"], r["intensity"]) for r in out] == [("complete", 0), ("partial", 0), ("complete", 1), ("complete", 3)]


def test_date_range(spark, weekly):
    events = spark.createDataFrame([(MONDAY,), (week(11) + timedelta(days=3),)], "day date")
    r = pb.date_range(events, weekly).first()
    assert r["last_week_partial"] and r["latest_complete_week"] == week(10) and r["default_start_week"] == week(0)
    full = spark.createDataFrame([(week(11) + timedelta(days=6),)], "day date")
    assert pb.date_range(full, weekly).first()["latest_complete_week"] == week(11)


def test_cube_decodes_to_the_same_total_and_offsets(weekly):
    cube = pb.cube_rows(weekly, KEYS)
    assert cube.count() == weekly.count() and cube.agg(F.sum("n")).first() == weekly.agg(F.sum("n")).first()
    offsets = {r["week_index"]: r["row_start"] for r in pb.cube_offsets(weekly).collect()}
    assert offsets[0] == 0 and offsets[12] == weekly.count()
    per_week = {r["week_index"]: r["count"] for r in cube.groupBy("week_index").count().collect()}
    assert all(offsets[i + 1] - offsets[i] == k for i, k in per_week.items())


def test_dictionary_has_no_limit(spark):
    labels = spark.range(300).selectExpr("printf('a%03d', id) AS area", "date'2024-01-01' AS week", "id AS n")
    got = {r["area"]: r["area_index"] for r in pb.dictionary(labels, "area").collect()}
    assert got == {f"a{i:03d}": i for i in range(300)}
    cube = pb.cube_rows(labels, ["area"]).collect()
    assert sorted((r["row_no"], r["area_index"], r["n"]) for r in cube) == [(i, i, i) for i in range(300)]


def test_slices(weekly):
    assert pb.cube_slice(weekly, {"grp": " N "}, week(0), week(0)).first()["total"] == 3
    assert pb.cube_slice(weekly, {"grp": "nowhere"}, week(0), week(11)).first()["total"] == 0


def test_series_is_dense_and_compares_complete_weeks(weekly):
    series = pb.observed_weekly(weekly, {"grp": "n"}, week(4), week(11), partial_after=week(10)).orderBy("week").collect()
    assert [r["total"] for r in series][:2] == [7, 0] and series[0]["baseline"] is None
    assert series[4]["baseline"] == round(sum([3, 4, 5, 6, 7, 0, 9, 10]) / 8, 1) and series[-1]["is_partial"]
    r = pb.recent_comparison(pb.observed_weekly(weekly, {"grp": "n"}, week(4), week(11), partial_after=week(10))).first()
    assert r["weeks"] == 3 and r["recent"] == 11 + 12 + 13 and r["prior"] == 0 + 9 + 10 and r["recent_end"] == week(10)


def test_key_sets(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",)], "k string")
    b = spark.createDataFrame([("2",), ("3",)], "k string")
    assert sorted(map(tuple, q.key_set_diff(a, b, ["k"]).collect())) == [("1", "missing"), ("3", "unexpected")]


def test_cramers_v_against_the_full_table(spark):
    rows = [("a", "x")] * 30 + [("a", "y")] * 5 + [("b", "y")] * 20 + [(None, "x")] * 3
    df = spark.createDataFrame(rows, "p string, q string")
    cells = {("a", "x"): 30, ("a", "y"): 5, ("b", "y"): 20, ("b", "x"): 0, ("m", "x"): 3, ("m", "y"): 0}
    n, rt, ct = 58, {"a": 35, "b": 20, "m": 3}, {"x": 33, "y": 25}
    chi2 = sum((o - rt[r] * ct[c] / n) ** 2 / (rt[r] * ct[c] / n) for (r, c), o in cells.items())
    phi2 = max(0, chi2 / n - 2 / 57)
    want = (phi2 / (min(3 - 4 / 57, 2 - 1 / 57) - 1)) ** 0.5
    assert cramers_v(df, ["p", "q"]).first()["cramers_v"] == pytest.approx(want, abs=1e-6)
    constant = df.withColumn("q", F.lit("x"))
    assert cramers_v(constant, ["p", "q"]).first()["cramers_v"] is None
