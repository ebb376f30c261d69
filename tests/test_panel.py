from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from segpanel.operators import evaluate as ev
from segpanel.operators import forecast as fc
from segpanel.operators.aggregate import reaggregate
from segpanel.operators.panel import PanelDates, dense_panel, join_observed, panel_dates, scoring_end

MONDAY = date(2024, 1, 1)


def week(i):
    return MONDAY + timedelta(weeks=i)


def weekly(spark, rows):
    return spark.createDataFrame([(week(i), s, float(n)) for i, s, n in rows], "week date, seg string, n double")


def test_zero_fill_and_prior_only_baselines(spark):
    w = weekly(spark, [(0, "a", 5), (2, "a", 9), (4, "a", 4)])
    dates = panel_dates(w, include_latest=True)
    rows = {r["week"]: r for r in fc.baseline_forecasts(dense_panel(w, ["seg"], dates.forecast, dates.last), ["seg"], dates).collect()}
    assert rows[week(1)]["actual"] == 0 and rows[week(1)]["previous_week"] == 5
    assert rows[week(2)]["previous_week"] == 0 and rows[week(4)]["previous_week"] == 0
    assert rows[week(4)]["trailing_4_week_mean"] == 3.5
    last = rows[week(5)]
    assert last["actual"] is None and last["previous_week"] == 4 and last["trailing_4_week_mean"] == 3.25
    assert last["trailing_8_week_mean"] is None and last["is_next_week"] and not last["is_backtest"]


def test_panel_starts_at_each_segments_first_week(spark):
    w = weekly(spark, [(0, "a", 1), (3, "b", 2), (5, "a", 3)])
    panel = dense_panel(w, ["seg"], week(6), week(5))
    counts = dict(panel.groupBy("seg").count().collect())
    assert counts == {"a": 7, "b": 4}
    assert panel.agg(F.sum("n")).first()[0] == 6.0
    assert panel.filter("n IS NULL").count() == 2


def test_panel_may_end_before_the_data_but_totals_do_not(spark):
    w = weekly(spark, [(0, "a", 1), (3, "a", 2), (5, "a", 3), (5, "late", 9)])
    rows = dense_panel(w, ["seg"], week(4), week(5)).orderBy("week").collect()
    assert [r["n"] for r in rows] == [1, 0, 0, 2, 0] and {r["seg"] for r in rows} == {"a"}
    assert rows[0]["total"] == 6 and rows[0]["last_week"] == week(5)


def test_panel_equals_the_join_with_a_calendar(spark):
    w = weekly(spark, [(i, s, i + 1) for i in (0, 1, 4, 7) for s in "ab"])
    panel = dense_panel(w, ["seg"], week(7), week(7))
    joined = join_observed(panel.select("week", "seg"), w, ["seg"])
    a = sorted(map(tuple, panel.select("week", "seg", "n").collect()))
    assert a == sorted(map(tuple, joined.select("week", "seg", "n").collect()))


def test_dates():
    d = PanelDates.split(week(0), week(9), backtest_weeks=4, validation_weeks=3)
    assert (d.backtest_start, d.backtest_end) == (week(5), week(8))
    assert (d.validation_start, d.validation_end) == (week(2), week(4))
    assert d.forecast == week(10)
    short = PanelDates.split(week(0), week(2))
    assert (short.backtest_start, short.backtest_end, short.validation_start) == (week(0), week(1), None)
    assert scoring_end(week(0), week(5)) == week(4)
    assert scoring_end(week(0), week(5), include_latest=True) == week(5)
    assert scoring_end(week(0), week(0)) == week(0)
    with pytest.raises(ValueError):
        PanelDates.split(week(0), week(2), backtest_weeks=0)


def test_features_do_not_see_the_target_week(spark):
    base = [(i, "a", (i * 7) % 5) for i in range(30)]
    changed = [(i, s, 99 if i == 20 else n) for i, s, n in base]
    out = []
    for rows in (base, changed):
        w = weekly(spark, rows)
        dates = panel_dates(w)
        f = fc.ml_features(dense_panel(w, ["seg"], dates.forecast, dates.last), ["seg"], dates)
        out.append([tuple(r) for r in f.filter(F.col("week") <= F.lit(week(20))).drop("actual", "total").orderBy("week").collect()])
    assert out[0] == out[1]


def test_missing_features_fall_back_to_the_prior_mean(spark):
    w = weekly(spark, [(0, "a", 4), (1, "a", 2), (2, "a", 3)])
    dates = panel_dates(w)
    rows = fc.ml_features(dense_panel(w, ["seg"], dates.forecast, dates.last), ["seg"], dates).orderBy("week").collect()
    assert rows[0]["lag_1"] == 0 and rows[0]["prior_weeks"] == 0
    assert rows[2]["lag_1"] == 2 and rows[2]["lag_52"] == 3.0 and rows[2]["trailing_mean_4"] == 3.0


def test_grid_fit_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, s, int(n)) for s in "abc" for i, n in enumerate(rng.poisson(2, 80)) if n]
    w = weekly(spark, rows)
    dates = panel_dates(w, backtest_weeks=20, validation_weeks=20)
    f = fc.ml_features(dense_panel(w, ["seg"], dates.forecast, dates.last), ["seg"], dates)
    got = {(r["alpha"], r["beta"], r["gamma"], r["shrink"]): r for r in fc.fit_grid(f, dates.validation_start, dates.validation_end).collect()}
    assert len(got) == 585
    pdf = f.filter(F.col("week").between(F.lit(dates.validation_start), F.lit(dates.validation_end))).toPandas()
    m8, m4, l1, l52, y = (pdf[c].to_numpy(float) for c in (*fc.FIT_INPUTS, "actual"))
    for a, b, g, s in list(got)[::37]:
        p = np.maximum(0, s * (m8 + a * (m4 - m8) + b * (l1 - m4) + g * (l52 - m8)))
        e = np.abs(p - y)
        r = got[(a, b, g, s)]
        assert r["rows"] == len(y)
        assert r["mae"] == pytest.approx(e.mean(), abs=6e-6)
        assert r["rmse"] == pytest.approx(np.sqrt((e * e).mean()), abs=6e-6)
        assert r["wmae"] == pytest.approx((e * y).sum() / y.sum(), abs=6e-6)
    best = fc.fit_best(spark.createDataFrame([tuple(r) for r in got.values()], fc.fit_grid(f, dates.validation_start, dates.validation_end).schema)).first()
    assert best["rmse"] == min(r["rmse"] for r in got.values())


def test_methods_without_predictions_stay_listed(spark):
    w = weekly(spark, [(0, "a", 1), (1, "a", 2), (2, "a", 3)])
    dates = panel_dates(w)
    long = fc.unpivot_methods(fc.baseline_forecasts(dense_panel(w, ["seg"], dates.forecast, dates.last), ["seg"], dates), ["seg"])
    rows = {r["method"]: r for r in ev.error_metrics(long).collect()}
    assert set(rows) == set(fc.METHODS)
    never = rows["previous_year_same_week"]
    assert never["predictions"] == 0 and never["coverage_pct"] == 0 and never["mae"] is None and never["backtest_rows"] == 2
    assert ev.best_method(ev.error_metrics(long)).first()["method"] == "previous_week"


def test_levels_add_up(spark):
    long = spark.createDataFrame(
        [(g, c, "m", a, float(p)) for g, c, a, p in [("x", "1", 3, 2), ("x", "2", 5, 5), ("y", "1", 0, 4), ("y", "2", 7, 1)]],
        "grp string, cat string, method string, actual bigint, predicted double")
    rows = ev.metric_levels(long, ["grp", "cat"], [[], ["grp"], ["cat"], ["grp", "cat"]]).collect()
    assert len(rows) == 1 + 2 + 2 + 4
    for level in (0, 1, 2, 3):
        part = [r for r in rows if r["level_id"] == level]
        assert sum(r["events"] for r in part) == 15 and sum(r["predictions"] for r in part) == 4
    whole = next(r for r in rows if r["level_id"] == 3)
    assert whole["mae"] == 2.75 and whole["rmse"] == round(np.sqrt(53 / 4), 4) and whole["wmae"] == 3.0


def test_top_k_capture(spark):
    rows = [(week(0), f"s{i:02d}", i, float(-i if i == 10 else i), "m") for i in range(11)]
    long = spark.createDataFrame(rows, "week date, seg string, actual bigint, predicted double, method string")
    r = ev.top_k_capture(long, ["seg"]).first()
    assert r["avg_k"] == 2 and r["top_events"] == 19 and r["captured_events"] == 9 and r["capture_rate"] == round(9 / 19, 4)
    one = ev.top_k_capture(long.filter("actual < 10"), ["seg"]).first()
    assert one["avg_k"] == 1 and one["capture_rate"] == 1.0


def test_derived_baseline_needs_enough_history(spark):
    w = weekly(spark, [(0, "old", 8), (7, "old", 8), (5, "new", 4)])
    out = {r["seg"]: r["derived_baseline"] for r in fc.derive_baseline(w, ["seg"], week(8), "trailing_8_week_mean").collect()}
    assert out == {"old": 2.0, "new": None}
    with pytest.raises(ValueError):
        fc.derive_baseline(w, ["seg"], week(8), "magic")


def test_reaggregate_fills_labels(spark):
    df = spark.createDataFrame([(week(0), None, 1), (week(0), "UNKNOWN", 2)], "week date, seg string, n bigint")
    assert [tuple(r) for r in reaggregate(df, "week", ["seg"], "n").collect()] == [(week(0), "UNKNOWN", 3.0)]


def test_windows_reuse_the_panels_partitioning(spark, plan):
    w = spark.createDataFrame([(week(i), s, float(i)) for i in range(5) for s in "ab"], "week date, seg string, n double")
    dates = panel_dates(w)
    p = plan(fc.ml_features(dense_panel(w, ["seg"], dates.forecast, dates.last), ["seg"], dates))
    assert p.count("Exchange hashpartitioning") == 1 and "Join" not in p
