from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from segpanel.functions import expr as E
from segpanel.operators import anomaly as an
from segpanel.operators import hotspot as hs
from segpanel.operators import quality as q
from segpanel.operators.aggregate import weighted_centroid
from segpanel.operators.panel import dense_panel
from segpanel.roles import AnomalyConfig, Box, HotspotConfig

MONDAY = date(2024, 1, 1)
BOX = Box(-74.3, -73.6, 40.4, 41.0)


def week(i):
    return MONDAY + timedelta(weeks=i)


def features(spark, counts):
    w = spark.createDataFrame([(week(i), "a", float(n)) for i, n in counts.items()], "week date, seg string, n double")
    last = week(max(counts))
    return an.anomaly_features(dense_panel(w, ["seg"], last, last), ["seg"])


def test_features_use_prior_weeks_only(spark):
    f = features(spark, {**{i: i + 1 for i in range(13)}, 13: 100})
    row = an.anomaly_scores(f, None, ["seg"]).filter(F.col("week") == F.lit(week(13))).first()
    assert row["expected"] == 7.0 and row["mean_short"] == 9.5 and row["total_base"] == 91 and row["residual"] == 93
    assert row["expected_source"] == "trailing_mean" and row["severity"] == "critical" and row["robust_z"] is None


def test_sparse_segments_are_never_flagged(spark):
    row = an.anomaly_scores(features(spark, {0: 1, 13: 4}), None, ["seg"]).orderBy(F.col("week").desc()).first()
    assert not row["passes_volume"] and row["severity"] == "none" and row["score"] == 0.0 and not row["is_anomaly"]


def test_median_and_mad(spark):
    f = features(spark, {i: float(i % 4) for i in range(27)})
    row = f.orderBy(F.col("week").desc()).first()
    assert row["weeks_long"] == 26 and row["median_long"] == 1.0 and row["mad_long"] == 1.0
    assert f.orderBy("week").first()["median_long"] is None


def test_model_expectation_wins_when_present(spark):
    f = features(spark, {i: 4 for i in range(13)} | {13: 20})
    model = spark.createDataFrame([(week(13), "a", 5.0)], "week date, seg string, expected_model double")
    row = an.anomaly_scores(f, model, ["seg"]).filter(F.col("week") == F.lit(week(13))).first()
    assert row["expected_source"] == "model" and row["expected"] == 5.0 and row["is_model_anomaly"]
    assert not row["is_history_anomaly"] or row["pct_vs_short"] >= 75


def test_only_backtest_rows_with_actuals_enter_scoring(spark):
    p = spark.createDataFrame([(week(0), "a", 1, 2.0, True), (week(1), "a", None, 2.0, True), (week(2), "a", 1, 2.0, False)],
                              "week date, seg string, actual bigint, predicted double, is_backtest boolean")
    assert [r["week"] for r in an.safe_predictions(p, ["seg"]).collect()] == [week(0)]


def test_volatile_groups_need_enough_weeks(spark):
    def rows(seg, n):
        return [(seg, "c", True, True, False, 5, "none", 1.0, 2.0, 0.0)] * n

    df = spark.createDataFrame(rows("few", 16) + rows("many", 52), (
        "grp string, cat string, is_evaluable boolean, passes_volume boolean, is_anomaly boolean, actual bigint, "
        "severity string, std_base double, residual_history double, score double"))
    out = an.volatile_groups(df, ["grp", "cat"], AnomalyConfig()).collect()
    assert [r["grp"] for r in out] == ["many"] and out[0]["events"] == 260 and out[0]["anomaly_rate_pct"] == 0.0


def test_ranks_and_rules_of_the_anomaly_table(spark):
    f = features(spark, {i: 3 + (i % 3) for i in range(30)} | {30: 40, 31: 4, 32: 25})
    scored = an.anomaly_scores(f, None, ["seg"])
    ranked = an.ranked_anomalies(scored, ["seg"])
    assert sorted(r["rank_overall"] for r in ranked.collect()) == list(range(1, ranked.count() + 1))
    assert {r["issue_count"] for r in q.check_anomalies(ranked, ["seg"]).collect()} == {0}
    assert sum(r["rows"] for r in an.severity_counts(scored.filter("is_anomaly")).collect()) == ranked.count()
    broken = ranked.withColumn("residual", F.col("residual") + 1)
    bad = {r["rule_name"] for r in q.check_anomalies(broken.unionByName(broken), ["seg"]).filter("issue_count > 0").collect()}
    assert bad == {"residual_arithmetic", "duplicate_key"}


# ---- hotspots -----------------------------------------------------------------------------------

CONFIG = HotspotConfig(box=BOX)
LAST = date(2024, 12, 31)
BIN_SCHEMA = "day date, grp string, area string, cat string, cls string, x double, y double, weight bigint"


def bins(spark, rows):
    return spark.createDataFrame([(LAST - timedelta(days=age), g, a, "c", "k", x, y, w) for age, g, a, x, y, w in rows], BIN_SCHEMA)


def test_only_usable_points_reach_the_grid(spark):
    b = bins(spark, [(1, "n", "7", -73.95, 40.75, 3), (1, "n", "7", None, 40.75, 4), (1, "n", "7", 0.0, 40.75, 5),
                     (1, "n", "7", -80.0, 40.75, 6), (1, "n", "7", -73.95, 50.0, 7), (0, "n", "7", -73.95, 40.75, 99)])
    cube = hs.window_cube(b, CONFIG)
    totals = {r["grain"]: r["recent_total"] for r in hs.window_totals(cube).collect()}
    assert totals == {"area": 25, "grid": 3}
    area = hs.area_base(cube).first()
    assert area["recent_30"] == 25 and area["valid_events"] == 3
    grid = hs.grid_base(cube).collect()
    assert len(grid) == 1 and grid[0]["recent_30"] == 3 and grid[0]["grp"] == "n"
    quality = q.weighted_xy_quality(b.filter("weight < 99"), BOX).first()
    assert (quality["valid_events"], quality["missing_events"], quality["zero_events"], quality["outside_events"]) == (3, 4, 5, 13)


def test_centroid_is_weighted(spark):
    b = bins(spark, [(1, "n", "7", -73.95, 40.7, 3), (2, "n", "7", -73.85, 40.8, 1)])
    r = weighted_centroid(b, ["grp"]).first()
    assert (r["map_y"], r["map_x"], r["centroid_weight"]) == (40.725, -73.925, 4)
    cube = hs.window_cube(bins(spark, [(0, "z", "1", None, None, 1), (1, "n", "7", -73.95, 40.7, 3), (2, "n", "7", -73.85, 40.8, 1)]), CONFIG)
    c = hs.area_centroids(cube).first()
    assert (c["map_y"], c["map_x"], c["centroid_weight"]) == (40.725, -73.925, 4)


def test_windows_do_not_overlap_the_baseline(spark):
    b = bins(spark, [(age, "n", "7", -73.95, 40.75, 1) for age in range(0, 500)])
    spans = {r["window_name"]: r for r in hs.hotspot_windows(b, CONFIG).collect()}
    end = LAST - timedelta(days=1)
    assert [spans[n]["events"] for n in ("recent_7", "recent_30", "recent_90", "baseline")] == [7, 30, 90, 365]
    assert spans["recent_90"]["first_day"] == end - timedelta(days=89)
    assert spans["baseline"]["last_day"] == end - timedelta(days=90)
    latest = HotspotConfig(box=BOX, include_latest_day=True)
    assert {r["window_name"]: r for r in hs.hotspot_windows(b, latest).collect()}["recent_7"]["last_day"] == LAST


def test_one_day_of_data_is_scored_as_it_is(spark):
    b = bins(spark, [(0, "n", "7", -73.95, 40.75, 1)])
    assert hs.window_cube(b, CONFIG).first()["snapshot_day"] == LAST


def test_a_surge_becomes_a_hotspot_at_both_grains(spark):
    quiet = [(age, "n", "8", -73.75, 40.85, 2) for age in range(1, 456)]
    surge = [(age, "n", "7", -73.95, 40.75, 1) for age in range(31, 456)] + [(age, "n", "7", -73.95, 40.75, 9) for age in range(1, 31)]
    scored = hs.hotspot_scores(hs.window_cube(bins(spark, [(0, "n", "7", -73.95, 40.75, 1), *quiet, *surge]), CONFIG), CONFIG)
    ranked = hs.ranked_hotspots(scored)
    rows = ranked.collect()
    assert {(r["grain"], r["severity"]) for r in rows} == {("area", "critical"), ("grid", "critical")}
    assert sorted(r["rank_overall"] for r in rows) == [1, 2] and {r["rank_in_grain"] for r in rows} == {1}
    area = next(r for r in rows if r["grain"] == "area")
    assert area["area"] == "7" and area["recent_30"] == 270 and area["expected"] == 30.0 and area["ratio"] == 9.0
    assert {r["issue_count"] for r in q.check_hotspots(ranked, BOX, F.lit(LAST)).collect()} == {0}
    assert q.grid_alignment(scored.filter("grain = 'grid'"), 0.01).first()["all_aligned"]


def test_the_bins_are_shuffled_once(spark, plan):
    b = bins(spark, [(1, "n", "7", -73.95, 40.75, 3)])
    main = plan(hs.window_cube(b, CONFIG)).split("Subquery")[0]
    assert main.count("Exchange hashpartitioning") == 1


def test_config_ladders():
    with pytest.raises(ValueError):
        HotspotConfig(box=BOX, short_days=30)
    with pytest.raises(ValueError):
        HotspotConfig(box=BOX, ratio_steps=(3.0, 2.0, 1.0))


def test_freshness(spark):
    df = spark.createDataFrame([(LAST, LAST), (LAST - timedelta(days=2), LAST), (LAST, LAST - timedelta(days=1)), (None, LAST)], "s date, h date")
    out = [tuple(r) for r in df.select(*q.freshness(F.col("s"), F.col("h"))).collect()]
    assert out == [(0, "current"), (2, "stale"), (-1, "incompatible"), (None, "invalid")]
    assert E.UNKNOWN == "UNKNOWN"
