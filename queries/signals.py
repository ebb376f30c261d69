"""Anomalies and hotspots."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import tables as t
from queries.registry import query
from segpanel.functions.expr import dround
from segpanel.operators import anomaly as an
from segpanel.operators import forecast as fc
from segpanel.operators import hotspot as hs
from segpanel.operators import quality as q
from segpanel.operators.panel import dense_panel, panel_dates, scoring_end
from segpanel.roles import AnomalyConfig
from segpanel.session import materialize

CONFIG = AnomalyConfig(volatile_min_weeks=10, volatile_min_events=40, top_n=20)
KEYS = t.KEYS2


def scoring_inputs(spark, sf, keys=KEYS):
    """Anomaly features up to the scoring week and the predictions allowed into scoring."""
    weekly = materialize(t.weekly(spark, sf, keys))
    dates = panel_dates(weekly)
    model_panel = dense_panel(weekly, keys, dates.forecast, dates.last)
    rows = materialize(fc.ml_features(model_panel, keys, dates).filter(F.col("week") >= F.lit(dates.validation_start)))
    best = fc.fit_best(fc.fit_grid(rows, dates.validation_start, dates.validation_end))
    model = an.safe_predictions(fc.predict(rows, best, keys), keys)
    end = scoring_end(dates.first, dates.last)
    return an.anomaly_features(dense_panel(weekly, keys, end, dates.last), keys, CONFIG), model


def scored(spark, sf, keys=KEYS):
    rows, model = scoring_inputs(spark, sf, keys)
    return an.anomaly_scores(rows, model, keys, CONFIG)


def ranked(spark, sf, keys=KEYS):
    return an.ranked_anomalies(scored(spark, sf, keys), keys)


_FEAT = ("total_base", "total_long", "mean_short", "mean_base", "mean_long", "std_base", "median_long", "mad_long")


@query("anomaly_features", "SELECT week, grp, cat, actual, first_week, last_week, observed_weeks, total, weeks_short, weeks_base, weeks_long, nonzero_weeks, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _FEAT) + " FROM afeat2")
def anomaly_features(spark, sf):
    weekly = materialize(t.weekly(spark, sf, KEYS))
    dates = panel_dates(weekly)
    panel = dense_panel(weekly, KEYS, scoring_end(dates.first, dates.last), dates.last)
    return an.anomaly_features(panel, KEYS, CONFIG).withColumns({c: dround(c, 6) for c in _FEAT})


@query("anomaly_scores", "SELECT * FROM ascore2")
def anomaly_scores(spark, sf):
    return scored(spark, sf)


@query("anomaly_severity", "SELECT week, grp, cat, is_anomaly, severity, score FROM ascore2 WHERE is_evaluable")
def anomaly_severity(spark, sf):
    return scored(spark, sf).filter("is_evaluable").select("week", *KEYS, "is_anomaly", "severity", "score")


_RANKED = "rank_overall, rank_in_week, week, grp, cat, actual, expected, expected_source, residual, z, robust_z, model_scaled, score, severity"


@query("anomalies_ranked", f"SELECT {_RANKED} FROM anoms2")
def anomalies_ranked(spark, sf):
    return ranked(spark, sf).select(*_RANKED.split(", "))


def _recent(spark, sf, keys, weeks):
    """Scored once: the last week and the anomalies come from the same table."""
    rows = materialize(scored(spark, sf, keys).select("week", *keys, "actual", "expected", "expected_source", "residual", "z", "robust_z", "model_scaled", "score", "severity", "is_anomaly"))
    end = rows.agg(F.max("week")).first()[0]
    return an.top_recent(an.ranked_anomalies(rows, keys), weeks, CONFIG.top_n, end)


@query("anomalies_recent", f"SELECT {_RANKED} FROM anoms2 WHERE week >= (SELECT max(week) - 7 * 59 FROM afeat2) ORDER BY rank_overall LIMIT 20")
def anomalies_recent(spark, sf):
    return _recent(spark, sf, KEYS, 60).select(*_RANKED.split(", "))


@query("anomalies_recent_8", f"SELECT {_RANKED} FROM anoms2 WHERE week >= (SELECT max(week) - 7 * 7 FROM afeat2) ORDER BY rank_overall LIMIT 20")
def anomalies_recent_8(spark, sf):
    """The report's own span of eight weeks."""
    return _recent(spark, sf, KEYS, CONFIG.recent_weeks).select(*_RANKED.split(", "))


# ---- the same at the full four keys ----------------------------------------------------------------

_RANKED4 = _RANKED.replace("grp, cat", ", ".join(t.KEYS))


@query("anomaly_features_4", f"SELECT week, {', '.join(t.KEYS)}, actual, first_week, last_week, observed_weeks, total, weeks_short, weeks_base, weeks_long, nonzero_weeks, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _FEAT) + " FROM afeat4")
def anomaly_features_4(spark, sf):
    weekly = materialize(t.weekly(spark, sf))
    dates = panel_dates(weekly)
    panel = dense_panel(weekly, t.KEYS, scoring_end(dates.first, dates.last), dates.last)
    return an.anomaly_features(panel, t.KEYS, CONFIG).withColumns({c: dround(c, 6) for c in _FEAT})


@query("anomaly_scores_4", "SELECT * FROM ascore4")
def anomaly_scores_4(spark, sf):
    return scored(spark, sf, t.KEYS)


@query("anomalies_ranked_4", f"SELECT {_RANKED4} FROM anoms4")
def anomalies_ranked_4(spark, sf):
    return ranked(spark, sf, t.KEYS).select(*_RANKED4.split(", "))


@query("anomalies_recent_4", f"SELECT {_RANKED4} FROM anoms4 WHERE week >= (SELECT max(week) - 7 * 7 FROM afeat4) ORDER BY rank_overall LIMIT 20")
def anomalies_recent_4(spark, sf):
    return _recent(spark, sf, t.KEYS, CONFIG.recent_weeks).select(*_RANKED4.split(", "))


@query("anomalies_top", f"SELECT {_RANKED} FROM anoms2 ORDER BY rank_overall LIMIT 20")
def anomalies_top(spark, sf):
    return ranked(spark, sf).orderBy("rank_overall").limit(CONFIG.top_n).select(*_RANKED.split(", "))


_SEV = "(SELECT unnest(['low', 'medium', 'high', 'critical']) AS severity)"


@query("severity_counts", f"""SELECT s.severity, coalesce(rows, 0) AS rows, coalesce(events, 0) AS events, avg_score, max_score FROM {_SEV} s LEFT JOIN (
  SELECT severity, count(*) AS rows, CAST(sum(actual) AS BIGINT) AS events, round(round(avg(score), 10), 4) AS avg_score, max(score) AS max_score
  FROM ascore2 WHERE is_anomaly GROUP BY severity) c ON s.severity = c.severity""")
def severity_counts(spark, sf):
    return an.severity_counts(scored(spark, sf).filter("is_anomaly"))


@query("volatile_groups", """SELECT grp, cat, count(*) AS evaluated_weeks, CAST(sum(actual) AS BIGINT) AS events, count(*) FILTER (WHERE is_anomaly) AS anomalies,
  count(*) FILTER (WHERE severity IN ('high', 'critical')) AS severe_anomalies, round(count(*) FILTER (WHERE is_anomaly) * 100.0 / count(*), 4) AS anomaly_rate_pct,
  round(round(avg(std_base), 10), 4) AS avg_std, round(round(avg(abs(residual_history)), 10), 4) AS avg_abs_residual, max(score) AS max_score
  FROM ascore2 WHERE is_evaluable AND passes_volume GROUP BY grp, cat HAVING count(*) >= 10 AND sum(actual) >= 40
  ORDER BY avg_abs_residual DESC NULLS LAST, avg_std DESC NULLS LAST, anomalies DESC, events DESC, grp, cat LIMIT 20""")
def volatile_groups(spark, sf):
    return an.volatile_groups(scored(spark, sf), KEYS, CONFIG)


_ANOMALY_RULES = {
    "bad_week": "week IS NULL OR extract(isodow FROM week) <> 1", "blank_key": "trim(coalesce(grp, '')) = '' OR trim(coalesce(cat, '')) = ''",
    "bad_actual": "actual IS NULL OR actual < 0", "bad_expected": "expected IS NULL OR NOT isfinite(expected) OR expected < 0 OR expected_history < 0 OR expected_model < 0",
    "bad_residual": "residual IS NULL OR NOT isfinite(residual)", "bad_score": "score IS NULL OR NOT isfinite(score) OR score < 0",
    "bad_source": "expected_source IS NULL OR expected_source NOT IN ('model', 'trailing_mean')",
    "bad_severity": "severity IS NULL OR severity NOT IN ('low', 'medium', 'high', 'critical')",
    "flag_not_true": "is_anomaly IS DISTINCT FROM true OR passes_volume IS DISTINCT FROM true",
    "residual_arithmetic": "abs(actual - expected - residual) > 1e-6",
    "published_residual_not_positive": "severity IN ('high', 'critical') AND residual <= 0",
    "history_source_mismatch": "expected_source = 'trailing_mean' AND (expected_history IS NULL OR abs(expected - expected_history) > 1e-6)",
    "model_source_mismatch": "expected_source = 'model' AND (expected_model IS NULL OR abs(expected - expected_model) > 1e-6)",
}
# The check runs on the anomalies plus deliberately damaged copies of some of them.
_DAMAGED = """(SELECT * REPLACE (CASE WHEN rank_in_week = 2 THEN residual + 1 ELSE residual END AS residual, CASE WHEN rank_in_week = 3 THEN 'odd' ELSE severity END AS severity) FROM anoms2
  UNION ALL SELECT * FROM anoms2 WHERE severity = 'critical') dd"""


@query("check_anomalies", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS rule_name, count(*) FILTER (WHERE {c}) AS issue_count FROM {_DAMAGED}" for n, c in _ANOMALY_RULES.items())
    + f" UNION ALL SELECT 'duplicate_key', count(*) - count(DISTINCT (week, grp, cat)) FROM {_DAMAGED}")
def check_anomalies(spark, sf):
    rows = materialize(ranked(spark, sf))
    damaged = rows.withColumns({
        "residual": F.when(F.col("rank_in_week") == 2, F.col("residual") + 1).otherwise(F.col("residual")),
        "severity": F.when(F.col("rank_in_week") == 3, "odd").otherwise(F.col("severity")),
    })
    return q.check_anomalies(damaged.unionByName(rows.filter("severity = 'critical'")), KEYS)


# ---- hotspots -----------------------------------------------------------------------------------

def cube(spark, sf):
    return materialize(hs.window_cube(t.bins(spark, sf), t.HOTSPOTS))


def hotspot_rows(spark, sf):
    return hs.hotspot_scores(cube(spark, sf), t.HOTSPOTS)


def hotspots_table(spark, sf):
    return hs.ranked_hotspots(hotspot_rows(spark, sf))


def _window_sql(name: str, cond: str) -> str:
    return f"""SELECT '{name}' AS window_name, count(*) FILTER (WHERE {cond}) AS bins, CAST(coalesce(sum(weight) FILTER (WHERE {cond}), 0) AS BIGINT) AS events,
  min(day) FILTER (WHERE {cond}) AS first_day, max(day) FILTER (WHERE {cond}) AS last_day FROM hbins"""


@query("hotspot_windows", "\nUNION ALL\n".join(_window_sql(n, c) for n, c in (
    ("recent_7", "age < 7"), ("recent_30", "age < 30"), ("recent_90", "age < 90"), ("baseline", "age BETWEEN 90 AND 454"))))
def hotspot_windows(spark, sf):
    return hs.hotspot_windows(t.bins(spark, sf), t.HOTSPOTS)


@query("window_totals", "SELECT * FROM htot")
def window_totals(spark, sf):
    return hs.window_totals(hs.window_cube(t.bins(spark, sf), t.HOTSPOTS))


@query("area_centroids", "SELECT * FROM hcent")
def area_centroids(spark, sf):
    return hs.area_centroids(hs.window_cube(t.bins(spark, sf), t.HOTSPOTS))


@query("hotspot_area_base", "SELECT * FROM harea")
def hotspot_area_base(spark, sf):
    return hs.area_base(cube(spark, sf))


@query("hotspot_grid_base", "SELECT * FROM hgrid")
def hotspot_grid_base(spark, sf):
    return hs.grid_base(cube(spark, sf))


@query("union_grains", "SELECT * FROM hboth")
def union_grains(spark, sf):
    return hs.union_grains(cube(spark, sf))


_SCORE = ("grain, grp, area, cell_x, cell_y, cat, cls, map_x, map_y, recent_7, recent_30, recent_90, baseline, valid_events, snapshot_day, recent_total, "
          "baseline_total, expected, recent_share, baseline_share, ratio, lift_pct, recency_count, coverage_pct, share_change, density_score, lift_score, "
          "share_score, recency_score, quality_score, passes_volume, score, is_hotspot, severity")


@query("hotspot_scores", f"SELECT {_SCORE} FROM hscore")
def hotspot_scores(spark, sf):
    return hotspot_rows(spark, sf).select(*_SCORE.split(", "))


@query("hotspot_severity", """SELECT s.grain, s.severity, coalesce(rows, 0) AS rows, coalesce(events, 0) AS events, avg_score, max_score
  FROM (SELECT DISTINCT grain, severity FROM (SELECT grain FROM hscore WHERE is_hotspot), (SELECT unnest(['low', 'medium', 'high', 'critical']) AS severity)) s LEFT JOIN (
  SELECT grain, severity, count(*) AS rows, CAST(sum(recent_30) AS BIGINT) AS events, round(round(avg(score), 10), 4) AS avg_score, max(score) AS max_score
  FROM hscore WHERE is_hotspot GROUP BY grain, severity) c ON s.grain = c.grain AND s.severity = c.severity""")
def hotspot_severity(spark, sf):
    return hs.severity_counts(materialize(hotspot_rows(spark, sf)))


_HRANK = "rank_overall, rank_in_grain, grain, grp, area, cell_x, cell_y, cat, cls, recent_30, baseline, expected, ratio, score, severity"


@query("hotspots_ranked", f"SELECT {_HRANK} FROM hots")
def hotspots_ranked(spark, sf):
    return hotspots_table(spark, sf).select(*_HRANK.split(", "))


@query("hotspots_top", f"SELECT {_HRANK} FROM hots WHERE rank_in_grain <= 5")
def hotspots_top(spark, sf):
    return hotspots_table(spark, sf).filter("rank_in_grain <= 5").select(*_HRANK.split(", "))


_HRULES = {
    "not_flagged": "is_hotspot IS DISTINCT FROM true", "bad_grain": "grain NOT IN ('area', 'grid')",
    "bad_severity": "severity NOT IN ('low', 'medium', 'high', 'critical')", "blank_key": "trim(grp) = '' OR trim(cat) = '' OR trim(cls) = ''",
    "bad_rank": "rank_overall < 1", "grid_with_area": "grain = 'grid' AND area IS NOT NULL",
    "grid_off_centre": "grain = 'grid' AND (abs(map_x - cell_x) > 1e-7 OR abs(map_y - cell_y) > 1e-7)",
    "area_without_area": "grain = 'area' AND area IS NULL", "area_with_cell": "grain = 'area' AND (cell_x IS NOT NULL OR cell_y IS NOT NULL)",
    "map_point_outside": "NOT coalesce(map_x BETWEEN -74.27 AND -73.65 AND map_y BETWEEN 40.48 AND 40.93, false)",
}
_HBAD = """(SELECT * REPLACE (CASE WHEN rank_in_grain = 2 THEN map_x + 1 ELSE map_x END AS map_x, CASE WHEN rank_in_grain = 3 THEN ' ' ELSE cat END AS cat) FROM hots
  UNION ALL SELECT * FROM hots WHERE rank_overall = 1) hb"""


@query("check_hotspots", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS rule_name, count(*) FILTER (WHERE {c}) AS issue_count FROM {_HBAD}" for n, c in _HRULES.items()) + f"""
UNION ALL SELECT 'extra_snapshot_days', greatest(count(DISTINCT snapshot_day) - 1, 0) FROM {_HBAD}
UNION ALL SELECT 'null_snapshot_days', count(*) - count(snapshot_day) FROM {_HBAD}
UNION ALL SELECT 'future_snapshot_rows', count(*) FILTER (WHERE snapshot_day > DATE '2001-07-31') FROM {_HBAD}
UNION ALL SELECT 'extra_recent_windows', greatest(count(DISTINCT recent_days) - 1, 0) FROM {_HBAD}
UNION ALL SELECT 'extra_baseline_windows', greatest(count(DISTINCT baseline_days) - 1, 0) FROM {_HBAD}
UNION ALL SELECT 'area_in_two_groups', (SELECT count(*) FROM (SELECT area FROM {_HBAD} WHERE grain = 'area' GROUP BY area HAVING count(DISTINCT grp) > 1))
UNION ALL SELECT 'duplicate_rank', count(*) - count(DISTINCT rank_overall) FROM {_HBAD}
UNION ALL SELECT 'duplicate_key', count(*) - count(DISTINCT (grain, grp, area, cell_x, cell_y, cat, cls)) FROM {_HBAD}""")
def check_hotspots(spark, sf):
    rows = materialize(hotspots_table(spark, sf))
    damaged = rows.withColumns({
        "map_x": F.when(F.col("rank_in_grain") == 2, F.col("map_x") + 1).otherwise(F.col("map_x")),
        "cat": F.when(F.col("rank_in_grain") == 3, " ").otherwise(F.col("cat")),
    })
    return q.check_hotspots(damaged.unionByName(rows.filter("rank_overall = 1")), t.BOX, F.lit(t.AS_OF))
