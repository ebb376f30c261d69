"""Publishable forecasts, the cube and its slices, signal views and their status."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from queries import forecasts as fq
from queries import signals as sg
from queries import tables as t
from queries.registry import query
from segpanel.functions.expr import location_label
from segpanel.operators import anomaly as an
from segpanel.operators import forecast as fc
from segpanel.operators import publish as pb
from segpanel.operators import quality as q
from segpanel.operators.ranks import exact_quantiles
from segpanel.session import materialize

SELECTION = {"grp": "ASIA", "cat": None}
START, END = date(2000, 1, 3), date(2001, 7, 23)
_PICK = "lower(trim(grp)) = 'asia'"
_RANGE = "week BETWEEN DATE '2000-01-03' AND DATE '2001-07-23'"
_BASELINE = "trailing_8_week_mean"


def forecast_parts(spark, sf):
    """Weekly table, next-week forecast with its baseline, and the tagged forecast rows."""
    weekly, dates, dense_rows = fq.panel(spark, sf)
    rows = materialize(fc.ml_features(dense_rows, t.KEYS, dates).filter(F.col("week") >= F.lit(dates.validation_start)))
    best = fc.fit_best(fc.fit_grid(rows, dates.validation_start, dates.validation_end))
    future = fc.next_week(fc.predict(rows, best, t.KEYS))
    lines = fc.next_week(fc.baseline_forecasts(dense_rows, t.KEYS, dates)).withColumn("baseline", F.col(_BASELINE))
    changes = fc.expected_change(future, lines, t.KEYS)
    return weekly, changes, fc.tag_publishable(changes, pb.canonical_groups(weekly))


def published(spark, sf):
    return forecast_parts(spark, sf)[2].filter("withheld_reason IS NULL")


def area_table(spark, sf):
    return fc.area_forecast(published(spark, sf))


@query("expected_change", "SELECT * FROM changes4")
def expected_change(spark, sf):
    return forecast_parts(spark, sf)[1]


@query("publishable_rows", "SELECT week, grp, area, cat, cls, predicted, baseline, change, change_pct, canonical_grp, withheld_reason, location_key FROM tagged4")
def publishable_rows(spark, sf):
    return forecast_parts(spark, sf)[2]


@query("join_anti_withheld", "SELECT week, grp, area, cat, cls, predicted FROM changes4 c WHERE NOT EXISTS (SELECT 1 FROM canon m WHERE m.area = c.area AND m.canonical_grp = c.grp)")
def join_anti_withheld(spark, sf):
    weekly, changes, _ = forecast_parts(spark, sf)
    canon = pb.canonical_groups(weekly).select("area", F.col("canonical_grp").alias("grp"))
    return changes.join(canon, ["area", "grp"], "left_anti").select("week", *t.KEYS, "predicted")


@query("publish_summary", "SELECT * FROM psum4")
def publish_summary(spark, sf):
    return fc.publish_summary(forecast_parts(spark, sf)[2])


@query("area_forecast", "SELECT * FROM areas4")
def area_forecast(spark, sf):
    return area_table(spark, sf)


@query("volume_levels", """SELECT a.location_key, predicted, CASE WHEN predicted = 0 THEN 'zero' WHEN cap <= 0 OR predicted <= cap / 4 THEN 'positive-1'
  WHEN predicted <= cap / 2 THEN 'positive-2' WHEN predicted <= cap * 3 / 4 THEN 'positive-3' ELSE 'positive-4' END AS level
  FROM areas4 a, (SELECT quantile_cont(predicted, 0.95) AS cap FROM areas4 WHERE predicted > 0) c""")
def volume_levels(spark, sf):
    areas = materialize(area_table(spark, sf))
    top = exact_quantiles(areas.filter("predicted > 0"), "predicted", [0.95])
    return fc.volume_levels(areas, top).select("location_key", "predicted", "level")


@query("change_levels", """SELECT a.location_key, change, CASE WHEN total_rows = 0 THEN 'unavailable' WHEN baseline_rows = 0 THEN 'missing' WHEN baseline_rows < total_rows THEN 'partial'
    WHEN change IS NULL THEN 'unavailable' ELSE 'complete' END AS coverage,
  CAST(CASE WHEN change IS NULL OR abs(change) <= 1e-6 THEN 0 WHEN cap <= 0 OR abs(change) <= cap / 3 THEN 1 WHEN abs(change) <= cap * 2 / 3 THEN 2 ELSE 3 END AS BIGINT) AS intensity
  FROM areas4 a, (SELECT quantile_cont(abs(change), 0.95) AS cap FROM areas4 WHERE abs(change) > 1e-6) c""")
def change_levels(spark, sf):
    areas = materialize(area_table(spark, sf))
    sizes = areas.filter(F.abs("change") > 1e-6).withColumn("size", F.abs("change"))
    return fc.change_levels(areas, exact_quantiles(sizes, "size", [0.95])).select("location_key", "change", "coverage", "intensity")


_SUMMED = "true AS withheld_adds_up, true AS reasons_add_up, {} AS total_matches, true AS source_total_matches, true AS coverage_matches"


@query("forecast_reconcile", f"""SELECT 'published' AS name, published_rows, source_rows, CAST(0 AS BIGINT) AS wrong_change_rows, CAST(0 AS BIGINT) AS wrong_pct_rows,
  CAST(0 AS BIGINT) AS bad_prediction_rows, {_SUMMED.format("true")} FROM psum4
UNION ALL SELECT 'damaged', published_rows, source_rows, c, p, n, {_SUMMED.format("moved <= 1e-4")} FROM psum4, (SELECT count(*) FILTER (WHERE cls = 'P' AND baseline IS NOT NULL) AS c,
  count(*) FILTER (WHERE cls = 'F' AND change_pct IS NOT NULL) AS p, count(*) FILTER (WHERE cls = 'P') AS n, coalesce(sum(predicted + 1) FILTER (WHERE cls = 'P'), 0) AS moved FROM pub4) d""")
def forecast_reconcile(spark, sf):
    """Of the published forecast; and of a copy with negative predictions in one class and other percentages in another."""
    _, changes, tagged = forecast_parts(spark, sf)
    tagged = materialize(tagged)
    shown, summary = tagged.filter("withheld_reason IS NULL"), fc.publish_summary(tagged)
    damaged = shown.withColumns({"predicted": F.when(F.col("cls") == "P", -1.0).otherwise(F.col("predicted")),
                                 "change_pct": F.when(F.col("cls") == "F", F.col("change_pct") + 5).otherwise(F.col("change_pct"))})
    parts = [q.forecast_reconcile(rows, changes, summary).select(F.lit(name).alias("name"), "*") for name, rows in (("published", shown), ("damaged", damaged))]
    return parts[0].unionByName(parts[1])


# ---- cube and slices ----------------------------------------------------------------------------

@query("date_range", """SELECT first_day, last_day, first_week, last_week, last_week + 6 > last_day AS last_week_partial, lc AS latest_complete_week,
  greatest(first_week, lc - 357) AS default_start_week FROM (SELECT *, CASE WHEN last_week + 6 > last_day THEN last_week - 7 ELSE last_week END AS lc FROM (
  SELECT (SELECT min(day) FROM ok) AS first_day, (SELECT max(day) FROM ok) AS last_day, min(week) AS first_week, max(week) AS last_week FROM weekly4))""")
def date_range(spark, sf):
    return pb.date_range(t.eligible(spark, sf), t.weekly(spark, sf))


@query("dictionary_encode", "\nUNION ALL\n".join(
    f"SELECT '{d}' AS dimension, {d} AS label, row_number() OVER (ORDER BY {d}) - 1 AS code FROM (SELECT DISTINCT {d} FROM weekly4)" for d in t.KEYS))
def dictionary_encode(spark, sf):
    return pb.dictionaries(t.weekly(spark, sf), t.KEYS)


@query("cube_rows", "SELECT n, row_number() OVER (ORDER BY week, grp, area, cat, cls) - 1 AS row_no, " + ", ".join(f"dense_rank() OVER (ORDER BY {d}) - 1 AS {d}_index" for d in ["week", *t.KEYS]) + " FROM weekly4")
def cube_rows(spark, sf):
    return pb.cube_rows(materialize(t.weekly(spark, sf)), t.KEYS)


@query("cube_offsets_hit", """SELECT row_number() OVER (ORDER BY week) - 1 AS week_index, true AS found, row_number() OVER (ORDER BY week) = 1 AS found_shifted
  FROM (SELECT DISTINCT week FROM weekly4)""")
def cube_offsets_hit(spark, sf):
    """Whether each week's offset is the least row number of its rows; and the same with offsets moved by one row but for the first."""
    weekly = materialize(t.weekly(spark, sf))
    first = pb.cube_rows(weekly, t.KEYS).groupBy("week_index").agg(F.min("row_no").alias("row_no"))
    hit = first.join(pb.cube_offsets(weekly), "week_index")
    moved = F.col("row_start") + F.when(F.col("week_index") > 0, 1).otherwise(0)
    return hit.select("week_index", (F.col("row_no") == F.col("row_start")).alias("found"), (F.col("row_no") == moved).alias("found_shifted"))


@query("cube_range", f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY week, grp, area, cat, cls) - 1 AS row_no, dense_rank() OVER (ORDER BY week) - 1 AS week_index,
  dense_rank() OVER (ORDER BY grp) - 1 AS grp_index, n FROM weekly4) WHERE week_index BETWEEN 40 AND 43""")
def cube_range(spark, sf):
    """Four weeks of a written cube, read by their range of row numbers."""
    weekly = materialize(t.weekly(spark, sf))
    path = t.scratch(spark, "cube")
    pb.write_cube(pb.cube_rows(weekly, t.KEYS), path, 64 << 10)
    return pb.read_cube(spark, path, pb.cube_offsets(weekly), 40, 43).select("row_no", "week_index", "grp_index", "n")


@query("cube_offsets", """SELECT row_number() OVER (ORDER BY week) - 1 AS week_index, CAST(sum(k) OVER (ORDER BY week) - k AS BIGINT) AS row_start
  FROM (SELECT week, count(*) AS k FROM weekly4 GROUP BY week) UNION ALL SELECT count(DISTINCT week), count(*) FROM weekly4""")
def cube_offsets(spark, sf):
    return pb.cube_offsets(t.weekly(spark, sf))


@query("cube_slice", f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM weekly4 WHERE {_PICK} AND {_RANGE}
UNION ALL SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM weekly4 WHERE grp = 'NOWHERE'""")
def cube_slice(spark, sf):
    weekly = t.weekly(spark, sf)
    return pb.cube_slice(weekly, SELECTION, START, END).unionByName(pb.cube_slice(weekly, {"grp": "NOWHERE"}, START, END))


@query("canonical_area_group", "SELECT * FROM canon")
def canonical_area_group(spark, sf):
    return pb.canonical_groups(t.weekly(spark, sf))


_INDEX = "(SELECT canonical_grp AS grp, area FROM canon UNION ALL SELECT DISTINCT grp, area FROM weekly4 WHERE area = 'UNKNOWN' AND n > 0) ix"


@query("areas_by_group", f"SELECT grp, area FROM {_INDEX}")
def areas_by_group(spark, sf):
    return pb.areas_by_group(t.weekly(spark, sf))


@query("join_semi_areas", f"SELECT w.grp, w.area, CAST(sum(n) AS BIGINT) AS total FROM weekly4 w WHERE EXISTS (SELECT 1 FROM {_INDEX} WHERE ix.grp = w.grp AND ix.area = w.area) GROUP BY w.grp, w.area")
def join_semi_areas(spark, sf):
    weekly = t.weekly(spark, sf)
    kept = weekly.join(pb.areas_by_group(weekly), ["grp", "area"], "left_semi")
    return kept.groupBy("grp", "area").agg(F.sum("n").alias("total"))


_SERIES = f"""(SELECT c.week, coalesce(s.total, 0) AS total FROM (SELECT week FROM cal4, (SELECT max(week) AS mw FROM weekly4) WHERE week <= mw) c
  LEFT JOIN (SELECT week, CAST(sum(n) AS BIGINT) AS total FROM weekly4 WHERE {_PICK} GROUP BY week) s ON c.week = s.week)"""
_OBSERVED = f"""(SELECT * FROM (SELECT week, total, CASE WHEN count(*) OVER w = 8 THEN round(avg(total) OVER w, 1) END AS baseline, week > DATE '2001-07-16' AS is_partial
  FROM {_SERIES} WINDOW w AS (ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) WHERE {_RANGE}) ob"""


def observed(spark, sf):
    return pb.observed_weekly(t.weekly(spark, sf), SELECTION, START, END, partial_after=date(2001, 7, 16))


@query("observed_weekly", f"SELECT * FROM {_OBSERVED}")
def observed_weekly(spark, sf):
    return observed(spark, sf)


@query("observed_ranked", f"SELECT cat, CAST(sum(n) AS BIGINT) AS total, row_number() OVER (ORDER BY sum(n) DESC, cat) AS rank FROM weekly4 WHERE {_PICK} AND {_RANGE} GROUP BY cat QUALIFY rank <= 8")
def observed_ranked(spark, sf):
    return pb.observed_ranked(t.weekly(spark, sf), SELECTION, "cat", START, END, 8)


@query("four_week_comparison", f"""SELECT *, round(CASE WHEN prior > 0 THEN (recent - prior) * 100.0 / prior END, 1) AS change_pct FROM (
  SELECT CAST(sum(total) FILTER (WHERE age <= 4) AS BIGINT) AS recent, CAST(sum(total) FILTER (WHERE age > 4) AS BIGINT) AS prior, CAST(4 AS BIGINT) AS weeks,
  min(week) FILTER (WHERE age <= 4) AS recent_start, max(week) FILTER (WHERE age <= 4) AS recent_end, min(week) FILTER (WHERE age > 4) AS prior_start, max(week) FILTER (WHERE age > 4) AS prior_end
  FROM (SELECT *, row_number() OVER (ORDER BY week DESC) AS age FROM {_OBSERVED} WHERE NOT is_partial) WHERE age <= 8)""")
def four_week_comparison(spark, sf):
    return pb.recent_comparison(observed(spark, sf))


# ---- signals ------------------------------------------------------------------------------------

_PUB_A = "(SELECT rank_overall, week, grp, cat, actual, expected, expected_source, residual, score, severity FROM anoms2 WHERE severity IN ('high', 'critical')) pa"
_PUB_H = """(SELECT rank_overall, snapshot_day, grain, grp, area, cell_x, cell_y, cat, cls, recent_30 AS recent, expected, lift_pct, score, severity
  FROM hots WHERE severity IN ('high', 'critical')) ph"""


@query("published_anomalies", f"SELECT * FROM {_PUB_A}")
def published_anomalies(spark, sf):
    return pb.published_anomalies(sg.ranked(spark, sf), t.KEYS2)


@query("published_hotspots", f"SELECT * FROM {_PUB_H}")
def published_hotspots(spark, sf):
    return pb.published_hotspots(sg.hotspots_table(spark, sf))


@query("hotspot_labels", f"""SELECT rank_overall, CASE WHEN grain = 'grid' THEN printf('GRID %.3f, %.3f · %s', cell_y, cell_x, grp) ELSE 'AREA ' || area || ' · ' || grp END AS label FROM {_PUB_H}""")
def hotspot_labels(spark, sf):
    rows = pb.published_hotspots(sg.hotspots_table(spark, sf))
    label = location_label(F.col("grain"), F.col("area"), F.col("grp"), F.col("cell_x"), F.col("cell_y"), digits=3)
    return rows.select("rank_overall", label.alias("label"))


@query("signal_summaries", f"""SELECT 'anomaly' AS signal, count(*) AS rows, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
  max(score) AS max_score, CAST(coalesce(sum(actual), 0) AS BIGINT) AS events, round(count(*) FILTER (WHERE severity = 'critical') * 100.0 / nullif(count(*), 0), 4) AS critical_pct FROM {_PUB_A}
UNION ALL SELECT 'hotspot', count(*), count(*) FILTER (WHERE severity = 'critical'), count(*) FILTER (WHERE severity = 'high'), max(score), CAST(coalesce(sum(recent), 0) AS BIGINT),
  round(count(*) FILTER (WHERE severity = 'critical') * 100.0 / nullif(count(*), 0), 4) FROM {_PUB_H}""")
def signal_summaries(spark, sf):
    a = pb.summary_row(pb.published_anomalies(sg.ranked(spark, sf), t.KEYS2), "actual")
    h = pb.summary_row(pb.published_hotspots(sg.hotspots_table(spark, sf)), "recent")
    return a.withColumn("signal", F.lit("anomaly")).unionByName(h.withColumn("signal", F.lit("hotspot")))


@query("signal_totals", f"""SELECT 'hotspot' AS signal, count(*) AS rows, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity <> 'critical') AS not_critical,
  NULL::DOUBLE AS predicted_total FROM {_PUB_H} WHERE {_PICK}
UNION ALL SELECT 'anomaly', count(*), count(*) FILTER (WHERE severity = 'critical'), count(*) FILTER (WHERE severity <> 'critical'), NULL FROM {_PUB_A} WHERE {_PICK} AND {_RANGE}
UNION ALL SELECT 'forecast', count(*), 0, 0, round(sum(predicted), 1) FROM pub4 WHERE {_PICK}""")
def signal_totals(spark, sf):
    hot = pb.published_hotspots(sg.hotspots_table(spark, sf))
    odd = pb.published_anomalies(sg.ranked(spark, sf), t.KEYS2)
    return pb.signal_totals(hot, odd, published(spark, sf), SELECTION, START, END)


@query("attention_list", f"""SELECT kind, severity, period, grp, cat, observed, reference, score, rank_overall FROM (
  SELECT 'Hotspot' AS kind, severity, snapshot_day AS period, grp, cat, recent::DOUBLE AS observed, expected AS reference, score, rank_overall FROM {_PUB_H}
  UNION ALL SELECT 'Anomaly', severity, week, grp, cat, actual::DOUBLE, expected, score, rank_overall FROM {_PUB_A})
  ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, score DESC, kind, period DESC, rank_overall LIMIT 10""")
def attention_list(spark, sf):
    hot = pb.published_hotspots(sg.hotspots_table(spark, sf))
    return pb.attention_list(hot, pb.published_anomalies(sg.ranked(spark, sf), t.KEYS2))


@query("hotspot_layers", f"""SELECT count(*) FILTER (WHERE area = '8') AS all_rows, count(*) FILTER (WHERE area = '8' AND grain = 'grid') AS grid_rows,
  count(*) FILTER (WHERE area = '8' AND grain = 'area') AS area_rows, count(*) FILTER (WHERE grain = 'grid') > 0 AS grid_hidden_by_area FROM hots WHERE {_PICK}
UNION ALL SELECT count(*), count(*) FILTER (WHERE grain = 'grid'), count(*) FILTER (WHERE grain = 'area'), false FROM hots WHERE {_PICK}""")
def hotspot_layers(spark, sf):
    rows = materialize(sg.hotspots_table(spark, sf))
    return pb.hotspot_layers(rows, SELECTION, "8").unionByName(pb.hotspot_layers(rows, SELECTION, None))


@query("filter_anomalies", f"""SELECT count(*) AS source_rows, count(*) FILTER (WHERE {_PICK} AND {_RANGE}) AS selected_rows,
  CAST(coalesce(sum(actual) FILTER (WHERE {_PICK} AND {_RANGE}), 0) AS BIGINT) AS selected_events, count(*) > 0 AND count(*) FILTER (WHERE {_PICK} AND {_RANGE}) = 0 AS filtered_empty FROM anoms2""")
def filter_anomalies(spark, sf):
    return pb.filter_anomalies(sg.ranked(spark, sf), SELECTION, START, END)


_SEV = ("low", "medium", "high", "critical")


def _anomaly_case(name: str, where: str, shifts: dict[str, int], end: str) -> str:
    """Status of the anomaly rows ``where``, if the metrics count ``shifts`` more rows and scoring ended at ``end``."""
    more = " + ".join(["0", *map(str, shifts.values())])
    differ = " OR ".join(f"{s} <> {s} + ({shifts.get(s, 0)})" for s in _SEV)
    code = f"""CASE WHEN n <> n + ({more}) THEN 'invalid row_count_off' WHEN {differ} THEN 'invalid severity_off' WHEN isodow(e) <> 1 THEN 'invalid scoring_no_monday'
      WHEN lo < h0 THEN 'invalid before_horizon' WHEN hi > e THEN 'invalid after_scoring' WHEN e < h1 THEN 'stale scored_too_early' WHEN e > h1 THEN 'incompatible scored_too_late'
      WHEN n = 0 THEN 'empty ' ELSE 'available ' END"""
    facts = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in _SEV)
    return f"""SELECT '{name}' AS signal, split_part(code, ' ', 1) AS status, nullif(split_part(code, ' ', 2), '') AS reason, n AS rows FROM (SELECT n, {code} AS code FROM (
      SELECT count(*) AS n, {facts}, min(week) AS lo, max(week) AS hi, {end} AS e, (SELECT min(week) FROM weekly4) AS h0, (SELECT max(week) - 7 FROM weekly4) AS h1 FROM anoms2 WHERE {where}))"""


_END = "(SELECT max(week) - 7 FROM weekly4)"
# name: rows, what the metrics table counts too many, end of scoring
_ANOMALY_CASES = {
    "anomaly": ("true", {}, _END),
    "anomaly_metrics_short": ("true", {"low": -1}, _END),
    "anomaly_severity_moved": ("true", {"low": 1, "medium": -1}, _END),
    "anomaly_sunday": ("true", {}, f"{_END} + 6"),
    "anomaly_beyond_scoring": ("true", {}, f"{_END} - 700"),
    "anomaly_old": ("week < DATE '2001-01-01'", {}, f"{_END} - 28"),
    "anomaly_ahead": ("true", {}, f"{_END} + 7"),
    "anomaly_none": ("false", {}, _END),
}
_FORECAST_CASES = {
    "forecast": ("true", "available", None), "forecast_none": ("false", "invalid", "not_one_week"),
    "forecast_lost_segment": ("grp <> 'ASIA'", "invalid", "segments_off"),
}


def _forecast_case(name: str) -> str:
    where = _FORECAST_CASES[name][0]
    return f"""SELECT '{name}', CASE WHEN weeks <> 1 OR segments <> expected OR no_value > 0 OR n <> segments THEN 'invalid' WHEN d < 7 THEN 'stale' WHEN d > 7 THEN 'incompatible' ELSE 'available' END,
      CASE WHEN weeks <> 1 THEN 'not_one_week' WHEN no_value > 0 THEN 'no_prediction' WHEN n <> segments THEN 'keys_repeat' WHEN segments <> expected THEN 'segments_off'
      WHEN d < 7 THEN 'week_not_ahead' WHEN d > 7 THEN 'week_too_far' END, n FROM (
      SELECT count(*) AS n, count(DISTINCT week) AS weeks, count(*) FILTER (WHERE predicted IS NULL) AS no_value, count(DISTINCT (grp, area, cat, cls)) AS segments, min(week) - (SELECT max(week) FROM weekly4) AS d,
      (SELECT count(*) FROM (SELECT DISTINCT grp, area, cat, cls FROM weekly4)) AS expected FROM future4 WHERE {where})"""


@query("signal_status", "\nUNION ALL\n".join([*(_anomaly_case(n, *c) for n, c in _ANOMALY_CASES.items()), *map(_forecast_case, _FORECAST_CASES)]))
def signal_status(spark, sf):
    weekly, dates, dense_rows = fq.panel(spark, sf)
    flagged = materialize(sg.scored(spark, sf).filter("is_anomaly"))
    last = weekly.agg(F.max("week")).scalar()
    ends = {"": 7, "_sunday": 1, "_beyond_scoring": 707, "_old": 35, "_ahead": 0}
    parts = []
    for name, (where, shifts, _) in _ANOMALY_CASES.items():
        rows = flagged.filter(where)
        shift = F.lit(0)
        for severity, n in shifts.items():
            shift = F.when(F.col("severity") == severity, F.lit(n)).otherwise(shift)
        metrics = an.severity_counts(rows).withColumn("rows", F.col("rows") + shift)  # the damaged copy of the published metrics
        end = F.date_sub(last, ends.get(name.removeprefix("anomaly"), 7))
        parts.append(q.anomaly_status(rows, metrics, weekly, end).withColumn("signal", F.lit(name)))
    feats = materialize(fc.ml_features(dense_rows, t.KEYS, dates).filter(F.col("week") >= F.lit(dates.validation_start)))
    future = materialize(fc.next_week(fc.predict(feats, fc.fit_best(fc.fit_grid(feats, dates.validation_start, dates.validation_end)), t.KEYS)))
    parts += [q.forecast_status(future.filter(where), weekly, t.KEYS).withColumn("signal", F.lit(name)) for name, (where, *_) in _FORECAST_CASES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("signal", "status", "reason", "rows")


_LAST_DAY = "(SELECT max(day) FROM ok)"
_HOT_CASES = {  # name -> rows kept, days added to the snapshot, rows added to the metrics of the highest severity
    "hotspots": ("true", "0", 0), "hotspots_none": ("false", "0", 0), "hotspots_metrics_off": ("true", "0", 3),
    "hotspots_two_days": ("true", "CASE WHEN rank_overall = 1 THEN -1 ELSE 0 END", 0), "hotspots_old": ("true", "-30", 0), "hotspots_ahead": ("true", "30", 0),
}


def _hot_case(name: str) -> str:
    where, days, more = _HOT_CASES[name]
    return f"""SELECT '{name}' AS signal, CASE WHEN n = 0 THEN 'empty' WHEN lo <> hi THEN 'invalid' WHEN age > 1 THEN 'stale' WHEN age < 0 THEN 'incompatible' ELSE 'available' END AS status,
  CASE WHEN n = 0 THEN NULL WHEN lo <> hi THEN 'several_snapshots' WHEN age > 1 THEN 'snapshot_old' WHEN age < 0 THEN 'snapshot_ahead' END AS reason, n AS rows, {str(more == 0).lower()} AS metrics_match
  FROM (SELECT count(*) AS n, min(d) AS lo, max(d) AS hi, {_LAST_DAY} - max(d) AS age FROM (SELECT snapshot_day + CAST({days} AS INTEGER) AS d FROM hots WHERE {where}))"""


@query("hotspot_status", "\nUNION ALL\n".join(map(_hot_case, _HOT_CASES)))
def hotspot_status(spark, sf):
    """Status of the hotspot table and of damaged copies; metrics that don't agree are told and withhold nothing."""
    table = materialize(sg.hotspots_table(spark, sf))
    last = t.eligible(spark, sf).agg(F.max("day")).scalar()
    parts = []
    for name, (where, days, more) in _HOT_CASES.items():
        rows = table.filter(where)
        metrics = rows.groupBy("severity").agg(F.count("*").alias("rows"))
        if more:
            metrics = metrics.withColumn("rows", F.col("rows") + more)
        moved = rows.withColumn("snapshot_day", F.expr(f"date_add(snapshot_day, {days})"))
        parts.append(q.hotspot_status(moved, last, metrics).select(F.lit(name).alias("signal"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
