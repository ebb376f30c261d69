"""Data quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import tables as t
from queries.prepare import _DATES, _KIND, date_issue
from queries.registry import query
from segpanel.functions import expr as E
from segpanel.operators import quality as q
from segpanel.operators.clean import FLAGS

_FLAG_LIST = ", ".join(FLAGS)


@query("quality_flags", f"SELECT event_id, {_FLAG_LIST}, is_eligible FROM clean")
def quality_flags(spark, sf):
    return t.clean(spark, sf).select("event_id", *FLAGS, "is_eligible")


def _long(names, value="issue_count", label="rule_name", source="clean"):
    return "\nUNION ALL\n".join(
        f"SELECT '{n}' AS {label}, count(*) FILTER (WHERE {c}) AS {value}, round(count(*) FILTER (WHERE {c}) * 100.0 / nullif(count(*), 0), 4) AS issue_pct FROM {source}"
        for n, c in names.items())


@query("flag_counts", _long({f: f for f in FLAGS}, label="quality_flag"))
def flag_counts(spark, sf):
    return q.flag_counts(t.clean(spark, sf), FLAGS)


_HITS = " + ".join(f"CAST({f} AS INTEGER)" for f in FLAGS)


@query("flag_overlap", f"""SELECT count(*) AS rows, CAST(sum(h) AS BIGINT) AS flag_total, count(*) FILTER (WHERE h >= 1) AS rows_with_flag,
  count(*) FILTER (WHERE h > 1) AS rows_with_overlap, CAST(max(h) AS BIGINT) AS max_flags_per_row, count(*) FILTER (WHERE h IS NULL) AS rows_with_null_flag
  FROM (SELECT {_HITS} AS h FROM clean)""")
def flag_overlap(spark, sf):
    return q.flag_overlap(t.clean(spark, sf), FLAGS)


@query("date_coverage", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS date_column, min({c}) AS min_date, max({c}) AS max_date FROM typed" for c in ("start_day", "end_day", "report_day")))
def date_coverage(spark, sf):
    return q.date_coverage(t.clean(spark, sf), ["start_day", "end_day", "report_day"])


@query("overall_counts", "SELECT count(*) AS rows, count(*) FILTER (WHERE is_eligible) AS eligible_rows, count(DISTINCT event_id) AS distinct_ids FROM clean")
def overall_counts(spark, sf):
    return q.overall_counts(t.clean(spark, sf), "event_id", "is_eligible")


@query("check_weekly", """SELECT count(*) AS rows, count(*) FILTER (WHERE week IS NULL) AS null_weeks, count(*) FILTER (WHERE n IS NULL) AS null_values,
  count(*) FILTER (WHERE n < 0) AS negative_values FROM weekly4""")
def check_weekly(spark, sf):
    return q.check_weekly(t.weekly(spark, sf))


@query("check_eligibility", """SELECT count(*) AS rows, count(*) FILTER (WHERE is_eligible IS NULL) AS null_flags,
  count(*) FILTER (WHERE is_eligible) AS eligible_rows, count(*) FILTER (WHERE is_eligible AND start_day IS NULL) AS eligible_without_date FROM clean""")
def check_eligibility(spark, sf):
    return q.check_eligibility(t.clean(spark, sf), "start_day", "is_eligible")


@query("check_bins", """SELECT count(*) AS rows, count(*) FILTER (WHERE day IS NULL) AS null_dates,
  count(*) FILTER (WHERE grp IS NULL OR area IS NULL OR cat IS NULL OR cls IS NULL) AS null_keys,
  count(*) FILTER (WHERE flag_missing_xy IS NULL OR flag_zero_xy IS NULL OR flag_outside_xy IS NULL) AS null_flags,
  count(*) FILTER (WHERE weight IS NULL OR weight <= 0) AS bad_weights FROM bins""")
def check_bins(spark, sf):
    return q.check_bins(t.bins(spark, sf), "day", t.KEYS, t.FLAG_COLUMNS)


_BADKEYS = "(SELECT *, week - CASE WHEN n >= 3 THEN 1 ELSE 0 END AS shifted, CASE WHEN n = 2 THEN ' ' ELSE area END AS part FROM weekly4)"


@query("check_weekly_keys", f"""SELECT CAST(sum(c) AS BIGINT) AS rows,
  CAST(coalesce(sum(c) FILTER (WHERE trim(grp) = '' OR trim(part) = '' OR trim(cat) = ''), 0) AS BIGINT) AS blank_key_rows,
  CAST(coalesce(sum(c) FILTER (WHERE extract(isodow FROM shifted) <> 1), 0) AS BIGINT) AS bad_week_rows,
  CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
  (SELECT count(DISTINCT (grp, part, cat)) FROM {_BADKEYS}) AS segments
  FROM (SELECT shifted, grp, part, cat, count(*) AS c FROM {_BADKEYS} GROUP BY ALL)""")
def check_weekly_keys(spark, sf):
    rows = t.weekly(spark, sf).select(
        F.date_sub("week", F.when(F.col("n") >= 3, 1).otherwise(0)).alias("week"), "grp",
        F.when(F.col("n") == 2, " ").otherwise(F.col("area")).alias("area"), "cat")
    return q.check_weekly_keys(rows, ["grp", "area", "cat"])


@query("duplicate_keys", "SELECT event_id, start_date_text, count(*) AS copies FROM raw GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return q.duplicate_keys(t.raw(spark, sf), ["event_id", "start_date_text"])


@query("duplicate_distribution", """SELECT copies, count(*) AS ids, CAST(sum(copies - 1) AS BIGINT) AS surplus_rows
  FROM (SELECT event_id, count(*) AS copies FROM raw WHERE event_id IS NOT NULL GROUP BY event_id) GROUP BY copies""")
def duplicate_distribution(spark, sf):
    return q.duplicate_distribution(t.raw(spark, sf), "event_id")


@query("code_consistency", """SELECT area_text, count(*) AS descriptions, CAST(sum(k) AS BIGINT) AS rows, string_agg(grp_text, ' | ' ORDER BY grp_text) AS description_list
  FROM (SELECT area_text, grp_text, count(*) AS k FROM prepared WHERE area_text IS NOT NULL AND grp_text IS NOT NULL GROUP BY ALL)
  GROUP BY area_text HAVING count(*) > 1""")
def code_consistency(spark, sf):
    from segpanel.operators.clean import prepare
    return q.code_consistency(prepare(t.raw(spark, sf)), "area_text", "grp_text")


_RULES = {
    "missing_id": "event_id IS NULL",
    "missing_start": "start_day IS NULL",
    "missing_report": "report_day IS NULL",
    "report_before_start": "report_day < start_day",
    "end_before_start": "end_day < start_day",
    "invalid_start_time": "NOT regexp_like_time",
    "missing_grp": "grp IS NULL",
    "missing_area": "area IS NULL",
    "missing_xy": "x IS NULL OR y IS NULL",
    "outside_xy": "flag_outside_xy",
    "missing_cat": "cat IS NULL",
    "invalid_cls": "flag_invalid_cls",
}
_RULE_SOURCE = "(SELECT *, regexp_full_match(start_time, '([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') AS regexp_like_time FROM clean)"


@query("rule_table", _long(_RULES, source=_RULE_SOURCE) + """
UNION ALL SELECT 'duplicate_id_surplus', count(event_id) - count(DISTINCT event_id),
  round((count(event_id) - count(DISTINCT event_id)) * 100.0 / nullif(count(*), 0), 4) FROM clean""")
def rule_table(spark, sf):
    rows = t.clean(spark, sf)
    rules = {
        "missing_id": F.col("event_id").isNull(), "missing_start": F.col("start_day").isNull(),
        "missing_report": F.col("report_day").isNull(),
        "report_before_start": F.col("report_day") < F.col("start_day"),
        "end_before_start": F.col("end_day") < F.col("start_day"),
        "invalid_start_time": ~E.valid_time("start_time"), "missing_grp": F.col("grp").isNull(),
        "missing_area": F.col("area").isNull(), "missing_xy": E.missing_xy("x", "y"),
        "outside_xy": F.col("flag_outside_xy"), "missing_cat": F.col("cat").isNull(), "invalid_cls": F.col("flag_invalid_cls"),
    }
    return q.rule_table_with_surplus(rows, rules, "event_id", "duplicate_id_surplus")


@query("allowed_value_audit", """SELECT 'grp_text' AS column_name, count(grp_text) AS checked, count(*) - count(grp_text) AS missing,
  count(*) FILTER (WHERE grp_text NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')) AS unexpected FROM prepared
UNION ALL SELECT 'cls_text', count(cls_text), count(*) - count(cls_text), count(*) FILTER (WHERE cls_text NOT IN ('F', 'O', 'P')) FROM prepared""")
def allowed_value_audit(spark, sf):
    from segpanel.operators.clean import prepare
    return q.allowed_value_audit(prepare(t.raw(spark, sf)), {"grp_text": t.GROUPS, "cls_text": t.CLASSES})


@query("time_quality", f"""SELECT count(*) AS rows, count(*) - count(start_time) AS missing, count(*) FILTER (WHERE regexp_like_time) AS valid,
  count(*) FILTER (WHERE NOT regexp_like_time) AS invalid, min(start_time) FILTER (WHERE regexp_like_time) AS first_time,
  max(start_time) FILTER (WHERE regexp_like_time) AS last_time FROM {_RULE_SOURCE}""")
def time_quality(spark, sf):
    return q.time_quality(t.clean(spark, sf), "start_time")


@query("xy_quality", f"""SELECT count(*) AS rows, count(*) FILTER (WHERE kind = 'missing') AS missing, count(*) FILTER (WHERE kind = 'zero') AS zero,
  count(*) FILTER (WHERE kind = 'outside') AS outside, count(*) FILTER (WHERE kind = 'valid') AS valid,
  min(x) FILTER (WHERE kind = 'valid') AS x_min, max(x) FILTER (WHERE kind = 'valid') AS x_max,
  min(y) FILTER (WHERE kind = 'valid') AS y_min, max(y) FILTER (WHERE kind = 'valid') AS y_max
  FROM (SELECT x, y, {_KIND} AS kind FROM clean)""")
def xy_quality(spark, sf):
    return q.xy_quality(t.clean(spark, sf), t.BOX)


@query("xy_issue_by_group", f"SELECT {_KIND} AS issue, coalesce(grp, 'UNKNOWN') AS grp, count(*) AS rows FROM clean GROUP BY ALL")
def xy_issue_by_group(spark, sf):
    return q.issue_by_group(t.clean(spark, sf), E.classify_xy("x", "y", t.BOX), "grp")


@query("date_issue_by_group", f"SELECT {_DATES} AS issue, coalesce(cls, 'UNKNOWN') AS cls, count(*) AS rows FROM clean GROUP BY ALL")
def date_issue_by_group(spark, sf):
    return q.issue_by_group(t.clean(spark, sf), date_issue(), "cls")


@query("weighted_xy_quality", f"""SELECT *, round(valid_events * 100.0 / nullif(events, 0), 4) AS coverage_pct FROM (
  SELECT CAST(sum(weight) AS BIGINT) AS events, CAST(coalesce(sum(weight) FILTER (WHERE kind = 'valid'), 0) AS BIGINT) AS valid_events,
  CAST(coalesce(sum(weight) FILTER (WHERE kind = 'missing'), 0) AS BIGINT) AS missing_events,
  CAST(coalesce(sum(weight) FILTER (WHERE kind = 'zero'), 0) AS BIGINT) AS zero_events,
  CAST(coalesce(sum(weight) FILTER (WHERE kind = 'outside'), 0) AS BIGINT) AS outside_events
  FROM (SELECT weight, {_KIND} AS kind FROM bins))""")
def weighted_xy_quality(spark, sf):
    return q.weighted_xy_quality(t.bins(spark, sf), t.BOX)


@query("reconcile_totals", """SELECT a.measure, from_events, from_weekly, from_events = from_weekly AS matches FROM (
  SELECT 'total' AS measure, count(*) AS from_events FROM ok UNION ALL SELECT 'unknown_grp', count(*) - count(grp) FROM ok
  UNION ALL SELECT 'unknown_area', count(*) - count(area) FROM ok UNION ALL SELECT 'unknown_cat', count(*) - count(cat) FROM ok
  UNION ALL SELECT 'unknown_cls', count(*) - count(cls) FROM ok) a JOIN (
  SELECT 'total' AS measure, CAST(sum(n) AS BIGINT) AS from_weekly FROM weekly4
  UNION ALL SELECT 'unknown_grp', CAST(coalesce(sum(n) FILTER (WHERE grp = 'UNKNOWN'), 0) AS BIGINT) FROM weekly4
  UNION ALL SELECT 'unknown_area', CAST(coalesce(sum(n) FILTER (WHERE area = 'UNKNOWN'), 0) AS BIGINT) FROM weekly4
  UNION ALL SELECT 'unknown_cat', CAST(coalesce(sum(n) FILTER (WHERE cat = 'UNKNOWN'), 0) AS BIGINT) FROM weekly4
  UNION ALL SELECT 'unknown_cls', CAST(coalesce(sum(n) FILTER (WHERE cls = 'UNKNOWN'), 0) AS BIGINT) FROM weekly4) b ON a.measure = b.measure""")
def reconcile_totals(spark, sf):
    return q.reconcile_totals(t.events(spark, sf), t.weekly(spark, sf), t.KEYS, F.col("is_eligible"))


@query("grid_aligned", """SELECT count(*) AS rows, count(*) AS aligned_rows, true AS all_aligned FROM hgrid
UNION ALL SELECT count(*), count(*) FILTER (WHERE abs(cell_x / 0.1 - 0.5 - round(cell_x / 0.1 - 0.5)) * 0.1 <= 1e-5
   AND abs(cell_y / 0.1 - 0.5 - round(cell_y / 0.1 - 0.5)) * 0.1 <= 1e-5), false
FROM (SELECT x AS cell_x, y AS cell_y FROM points)""")
def grid_aligned(spark, sf):
    from segpanel.operators.hotspot import grid_base, window_cube
    cells = grid_base(window_cube(t.bins(spark, sf), t.HOTSPOTS))
    loose = t.valid_points(spark, sf).select(F.col("x").alias("cell_x"), F.col("y").alias("cell_y"))
    return q.grid_alignment(cells, 0.1).unionByName(q.grid_alignment(loose, 0.1))


@query("key_set_diff", """SELECT grp, cat, 'missing' AS status FROM (SELECT DISTINCT grp, cat FROM weekly4 EXCEPT SELECT grp, cat FROM ok WHERE day >= DATE '2001-06-01')
UNION ALL SELECT grp, cat, 'unexpected' FROM (SELECT grp, cat FROM ok WHERE day >= DATE '2001-06-01' AND grp IS NOT NULL AND cat IS NOT NULL EXCEPT SELECT grp, cat FROM weekly4)""")
def key_set_diff(spark, sf):
    late = t.eligible(spark, sf).filter(F.col("day") >= "2001-06-01").filter("grp IS NOT NULL AND cat IS NOT NULL")
    return q.key_set_diff(t.weekly(spark, sf), late, ["grp", "cat"])


@query("freshness", """SELECT grp, snapshot, horizon, CAST(horizon - snapshot AS BIGINT) AS age_days,
  CASE WHEN horizon < snapshot THEN 'incompatible' WHEN horizon - snapshot > 1 THEN 'stale' ELSE 'current' END AS freshness
  FROM (SELECT grp, max(day) AS snapshot, (SELECT max(day) FROM ok) AS horizon FROM ok GROUP BY grp)""")
def freshness(spark, sf):
    rows = t.eligible(spark, sf)
    per_group = rows.groupBy("grp").agg(F.max("day").alias("snapshot")).withColumn("horizon", rows.agg(F.max("day")).scalar())
    return per_group.select("*", *q.freshness(F.col("snapshot"), F.col("horizon")))


