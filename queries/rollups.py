"""Aggregations, trends, rankings and cross-sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import tables as t
from queries.ctes import cell, norm
from queries.registry import query
from segpanel.functions import expr as E
from segpanel.operators import aggregate as a
from segpanel.operators import sketches as sk
from segpanel.operators import trends as tr
from segpanel.operators.association import association_matrix, cramers_v
from segpanel.operators.ranks import exact_quantiles, rank_within, top_ranked, top_within, with_row_id
from segpanel.session import materialize


@query("weekly_counts", "SELECT week, grp, area, cat, cls, n FROM weekly4")
def weekly_counts(spark, sf):
    return t.weekly(spark, sf)


@query("monthly_counts", "SELECT month, grp, area, cat, cls, n FROM monthly4")
def monthly_counts(spark, sf):
    return t.monthly(spark, sf)


@query("reaggregate", "SELECT week, grp, cat, CAST(sum(n) AS DOUBLE) AS n FROM weekly4 GROUP BY week, grp, cat")
def reaggregate(spark, sf):
    return a.reaggregate(t.weekly(spark, sf), "week", ["grp", "cat"], "n")


@query("filtered_aggs", """SELECT event_type, count(*) FILTER (WHERE value > 50) AS high_rows,
  min(ts) FILTER (WHERE value > 50) AS first_high, CAST(coalesce(sum(user_id) FILTER (WHERE value <= 10), 0) AS BIGINT) AS low_user_sum
  FROM events GROUP BY event_type""")
def filtered_aggs(spark, sf):
    high = F.col("value") > 50
    return t.stream_events(spark, sf).groupBy("event_type").agg(
        a.count_if(high).alias("high_rows"), F.min(F.when(high, F.col("ts"))).alias("first_high"),
        a.sum_or_zero(F.col("value") <= 10, "user_id").alias("low_user_sum"))


@query("segment_count", "SELECT count(DISTINCT (grp, area, cat, cls)) AS segments FROM ok")
def segment_count(spark, sf):
    return a.segment_count(t.eligible(spark, sf), t.KEYS)


@query("approx_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, true AS within_error FROM events GROUP BY event_type")
def approx_distinct(spark, sf):
    """The sketch's count may be off by five standard errors, in practice never more."""
    counts = sk.distinct_both(t.stream_events(spark, sf), "event_type", "user_id", 0.02)
    return counts.select("event_type", F.col("exact").alias("users"), (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("within_error"))


@query("lag_quantiles", """SELECT p, round(v, 6) AS value FROM (
  SELECT unnest([0.5, 0.9, 0.99]::DOUBLE[]) AS p, unnest(quantile_cont(value, [0.5, 0.9, 0.99])) AS v FROM events)""")
def lag_quantiles(spark, sf):
    return exact_quantiles(t.stream_events(spark, sf), "value", [0.5, 0.9, 0.99]).select("p", E.dround("value", 6).alias("value"))


@query("quantiles_by_type", """SELECT event_type, p, round(v, 6) AS value FROM (SELECT event_type, unnest([0.1, 0.5, 0.9, 0.99]::DOUBLE[]) AS p,
  unnest(quantile_cont(value, [0.1, 0.5, 0.9, 0.99])) AS v FROM events GROUP BY event_type)""")
def quantiles_by_type(spark, sf):
    """Exact quantiles of every event type; the small limit makes the brackets be cut at every size."""
    rows = materialize(t.stream_events(spark, sf).select("event_type", "value"))
    return sk.quantiles_within(rows, ["event_type"], "value", [0.1, 0.5, 0.9, 0.99], limit=200).withColumn("value", E.dround("value", 6))


@query("distinct_rollup", """SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n, count(DISTINCT user_id) AS users, true AS within_error
  FROM events GROUP BY ALL""")
def distinct_rollup(spark, sf):
    """Users of a month from the sketches of its days, next to the exact number."""
    rows = t.stream_events(spark, sf).withColumn("day", F.col("ts").cast("date"))
    daily = materialize(sk.counts_with_distinct(rows, F.col("day"), "day", ["event_type"], "user_id"))
    about = sk.roll_up_distinct(daily, ["event_type", E.month_of("day").alias("month")])
    exact = rows.groupBy("event_type", E.month_of("day").alias("month")).agg(F.countDistinct("user_id").alias("users"))
    return about.join(exact, ["event_type", "month"]).select(
        "event_type", "month", "n", "users", (F.abs(F.col("about") - F.col("users")) <= 0.035 * F.col("users")).alias("within_error"))


@query("top_values_counted", """SELECT value, rows FROM (SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS rows FROM events GROUP BY user_id) ORDER BY rows DESC, value LIMIT 20
""")
def top_values_counted(spark, sf):
    return sk.top_values_counted(t.stream_events(spark, sf), "user_id", 20)


@query("top_values", """SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS rows, round(count(*) * 100.0 / (SELECT count(*) FROM events), 4) AS pct
  FROM events GROUP BY user_id ORDER BY rows DESC, value LIMIT 20""")
def top_values(spark, sf):
    return a.top_values(t.stream_events(spark, sf), "user_id", 20)


_TEXTS = ("start_date_text", "start_time_text", "end_date_text", "grp_text", "area_text", "cat_text", "cls_text", "x_text")
_PROFILE = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count(v) AS missing, round((count(*) - count(v)) * 100.0 / count(*), 4) AS missing_pct,
  round(100.0 - round((count(*) - count(v)) * 100.0 / count(*), 4), 4) AS present_pct, count(DISTINCT v) AS distinct_values,
  min(v) AS low, max(v) AS high FROM (SELECT {norm(c)} AS v FROM raw)""" for c in _TEXTS)


@query("column_profile", _PROFILE)
def column_profile(spark, sf):
    return a.column_profile(t.raw(spark, sf), _TEXTS, exact=True, normalize=E.normalize_text)


@query("column_profile_approx", f"SELECT column_name, rows, missing, low, high, true AS within_error FROM ({_PROFILE})")
def column_profile_approx(spark, sf):
    raw = t.raw(spark, sf)
    about = a.column_profile(raw, _TEXTS, normalize=E.normalize_text)
    exact = a.column_profile(raw, _TEXTS, exact=True, normalize=E.normalize_text).select("column_name", F.col("distinct_values").alias("n"))
    return about.join(exact, "column_name").select(
        "column_name", "rows", "missing", "low", "high", (F.abs(F.col("distinct_values") - F.col("n")) <= 0.25 * F.col("n")).alias("within_error"))


_GROUPS = {"start_date_text": "time", "start_time_text": "time", "end_date_text": "time", "grp_text": "place", "area_text": "place",
           "x_text": "place", "cat_text": "class", "cls_text": "class"}


@query("column_group_profile", f"""SELECT column_group, count(*) AS columns, round(avg(missing_pct), 4) AS avg_missing_pct, max(missing_pct) AS max_missing_pct,
  first(column_name ORDER BY missing_pct DESC, column_name) AS worst_column
  FROM (SELECT *, CASE WHEN column_name IN ('cat_text', 'cls_text') THEN 'class' WHEN column_name IN ('grp_text', 'area_text', 'x_text') THEN 'place' ELSE 'time' END AS column_group
    FROM ({_PROFILE})) GROUP BY column_group""")
def column_group_profile(spark, sf):
    return a.column_group_profile(a.column_profile(t.raw(spark, sf), _TEXTS, normalize=E.normalize_text), _GROUPS)


@query("weighted_bins", "SELECT * FROM bins")
def weighted_bins(spark, sf):
    return t.bins(spark, sf)


@query("weighted_centroid", """SELECT grp, round(sum(x * weight) / sum(weight), 6) AS map_x, round(sum(y * weight) / sum(weight), 6) AS map_y,
  CAST(sum(weight) AS BIGINT) AS centroid_weight FROM hbins WHERE ok_xy AND day <= send GROUP BY grp""")
def weighted_centroid(spark, sf):
    from segpanel.operators.hotspot import scoring_day
    bins = t.bins(spark, sf)
    rows = bins.filter(E.valid_xy("x", "y", t.BOX)).filter(F.col("day") <= scoring_day(bins, t.HOTSPOTS))
    return a.weighted_centroid(rows, ["grp"])


@query("centroid", "SELECT cat, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y, count(*) AS points FROM points GROUP BY cat")
def centroid(spark, sf):
    return a.centroid(t.valid_points(spark, sf), ["cat"])


@query("dominant_value", """SELECT area, cat AS top_cat, k AS top_count FROM (SELECT area, cat, count(*) AS k,
  row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, cat) AS rn FROM ok WHERE area IS NOT NULL AND cat IS NOT NULL GROUP BY area, cat) WHERE rn = 1""")
def dominant_value(spark, sf):
    rows = t.eligible(spark, sf).filter("area IS NOT NULL AND cat IS NOT NULL")
    return a.dominant_value(rows, ["area"], "cat", count_name="top_count")


@query("segment_profile", "SELECT * FROM seg4")
def segment_profile(spark, sf):
    return a.segment_profile(t.weekly(spark, sf), t.KEYS)


@query("having_min_volume", "SELECT grp, cat, count(*) AS rows FROM ok GROUP BY grp, cat HAVING count(*) >= 20")
def having_min_volume(spark, sf):
    return tr.crosstab(t.eligible(spark, sf), ["grp", "cat"], 20)


@query("input_summary", """SELECT count(*) AS rows, CAST(sum(n) AS BIGINT) AS events, min(week) AS first_week, max(week) AS last_week,
  count(DISTINCT week) AS weeks, count(DISTINCT (grp, area, cat, cls)) AS segments FROM weekly4""")
def input_summary(spark, sf):
    return t.weekly(spark, sf).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("events"), F.min("week").alias("first_week"),
        F.max("week").alias("last_week"), F.countDistinct("week").alias("weeks"),
        F.countDistinct(F.struct(*t.KEYS)).alias("segments"))


@query("record_counts", """SELECT 'raw' AS stage, count(*) AS rows FROM raw UNION ALL SELECT 'eligible', count(*) FROM clean WHERE is_eligible
UNION ALL SELECT 'weekly', count(*) FROM weekly4 UNION ALL SELECT 'monthly', count(*) FROM monthly4 UNION ALL SELECT 'segments', count(*) FROM seg4""")
def record_counts(spark, sf):
    weekly = t.weekly(spark, sf)
    stages = {"raw": t.raw(spark, sf), "eligible": t.clean(spark, sf).filter("is_eligible"), "weekly": weekly,
              "monthly": t.monthly(spark, sf), "segments": weekly.select(*t.KEYS).distinct()}
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("stage"), "rows") for n, df in stages.items()]
    return reduce(DataFrame.unionByName, parts)


@query("analysis_window", """SELECT min(day) AS first_day, max(day) AS last_day, min(day) FILTER (WHERE is_eligible) AS first_eligible,
  max(day) FILTER (WHERE is_eligible) AS last_eligible, max(day) FILTER (WHERE cat IS NULL) AS last_unknown_cat FROM ev""")
def analysis_window(spark, sf):
    return t.events(spark, sf).agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.min(F.when(F.col("is_eligible"), F.col("day"))).alias("first_eligible"),
        F.max(F.when(F.col("is_eligible"), F.col("day"))).alias("last_eligible"),
        F.max(F.when(F.col("cat").isNull(), F.col("day"))).alias("last_unknown_cat"))


@query("unknown_volume", "SELECT " + ", ".join(
    f"CAST(coalesce(sum(n) FILTER (WHERE {k} = 'UNKNOWN'), 0) AS BIGINT) AS unknown_{k}" for k in t.KEYS) + " FROM weekly4")
def unknown_volume(spark, sf):
    return a.unknown_volume(t.weekly(spark, sf), t.KEYS)


_YEARS = list(range(1995, 2002))


@query("pivot_month_year", "SELECT extract(month FROM month) AS month_no, " + ", ".join(
    f"CAST(coalesce(sum(n) FILTER (WHERE extract(year FROM month) = {y}), 0) AS BIGINT) AS y{y}" for y in _YEARS) + ", CAST(coalesce(sum(n) FILTER (WHERE extract(year FROM month) NOT BETWEEN 1995 AND 2001), 0) AS BIGINT) AS other FROM monthly4 GROUP BY 1")
def pivot_month_year(spark, sf):
    rows = t.monthly(spark, sf).select(F.month("month").cast("bigint").alias("month_no"), F.year("month").alias("year"), "n")
    return a.pivot_counts(rows, ["month_no"], "year", _YEARS, F.sum("n"), [f"y{y}" for y in _YEARS])


@query("pivot_hour_weekday", "SELECT extract(hour FROM ts) AS hour, " + ", ".join(
    f"count(*) FILTER (WHERE extract(isodow FROM ts) = {d}) AS d{d}" for d in range(1, 8)) + ", 0::BIGINT AS other FROM events GROUP BY 1")
def pivot_hour_weekday(spark, sf):
    rows = t.stream_events(spark, sf).select(F.hour("ts").cast("bigint").alias("hour"), (F.weekday("ts") + 1).alias("d"))
    return a.pivot_counts(rows, ["hour"], "d", list(range(1, 8)), F.count(F.lit(1)), [f"d{d}" for d in range(1, 8)])


@query("pivot_cat_cls", "SELECT cat, " + ", ".join(f"count(*) FILTER (WHERE cls = '{c}') AS {c}" for c in t.CLASSES) + f", count(*) FILTER (WHERE cls IS NULL OR cls NOT IN {t.CLASSES}) AS other FROM ok GROUP BY cat")
def pivot_cat_cls(spark, sf):
    return a.pivot_counts(t.eligible(spark, sf), ["cat"], "cls", list(t.CLASSES), F.count(F.lit(1)))


_ASSOC = ["lang", "source", "quality", "toxic"]


def _cramer_sql() -> str:
    parts = []
    for i, x in enumerate(_ASSOC):
        for y in _ASSOC[i + 1:]:
            parts.append(f"SELECT '{x}' AS left_column, '{y}' AS right_column, coalesce(CAST({x} AS VARCHAR), '__MISSING__') AS a, coalesce(CAST({y} AS VARCHAR), '__MISSING__') AS b FROM docs")
    return "(" + " UNION ALL ".join(parts) + ")"


_CRAMER = f"""(SELECT left_column, right_column, CASE WHEN least(r, c) >= 2 AND least(r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)) > 1
  THEN round(sqrt(greatest(0, chi2 / n - (r - 1) * (c - 1) / (n - 1)) / (least(r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)) - 1)), 6) END AS cramers_v FROM (
 SELECT left_column, right_column, max(r)::DOUBLE AS r, max(c)::DOUBLE AS c, max(n)::DOUBLE AS n, sum((coalesce(o, 0) - rs * cs / n) ** 2 / (rs * cs / n)) AS chi2 FROM (
  SELECT ra.left_column, ra.right_column, o, rs::DOUBLE AS rs, cs::DOUBLE AS cs, sum(rs) OVER (PARTITION BY ra.left_column, ra.right_column, cb.b) AS n,
    count(*) OVER (PARTITION BY ra.left_column, ra.right_column, cb.b) AS r, count(*) OVER (PARTITION BY ra.left_column, ra.right_column, ra.a) AS c
  FROM (SELECT left_column, right_column, a, count(*) AS rs FROM {_cramer_sql()} GROUP BY ALL) ra
  JOIN (SELECT left_column, right_column, b, count(*) AS cs FROM {_cramer_sql()} GROUP BY ALL) cb ON ra.left_column = cb.left_column AND ra.right_column = cb.right_column
  LEFT JOIN (SELECT left_column, right_column, a, b, count(*) AS o FROM {_cramer_sql()} GROUP BY ALL) x
    ON x.left_column = ra.left_column AND x.right_column = ra.right_column AND x.a = ra.a AND x.b = cb.b) GROUP BY left_column, right_column))"""


@query("cramers_v", f"SELECT * FROM {_CRAMER}")
def cramer(spark, sf):
    return cramers_v(t.labelled_documents(spark, sf), _ASSOC)


@query("association_matrix", "SELECT c AS row_column, " + ", ".join(
    f"CASE WHEN c = '{x}' THEN 1.0 ELSE max(cramers_v) FILTER (WHERE '{x}' IN (left_column, right_column) AND c IN (left_column, right_column)) END::DOUBLE AS v_{x}"
    for x in _ASSOC) + f" FROM {_CRAMER}, (SELECT unnest(['lang', 'source', 'quality', 'toxic']) AS c) GROUP BY c")
def matrix(spark, sf):
    return association_matrix(cramers_v(t.labelled_documents(spark, sf), _ASSOC), _ASSOC)


# ---- trends -------------------------------------------------------------------------------------

def _trend(period: str, name: str, source: str, extra: str = "") -> str:
    return f"""SELECT {name}, total, prior_total, total - prior_total AS change,
  round(CASE WHEN prior_total > 0 THEN (total - prior_total) * 100.0 / prior_total END, 2) AS change_pct{extra} FROM (
  SELECT {name}, total, lag(total) OVER (ORDER BY {name}) AS prior_total FROM (
    SELECT {period} AS {name}, CAST(sum(n) AS BIGINT) AS total FROM {source} GROUP BY 1))"""


@query("yearly_trend", _trend("extract(year FROM month)", "year", "monthly4"))
def yearly_trend(spark, sf):
    return tr.yearly_trend(t.monthly(spark, sf))


@query("monthly_trend", _trend("month", "month", "monthly4", ", strftime(month, '%Y-%m') AS label"))
def monthly_trend(spark, sf):
    return tr.monthly_trend(t.monthly(spark, sf))


@query("weekly_trend", _trend("week", "week", "weekly4"))
def weekly_trend(spark, sf):
    return tr.weekly_trend(t.weekly(spark, sf))


def _ranking(keys: str, where: str = "true", tail: str = "") -> str:
    return f"""SELECT *, round(total * 100.0 / (SELECT sum(n) FROM monthly4 WHERE {where}), 2) AS pct_total, round(total * 1.0 / active_months, 2) AS avg_per_month,
  row_number() OVER (ORDER BY total DESC, {keys}) AS rank FROM (
  SELECT {keys}, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT month) AS active_months FROM monthly4 WHERE {where} GROUP BY {keys}) {tail}"""


@query("group_ranking", _ranking("grp"))
def group_ranking(spark, sf):
    return tr.group_ranking(t.monthly(spark, sf), ["grp"])


@query("area_ranking", _ranking("grp, area", "area <> 'UNKNOWN'", "QUALIFY rank <= 15"))
def area_ranking(spark, sf):
    return tr.group_ranking(t.monthly(spark, sf), ["grp", "area"], known_only="area", top_n=15)


@query("category_distribution", """SELECT rank, cat, total, round(total * 100.0 / (SELECT sum(n) FROM monthly4), 2) AS pct_total FROM (
  SELECT row_number() OVER (ORDER BY sum(n) DESC, cat) AS rank, cat, CAST(sum(n) AS BIGINT) AS total FROM monthly4 GROUP BY cat) WHERE rank <= 3
UNION ALL SELECT NULL, 'OTHER', CAST(sum(total) AS BIGINT), round(sum(total) * 100.0 / (SELECT sum(n) FROM monthly4), 2) FROM (
  SELECT row_number() OVER (ORDER BY sum(n) DESC, cat) AS rank, sum(n) AS total FROM monthly4 GROUP BY cat) WHERE rank > 3""")
def category_distribution(spark, sf):
    return tr.category_distribution(t.monthly(spark, sf), "cat", 3)


_CLASS = """SELECT row_number() OVER (ORDER BY sum(n) DESC, cls) AS rank, cls, CAST(sum(n) AS BIGINT) AS total,
  round(sum(n) * 100.0 / (SELECT sum(n) FROM monthly4), 2) AS pct_total FROM monthly4 GROUP BY cls"""


@query("class_distribution", _CLASS)
def class_distribution(spark, sf):
    return tr.class_distribution(t.monthly(spark, sf), "cls")


@query("share_of_total", "SELECT event_type, count(*) AS rows, round(count(*) * 100.0 / (SELECT count(*) FROM events), 2) AS pct_total FROM events GROUP BY event_type")
def share_of_total(spark, sf):
    counts = t.stream_events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))
    return a.share_of_total(counts, "rows")


@query("hour_pattern", """SELECT extract(hour FROM ts) AS hour, lpad(CAST(extract(hour FROM ts) AS VARCHAR), 2, '0') || ':00' AS label, count(*) AS rows,
  round(count(*) * 100.0 / (SELECT count(*) FROM events), 2) AS pct_total FROM events GROUP BY ALL""")
def hour_pattern(spark, sf):
    return tr.hour_pattern(t.stream_events(spark, sf), "ts")


@query("weekday_pattern", """SELECT extract(isodow FROM ts) AS weekday, dayname(ts) AS name, count(*) AS rows,
  round(count(*) * 100.0 / (SELECT count(*) FROM events), 2) AS pct_total FROM events GROUP BY ALL""")
def weekday_pattern(spark, sf):
    return tr.weekday_pattern(t.stream_events(spark, sf), "ts")


_BOUNDS = """(SELECT CAST(max(month) - INTERVAL 23 MONTH AS DATE) AS previous_start, CAST(max(month) - INTERVAL 12 MONTH AS DATE) AS previous_end,
  CAST(max(month) - INTERVAL 11 MONTH AS DATE) AS current_start, max(month) AS current_end FROM monthly4)"""


@query("growth_bounds", f"SELECT * FROM {_BOUNDS}")
def growth_bounds(spark, sf):
    return tr.growth_bounds(t.monthly(spark, sf), 12)


def _growth(keys: list[str], way: str) -> str:
    k = ", ".join(keys)
    known = " AND ".join(f"{c} <> 'UNKNOWN'" for c in keys)
    return f"""SELECT *, row_number() OVER (ORDER BY change_pct {way}, change {way}, {k}) AS rank FROM (
  SELECT {k}, previous, current, current - previous AS change, round((current - previous) * 100.0 / previous, 2) AS change_pct FROM (
    SELECT {k}, CAST(coalesce(sum(n) FILTER (WHERE month BETWEEN current_start AND current_end), 0) AS BIGINT) AS current,
      CAST(coalesce(sum(n) FILTER (WHERE month BETWEEN previous_start AND previous_end), 0) AS BIGINT) AS previous
    FROM monthly4, {_BOUNDS} WHERE {known} GROUP BY {k}) WHERE previous >= 3) QUALIFY rank <= 10"""


def _register_growth() -> None:
    for keys, tag in ((["grp", "cat"], "2"), (["grp", "area", "cat"], "3")):
        for direction, way in (("up", "DESC"), ("down", "ASC")):
            def run(spark, sf, keys=keys, direction=direction):
                return tr.growth(t.monthly(spark, sf), keys, direction, 10, 3)
            query(f"growth_{direction}_{tag}", _growth(keys, way))(run)


_register_growth()


@query("area_map_summary", """SELECT c.*, g.grp, k.cat AS top_cat, k.k AS top_cat_count, round(total * 100.0 / sum(total) OVER (), 2) AS pct_valid,
  row_number() OVER (ORDER BY total DESC, g.grp, c.area) AS rank FROM (
  SELECT area, count(*) AS total, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y FROM points WHERE area IS NOT NULL AND grp IS NOT NULL GROUP BY area) c
LEFT JOIN (SELECT area, grp FROM points WHERE area IS NOT NULL AND grp IS NOT NULL GROUP BY area, grp
  QUALIFY row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, grp) = 1) g ON c.area = g.area
LEFT JOIN (SELECT area, coalesce(cat, 'UNKNOWN') AS cat, count(*) AS k FROM points WHERE area IS NOT NULL AND grp IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, coalesce(cat, 'UNKNOWN')) = 1) k ON c.area = k.area""")
def area_map_summary(spark, sf):
    return tr.area_map_summary(t.valid_points(spark, sf))


_CELLS = f"(SELECT {cell('x')} AS cell_x, {cell('y')} AS cell_y, coalesce(grp, 'UNKNOWN') AS grp, coalesce(cat, 'UNKNOWN') AS cat FROM points)"


@query("heatmap_cells", f"""SELECT c.cell_x, c.cell_y, c.total, c.rank, round(c.total * 100.0 / c.all_points, 2) AS pct_total, g.grp AS dominant_grp, k.cat AS top_cat, k.k AS top_cat_count
FROM (SELECT cell_x, cell_y, count(*) AS total, sum(count(*)) OVER () AS all_points, row_number() OVER (ORDER BY count(*) DESC, cell_y, cell_x) AS rank
      FROM {_CELLS} GROUP BY cell_x, cell_y) c
LEFT JOIN (SELECT cell_x, cell_y, grp FROM {_CELLS} GROUP BY cell_x, cell_y, grp QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY count(*) DESC, grp) = 1) g
  ON c.cell_x = g.cell_x AND c.cell_y = g.cell_y
LEFT JOIN (SELECT cell_x, cell_y, cat, count(*) AS k FROM {_CELLS} GROUP BY cell_x, cell_y, cat QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY count(*) DESC, cat) = 1) k
  ON c.cell_x = k.cell_x AND c.cell_y = k.cell_y WHERE c.rank <= 20""")
def heatmap_cells(spark, sf):
    return tr.heatmap_cells(t.valid_points(spark, sf), 0.1, 20)


@query("coordinate_coverage", """SELECT count(*) FILTER (WHERE is_eligible) AS eligible_rows, (SELECT count(*) FROM points) AS valid_rows,
  round((SELECT count(*) FROM points) * 100.0 / count(*) FILTER (WHERE is_eligible), 4) AS valid_pct FROM ev""")
def coordinate_coverage(spark, sf):
    return tr.coordinate_coverage(t.events(spark, sf), F.col("is_eligible"), E.valid_xy("x", "y", t.BOX, *t.FLAG_COLUMNS))


@query("rolling_mean_min_periods", """SELECT month, grp, total, round(CASE WHEN count(*) OVER w >= 3 THEN avg(total) OVER w END, 6) AS rolling_mean
  FROM (SELECT month, grp, CAST(sum(n) AS BIGINT) AS total FROM monthly4 GROUP BY month, grp)
  WINDOW w AS (PARTITION BY grp ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling_mean(spark, sf):
    rows = t.monthly(spark, sf).groupBy("month", "grp").agg(F.sum("n").alias("total"))
    out = tr.rolling_mean(rows, ["grp"], "month", 12, 3, "total")
    return out.withColumn("rolling_mean", E.dround("rolling_mean", 6))


@query("recent_vs_prior", """SELECT grp, cat, recent, prior, recent - prior AS change, round((recent - prior) * 100.0 / nullif(prior, 0), 4) AS change_pct,
  abs(recent - prior) AS magnitude, CASE WHEN recent > prior THEN 'increase' WHEN recent < prior THEN 'decrease' ELSE 'no change' END AS direction FROM (
  SELECT grp, cat, count(*) FILTER (WHERE day > m - 90) AS recent, count(*) FILTER (WHERE day <= m - 90) AS prior
  FROM ok, (SELECT max(day) AS m FROM ok) WHERE day > m - 180 AND grp IS NOT NULL AND cat IS NOT NULL GROUP BY grp, cat)
  WHERE recent + prior >= 5 ORDER BY change DESC, grp, cat LIMIT 100""")
def recent_vs_prior(spark, sf):
    return tr.recent_vs_prior(t.eligible(spark, sf), ["grp", "cat"], "day", 90, 5, 100)


@query("monthly_zscore", """SELECT month, grp, cat, total, round(mu, 4) AS trailing_mean, round(sd, 4) AS trailing_std, round((total - mu) / sd, 4) AS z_score FROM (
  SELECT *, avg(total) OVER w AS mu, stddev_samp(total) OVER w AS sd, count(*) OVER w AS k
  FROM (SELECT month, grp, cat, CAST(sum(n) AS BIGINT) AS total FROM monthly4 WHERE grp <> 'UNKNOWN' AND cat <> 'UNKNOWN' GROUP BY month, grp, cat)
  WINDOW w AS (PARTITION BY grp, cat ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
  WHERE k >= 6 AND sd > 0 ORDER BY z_score DESC, month, grp, cat LIMIT 100""")
def monthly_zscore(spark, sf):
    rows = t.monthly(spark, sf).filter("grp <> 'UNKNOWN' AND cat <> 'UNKNOWN'")
    return tr.monthly_zscore(rows, ["grp", "cat"], limit=100)


@query("top_within_group", """SELECT grp, area, total, rank FROM (SELECT grp, area, CAST(sum(n) AS BIGINT) AS total,
  row_number() OVER (PARTITION BY grp ORDER BY sum(n) DESC, area) AS rank FROM weekly4 GROUP BY grp, area) WHERE rank <= 3""")
def top_within_group(spark, sf):
    totals = t.weekly(spark, sf).groupBy("grp", "area").agg(F.sum("n").alias("total"))
    return top_within(totals, ["grp"], [F.col("total").desc(), "area"], 3)


_CROSS = {
    "crosstab_cat_cls": (["cat", "cls"], 0), "crosstab_grp_area": (["grp", "area"], 0), "crosstab_grp_cls": (["grp", "cls"], 0),
    "crosstab_grp_cls_cat": (["grp", "cls", "cat"], 10),
}


def _register_cross() -> None:
    for name, (keys, low) in _CROSS.items():
        k = ", ".join(keys)
        def run(spark, sf, keys=keys, low=low):
            return tr.crosstab(t.eligible(spark, sf), keys, low)
        query(name, f"SELECT {k}, count(*) AS rows FROM ok GROUP BY {k} HAVING count(*) >= {low}")(run)


_register_cross()


@query("crosstab_month_cat", "SELECT month, cat, CAST(sum(n) AS BIGINT) AS rows FROM monthly4 GROUP BY month, cat")
def crosstab_month_cat(spark, sf):
    return tr.crosstab(t.monthly(spark, sf), ["month", "cat"], value=F.sum("n"))


@query("crosstab_type_hour", "SELECT event_type, extract(hour FROM ts) AS hour, count(*) AS rows FROM events GROUP BY ALL")
def crosstab_type_hour(spark, sf):
    rows = t.stream_events(spark, sf).select("event_type", F.hour("ts").cast("bigint").alias("hour"))
    return tr.crosstab(rows, ["event_type", "hour"])


@query("crosstab_flag_status", "SELECT flag, status, count(*) AS rows FROM ship GROUP BY ALL")
def crosstab_flag_status(spark, sf):
    return tr.crosstab(t.shipments(spark, sf), ["flag", "status"])


@query("grid_density", """SELECT round(x, 1) AS cell_x, round(y, 1) AS cell_y, count(*) AS rows, count(DISTINCT cat) AS cats, count(DISTINCT grp) AS grps
  FROM points GROUP BY 1, 2 HAVING count(*) >= 10 ORDER BY rows DESC, cell_x, cell_y LIMIT 100""")
def grid_density(spark, sf):
    return tr.grid_density(t.valid_points(spark, sf), 1, limit=100)


def _lag_sql(unit: str, name: str) -> str:
    return f"""SELECT '{name}' AS measure, count(*) AS rows, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.9), 4) AS p90,
  round(quantile_cont(v, 0.99), 4) AS p99, count(*) FILTER (WHERE v < 0) AS negative, count(*) FILTER (WHERE v > 30) AS over_limit
  FROM (SELECT date_diff('{unit}', start_ts, end_ts) AS v FROM ship)"""


@query("duration_lag_summary", _lag_sql("day", "lag_days") + " UNION ALL " + _lag_sql("hour", "lag_hours"))
def duration_lag_summary(spark, sf):
    rows = t.shipments(spark, sf)
    days = F.datediff("end_ts", "start_ts")
    hours = E.boundary_hours(F.col("start_ts"), F.col("end_ts"))
    p = [0.5, 0.9, 0.99]
    return tr.lag_summary(rows, {"lag_days": days, "lag_hours": hours}, p)


@query("lag_buckets", """SELECT lag_bucket, count(*) AS rows, round(count(*) * 100.0 / (SELECT count(*) FROM ship), 4) AS pct FROM (
  SELECT CASE WHEN d < 0 THEN 'negative' WHEN d = 0 THEN 'same day' WHEN d <= 7 THEN '1-7 days' WHEN d <= 30 THEN '8-30 days'
    WHEN d <= 365 THEN '31-365 days' ELSE 'over 365 days' END AS lag_bucket FROM (SELECT date_diff('day', start_ts, end_ts) AS d FROM ship)) GROUP BY 1""")
def lag_buckets(spark, sf):
    return tr.lag_distribution(t.shipments(spark, sf), F.datediff("end_ts", "start_ts"))


@query("rank_overall", "SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events")
def rank_overall(spark, sf):
    return with_row_id(t.stream_events(spark, sf).select("event_id", "value"), [F.col("value").desc(), "event_id"], "rank")


@query("rank_in_partition", "SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def rank_in_partition(spark, sf):
    rows = t.stream_events(spark, sf).select("event_type", "event_id", "value")
    return rank_within(rows, ["event_type"], [F.col("value").desc(), "event_id"])


@query("top_k_ordered", "SELECT event_id, event_type, value, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 50")
def top_k_ordered(spark, sf):
    return top_ranked(t.stream_events(spark, sf).select("event_id", "event_type", "value"), [F.col("value").desc(), "event_id"], 50)


@query("join_semi_top", """SELECT area, cat, count(*) AS rows FROM ok WHERE area IN (
  SELECT area FROM ok WHERE area IS NOT NULL GROUP BY area ORDER BY count(*) DESC, area LIMIT 5) GROUP BY area, cat""")
def join_semi_top(spark, sf):
    rows = t.eligible(spark, sf)
    top = a.top_values(rows.filter("area IS NOT NULL"), "area", 5).select(F.col("value").alias("area"))
    return tr.crosstab(rows.join(top, "area", "left_semi"), ["area", "cat"])


@query("distinct_dimensions", """SELECT DISTINCT dimension, label FROM (
  SELECT 'grp' AS dimension, grp AS label FROM weekly4 UNION ALL SELECT 'area', area FROM weekly4 UNION ALL SELECT 'cat', cat FROM weekly4
  UNION ALL SELECT 'cls', cls FROM weekly4 UNION ALL SELECT 'cls', l_linestatus FROM lineitem UNION ALL SELECT 'cat', event_type FROM events)""")
def distinct_dimensions(spark, sf):
    from segpanel.operators.publish import distinct_dimensions as dims
    lines = t.read(spark, sf, "lineitem").select(F.col("l_linestatus").alias("cls"))
    types = t.stream_events(spark, sf).select(F.col("event_type").alias("cat"))
    return dims([t.weekly(spark, sf), lines, types], t.KEYS)


@query("except_keys", "SELECT DISTINCT grp, area FROM weekly4 EXCEPT SELECT grp, area FROM weekly4 WHERE week >= DATE '2001-07-01'")
def except_keys(spark, sf):
    w = t.weekly(spark, sf)
    return w.select("grp", "area").distinct().exceptAll(w.filter("week >= DATE '2001-07-01'").select("grp", "area").distinct())


@query("intersect_keys", "SELECT user_id AS id FROM events INTERSECT SELECT c_custkey FROM customer")
def intersect_keys(spark, sf):
    users = t.stream_events(spark, sf).select(F.col("user_id").alias("id"))
    return users.intersect(t.read(spark, sf, "customer").select(F.col("c_custkey").alias("id")))
