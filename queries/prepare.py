"""Sources, sinks, normalisation and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import tables as t
from queries.ctes import IN_BOX, NULLS, cell, norm
from queries.registry import query
from segpanel.functions import expr as E
from segpanel.operators.clean import RAW_COLUMNS, prepare, project_allowed, type_rows
from segpanel.operators.ranks import with_row_id
from segpanel.plans import refresh
from segpanel.session import materialize
from segpanel.sources import order, readers, versions, writers

_NULLED = ", ".join(f"CASE WHEN upper(trim({c})) NOT IN {NULLS} THEN {c} END AS {c}" for c in RAW_COLUMNS)


@query("read_csv_null_tokens", f"SELECT {_NULLED} FROM raw")
def read_csv_null_tokens(spark, sf):
    path = t.scratch(spark, "raw-csv")
    t.raw(spark, sf).write.csv(path, header=True, quoteAll=True, nullValue="NULL", emptyValue="",
                               ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_raw_csv(spark, path, RAW_COLUMNS)


@query("malformed_rows", """SELECT count(*) + count(*) FILTER (WHERE event_id % 50 = 0) AS rows, count(*) FILTER (WHERE event_id % 50 = 0) AS malformed FROM events""")
def malformed_rows(spark, sf):
    path = t.scratch(spark, "broken-csv")
    rows = t.stream_events(spark, sf).select("event_id", "event_type", "user_id")
    good = rows.select(F.concat_ws(",", "event_id", "event_type", "user_id").alias("line"))
    cut = rows.filter("event_id % 50 = 0").select(F.concat_ws(",", "event_id", "event_type").alias("line"))
    good.unionByName(cut).write.text(path)
    return readers.malformed_rows(spark, path, ["event_id", "event_type", "user_id"], header=False).select("rows", "malformed")


@query("limit_rows", "SELECT k, day, grp FROM ev ORDER BY k LIMIT 500")
def limit_rows(spark, sf):
    return readers.limit_rows(t.events(spark, sf).select("k", "day", "grp"), 500, "k")


@query("row_id", "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS row_id FROM events")
def row_id(spark, sf):
    return with_row_id(t.stream_events(spark, sf).select("event_id", "ts"), ["ts", "event_id"])


@query("parquet_roundtrip", "SELECT week, grp, area, cat, cls, n FROM weekly4")
def parquet_roundtrip(spark, sf):
    path = t.scratch(spark, "weekly")
    weekly = t.weekly(spark, sf).withColumn("year", F.year("week"))
    writers.write_parquet(weekly, path, ["week", *t.KEYS], partition_by=["year"])
    return spark.read.parquet(path).drop("year")


_K4 = ", ".join(t.KEYS)


@query("ordered_write", f"SELECT week, {_K4}, n, row_number() OVER (ORDER BY week, {_K4}) AS position FROM weekly4")
def ordered_write(spark, sf):
    """Rows of a totally ordered write, with the places at which they stand in its files."""
    path = t.scratch(spark, "ordered")
    writers.write_parquet(t.weekly(spark, sf), path, ["week", *t.KEYS])
    return order.with_positions(spark, path)


@query("order_proof", f"""SELECT 'sorted' AS name, count(*) AS rows, CAST(0 AS BIGINT) AS breaks, true AS sound FROM weekly4
UNION ALL SELECT 'backwards', count(*), count(*) FILTER (WHERE earlier > week), count(*) FILTER (WHERE earlier > week) = 0
  FROM (SELECT week, lag(week) OVER (ORDER BY week DESC, {_K4}) AS earlier FROM weekly4)
UNION ALL SELECT 'twice', 2 * count(*), count(*), count(*) = 0 FROM weekly4""")
def order_proof(spark, sf):
    """Breaks of a sorted table, of one sorted backwards by week, and (equal neighbours counting) of one with every row twice."""
    weekly = materialize(t.weekly(spark, sf))
    paths = {name: t.scratch(spark, name) for name in ("sorted", "backwards", "twice")}
    writers.write_parquet(weekly, paths["sorted"], ["week", *t.KEYS])
    writers.write_parquet(weekly, paths["backwards"], [F.desc("week"), *t.KEYS])
    writers.write_parquet(weekly.unionByName(weekly), paths["twice"], ["week", *t.KEYS])
    return order.in_order([
        ("sorted", order.order_report(spark, paths["sorted"], ["week", *t.KEYS], strict=True)),
        ("backwards", order.order_report(spark, paths["backwards"], ["week"])),
        ("twice", order.order_report(spark, paths["twice"], ["week", *t.KEYS], strict=True))])


@query("table_versions", """SELECT 1 AS version, week, grp, area, cat, cls, n FROM weekly4 WHERE cls = 'F'
UNION ALL SELECT 2, week, grp, area, cat, cls, 2 * n FROM weekly4 WHERE cls = 'F'""")
def table_versions(spark, sf):
    """A table replaced by rows made from itself; both versions can be read."""
    root = t.scratch(spark, "weekly-table")
    versions.replace_table(t.weekly(spark, sf).filter("cls = 'F'"), root, ["week", *t.KEYS])
    versions.replace_table(versions.read_table(spark, root).withColumn("n", 2 * F.col("n")), root, ["week", *t.KEYS])
    return versions.read_table(spark, root, 1).select(F.lit(1).alias("version"), "*").unionByName(versions.read_table(spark, root).select(F.lit(2).alias("version"), "*"))


_LATE = "(k % 10 = 0 AND day BETWEEN DATE '2000-03-01' AND DATE '2000-05-31')"


def _refreshed(spark, sf):
    """Weekly counts of events that come in two deliveries; the second brings late rows of three months."""
    source = t.scratch(spark, "deliveries")
    rows = materialize(t.events(spark, sf).select("k", "day", *t.KEYS))
    rows.filter(f"NOT {_LATE}").repartitionByRange("day").write.parquet(source)
    table = refresh.PeriodTable(t.scratch(spark, "weekly-counts"), source, "day", tuple(t.KEYS), f"day BETWEEN DATE '{t.MIN_DAY}' AND DATE '{t.AS_OF}'")
    refresh.refresh(spark, table)
    rows.filter(_LATE).write.mode("append").parquet(source)
    return table, refresh.refresh(spark, table)


@query("refresh_counts", "SELECT week, grp, area, cat, cls, n FROM weekly4")
def refresh_counts(spark, sf):
    return refresh.read_counts(spark, _refreshed(spark, sf)[0])


@query("refresh_touched", f"SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS week FROM ok WHERE {_LATE}")
def refresh_touched(spark, sf):
    """Weeks that the second delivery made the refresh count anew."""
    return spark.createDataFrame([(week,) for week in _refreshed(spark, sf)[1].periods], "week date")


@query("metrics_json_roundtrip", "SELECT cat, count(*) AS rows, min(day) AS first_day FROM ok GROUP BY cat")
def metrics_json_roundtrip(spark, sf):
    path = t.scratch(spark, "metrics")
    metrics = t.eligible(spark, sf).groupBy("cat").agg(F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"))
    writers.write_metrics(metrics, path)
    return readers.read_metrics(spark, path, "cat string, rows bigint, first_day date")


@query("weekly_calendar", "SELECT week FROM cal4")
def weekly_calendar(spark, sf):
    bounds = t.weekly(spark, sf).agg(F.min("week").alias("a"), F.date_add(F.max("week"), 7).alias("b"))
    return readers.weekly_calendar(bounds, "a", "b")


@query("hash_sample", "SELECT event_id, event_type, value FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 1000")
def hash_sample(spark, sf):
    return readers.fixed_sample(t.stream_events(spark, sf).select("event_id", "event_type", "value"), 1000, 42, "event_id")


@query("normalize_text", f"SELECT event_id, grp_text, cat_text, {norm('grp_text')} AS grp, {norm('cat_text')} AS cat FROM raw")
def normalize_text(spark, sf):
    return t.raw(spark, sf).select("event_id", "grp_text", "cat_text", E.normalize_text("grp_text").alias("grp"),
                                   E.normalize_text("cat_text").alias("cat"))


@query("normalize_documents", rf"""SELECT doc_id, length({norm('text')}) AS kept_chars, md5({norm('text')}) AS digest FROM documents""")
def normalize_documents(spark, sf):
    text = E.normalize_text("text")
    return t.read(spark, sf, "documents").select(
        "doc_id", F.length(text).cast("bigint").alias("kept_chars"), F.md5(text).alias("digest"))


@query("upper_normalize", f"SELECT event_id, upper({norm('grp_text')}) AS grp, upper({norm('cls_text')}) AS cls FROM raw")
def upper_normalize(spark, sf):
    return t.raw(spark, sf).select("event_id", E.upper_normalize("grp_text").alias("grp"),
                                   E.upper_normalize("cls_text").alias("cls"))


@query("parse_date", "SELECT event_id, start_date_text, CAST(try_strptime(start_date_text, '%m/%d/%Y') AS DATE) AS start_day FROM prepared")
def parse_date(spark, sf):
    return prepare(t.raw(spark, sf)).select("event_id", "start_date_text", E.parse_date("start_date_text").alias("start_day"))


@query("parse_datetime", """SELECT event_id, start_time_text,
  try_strptime(start_date_text || ' ' || start_time_text, '%m/%d/%Y %H:%M:%S') AS start_ts FROM prepared""")
def parse_datetime(spark, sf):
    return prepare(t.raw(spark, sf)).select("event_id", "start_time_text",
                                            E.parse_datetime("start_date_text", "start_time_text").alias("start_ts"))


@query("try_cast_numeric", """SELECT event_id, area_text, x_text, CAST(try_cast(area_text AS INTEGER) AS BIGINT) AS area,
  try_cast(x_text AS DOUBLE) AS x, CAST(try_cast(x_text AS INTEGER) AS BIGINT) AS x_int FROM prepared""")
def try_cast_numeric(spark, sf):
    return prepare(t.raw(spark, sf)).select(
        "event_id", "area_text", "x_text", E.try_int("area_text").cast("bigint").alias("area"),
        E.try_double("x_text").alias("x"), E.try_int("x_text").cast("bigint").alias("x_int"))


@query("allow_list", "SELECT event_id, grp_text AS grp_raw, CASE WHEN grp_text IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST') THEN grp_text END AS grp FROM prepared")
def allow_list(spark, sf):
    return prepare(t.raw(spark, sf)).select("event_id", F.col("grp_text").alias("grp_raw"),
                                            E.allow_list("grp_text", t.GROUPS).alias("grp"))


@query("typed_events", "SELECT event_id, start_day, end_day, report_day, start_ts, end_ts, start_time, grp, CAST(area AS BIGINT) AS area, cat, cls, cls_raw, x, y FROM typed")
def typed_events(spark, sf):
    return type_rows(prepare(t.raw(spark, sf)), t.QUALITY).withColumn("area", F.col("area").cast("bigint"))


@query("fill_unknown", "SELECT k, coalesce(grp, 'UNKNOWN') AS grp, coalesce(area, 'UNKNOWN') AS area, coalesce(cat, 'UNKNOWN') AS cat FROM ev")
def fill_unknown(spark, sf):
    return t.events(spark, sf).select("k", *[E.fill_unknown(c).alias(c) for c in ("grp", "area", "cat")])


@query("eligible_events", "SELECT k, day, is_eligible FROM ev")
def eligible_events(spark, sf):
    return t.events(spark, sf).select("k", "day", "is_eligible")


@query("project_allowed", "SELECT event_id, start_day, grp, cls, is_eligible FROM clean")
def project(spark, sf):
    return project_allowed(t.clean(spark, sf), ["event_id", "start_day", "grp", "cls", "is_eligible"])


@query("valid_time", """SELECT event_id, start_time_text, CASE WHEN start_time_text IS NULL THEN NULL
  ELSE regexp_full_match(start_time_text, '([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') END AS is_valid FROM prepared""")
def valid_time(spark, sf):
    return prepare(t.raw(spark, sf)).select("event_id", "start_time_text", E.valid_time("start_time_text").alias("is_valid"))


@query("valid_xy", f"SELECT k, x, y, coalesce({IN_BOX} AND x <> 0 AND y <> 0, false) AS is_valid FROM ev")
def valid_xy(spark, sf):
    return t.events(spark, sf).select("k", "x", "y", E.valid_xy("x", "y", t.BOX, *t.FLAG_COLUMNS).alias("is_valid"))


@query("grid_snap", f"SELECT k, {cell('x')} AS cell_x, {cell('y')} AS cell_y, {cell('x', 0.01)} AS fine_x, {cell('y', 0.01)} AS fine_y FROM points")
def grid_snap(spark, sf):
    return t.valid_points(spark, sf).select(
        "k", E.grid_snap("x", 0.1).alias("cell_x"), E.grid_snap("y", 0.1).alias("cell_y"),
        E.grid_snap("x", 0.01).alias("fine_x"), E.grid_snap("y", 0.01).alias("fine_y"))


@query("grid_round", "SELECT k, round(x, 2) AS cell_x, round(y, 1) AS cell_y FROM points")
def grid_round(spark, sf):
    return t.valid_points(spark, sf).select("k", E.grid_round("x", 2).alias("cell_x"), E.grid_round("y", 1).alias("cell_y"))


_KIND = f"CASE WHEN x IS NULL OR y IS NULL THEN 'missing' WHEN x = 0 OR y = 0 THEN 'zero' WHEN NOT ({IN_BOX}) THEN 'outside' ELSE 'valid' END"
_DATES = """CASE WHEN start_day IS NULL THEN 'start missing' WHEN start_day < DATE '1995-02-01' THEN 'start too old'
  WHEN start_day > DATE '2001-07-31' THEN 'start in future' WHEN end_day < start_day THEN 'end before start'
  WHEN report_day < start_day THEN 'report before start' ELSE 'valid' END"""


@query("classify_xy", f"SELECT k, {_KIND} AS kind FROM ev")
def classify_xy(spark, sf):
    return t.events(spark, sf).select("k", E.classify_xy("x", "y", t.BOX).alias("kind"))


def date_issue():
    return E.classify_dates(F.col("start_day"), F.col("end_day"), F.col("report_day"), t.MIN_DAY, t.AS_OF)


@query("classify_dates", f"SELECT event_id, {_DATES} AS kind FROM typed")
def classify_dates(spark, sf):
    return t.clean(spark, sf).select("event_id", date_issue().alias("kind"))


@query("location_label", """SELECT grain, grp, area, cell_x, cell_y, cat, cls, CASE WHEN grain = 'grid'
  THEN printf('GRID %.4f, %.4f · %s', map_y, map_x, grp) ELSE 'AREA ' || area || ' · ' || grp END AS label FROM hboth""")
def location_label(spark, sf):
    from segpanel.operators.hotspot import union_grains, window_cube
    rows = union_grains(window_cube(t.bins(spark, sf), t.HOTSPOTS))
    label = E.location_label(F.col("grain"), F.col("area"), F.col("grp"), F.col("map_x"), F.col("map_y"))
    return rows.select("grain", "grp", "area", "cell_x", "cell_y", "cat", "cls", label.alias("label"))


@query("location_key", "SELECT DISTINCT area, CASE WHEN regexp_full_match(area, '[1-9][0-9]{0,2}') THEN 'area:' || area END AS location_key FROM weekly4")
def location_key(spark, sf):
    return t.weekly(spark, sf).select("area").distinct().withColumn("location_key", E.location_key("area"))


@query("is_unknown", """SELECT event_id, grp_text, grp_text IS NULL OR upper(trim(grp_text)) IN ('', 'UNKNOWN', 'NULL', '(NULL)') AS unknown_grp,
  cat_text IS NULL OR upper(trim(cat_text)) IN ('', 'UNKNOWN', 'NULL', '(NULL)') AS unknown_cat FROM raw""")
def is_unknown(spark, sf):
    return t.raw(spark, sf).select("event_id", "grp_text", E.is_unknown("grp_text").alias("unknown_grp"),
                                   E.is_unknown("cat_text").alias("unknown_cat"))


@query("canonical_number", """SELECT event_id, CASE WHEN isfinite(v) THEN round(v, 2) + 0 END AS number FROM (
  SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 50 = 1 THEN 'Infinity'::DOUBLE
    WHEN event_id % 50 = 2 THEN NULL ELSE value * 1.001e0 END AS v FROM events)""")
def canonical_number(spark, sf):
    v = (F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).when(F.col("event_id") % 50 == 1, F.lit(float("inf")))
         .when(F.col("event_id") % 50 == 2, F.lit(None)).otherwise(F.col("value") * 1.001))
    return t.stream_events(spark, sf).select("event_id", E.canonical_number(v, 2).alias("number"))


@query("label_match", "SELECT event_id, grp_text FROM raw WHERE lower(trim(grp_text)) = 'europe'")
def label_match(spark, sf):
    return t.raw(spark, sf).filter(E.label_match("grp_text", " Europe ")).select("event_id", "grp_text")


@query("nulls_last_order", """SELECT k, grp, area, row_number() OVER (ORDER BY area ASC NULLS LAST, k) AS asc_rank,
  row_number() OVER (ORDER BY area DESC NULLS LAST, k) AS desc_rank FROM ev""")
def nulls_last_order(spark, sf):
    rows = with_row_id(t.events(spark, sf).select("k", "grp", "area"), [F.col("area").asc_nulls_last(), "k"], "asc_rank")
    return with_row_id(rows, [F.col("area").desc_nulls_last(), "k"], "desc_rank")


# ---- geometry: rectangles around the events of every area ------------------------------------

def area_features(spark, sf):
    """One feature per area, written and read as newline-delimited feature collections."""
    box = t.valid_points(spark, sf).filter("area IS NOT NULL").groupBy("area").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    ring = F.array(*[F.array(F.col(a), F.col(b)) for a, b in corners])
    feature = F.struct(
        F.struct(F.col("area"), E.location_key("area").alias("location_key")).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates")).alias("geometry"),
    )
    path = t.scratch(spark, "features")
    box.select(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")).write.json(path)
    return readers.read_geojson(spark, path, ["area", "location_key"], multi_line=False)


_BOXES = "(SELECT area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points WHERE area IS NOT NULL GROUP BY area)"


@query("read_geojson", f"""SELECT area, CASE WHEN area <> '0' THEN 'area:' || area END AS location_key, 'MultiPolygon' AS geometry_type
  FROM {_BOXES}""")
def read_geojson(spark, sf):
    return area_features(spark, sf).drop("coordinates")


@query("explode_rings", f"""SELECT area, CAST(0 AS BIGINT) AS polygon_no, CAST(0 AS BIGINT) AS ring_no, CAST(i AS BIGINT) AS position_no,
  CASE WHEN i IN (1, 2) THEN x1 ELSE x0 END AS x, CASE WHEN i IN (2, 3) THEN y1 ELSE y0 END AS y FROM {_BOXES}, range(5) r(i)""")
def explode_rings(spark, sf):
    from segpanel.operators.geometry import explode_positions, explode_rings as rings
    out = explode_positions(rings(area_features(spark, sf), "area"), "area")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("polygon_no", "ring_no", "position_no")})


@query("ring_checks", f"""SELECT area, CAST(5 AS BIGINT) AS positions, true AS enough_positions, true AS closed, true AS enough_vertices,
  true AS finite, true AS in_bounds, true AS has_area, true AS valid, round((x1 - x0) * (y1 - y0), 6) AS ring_area FROM {_BOXES}""")
def ring_checks(spark, sf):
    from segpanel.operators.geometry import explode_rings as rings, ring_checks as checks
    out = checks(rings(area_features(spark, sf), "area"), "area", t.BOX)
    return out.withColumn("ring_area", E.dround("area_size", 6)).drop("area_size", "polygon_no", "ring_no")


@query("ring_checks_damaged", f"""SELECT area, polygon_no, ring_no, CAST(CASE WHEN k = 1 THEN 4 ELSE 5 END AS BIGINT) AS positions, k <> 1 AS closed, k <> 2 AS has_area, k <> 3 AS in_bounds, k NOT IN (1, 2, 3) AS valid
  FROM (SELECT area, CAST(area AS INTEGER) % 6 AS k FROM {_BOXES}), (VALUES (CAST(0 AS BIGINT), CAST(0 AS BIGINT)), (0, 1), (1, 0)) r(polygon_no, ring_no)
  WHERE polygon_no + ring_no = 0 OR (k = 4 AND ring_no = 1) OR (k = 5 AND polygon_no = 1)""")
def ring_checks_damaged(spark, sf):
    """By area: sound rings, open ones, ones without area, ones outside the bounds, ones with a hole, and ones with a second part."""
    from segpanel.operators.geometry import explode_rings as rings, ring_checks as checks
    k = F.col("area").cast("int") % 6
    ring = F.get(F.get("coordinates", F.lit(0)), F.lit(0))
    flat = F.transform(ring, lambda p: F.array(p[0], F.get(F.get(ring, F.lit(0)), F.lit(1))))
    away = F.transform(ring, lambda p: F.array(p[0] + 10, p[1]))
    outer = F.when(k == 1, F.slice(ring, 1, 4)).when(k == 2, flat).when(k == 3, away).otherwise(ring)
    parts = F.when(k == 4, F.array(F.array(outer, ring))).when(k == 5, F.array(F.array(outer), F.array(ring))).otherwise(F.array(F.array(outer)))
    out = checks(rings(area_features(spark, sf).withColumn("coordinates", parts), "area"), "area", t.BOX)
    return out.select("area", F.col("polygon_no").cast("bigint").alias("polygon_no"), F.col("ring_no").cast("bigint").alias("ring_no"), "positions", "closed", "has_area", "in_bounds", "valid")


@query("geometry_stats", f"""SELECT area, CAST(1 AS BIGINT) AS polygons, CAST(1 AS BIGINT) AS rings, CAST(5 AS BIGINT) AS positions,
  x0 AS x_min, x1 AS x_max, y0 AS y_min, y1 AS y_max FROM {_BOXES}""")
def geometry_stats(spark, sf):
    from segpanel.operators.geometry import explode_rings as rings, geometry_stats as stats
    return stats(rings(area_features(spark, sf), "area"), "area")


@query("round_geometry", f"""SELECT area, round(x0, 3) AS x_min, round(x1, 3) AS x_max, round(y0, 3) AS y_min, round(y1, 3) AS y_max,
  CAST(5 AS BIGINT) AS positions, true AS closed FROM {_BOXES}""")
def round_geometry(spark, sf):
    from segpanel.operators import geometry as g
    rings = g.explode_rings(g.round_geometry(area_features(spark, sf), 3), "area")
    closed = g.ring_checks(rings, "area", t.BOX).select("area", "closed")
    return g.geometry_stats(rings, "area").drop("polygons", "rings").join(closed, "area")


@query("join_features_inner", f"SELECT a.location_key, a.area, a.predicted, 'MultiPolygon' AS geometry_type FROM areas4 a JOIN {_BOXES} b ON a.area = b.area")
def join_features_inner(spark, sf):
    from queries.publication import area_table
    from segpanel.operators.geometry import join_features
    features = area_features(spark, sf).select("location_key", "geometry_type")
    return join_features(area_table(spark, sf).select("location_key", "area", "predicted"), features)
