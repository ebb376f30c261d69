"""Publication tables: date range, dictionaries, the encoded cube, slices, signal views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segpanel.functions.expr import UNKNOWN, dround, label_match, pct
from segpanel.operators.aggregate import dominant_value
from segpanel.operators.ranks import rank_within, top_ranked, with_row_id
from segpanel.session import materialize


def date_range(events: DataFrame, weekly: DataFrame, time: str = "day", week: str = "week",
               default_weeks: int = 52) -> DataFrame:
    """First and last week, whether the last one is partial, and the default selection."""
    e = events.agg(F.min(time).alias("first_day"), F.max(time).alias("last_day")).select(F.struct("*")).scalar()
    w = weekly.agg(F.min(week).alias("first_week"), F.max(week).alias("last_week")).withColumn("e", e)
    partial = F.date_add("last_week", 6) > F.col("e.last_day")
    out = w.select(
        F.col("e.first_day").alias("first_day"), F.col("e.last_day").alias("last_day"), "first_week", "last_week",
        partial.alias("last_week_partial"),
        F.when(partial, F.date_sub("last_week", 7)).otherwise(F.col("last_week")).alias("latest_complete_week"),
    )
    return out.withColumn("default_start_week", F.greatest(
        F.col("first_week"), F.date_sub("latest_complete_week", 7 * (default_weeks - 1))
    ))


def distinct_dimensions(tables: Sequence[DataFrame], dims: Sequence[str]) -> DataFrame:
    """All labels of every dimension that any of the tables uses, as (dimension, label) rows."""
    long = []
    for t in tables:
        present = [d for d in dims if d in t.columns]
        combos = t.select(*present).distinct()
        long.append(combos.select(F.inline(F.array(*[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in present
        ]))).filter(F.col("label").isNotNull()))
    out = long[0]
    for t in long[1:]:
        out = out.unionByName(t)
    return out.distinct()


def dictionary(table: DataFrame, dim: str) -> DataFrame:
    """Sorted labels with 0-based codes, however many there are."""
    labels = table.select(F.col(dim).cast("string").alias(dim)).filter(F.col(dim).isNotNull()).distinct()
    return with_row_id(labels, [dim], "__code").withColumn(f"{dim}_index", F.col("__code") - 1).drop("__code")


def dictionaries(table: DataFrame, dims: Sequence[str]) -> DataFrame:
    """dimension, label, code: the sorted labels of every dimension with codes from 0, numbered in one sort for all of them."""
    labels = table.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in dims])).alias("x"))
    labels = labels.select("x.*").filter(F.col("label").isNotNull()).distinct()
    return rank_within(labels, ["dimension"], ["label"], "code").withColumn("code", F.col("code") - 1)


def dictionary_encode(table: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Replace labels by codes; Spark decides how a dictionary is joined by its size."""
    out, codes = table, materialize(dictionaries(table, dims))
    for dim in dims:
        own = codes.filter(F.col("dimension") == dim).select(F.col("label").alias(dim), F.col("code").alias(f"{dim}_index"))
        out = out.withColumn(dim, F.col(dim).cast("string")).join(own, dim, "left").drop(dim)
    return out


def cube_rows(weekly: DataFrame, dims: Sequence[str], week: str = "week", value: str = "n") -> DataFrame:
    """Encoded weekly rows in the cube's order: row number from 0, week and dimension codes and the count.

    ``cube_offsets`` gives the row number of each week's first row. ``weekly`` should be a written table.
    """
    coded = dictionary_encode(with_row_id(weekly, [week, *dims], "__row"), [week, *dims])
    return coded.select((F.col("__row") - 1).alias("row_no"), f"{week}_index", *[f"{d}_index" for d in dims],
                        F.col(value).cast("bigint").alias(value))


def write_cube(rows: DataFrame, path: str, group_bytes: int = 8 << 20) -> None:
    """``cube_rows`` in the order of their numbers, in row groups of about ``group_bytes``, so that a range of numbers is a few of these."""
    rows.orderBy("row_no").write.mode("overwrite").option("parquet.block.size", str(group_bytes)).parquet(path)


def read_cube(spark: SparkSession, path: str, offsets: DataFrame, first_week: int, last_week: int) -> DataFrame:
    """Rows of a written cube from one week code to another, both included.

    The two row numbers that bound them come from ``offsets`` (one row for each week) and go into the scan as a filter, which
    the files' statistics turn into the row groups to read.
    """
    bounds = offsets.agg(F.min(F.when(F.col("week_index") >= first_week, F.col("row_start"))).alias("a"),
                         F.min(F.when(F.col("week_index") > last_week, F.col("row_start"))).alias("b"), F.max("row_start").alias("end")).first()
    start = bounds["end"] if bounds["a"] is None else bounds["a"]
    stop = bounds["end"] if bounds["b"] is None else bounds["b"]
    return spark.read.parquet(path).filter((F.col("row_no") >= F.lit(start)) & (F.col("row_no") < F.lit(stop)))


def cube_offsets(weekly: DataFrame, week: str = "week") -> DataFrame:
    """First row number of every week in the sorted cube, and one terminal row with the total.

    The running count runs over weeks, not rows.
    """
    per_week = weekly.groupBy(week).agg(F.count(F.lit(1)).alias("rows"))
    spec = Window.orderBy(week)
    upto = F.sum("rows").over(spec.rowsBetween(Window.unboundedPreceding, 0))
    numbered = per_week.select((F.row_number().over(spec) - 1).cast("bigint").alias("week_index"),
                               (upto - F.col("rows")).alias("row_start"))
    end = weekly.agg(F.countDistinct(week).alias("week_index"), F.count(F.lit(1)).alias("row_start"))
    return numbered.unionByName(end)


def select_cells(weekly: DataFrame, labels: Mapping[str, str | None], start=None, end=None,
                 week: str = "week") -> DataFrame:
    """Rows in a week range with the chosen labels; a NULL choice keeps every label."""
    rows = weekly
    if start is not None:
        rows = rows.filter(F.col(week) >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col(week) <= F.lit(end))
    for dim, label in labels.items():
        if label is not None:
            rows = rows.filter(label_match(dim, label))
    return rows


def cube_slice(weekly: DataFrame, labels: Mapping[str, str | None], start, end, week: str = "week",
               value: str = "n") -> DataFrame:
    rows = select_cells(weekly, labels, start, end, week)
    return rows.agg(F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias("total"))


def canonical_groups(weekly: DataFrame, grp: str = "grp", area: str = "area", value: str = "n") -> DataFrame:
    """Known area to the group that holds most of its volume."""
    known = weekly.filter(F.col(area) != UNKNOWN)
    return dominant_value(known, [area], grp, F.sum(value), "canonical_grp", "canonical_events")


def areas_by_group(weekly: DataFrame, grp: str = "grp", area: str = "area", value: str = "n") -> DataFrame:
    """Filter index: the areas offered for every group, one row each. UNKNOWN areas are listed
    under every group that has volume in them."""
    known = canonical_groups(weekly, grp, area, value).select(F.col("canonical_grp").alias(grp), area)
    unknown = weekly.filter((F.col(area) == UNKNOWN) & (F.col(value) > 0)).select(grp, area).distinct()
    return known.unionByName(unknown)


def observed_weekly(weekly: DataFrame, labels: Mapping[str, str | None], start, end, prior_weeks: int = 8,
                    week: str = "week", value: str = "n", partial_after=None) -> DataFrame:
    """Dense weekly series of a selection with the mean of the weeks before each point.

    The series covers the whole horizon first, so early points still see their history; the
    windows run over at most one row per calendar week.
    """
    horizon = weekly.agg(F.min(week).alias("a"), F.max(week).alias("b"))
    calendar = horizon.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias(week))
    totals = select_cells(weekly, labels, week=week).groupBy(week).agg(F.sum(value).cast("bigint").alias("total"))
    dense = calendar.join(totals, week, "left").withColumn("total", F.coalesce("total", F.lit(0)))
    prior = Window.orderBy(week).rowsBetween(-prior_weeks, -1)
    mean = F.when(F.count("total").over(prior) == prior_weeks, dround(F.avg("total").over(prior), 1))
    out = dense.withColumn("baseline", mean).withColumn(
        "is_partial", F.col(week) > F.lit(partial_after) if partial_after is not None else F.lit(False)
    )
    return out.filter(F.col(week).between(F.lit(start), F.lit(end)))


def observed_ranked(weekly: DataFrame, labels: Mapping[str, str | None], dim: str, start, end, limit: int,
                    week: str = "week", value: str = "n") -> DataFrame:
    counts = select_cells(weekly, labels, start, end, week).groupBy(dim).agg(F.sum(value).cast("bigint").alias("total"))
    return top_ranked(counts.filter(F.col("total") > 0), [F.col("total").desc(), dim], limit)


def recent_comparison(series: DataFrame, weeks: int = 4, week: str = "week") -> DataFrame:
    """The last complete weeks of a series against as many before them."""
    complete = series.filter(~F.col("is_partial"))
    points = complete.agg(F.count(F.lit(1))).scalar()
    span = F.least(F.lit(weeks), F.floor(points / 2)).cast("bigint")
    age = F.row_number().over(Window.orderBy(F.col(week).desc()))
    rows = complete.withColumn("age", age).withColumn("span", span).filter(F.col("age") <= 2 * F.col("span"))
    recent = F.col("age") <= F.col("span")
    out = rows.agg(
        F.coalesce(F.sum(F.when(recent, F.col("total"))), F.lit(0)).alias("recent"),
        F.coalesce(F.sum(F.when(~recent, F.col("total"))), F.lit(0)).alias("prior"),
        F.max("span").alias("weeks"),
        F.min(F.when(recent, F.col(week))).alias("recent_start"), F.max(F.when(recent, F.col(week))).alias("recent_end"),
        F.min(F.when(~recent, F.col(week))).alias("prior_start"), F.max(F.when(~recent, F.col(week))).alias("prior_end"),
    )
    return out.withColumn("change_pct", dround(F.when(F.col("prior") > 0, (F.col("recent") - F.col("prior")) * 100.0 / F.col("prior")), 1))


def published_anomalies(ranked: DataFrame, keys: Sequence[str], severities: Sequence[str] = ("high", "critical")) -> DataFrame:
    return ranked.filter(F.col("severity").isin(list(severities))).select(
        "rank_overall", "week", *keys, "actual", "expected", "expected_source", "residual", "score", "severity"
    )


def published_hotspots(ranked: DataFrame, severities: Sequence[str] = ("high", "critical")) -> DataFrame:
    return ranked.filter(F.col("severity").isin(list(severities))).select(
        "rank_overall", "snapshot_day", "grain", "grp", "area", "cell_x", "cell_y", "cat", "cls",
        F.col("recent_30").alias("recent"), "expected", "lift_pct", "score", "severity",
    )


def signal_totals(hotspots: DataFrame, anomalies: DataFrame, forecast: DataFrame,
                  labels: Mapping[str, str | None], start, end) -> DataFrame:
    """Hotspots, anomalies and forecast volume of a selection, one row per signal."""
    def counts(kind: str, rows: DataFrame) -> DataFrame:
        return rows.agg(
            F.lit(kind).alias("signal"), F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("severity") == "critical").alias("critical"),
            F.count_if(F.col("severity") != "critical").alias("not_critical"),
            F.lit(None).cast("double").alias("predicted_total"),
        )

    hot = counts("hotspot", select_cells(hotspots, labels))
    odd = counts("anomaly", select_cells(anomalies, labels, start, end))
    none = F.lit(0).cast("bigint")
    future = select_cells(forecast, labels).agg(
        F.lit("forecast").alias("signal"), F.count(F.lit(1)).alias("rows"), none.alias("critical"),
        none.alias("not_critical"), dround(F.sum("predicted"), 1).alias("predicted_total"),
    )
    return hot.unionByName(odd).unionByName(future)


def attention_list(hotspots: DataFrame, anomalies: DataFrame, limit: int = 10) -> DataFrame:
    """The most urgent rows of both signals: severity, score, kind, latest period."""
    a = hotspots.select(
        F.lit("Hotspot").alias("kind"), "severity", F.col("snapshot_day").alias("period"), "grp", "cat",
        F.col("recent").cast("double").alias("observed"), F.col("expected").alias("reference"), "score", "rank_overall",
    )
    b = anomalies.select(
        F.lit("Anomaly").alias("kind"), "severity", F.col("week").alias("period"), "grp", "cat",
        F.col("actual").cast("double").alias("observed"), F.col("expected").alias("reference"), "score", "rank_overall",
    )
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2)
    return a.unionByName(b).orderBy(order, F.col("score").desc(), "kind", F.col("period").desc(), "rank_overall").limit(limit)


def hotspot_layers(hotspots: DataFrame, labels: Mapping[str, str | None], area: str | None) -> DataFrame:
    """Rows per map layer, and whether an area selection hides grid rows."""
    scope = select_cells(hotspots, labels)
    chosen = F.lit(True) if area is None else label_match("area", area)
    grid = F.col("grain") == "grid"
    return scope.agg(
        F.count_if(chosen).alias("all_rows"), F.count_if(chosen & grid).alias("grid_rows"),
        F.count_if(chosen & ~grid).alias("area_rows"),
        ((F.count_if(grid) > 0) & F.lit(area is not None)).alias("grid_hidden_by_area"),
    )


def filter_anomalies(anomalies: DataFrame, labels: Mapping[str, str | None], start, end) -> DataFrame:
    """Selected anomalies as counts, with the flag for an empty selection of a non-empty source."""
    hit = F.col("week").between(F.lit(start), F.lit(end))
    for dim, label in labels.items():
        hit = hit & label_match(dim, label)
    return anomalies.agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_if(hit).alias("selected_rows"),
        F.coalesce(F.sum(F.when(hit, F.col("actual"))), F.lit(0)).cast("bigint").alias("selected_events"),
    ).withColumn("filtered_empty", (F.col("source_rows") > 0) & (F.col("selected_rows") == 0))


def summary_row(rows: DataFrame, amount: Column | str) -> DataFrame:
    total = F.count(F.lit(1))
    return rows.agg(
        total.alias("rows"), F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"), F.max("score").alias("max_score"),
        F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("events"),
    ).withColumn("critical_pct", pct(F.col("critical"), F.col("rows"), 4))
