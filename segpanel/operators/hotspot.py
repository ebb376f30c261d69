"""Spatial hotspots at area and grid grain from one pre-aggregated table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segpanel.functions import expr as E
from segpanel.functions.expr import UNKNOWN, dround, sround
from segpanel.operators.aggregate import dominant_value, label_counts
from segpanel.operators.ranks import rank_within, with_row_id
from segpanel.roles import HotspotConfig
from segpanel.session import materialize

KEYS = ("grp", "area", "cat", "cls")
COUNTS = ("recent_7", "recent_30", "recent_90", "baseline")
GRAINS = ("area", "grid")


def scoring_day(bins: DataFrame, config: HotspotConfig, time: str = "day") -> Column:
    """Last day to score: the day before the latest one, if there is one. One scalar."""
    first, last = F.min(time), F.max(time)
    if config.include_latest_day:
        return bins.agg(last).scalar()
    return bins.agg(F.when(F.date_sub(last, 1) < first, last).otherwise(F.date_sub(last, 1))).scalar()


def window_conditions(age: Column, config: HotspotConfig) -> dict[str, Column]:
    """Conditions on the age in days. The baseline ends where the longest recent window starts."""
    return {
        "recent_7": age.between(0, config.short_days - 1),
        "recent_30": age.between(0, config.recent_days - 1),
        "recent_90": age.between(0, config.long_days - 1),
        "baseline": age.between(config.long_days, config.long_days + config.baseline_days - 1),
    }


def hotspot_windows(bins: DataFrame, config: HotspotConfig, weight: str = "weight", time: str = "day") -> DataFrame:
    """Bins, events and date span per window; windows overlap, so a bin can count in several."""
    dated = bins.withColumn("__age", F.datediff(scoring_day(bins, config, time), F.col(time)))
    parts = []
    for name, hit in window_conditions(F.col("__age"), config).items():
        parts.append((name, [
            F.count_if(hit).alias(f"{name}_bins"),
            F.coalesce(F.sum(F.when(hit, F.col(weight))), F.lit(0)).cast("bigint").alias(f"{name}_events"),
            F.min(F.when(hit, F.col(time))).alias(f"{name}_first"), F.max(F.when(hit, F.col(time))).alias(f"{name}_last"),
        ]))
    wide = dated.agg(*[c for _, cs in parts for c in cs])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("window_name"), F.col(f"{n}_bins").alias("bins"), F.col(f"{n}_events").alias("events"),
                 F.col(f"{n}_first").alias("first_day"), F.col(f"{n}_last").alias("last_day")) for n, _ in parts
    ])))


def window_cube(bins: DataFrame, config: HotspotConfig, weight: str = "weight", time: str = "day") -> DataFrame:
    """Window counts per key tuple and cell, plus coordinate sums.

    This is the only shuffle of the daily bins. Both grains, the totals and the centroids are
    sums of its rows. Bins without a usable point keep a NULL cell.
    """
    end = scoring_day(bins, config, time)
    valid = E.valid_xy("x", "y", config.box)
    w = F.col(weight)
    tagged = bins.withColumn("__end", end).withColumn("__age", F.datediff("__end", F.col(time))).filter("__age >= 0")
    sums = [
        F.coalesce(F.sum(F.when(hit, w)), F.lit(0)).cast("bigint").alias(name)
        for name, hit in window_conditions(F.col("__age"), config).items()
    ]
    return tagged.groupBy(
        *KEYS,
        F.when(valid, E.grid_snap("x", config.cell_size)).alias("cell_x"),
        F.when(valid, E.grid_snap("y", config.cell_size)).alias("cell_y"),
    ).agg(
        *sums, F.sum(w).cast("bigint").alias("all_events"),
        F.sum(F.when(valid, F.col("x") * w)).alias("sum_x"), F.sum(F.when(valid, F.col("y") * w)).alias("sum_y"),
        F.max("__end").alias("snapshot_day"),
    )


def _has_cell() -> Column:
    return F.col("cell_x").isNotNull()


def _totals_row(cube: DataFrame) -> DataFrame:
    """All window totals as one row, from one pass over the cube."""
    return cube.agg(*[
        F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint").alias(f"{grain}_{c}")
        for grain, cond in (("area", F.lit(True)), ("grid", _has_cell())) for c in ("recent_30", "baseline")
    ])


def window_totals(cube: DataFrame) -> DataFrame:
    """Recent and baseline totals per grain: all bins for areas, usable points for the grid."""
    wide = _totals_row(cube)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(g).alias("grain"), F.col(f"{g}_recent_30").alias("recent_total"),
                 F.col(f"{g}_baseline").alias("baseline_total")) for g in GRAINS
    ])))


def _counts() -> list[Column]:
    return [F.sum(c).cast("bigint").alias(c) for c in COUNTS]


def _observed() -> Column:
    return (F.col("recent_90") > 0) | (F.col("baseline") > 0)


def area_centroids(cube: DataFrame) -> DataFrame:
    """Event-weighted mean position per known area over all scored days."""
    points = cube.filter(_has_cell() & (F.col("area") != UNKNOWN))
    sums = points.groupBy("grp", "area").agg(
        F.sum("sum_x").alias("sx"), F.sum("sum_y").alias("sy"), F.sum("all_events").alias("centroid_weight")
    )
    return sums.select(
        "grp", "area", dround(F.col("sx") / F.col("centroid_weight"), 6).alias("map_x"),
        dround(F.col("sy") / F.col("centroid_weight"), 6).alias("map_y"), "centroid_weight",
    )


def area_base(cube: DataFrame) -> DataFrame:
    """Counts per area, category and class, with the centroid of the area."""
    base = cube.groupBy(*KEYS).agg(
        *_counts(),
        F.coalesce(F.sum(F.when(_has_cell(), F.col("recent_30"))), F.lit(0)).cast("bigint").alias("valid_events"),
        F.max("snapshot_day").alias("snapshot_day"),
    ).filter(_observed())
    joined = base.join(area_centroids(cube).drop("centroid_weight"), ["grp", "area"], "left")
    none = F.lit(None).cast("double")
    return joined.select(
        F.lit("area").alias("grain"), "grp", "area", none.alias("cell_x"), none.alias("cell_y"), "cat", "cls",
        "map_x", "map_y", *COUNTS, "valid_events", "snapshot_day",
    )


def grid_base(cube: DataFrame) -> DataFrame:
    """Counts per cell, category and class, with the group that dominates the analysis window."""
    by = ["cell_x", "cell_y", "cat", "cls"]
    points = cube.filter(_has_cell() & _observed())
    base = points.groupBy(*by).agg(*_counts(), F.max("snapshot_day").alias("snapshot_day")).filter(_observed())
    groups = dominant_value(points, by, "grp", F.sum(F.col("recent_90") + F.col("baseline")), "grp")
    joined = base.join(groups, by, "left")
    return joined.select(
        F.lit("grid").alias("grain"), F.coalesce("grp", F.lit(UNKNOWN)).alias("grp"),
        F.lit(None).cast("string").alias("area"), "cell_x", "cell_y", "cat", "cls",
        F.col("cell_x").alias("map_x"), F.col("cell_y").alias("map_y"), *COUNTS,
        F.col("recent_30").alias("valid_events"), "snapshot_day",
    )


def union_grains(cube: DataFrame) -> DataFrame:
    return area_base(cube).unionByName(grid_base(cube))


def _by_grain(config: HotspotConfig, field: str) -> Column:
    return F.when(F.col("grain") == "area", getattr(config.area, field)).otherwise(getattr(config.grid, field))


def hotspot_scores(cube: DataFrame, config: HotspotConfig) -> DataFrame:
    """Shares, ratios, sub-scores, composite score, flag and severity for every candidate."""
    totals = _totals_row(cube).select(F.struct("*")).scalar()
    is_area = F.col("grain") == "area"
    r7, r30, r90, base = (F.col(c) for c in COUNTS)
    zero = F.lit(0.0)

    rows = union_grains(cube).withColumn("__t", totals).withColumns({
        "recent_total": F.when(is_area, F.col("__t.area_recent_30")).otherwise(F.col("__t.grid_recent_30")),
        "baseline_total": F.when(is_area, F.col("__t.area_baseline")).otherwise(F.col("__t.grid_baseline")),
        "expected": dround(base * float(config.recent_days) / float(config.baseline_days), 6),
        "recent_days": F.lit(config.recent_days), "baseline_days": F.lit(config.baseline_days),
    }).drop("__t")
    rows = rows.withColumns({
        "recent_share": F.when(F.col("recent_total") > 0, dround(r30 * 100.0 / F.col("recent_total"), 6)).otherwise(0.0),
        "baseline_share": F.when(F.col("baseline_total") > 0, dround(base * 100.0 / F.col("baseline_total"), 6)).otherwise(0.0),
        "ratio": dround(F.when(F.col("expected") > 0, r30 / F.col("expected")), 6),
        "lift_pct": dround(F.when(F.col("expected") > 0, (r30 / F.col("expected") - 1.0) * 100.0), 6),
        "recency_count": dround(
            r7.cast("double") * 0.50 + F.greatest(r30 - r7, F.lit(0)).cast("double") * 0.35
            + F.greatest(r90 - r30, F.lit(0)).cast("double") * 0.15, 6),
        "coverage_pct": F.when(r30 > 0, dround(F.col("valid_events") * 100.0 / r30, 6)).otherwise(0.0),
    })
    reference = F.log(F.lit(1.0) + _by_grain(config, "density_reference").cast("double"))

    def density(c: Column) -> Column:
        return dround(100.0 * F.least(F.log(F.lit(1.0) + c) / reference, F.lit(1.0)), 4)

    def clamp(c: Column) -> Column:
        span = max(config.ratio_steps[2] - 1.0, 0.0001)
        return dround(100.0 * F.least(F.greatest((c - 1.0) / span, zero), F.lit(1.0)), 4)

    share_ratio = F.when(F.col("baseline_share") > 0, F.col("recent_share") / F.col("baseline_share")).otherwise(0.0)
    rows = rows.withColumns({
        "share_change": dround(F.col("recent_share") - F.col("baseline_share"), 6),
        "density_score": density(r30.cast("double")),
        "lift_score": clamp(F.coalesce("ratio", zero)),
        "share_score": clamp(share_ratio),
        "recency_score": density(F.col("recency_count")),
        "quality_score": dround(F.least(F.greatest(F.col("coverage_pct"), zero), F.lit(100.0)), 4),
        "passes_volume": (r30 >= _by_grain(config, "min_recent")) & (base >= _by_grain(config, "min_baseline"))
        & (F.col("expected") > 0),
    })
    rows = rows.withColumn("score", dround(
        0.35 * F.col("density_score") + 0.25 * F.col("lift_score") + 0.20 * F.col("share_score")
        + 0.15 * F.col("recency_score") + 0.05 * F.col("quality_score"), 4))
    ratio = F.coalesce("ratio", zero)
    rows = rows.withColumn("is_hotspot", F.col("passes_volume") & (ratio >= config.min_ratio)
                           & (F.col("share_change") > config.min_share_change) & (F.col("score") >= config.min_score))
    medium, high, critical = zip(config.score_steps, config.ratio_steps)

    def reaches(step: tuple[float, float]) -> Column:
        return (F.col("score") >= step[0]) & (ratio >= step[1])

    return rows.withColumn(
        "severity",
        F.when(~F.col("is_hotspot"), "none")
        .when(reaches(critical) & (r30 >= _by_grain(config, "critical_min_recent")), "critical")
        .when(reaches(high) & (r30 >= _by_grain(config, "high_min_recent")), "high")
        .when(reaches(medium), "medium").otherwise("low"),
    )


def ranked_hotspots(scored: DataFrame) -> DataFrame:
    """Flagged rows with overall rank and rank in the grain."""
    lead = [F.col("score").desc(), F.col("recent_30").desc(), F.col("ratio").desc_nulls_last()]
    place = ["grp", "area", "cell_y", "cell_x", "cat", "cls"]
    flagged = materialize(scored.filter("is_hotspot"))
    in_grain = rank_within(flagged, ["grain"], [*lead, *place], "rank_in_grain")
    return with_row_id(in_grain, [*lead, "grain", *place], "rank_overall")


def severity_counts(scored: DataFrame, by: Sequence[str] = ("grain",)) -> DataFrame:
    out = label_counts(scored.filter("is_hotspot"), "severity", ("low", "medium", "high", "critical"), [
        F.count(F.lit(1)).alias("rows"), F.sum("recent_30").alias("events"),
        sround(F.avg("score"), 4).alias("avg_score"), F.max("score").alias("max_score"),
    ], by)
    return out.withColumns({"rows": F.coalesce("rows", F.lit(0)), "events": F.coalesce("events", F.lit(0))})
