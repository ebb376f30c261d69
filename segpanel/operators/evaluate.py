"""Forecast evaluation: error metrics at several levels, top-k capture, comparison of models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segpanel.functions.expr import dround, pct, sround
from segpanel.operators.aggregate import grouping_levels
from segpanel.operators.selection import kth_places, place_of, with_place
from segpanel.session import materialize

_SUMS = ("rows_all", "events_all", "k", "events", "abs_sum", "sq_sum", "wabs_sum")


def _error_terms(long: DataFrame) -> DataFrame:
    """Per-row terms whose sums give every metric at every level."""
    both = F.col("actual").isNotNull() & F.col("predicted").isNotNull()
    error = F.abs(F.col("predicted") - F.col("actual"))
    return long.select(
        "*", F.lit(1).cast("bigint").alias("rows_all"), F.coalesce("actual", F.lit(0)).alias("events_all"),
        both.cast("bigint").alias("k"), F.when(both, F.col("actual")).alias("events"),
        F.when(both, error).alias("abs_sum"), F.when(both, error * error).alias("sq_sum"),
        F.when(both, error * F.col("actual")).alias("wabs_sum"),
    )


def _metrics() -> list[Column]:
    k = F.when(F.col("k") > 0, F.col("k"))
    return [
        F.col("k").alias("predictions"), F.col("rows_all").alias("backtest_rows"),
        pct(F.col("k"), F.col("rows_all")).alias("coverage_pct"),
        F.coalesce("events", F.lit(0)).alias("events"), F.col("events_all").alias("all_events"),
        sround(F.col("abs_sum") / k, 4).alias("mae"),
        sround(F.sqrt(F.col("sq_sum") / k), 4).alias("rmse"),
        sround(F.when(F.col("events") > 0, F.col("wabs_sum") / F.col("events")), 4).alias("wmae"),
    ]


def error_metrics(long: DataFrame, by: Sequence[str] = (), method: str = "method") -> DataFrame:
    """MAE, RMSE, weighted MAE and coverage per method and group.

    ``long`` has a row per method for every backtest cell, predicted or not, so methods that
    predict nothing keep their row and no join with a method list is needed.
    """
    sums = _error_terms(long).groupBy(method, *by).agg(*[F.sum(c).alias(c) for c in _SUMS])
    return sums.select(method, *by, *_metrics())


def metric_levels(long: DataFrame, dims: Sequence[str], levels: Sequence[Sequence[str]],
                  method: str = "method") -> DataFrame:
    """The same metrics at several grouping levels in one pass over the predictions."""
    terms = _error_terms(long)
    sums = grouping_levels(terms, [method, *dims], {c: c for c in _SUMS}, [[method, *lv] for lv in levels])
    return sums.select(method, *dims, "level_id", *_metrics())


def methods_for_groups(groups: DataFrame, stats: DataFrame, methods: Sequence[str], keys: Sequence[str],
                       method: str = "method") -> DataFrame:
    """Every listed method for every group, with its statistics if it has any."""
    wanted = groups.withColumn(method, F.explode(F.array(*[F.lit(m) for m in methods])))
    return wanted.join(stats, [method, *keys], "left")


def top_k_capture(long: DataFrame, keys: Sequence[str], fraction: str = "0.1", week: str = "week",
                  method: str = "method") -> DataFrame:
    """Share of the volume in the true top-k cells of a week that the predicted top-k also holds.

    k is the given decimal fraction of the week's cells, rounded up; ties go by ``keys``. The k-th cells are found by
    counting (``kth_places``), so nothing is sorted but the few cells around them.
    """
    # Every round of counting reads the cells, so they are computed once.
    cells = materialize(long.filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull()).select(
        method, week, *keys, "actual", "predicted"
    ))
    group = [method, week]

    def k(cells_in_week: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(cells_in_week.cast("decimal(18,0)") * F.lit(fraction).cast("decimal(6,4)")))
    places = [kth_places(cells, group, c, keys, k, name=f"{c}_place") for c in ("actual", "predicted")]
    placed = with_place(cells, materialize(with_place(places[0], places[1].drop("k"), group)), group)
    top, chosen = (place_of(c, keys) <= F.col(f"{c}_place") for c in ("actual", "predicted"))
    weekly = placed.groupBy(*group).agg(
        F.max("k").alias("k"),
        F.sum(F.when(top, F.col("actual"))).alias("top_events"),
        F.coalesce(F.sum(F.when(top & chosen, F.col("actual"))), F.lit(0)).alias("captured"),
    )
    return weekly.groupBy(method).agg(
        F.count(F.lit(1)).alias("weeks"), dround(F.avg("k"), 2).alias("avg_k"),
        F.sum("top_events").alias("top_events"), F.sum("captured").alias("captured_events"),
        dround(F.sum("captured").cast("double") / F.nullif(F.sum("top_events"), F.lit(0)), 4).alias("capture_rate"),
    )


def best_method(metrics: DataFrame, method: str = "method") -> DataFrame:
    return metrics.filter((F.col("predictions") > 0) & F.col("mae").isNotNull()).orderBy(
        "mae", F.col("wmae").asc_nulls_last(), F.col("coverage_pct").desc(), method
    ).limit(1)


def hardest_segments(cells: DataFrame, by: Sequence[str], min_events: int = 50, limit: int = 15) -> DataFrame:
    """Groups with the largest error among those with enough volume."""
    sums = _error_terms(cells.filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull())).groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in _SUMS]
    ).filter(F.col("events") >= min_events)
    out = sums.select(
        *by, F.col("k").alias("predictions"), "events",
        sround(F.col("abs_sum") / F.col("k"), 4).alias("mae"),
        sround(F.sqrt(F.col("sq_sum") / F.col("k")), 4).alias("rmse"),
    )
    return out.orderBy(F.col("mae").desc(), F.col("rmse").desc(), F.col("events").desc(), *by).limit(limit)


def matched_predictions(left: DataFrame, right: DataFrame, keys: Sequence[str], names: tuple[str, str],
                        week: str = "week") -> DataFrame:
    """Long table of two models on the cells that both predict."""
    a = left.filter(F.col("predicted").isNotNull()).select(week, *keys, "actual", F.col("predicted").alias(names[0]))
    b = right.filter(F.col("predicted").isNotNull()).select(week, *keys, F.col("predicted").alias(names[1]))
    return a.join(b, [week, *keys]).unpivot([week, *keys, "actual"], list(names), "method", "predicted")


def compare_models(metrics: DataFrame, challenger: str, reference: str, method: str = "method") -> DataFrame:
    """Difference of two rows of a metric table, and whether the challenger is better."""
    def value(metric: str, name: str) -> Column:
        return F.max(F.when(F.col(method) == name, F.col(metric)))

    measures: Mapping[str, str] = {"mae": "mae", "rmse": "rmse", "wmae": "wmae"}
    wide = metrics.agg(*[
        value(m, n).alias(f"{m}_{side}") for m in measures for side, n in (("new", challenger), ("old", reference))
    ])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_new").alias("challenger"), F.col(f"{m}_old").alias("reference"),
                 dround(F.col(f"{m}_new") - F.col(f"{m}_old"), 4).alias("delta"),
                 (F.col(f"{m}_new") < F.col(f"{m}_old")).alias("beats")) for m in measures
    ])))
