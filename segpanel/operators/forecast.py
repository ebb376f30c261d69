"""Baseline forecasts, lag features, the grid-fitted lag ensemble, and change against a baseline."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segpanel.functions.expr import dround, is_unknown, location_key, mappable_area, sround
from segpanel.functions.windows import PriorRows
from segpanel.operators.panel import SEGMENT_COLUMNS, PanelDates

# Baseline names.
METHODS = ("previous_week", "previous_year_same_week", "trailing_4_week_mean", "trailing_8_week_mean")
MODEL_NAME = "lag_ensemble"

# The parameter grid, 13 x 5 x 3 x 3 combinations.
ALPHAS = tuple(round(-0.10 + 0.05 * i, 2) for i in range(13))
BETAS = (-0.10, -0.05, 0.0, 0.05, 0.10)
GAMMAS = (-0.05, 0.0, 0.05)
SHRINKS = (0.95, 1.0, 1.05)

FIT_INPUTS = ("trailing_mean_8", "trailing_mean_4", "lag_1", "lag_52")


def _split_flags(dates: PanelDates, week: str) -> list[Column]:
    w = F.col(week)
    return [
        w.between(F.lit(dates.backtest_start), F.lit(dates.backtest_end)).alias("is_backtest"),
        (w == F.lit(dates.forecast)).alias("is_next_week"),
    ]


def baseline_forecasts(panel: DataFrame, keys: Sequence[str], dates: PanelDates,
                       week: str = "week", value: str = "n") -> DataFrame:
    """Four prior-only baselines for the backtest weeks and the one future week.

    Trailing means exist only with a full window.
    """
    prior = PriorRows(keys, week, value)
    rows = panel.select(
        week, *keys, F.col(value).cast("bigint").alias("actual"),
        prior.lag(1).alias("previous_week"),
        prior.lag(52).alias("previous_year_same_week"),
        F.when(prior.count(4) == 4, prior.mean(4)).alias("trailing_4_week_mean"),
        F.when(prior.count(8) == 8, prior.mean(8)).alias("trailing_8_week_mean"),
        *_split_flags(dates, week), *SEGMENT_COLUMNS,
    )
    return rows.filter("is_backtest OR is_next_week")


def next_week(predictions: DataFrame) -> DataFrame:
    return predictions.filter("is_next_week")


def unpivot_methods(predictions: DataFrame, keys: Sequence[str], week: str = "week",
                    methods: Sequence[str] = METHODS) -> DataFrame:
    """One row per method; a single scan instead of one per method."""
    return predictions.filter("is_backtest").unpivot(
        [week, *keys, "actual"], list(methods), "method", "predicted"
    )


def ml_features(panel: DataFrame, keys: Sequence[str], dates: PanelDates,
                week: str = "week", value: str = "n") -> DataFrame:
    """Calendar, lag, trailing and all-history features, every one from earlier weeks only.

    All windows share one partition and order, so the panel is sorted once and not reshuffled.
    """
    prior = PriorRows(keys, week, value)
    raw: dict[str, Column] = {f"lag_{n}": prior.lag(n) for n in (1, 2, 4, 8, 52)}
    for n in (4, 8):
        raw[f"trailing_mean_{n}"] = prior.mean(n)
        raw[f"trailing_std_{n}"] = prior.std(n)
        raw[f"trailing_min_{n}"] = prior.low(n)
        raw[f"trailing_max_{n}"] = prior.high(n)
    rolled = panel.select(
        week, *keys, value, *SEGMENT_COLUMNS, *[c.alias(n) for n, c in raw.items()],
        prior.count().alias("prior_weeks"), prior.total().alias("prior_total"), prior.mean().alias("prior_mean"),
    )

    def imputed(name: str) -> Column:
        if "_std_" in name:
            return F.coalesce(F.col(name), F.lit(0.0))
        return F.coalesce(F.col(name), F.col("prior_mean"), F.lit(0.0))

    w = F.col(week)
    return rolled.select(
        week, *keys, F.col(value).cast("bigint").alias("actual"),
        F.year(w).cast("double").alias("year"), F.month(w).cast("double").alias("month_no"),
        F.weekofyear(w).cast("double").alias("iso_week"), F.quarter(w).cast("double").alias("quarter"),
        (F.datediff(w, F.lit(dates.first)) / 7.0).alias("week_index"),
        *[imputed(n).alias(n) for n in raw],
        "prior_weeks", F.coalesce("prior_total", F.lit(0.0)).alias("prior_total"),
        F.coalesce("prior_mean", F.lit(0.0)).alias("prior_mean"),
        *_split_flags(dates, week), *SEGMENT_COLUMNS,
    )


def ensemble(alpha: Column, beta: Column, gamma: Column, shrink: Column) -> Column:
    m8, m4, l1, l52 = (F.col(c) for c in FIT_INPUTS)
    value = shrink * (m8 + alpha * (m4 - m8) + beta * (l1 - m4) + gamma * (l52 - m8))
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))  # no parameters, no prediction


def _literals(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def fit_grid(features: DataFrame, start: date, end: date, week: str = "week") -> DataFrame:
    """Validation errors of every parameter combination.

    Rows with equal inputs are counted first: sparse panels hold few distinct ones. The shrink
    factors become columns of the aggregate, so a row is copied 195 and not 585 times, and the
    partial aggregation sends at most 195 rows per task.
    """
    rows = features.filter(
        F.col(week).between(F.lit(start), F.lit(end)) & F.col("actual").isNotNull()
    ).groupBy("actual", *FIT_INPUTS).agg(F.count(F.lit(1)).alias("k"))
    trials = (
        rows.withColumn("alpha", F.explode(_literals(ALPHAS)))
        .withColumn("beta", F.explode(_literals(BETAS)))
        .withColumn("gamma", F.explode(_literals(GAMMAS)))
    )
    k, actual = F.col("k"), F.col("actual")
    sums = [F.sum("k").alias("rows"), F.sum(k * actual).alias("events")]
    for i, s in enumerate(SHRINKS):
        error = F.abs(ensemble(F.col("alpha"), F.col("beta"), F.col("gamma"), F.lit(s)) - actual)
        sums += [F.sum(k * error).alias(f"abs{i}"), F.sum(k * error * error).alias(f"sq{i}"),
                 F.sum(k * error * actual).alias(f"wabs{i}")]
    wide = trials.groupBy("alpha", "beta", "gamma").agg(*sums)
    long = wide.select("alpha", "beta", "gamma", "rows", "events", F.inline(F.array(*[
        F.struct(F.lit(float(s)).alias("shrink"), F.col(f"abs{i}").alias("a"), F.col(f"sq{i}").alias("q"),
                 F.col(f"wabs{i}").alias("w")) for i, s in enumerate(SHRINKS)
    ])))
    return long.select(
        "alpha", "beta", "gamma", "shrink", "rows", "events",
        sround(F.col("a") / F.col("rows"), 5).alias("mae"),
        sround(F.sqrt(F.col("q") / F.col("rows")), 5).alias("rmse"),
        sround(F.when(F.col("events") > 0, F.col("w") / F.col("events")), 5).alias("wmae"),
    )


def fit_best(grid: DataFrame) -> DataFrame:
    """The winning combination with its complete tie-break, as one row."""
    return grid.orderBy(
        "rmse", "mae", F.coalesce(F.col("wmae"), F.lit(1e18)), F.abs(F.col("shrink") - 1.0),
        F.abs("alpha"), F.abs("beta"), F.abs("gamma"), "alpha", "beta", "gamma", "shrink",
    ).limit(1)


def predict(features: DataFrame, best: DataFrame, keys: Sequence[str], week: str = "week") -> DataFrame:
    """Ensemble predictions for backtest weeks and the future week; ``best`` has one row."""
    params = best.select(F.struct("alpha", "beta", "gamma", "shrink")).scalar()
    rows = features.filter("is_backtest OR is_next_week").withColumn("__p", params)
    value = ensemble(*[F.col(f"__p.{p}") for p in ("alpha", "beta", "gamma", "shrink")])
    return rows.select(
        week, *keys, "actual", dround(value, 6).alias("predicted"), F.lit(MODEL_NAME).alias("model"),
        "is_backtest", "is_next_week", *SEGMENT_COLUMNS,
    )


def expected_change(forecast: DataFrame, baseline: DataFrame, keys: Sequence[str],
                    week: str = "week") -> DataFrame:
    """Change of a forecast against a baseline; a missing baseline stays missing."""
    joined = forecast.select(week, *keys, "predicted").join(
        baseline.select(week, *keys, "baseline"), [week, *keys], "left"
    )
    change = F.col("predicted") - F.col("baseline")
    return joined.select(
        week, *keys, "predicted", "baseline", dround(change, 6).alias("change"),
        dround(F.when(F.col("baseline") > 0, change / F.col("baseline") * 100.0), 6).alias("change_pct"),
    )


def tag_publishable(forecast: DataFrame, canonical: DataFrame, grp: str = "grp", area: str = "area") -> DataFrame:
    """Add the reason a forecast row is withheld (NULL when it may be published)."""
    mapping = canonical.select(F.col(area), F.col("canonical_grp"))
    # The unknown area may hold most rows; it maps to nothing and stays out of the join.
    aside = F.coalesce(is_unknown(area), F.lit(True))
    columns = [*forecast.columns, "canonical_grp"]
    joined = forecast.filter(~aside).join(mapping, area, "left").select(*columns).unionByName(
        forecast.filter(aside).withColumn("canonical_grp", F.lit(None).cast("string")).select(*columns))
    unmappable = is_unknown(grp) | is_unknown(area) | ~mappable_area(area) | F.col("canonical_grp").isNull()
    reason = F.when(unmappable, "unmappable").when(F.col(grp) != F.col("canonical_grp"), "mismatch")
    return joined.withColumn("withheld_reason", reason).withColumn("location_key", location_key(area))


def publish_summary(tagged: DataFrame) -> DataFrame:
    """Counts and totals of published and withheld rows in one pass."""
    kept = F.col("withheld_reason").isNull()
    zero = F.lit(0.0)
    out = tagged.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(kept).alias("published_rows"),
        F.count_if(~kept).alias("withheld_rows"),
        F.count_if(F.col("withheld_reason") == "unmappable").alias("withheld_unmappable"),
        F.count_if(F.col("withheld_reason") == "mismatch").alias("withheld_mismatch"),
        dround(F.sum("predicted"), 6).alias("source_total"),
        dround(F.coalesce(F.sum(F.when(kept, F.col("predicted"))), zero), 6).alias("predicted_total"),
        dround(F.coalesce(F.sum(F.when(~kept, F.col("predicted"))), zero), 6).alias("withheld_total"),
        F.count_if(kept & (F.col("predicted") == 0)).alias("zero_rows"),
        F.count_if(kept & is_unknown("cat")).alias("unknown_cat_rows"),
        F.countDistinct(F.when(kept, F.col("area"))).alias("published_areas"),
    )
    return out.withColumn(
        "row_coverage_pct", dround(F.when(F.col("source_rows") > 0, F.col("published_rows") * 100.0 / F.col("source_rows")), 4)
    ).withColumn(
        "volume_coverage_pct", dround(F.when(F.col("source_total") > 0, F.col("predicted_total") * 100.0 / F.col("source_total")), 4)
    )


def area_forecast(published: DataFrame, area: str = "area", grp: str = "grp", tolerance: float = 1e-6) -> DataFrame:
    """Forecast per area. A baseline sum exists only if every row has one."""
    sums = published.groupBy("location_key", area, grp).agg(
        F.sum("predicted").alias("p"), F.sum("baseline").alias("b"),
        F.count("baseline").alias("baseline_rows"), F.count(F.lit(1)).alias("total_rows"),
    )
    full = F.when(F.col("baseline_rows") == F.col("total_rows"), F.col("b"))
    change = F.col("p") - full
    return sums.select(
        "location_key", area, grp, dround("p", 6).alias("predicted"), dround(full, 6).alias("baseline"),
        dround(change, 6).alias("change"),
        dround(F.when(full > 0, change / full * 100.0), 4).alias("change_pct"),
        "baseline_rows", "total_rows",
        F.when(change.isNull(), "unavailable").when(F.abs(change) <= tolerance, "approximately equal")
        .when(change > 0, "above").otherwise("below").alias("direction"),
        F.expr(f"try_cast({area} AS int)").alias("area_no"),
    )


def baseline_coverage() -> Column:
    rows, have = F.col("total_rows"), F.col("baseline_rows")
    return (
        F.when(rows == 0, "unavailable").when(have == 0, "missing").when(have < rows, "partial")
        .otherwise(F.when(F.col("change").isNull(), "unavailable").otherwise("complete"))
    )


def volume_levels(areas: DataFrame, top: DataFrame) -> DataFrame:
    """Quartile steps below the 95th percentile of positive forecasts (``top``: one value)."""
    cap = F.coalesce(top.select("value").scalar(), F.lit(0.0))
    p = F.col("predicted")
    rows = areas.withColumn("cap", cap)
    level = F.when(p == 0, "zero").when((F.col("cap") <= 0) | (p <= F.col("cap") / 4.0), "positive-1")
    level = level.when(p <= F.col("cap") / 2.0, "positive-2").when(p <= F.col("cap") * 3.0 / 4.0, "positive-3")
    return rows.withColumn("level", level.otherwise("positive-4"))


def change_levels(areas: DataFrame, top: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Thirds below the 95th percentile of absolute change, 0 when there is none to show."""
    cap = F.coalesce(top.select("value").scalar(), F.lit(0.0))
    rows = areas.withColumn("cap", cap).withColumn("coverage", baseline_coverage())
    size = F.abs("change")
    none = (F.col("coverage") != "complete") | (size <= tolerance)
    step = F.when(none, 0).when((F.col("cap") <= 0) | (size <= F.col("cap") / 3.0), 1)
    step = step.when(size <= F.col("cap") * 2.0 / 3.0, 2).otherwise(3)
    return rows.withColumn("intensity", step.cast("bigint"))


def derive_baseline(weekly: DataFrame, keys: Sequence[str], forecast_week: date, method: str,
                    week: str = "week", value: str = "n") -> DataFrame:
    """A baseline for one future week straight from the weekly table, without a panel."""
    spans = {"previous_week": (1, 1), "trailing_4_week_mean": (4, 1), "trailing_8_week_mean": (8, 1),
             "previous_year_same_week": (52, 52)}
    if method not in spans:
        raise ValueError(f"unknown baseline {method}")
    oldest, newest = spans[method]
    start = F.date_sub(F.lit(forecast_week), 7 * oldest)
    stop = F.date_sub(F.lit(forecast_week), 7 * newest)
    inside = F.col(week).between(start, stop)
    total = F.coalesce(F.sum(F.when(inside, F.col(value))), F.lit(0)).cast("double")
    known = F.min(week) <= start
    return weekly.groupBy(*keys).agg(
        F.when(known, total / float(oldest - newest + 1)).alias("derived_baseline")
    ).withColumn(week, F.lit(forecast_week))
