"""Weekly anomalies: prior-only expectations, scores, severity and ranked tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segpanel.functions.expr import dround, sround
from segpanel.functions.windows import PriorRows, array_mad, array_median
from segpanel.operators.aggregate import label_counts
from segpanel.operators.panel import SEGMENT_COLUMNS
from segpanel.operators.ranks import rank_within, with_row_id
from segpanel.roles import AnomalyConfig
from segpanel.session import materialize

SEVERITIES = ("low", "medium", "high", "critical")


def anomaly_features(panel: DataFrame, keys: Sequence[str], config: AnomalyConfig = AnomalyConfig(),
                     week: str = "week", value: str = "n") -> DataFrame:
    """Trailing statistics of every segment week. Median and MAD come from one short array
    that never exceeds the long window and is dropped in the next projection."""
    prior = PriorRows(keys, week, value)
    s, b, g = config.short_weeks, config.base_weeks, config.long_weeks
    rolled = panel.select(
        week, *keys, F.col(value).cast("bigint").alias("actual"), *SEGMENT_COLUMNS,
        prior.count(s).alias("weeks_short"), prior.count(b).alias("weeks_base"), prior.count(g).alias("weeks_long"),
        prior.total(b).alias("total_base"), prior.total(g).alias("total_long"),
        prior.nonzero(b).alias("nonzero_weeks"),
        prior.mean(s).alias("mean_short"), prior.mean(b).alias("mean_base"), prior.mean(g).alias("mean_long"),
        prior.std(b).alias("std_base"), prior.recent_values(g).alias("__values"),
    )
    with_median = rolled.withColumn("median_long", array_median(F.col("__values")))
    return with_median.withColumn("mad_long", array_mad(F.col("__values"), F.col("median_long"))).drop("__values")


def safe_predictions(predictions: DataFrame, keys: Sequence[str], week: str = "week") -> DataFrame:
    """Backtest rows with both an actual and a prediction; nothing else may enter scoring."""
    return predictions.filter(
        F.col("is_backtest") & F.col("actual").isNotNull() & F.col("predicted").isNotNull()
    ).select(week, *keys, F.col("predicted").alias("expected_model"))


def _at_least(c: str, limit: float) -> Column:
    """False where there is no value."""
    return F.coalesce(F.col(c) >= limit, F.lit(False))


def anomaly_scores(features: DataFrame, predictions: DataFrame | None, keys: Sequence[str],
                   config: AnomalyConfig = AnomalyConfig(), week: str = "week") -> DataFrame:
    """Expectations, residuals, flags, score and severity for every segment week."""
    if predictions is None:
        joined = features.withColumn("expected_model", F.lit(None).cast("double"))
    else:
        joined = features.join(predictions, [week, *keys], "left")

    has_base = F.col("weeks_base") >= config.min_prior_weeks
    has_long = F.col("weeks_long") == config.long_weeks
    gated = joined.select(
        week, *keys, "actual", *SEGMENT_COLUMNS, "expected_model",
        F.col("expected_model").isNotNull().alias("has_model"),
        F.when(has_base, F.col("mean_base")).alias("expected_history"),
        F.when(F.col("weeks_short") == config.short_weeks, F.col("mean_short")).alias("mean_short"),
        F.when(has_base, F.col("mean_base")).alias("mean_base"),
        F.when(has_long, F.col("mean_long")).alias("mean_long"),
        F.when(has_base, F.col("std_base")).alias("std_base"),
        F.when(has_long, F.col("median_long")).alias("median_long"),
        F.when(has_long, F.col("mad_long")).alias("mad_long"),
        "weeks_base", "weeks_long", "nonzero_weeks",
        F.coalesce(F.col("total_base"), F.lit(0.0)).cast("bigint").alias("total_base"),
        F.coalesce(F.col("total_long"), F.lit(0.0)).cast("bigint").alias("total_long"),
    )
    actual = F.col("actual")
    measured = gated.withColumns({
        "expected": F.coalesce("expected_model", "expected_history"),
        "expected_source": F.when(F.col("has_model"), "model").when(F.col("expected_history").isNotNull(), "trailing_mean"),
        "residual_history": actual - F.col("expected_history"),
        "residual_model": actual - F.col("expected_model"),
        "pct_vs_short": dround(F.when(F.col("mean_short") > 0, (actual - F.col("mean_short")) * 100.0 / F.col("mean_short")), 4),
        "z": dround(F.when(F.col("std_base") > 0, (actual - F.col("mean_base")) / F.col("std_base")), 4),
        "robust_z": dround(F.when(F.col("mad_long") > 0, (actual - F.col("median_long")) / (1.4826 * F.col("mad_long"))), 4),
        "model_scaled": dround((actual - F.col("expected_model")) / F.greatest(F.sqrt(F.col("expected_model") + 1.0), F.lit(1.0)), 4),
        "is_evaluable": F.col("weeks_base") >= config.min_prior_weeks,
    }).withColumn("residual", actual - F.col("expected"))

    volume = F.col("is_evaluable") & (F.col("total_base") >= config.min_prior_total) & (actual >= config.min_actual)
    history_hit = (
        _at_least("z", config.z[0]) | _at_least("robust_z", config.robust_z[0])
        | _at_least("pct_vs_short", config.min_pct_change)
    )
    model_hit = _at_least("model_scaled", config.model_scaled[0]) | F.coalesce(
        (F.col("expected_model") > 0) & (actual >= F.col("expected_model") * config.model_multiple), F.lit(False)
    )
    flagged = measured.withColumn("passes_volume", volume).withColumns({
        "is_history_anomaly": F.col("passes_volume") & _at_least("residual_history", config.min_increase) & history_hit,
        "is_model_anomaly": F.col("has_model") & F.col("passes_volume")
        & _at_least("residual_model", config.min_increase) & model_hit,
    }).withColumn("is_anomaly", F.col("is_history_anomaly") | F.col("is_model_anomaly"))

    zero = F.lit(0.0)

    def positive(c: Column | str) -> Column:
        return F.greatest(F.coalesce(F.col(c) if isinstance(c, str) else c, zero), zero)

    surprise = F.coalesce("residual_history", zero) / F.greatest(
        F.sqrt(F.coalesce("expected_history", zero) + 1.0), F.lit(1.0)
    )
    score = (
        0.45 * positive("z") + 0.20 * positive("robust_z")
        + 0.15 * F.least(positive(F.col("pct_vs_short") / 100.0), F.lit(5.0))
        + 0.15 * F.least(positive(surprise), F.lit(8.0))
        + 0.05 * F.least(positive("model_scaled"), F.lit(8.0))
    )
    scored = flagged.withColumn("score", F.when(F.col("is_anomaly"), dround(score, 4)).otherwise(0.0))

    def reaches(limit: float) -> Column:
        return _at_least("residual_history", limit) | _at_least("residual_model", limit)

    def strong(i: int, pct_step: float | None) -> Column:
        hit = (
            _at_least("z", config.z[i]) | _at_least("robust_z", config.robust_z[i])
            | _at_least("model_scaled", config.model_scaled[i]) | (F.col("score") >= config.score_steps[i - 1])
        )
        return hit if pct_step is None else hit | _at_least("pct_vs_short", pct_step)

    severity = (
        F.when(~F.col("is_anomaly"), "none")
        .when((actual >= config.critical_min_actual) & reaches(config.critical_min_residual) & strong(3, None), "critical")
        .when(reaches(config.high_min_residual) & strong(2, config.pct_steps[1]), "high")
        .when(reaches(config.min_increase + 1) & strong(1, config.pct_steps[0]), "medium")
        .otherwise("low")
    )
    rounded = ("expected", "expected_history", "expected_model", "residual", "residual_history", "residual_model",
               "mean_short", "mean_base", "mean_long", "std_base", "median_long", "mad_long")
    return scored.withColumn("severity", severity).withColumns({c: dround(c, 6) for c in rounded})


def ranked_anomalies(scored: DataFrame, keys: Sequence[str], week: str = "week") -> DataFrame:
    """Flagged rows with their overall rank and their rank in the week.

    The few flagged rows are written first, so that sampling for the sort does not score twice.
    """
    order = [F.col("score").desc(), F.col("actual").desc()]
    flagged = materialize(scored.filter("is_anomaly"))
    in_week = rank_within(flagged, [week], [*order, *keys], "rank_in_week")
    return with_row_id(in_week, [*order, F.col(week).desc(), *keys], "rank_overall")


def severity_counts(scored: DataFrame, by: Sequence[str] = (), labels: Sequence[str] = SEVERITIES,
                    score: str = "score") -> DataFrame:
    """Count, total, mean and highest score per severity; absent labels are listed with 0."""
    out = label_counts(scored, "severity", labels, [
        F.count(F.lit(1)).alias("rows"), F.sum("actual").alias("events"),
        sround(F.avg(score), 4).alias("avg_score"), F.max(score).alias("max_score"),
    ], by)
    return out.withColumns({"rows": F.coalesce("rows", F.lit(0)), "events": F.coalesce("events", F.lit(0))})


def top_recent(ranked: DataFrame, weeks: int, limit: int, end, week: str = "week") -> DataFrame:
    first = F.date_sub(F.lit(end), 7 * (weeks - 1))
    return ranked.filter(F.col(week) >= first).orderBy("rank_overall").limit(limit)


def volatile_groups(scored: DataFrame, by: Sequence[str], config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Groups whose evaluated weeks deviate most, among those with enough weeks and volume."""
    rows = scored.filter(F.col("is_evaluable") & F.col("passes_volume"))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("evaluated_weeks"),
        F.sum("actual").cast("bigint").alias("events"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("severe_anomalies"),
        dround(F.count_if("is_anomaly") * 100.0 / F.count(F.lit(1)), 4).alias("anomaly_rate_pct"),
        sround(F.avg("std_base"), 4).alias("avg_std"),
        sround(F.avg(F.abs("residual_history")), 4).alias("avg_abs_residual"),
        F.max("score").alias("max_score"),
    ).filter((F.col("evaluated_weeks") >= config.volatile_min_weeks) & (F.col("events") >= config.volatile_min_events))
    return out.orderBy(
        F.col("avg_abs_residual").desc_nulls_last(), F.col("avg_std").desc_nulls_last(),
        F.col("anomalies").desc(), F.col("events").desc(), *by,
    ).limit(config.top_n)
