"""The batch stages end to end. Every stage reads tables, writes tables, and hands on paths.

Only one-row bounds and the existence of a result reach the driver. A table that several later
steps read is written first and read back, so no step recomputes an earlier stage and a lost
executor costs at most one stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segpanel.functions import expr as E
from segpanel.operators import anomaly, clean, evaluate, forecast, hotspot, publish, quality
from segpanel.operators.aggregate import monthly_counts, reaggregate, weekly_counts, weighted_bins
from segpanel.operators.panel import dense_panel, panel_dates, scoring_end
from segpanel.roles import AnomalyConfig, HotspotConfig, QualityConfig
from segpanel.sources.readers import read_metrics
from segpanel.sources.writers import write_metrics, write_parquet

KEYS = ["grp", "area", "cat", "cls"]
CLEAN_COLUMNS = (
    "event_id", "start_day", "end_day", "report_day", "start_ts", "end_ts", "grp", "area", "cat", "cls", "x", "y",
    *clean.FLAGS, "is_eligible",
)


@dataclass(frozen=True)
class Layout:
    """Where the tables of one run live."""

    root: str

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.table(name))


def clean_and_aggregate(spark: SparkSession, raw: DataFrame, layout: Layout, config: QualityConfig) -> None:
    """Raw text rows to clean events, weekly and monthly counts, and quality metrics.

    The first job only scans, projects and writes; the aggregates then read the typed columns
    they need. Clean rows are partitioned by year, so later date ranges prune directories.
    """
    events = clean.project_allowed(clean.clean_events(raw, config), CLEAN_COLUMNS)
    # Ineligible years share a directory; a year's rows go to a few tasks, not to a file of every task.
    year = F.when(F.col("is_eligible"), F.year("start_day")).otherwise(F.lit(0))
    events.withColumn("year", year).repartition("year", F.pmod(F.xxhash64("event_id"), F.lit(16))).write.mode(
        "overwrite").partitionBy("year").parquet(layout.table("clean"))
    rows = layout.read(spark, "clean").drop("year")
    for name, counts, period in (("weekly", weekly_counts, "week"), ("monthly", monthly_counts, "month")):
        write_parquet(counts(rows, "start_day", KEYS, F.col("is_eligible")), layout.table(name), [period, *KEYS])
    write_metrics(quality.flag_counts(rows, clean.FLAGS), layout.table("metrics_flags"))
    write_metrics(quality.date_coverage(rows, ["start_day", "end_day", "report_day"]), layout.table("metrics_dates"))


def build_forecasts(spark: SparkSession, layout: Layout, keys: Sequence[str] = KEYS,
                    levels_by: Sequence[str] = ("grp", "cat"), **windows) -> None:
    """Weekly counts to baselines, the fitted ensemble, their errors at the levels of ``levels_by``, and the best baseline."""
    keys = list(keys)
    weekly = reaggregate(layout.read(spark, "weekly"), "week", keys, "n")
    dates = panel_dates(weekly, **windows)
    if dates.validation_start is None:
        raise ValueError("there are no weeks before the backtest to validate on")
    panel = dense_panel(weekly, keys, dates.forecast, dates.last)
    write_parquet(forecast.baseline_forecasts(panel, keys, dates), layout.table("baselines"), ["week", *keys])
    features = forecast.ml_features(panel, keys, dates).filter(F.col("week") >= F.lit(dates.validation_start))
    features.write.mode("overwrite").parquet(layout.table("features"))
    used = layout.read(spark, "features")
    best = forecast.fit_best(forecast.fit_grid(used, dates.validation_start, dates.validation_end))
    best.write.mode("overwrite").parquet(layout.table("parameters"))
    best = layout.read(spark, "parameters")
    write_parquet(forecast.predict(used, best, keys), layout.table("predictions"), ["week", *keys])

    long = forecast.unpivot_methods(layout.read(spark, "baselines"), keys)
    model = layout.read(spark, "predictions").filter("is_backtest").withColumnRenamed("model", "method")
    both = long.unionByName(model.select(*long.columns))
    first, second = levels_by
    levels = [[], [first], [second], [first, second]]
    write_metrics(evaluate.metric_levels(both, [first, second], levels), layout.table("metrics_errors"))
    baselines = evaluate.error_metrics(long)
    evaluate.best_method(baselines).write.mode("overwrite").parquet(layout.table("best_baseline"))
    won = layout.read(spark, "best_baseline").select("method")
    for name, rows in (("baseline", long.join(F.broadcast(won), "method", "left_semi")), ("model", model)):
        hard = evaluate.hardest_segments(rows, [first, second])
        write_metrics(hard, layout.table(f"metrics_hardest_{name}"))
    write_metrics(evaluate.top_k_capture(both, keys), layout.table("metrics_capture"))


def score_anomalies(spark: SparkSession, layout: Layout, config: AnomalyConfig = AnomalyConfig(),
                    keys: Sequence[str] = KEYS, include_latest: bool = False) -> None:
    """Weekly counts and backtest predictions to the ranked anomaly table."""
    keys = list(keys)
    weekly = reaggregate(layout.read(spark, "weekly"), "week", keys, "n")
    dates = panel_dates(weekly)
    panel = dense_panel(weekly, keys, scoring_end(dates.first, dates.last, include_latest), dates.last)
    model = anomaly.safe_predictions(layout.read(spark, "predictions"), keys)
    scored = anomaly.anomaly_scores(anomaly.anomaly_features(panel, keys, config), model, keys, config)
    scored.write.mode("overwrite").parquet(layout.table("anomaly_candidates"))
    candidates = layout.read(spark, "anomaly_candidates")
    write_parquet(anomaly.ranked_anomalies(candidates, keys), layout.table("anomalies"), ["rank_overall"])
    write_metrics(anomaly.severity_counts(candidates.filter("is_anomaly")), layout.table("metrics_anomalies"))


def score_hotspots(spark: SparkSession, layout: Layout, config: HotspotConfig) -> None:
    """Clean events to the ranked hotspot table. Events leave their partitions only as sums."""
    rows = layout.read(spark, "clean").filter("is_eligible")
    bins = weighted_bins(rows, [
        F.col("start_day").alias("day"), *[E.fill_unknown(k).alias(k) for k in KEYS], "x", "y", *clean.XY_FLAGS,
    ])
    hotspot.window_cube(bins, config).write.mode("overwrite").parquet(layout.table("hotspot_cube"))
    scored = hotspot.hotspot_scores(layout.read(spark, "hotspot_cube"), config)
    scored.write.mode("overwrite").parquet(layout.table("hotspot_candidates"))
    candidates = layout.read(spark, "hotspot_candidates")
    write_parquet(hotspot.ranked_hotspots(candidates), layout.table("hotspots"), ["rank_overall"])
    write_metrics(hotspot.severity_counts(candidates), layout.table("metrics_hotspots"))


def publish_tables(spark: SparkSession, layout: Layout, baseline: str | None = None) -> None:
    """Published forecast, signals and summaries from the stage tables.

    Changes are against the named baseline, or the one that the forecast stage found best. A signal whose
    status is not available is written without rows.
    """
    if baseline is None:
        best = layout.read(spark, "best_baseline").first()
        if best is None:
            raise ValueError("no baseline has predictions to compare with")
        baseline = best["method"]
    weekly = layout.read(spark, "weekly")
    future = forecast.next_week(layout.read(spark, "predictions"))
    anomalies, hotspots = layout.read(spark, "anomalies"), layout.read(spark, "hotspots")
    scored_to = layout.read(spark, "anomaly_candidates").agg(F.max("week")).scalar()
    last_day = layout.read(spark, "clean").filter("is_eligible").agg(F.max("start_day")).scalar()
    statuses = {
        "forecast": quality.forecast_status(future, weekly, KEYS),
        "anomalies": quality.anomaly_status(anomalies, _metrics(spark, layout, "metrics_anomalies"), weekly, scored_to),
        "hotspots": quality.hotspot_status(hotspots, last_day, _metrics(spark, layout, "metrics_hotspots")),
    }
    told = {name: status.first() for name, status in statuses.items()}  # one row each
    rows = [(name, r["status"], r["reason"], r["rows"]) for name, r in told.items()]
    write_metrics(spark.createDataFrame(rows, "signal string, status string, reason string, rows bigint"), layout.table("metrics_signals"))

    def gated(name: str, table: DataFrame) -> DataFrame:
        return table if told[name]["status"] == "available" else table.limit(0)
    lines = forecast.next_week(layout.read(spark, "baselines")).withColumn("baseline", F.col(baseline))
    changes = forecast.expected_change(gated("forecast", future), lines, KEYS)
    tagged = forecast.tag_publishable(changes, publish.canonical_groups(weekly))
    tagged.write.mode("overwrite").parquet(layout.table("forecast_tagged"))
    tagged = layout.read(spark, "forecast_tagged")
    shown = tagged.filter("withheld_reason IS NULL")
    write_parquet(shown.drop("withheld_reason", "canonical_grp"), layout.table("published_forecast"), ["week", *KEYS])
    write_metrics(forecast.publish_summary(tagged), layout.table("metrics_publish"))
    write_parquet(forecast.area_forecast(shown), layout.table("published_areas"),
                  [F.col("predicted").desc(), F.col("area_no").asc_nulls_last(), "area"])
    write_parquet(publish.published_anomalies(gated("anomalies", anomalies), KEYS),
                  layout.table("published_anomalies"), ["rank_overall"])
    write_parquet(publish.published_hotspots(gated("hotspots", hotspots)), layout.table("published_hotspots"),
                  ["rank_overall"])
    write_parquet(publish.cube_rows(weekly, KEYS), layout.table("cube"), ["row_no"])
    write_metrics(publish.cube_offsets(weekly), layout.table("cube_offsets"))
    write_parquet(publish.canonical_groups(weekly), layout.table("canonical_groups"), ["area"])
    write_parquet(publish.areas_by_group(weekly), layout.table("areas_by_group"), ["grp", "area"])


def _metrics(spark: SparkSession, layout: Layout, name: str) -> DataFrame:
    """Severity counts as the scoring stage published them."""
    return read_metrics(spark, layout.table(name), "severity string, rows bigint")
