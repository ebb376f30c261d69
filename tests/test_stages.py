from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from queries import tables as t
from segpanel.plans import stages
from segpanel.roles import AnomalyConfig
from segpanel.sources.readers import read_raw_csv
from segpanel.operators.clean import RAW_COLUMNS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    csv = str(root / "raw-csv")
    t.raw(spark, SF).write.csv(csv, header=True)
    layout = stages.Layout(str(root / "tables"))
    stages.clean_and_aggregate(spark, read_raw_csv(spark, csv, RAW_COLUMNS), layout, t.QUALITY)
    stages.build_forecasts(spark, layout)
    stages.score_anomalies(spark, layout, AnomalyConfig(min_prior_total=1, min_actual=2, min_increase=1.0))
    stages.score_hotspots(spark, layout, t.HOTSPOTS)
    stages.publish_tables(spark, layout)
    return layout


def test_clean_rows_and_totals(spark, layout):
    clean = layout.read(spark, "clean")
    assert clean.count() == t.raw(spark, SF).count()
    assert "start_time_text" not in clean.columns and "cls_raw" not in clean.columns
    eligible = clean.filter("is_eligible").count()
    for name in ("weekly", "monthly"):
        assert layout.read(spark, name).agg(F.sum("n")).first()[0] == eligible


def test_forecast_tables(spark, layout):
    predictions = layout.read(spark, "predictions")
    segments = layout.read(spark, "weekly").select(*t.KEYS).distinct().count()
    assert predictions.filter("is_next_week").count() == segments
    assert layout.read(spark, "parameters").count() == 1
    errors = spark.read.json(layout.table("metrics_errors"))
    assert errors.filter("level_id = 3").count() == 5
    assert {"grp", "cat"} < set(errors.columns) and "cls" not in errors.columns
    by_pair = errors.filter("grp is not null and cat is not null").select("grp", "cat").distinct()
    assert by_pair.count() == layout.read(spark, "baselines").filter("is_backtest").select("grp", "cat").distinct().count()
    assert layout.read(spark, "best_baseline").count() == 1


def test_signal_tables(spark, layout):
    ranks = [r[0] for r in layout.read(spark, "anomalies").select("rank_overall").collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and ranks
    candidates = layout.read(spark, "hotspot_candidates")
    assert layout.read(spark, "hotspots").count() == candidates.filter("is_hotspot").count()


def test_published_tables(spark, layout):
    source = layout.read(spark, "predictions").filter("is_next_week").count()
    summary = spark.read.json(layout.table("metrics_publish")).first()
    assert summary["source_rows"] == source == summary["published_rows"] + summary["withheld_rows"]
    assert layout.read(spark, "published_forecast").count() == summary["published_rows"]
    total = layout.read(spark, "published_areas").agg(F.sum("predicted")).first()[0]
    assert total == pytest.approx(summary["predicted_total"], abs=1e-3)


def test_signals_are_gated(spark, layout, tmp_path):
    import shutil

    told = {r["signal"]: r["status"] for r in spark.read.json(layout.table("metrics_signals")).collect()}
    assert told["forecast"] == told["anomalies"] == "available"
    broken = stages.Layout(str(tmp_path / "tables"))
    shutil.copytree(layout.root, broken.root)
    counts = spark.read.json(broken.table("metrics_anomalies")).withColumn("rows", F.col("rows") + 1)
    counts.write.json(str(tmp_path / "damaged"))
    spark.read.json(str(tmp_path / "damaged")).write.mode("overwrite").json(broken.table("metrics_anomalies"))
    stages.publish_tables(spark, broken)
    row = {r["signal"]: r for r in spark.read.json(broken.table("metrics_signals")).collect()}["anomalies"]
    assert (row["status"], row["reason"]) == ("invalid", "row_count_off")
    assert broken.read(spark, "published_anomalies").count() == 0
    assert broken.read(spark, "published_forecast").count() == layout.read(spark, "published_forecast").count()
