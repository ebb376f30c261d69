"""Registered queries against their oracle SQL on the smallest tables.

A spread of queries runs by default; SEGPANEL_ALL=1 runs every one.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from queries.registry import ORACLES, QUERIES
from tests.compare import TESTDATA, differences, oracle_connection

SOME = [
    "read_csv_null_tokens", "row_id", "parquet_roundtrip", "typed_events", "quality_flags", "flag_counts", "rule_table",
    "check_weekly_keys", "code_consistency", "reconcile_totals", "weekly_counts", "column_profile", "cramers_v",
    "lag_quantiles", "group_ranking", "category_distribution", "growth_up_2", "area_map_summary", "heatmap_cells",
    "duration_lag_summary", "rank_in_partition", "dense_panel", "baseline_metrics", "metrics_grouping_sets",
    "lag_ensemble_predict", "anomaly_scores", "hotspot_scores", "publish_summary", "cube_rows", "explode_rings",
]
NAMES = list(entry.queries()) if os.environ.get("SEGPANEL_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return oracle_connection("0.001")


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_oracle(spark, con, plan, name):
    df = entry.queries()[name](spark, f"{TESTDATA}/sf0.001")
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    problem, _ = differences(df, con, sql)
    assert problem is None


def test_registry():
    """Every query of the library itself has an oracle; the optional part counts its own."""
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, plan):
    text = plan(entry.queries()["weekly_counts"](spark, f"{TESTDATA}/sf0.001"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_totalprice" not in text and "c_name" not in text


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 4 and all(r["backtest_rows"] > 0 for r in rows)
