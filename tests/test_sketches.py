"""Sketch-backed operators against exact answers on skewed, tied and empty groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segpanel.operators import publish as pb
from segpanel.operators.sketches import counts_with_distinct, distinct_both, quantiles_within, roll_up_distinct, top_values_counted


def rows():
    random.seed(3)
    out = [("big", random.gauss(0, 100)) for _ in range(6000)] + [("ties", float(random.choice([1, 1, 1, 1, 2, 9]))) for _ in range(3000)]
    out += [("far", 10.0 ** random.randint(-200, 200)) for _ in range(2000)] + [("one", 4.5), (None, 1.0), (None, 3.0), ("none", None), ("nan", float("nan")), ("same", 7.0), ("same", 7.0)]
    return out


@pytest.mark.parametrize("size,limit", [(8, 50), (200, 10), (1000, 100_000)])
def test_quantiles_are_exact(spark, size, limit):
    """A tiny sketch misses its brackets; a small limit cuts them many times."""
    ps = [0.0, 0.01, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows(), "g string, v double").repartition(4)
    got = {(r.g, r.p): r.value for r in quantiles_within(df, ["g"], "v", ps, size, limit).collect()}
    groups = {}
    for g, v in rows():
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert set(got) == {(g, p) for g in groups for p in ps}
    for (g, p), v in got.items():
        assert v == pytest.approx(float(np.quantile(groups[g], p)), rel=1e-12, abs=1e-300), (g, p)


def test_quantiles_do_not_sort_the_rows(spark, plan):
    df = spark.createDataFrame(rows(), "g string, v double")
    assert "rangepartitioning" not in plan(quantiles_within(df, ["g"], "v", [0.5]))
    assert quantiles_within(df.limit(0), ["g"], "v", [0.5]).collect() == []
    with pytest.raises(ValueError):
        quantiles_within(df, [], "v", [0.5])


def test_distinct_counts_add_up(spark, plan):
    df = spark.range(40_000).select((F.col("id") % 50).alias("day"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") % 7001).alias("who"))
    daily = counts_with_distinct(df, F.col("day"), "day", ["g"], "who")
    total = roll_up_distinct(daily, ["g"]).collect()
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("who").alias("n")).collect()}
    assert {r.g for r in total} == set(exact) and all(abs(r.about - exact[r.g]) <= 0.035 * exact[r.g] for r in total)
    assert sum(r.n for r in total) == 40_000


def test_distinct_ids_are_counted_without_a_sketch_for_each(spark, plan):
    """No aggregate by group and id may carry a sketch."""
    df = spark.range(9000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 'a' else 'b' end AS g", "if(id % 10 = 0, null, id % 1000) AS u")
    out = distinct_both(df.unionByName(spark.createDataFrame([("none", None)], "g string, u long")), "g", "u", 0.02)
    got = {r.g: (r.about, r.exact) for r in out.collect()}
    assert {g: n for g, (_, n) in got.items()} == {None: 900, "a": 900, "b": 900, "none": 0}
    assert all(abs(about - n) <= 0.1 * n for about, n in got.values())
    aggregates = [line for line in plan(out).splitlines() if "Aggregate(" in line]
    assert aggregates and not [line for line in aggregates if "approx_count_distinct" in line and "keys=[g" in line and "u#" in line.split("functions=")[0]]


@pytest.mark.parametrize("skew", [True, False])
def test_frequent_values_are_exact_either_way(spark, skew):
    random.seed(5)
    values = [str(int(random.paretovariate(0.7))) if skew else str(random.randrange(500)) for _ in range(8000)] + [None] * 700
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    counts = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0] is None, x[0] or ""))[:8]
    assert [(r.value, r.rows) for r in top_values_counted(df, "v", 8, tracked=64).collect()] == want
    with pytest.raises(ValueError):
        top_values_counted(df, "v", 30, tracked=64)


def test_cube_range_reads_its_row_groups_alone(spark, tmp_path):
    weekly = spark.range(60_000).select(F.expr("date_add(DATE '2024-01-01', 7 * CAST(id / 600 AS INT))").alias("week"), F.format_string("s%03d", F.col("id") % 600).alias("s"), F.col("id").alias("n"))
    weekly.write.parquet(str(tmp_path / "weekly"))
    weekly = spark.read.parquet(str(tmp_path / "weekly"))
    pb.write_cube(pb.cube_rows(weekly, ["s"]), str(tmp_path / "cube"), 16 << 10)
    out = pb.read_cube(spark, str(tmp_path / "cube"), pb.cube_offsets(weekly), 40, 41)
    assert sorted(r.row_no for r in out.collect()) == list(range(24_000, 25_200))
    nodes, scans = [out._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan parquet"):
            scans.append(node)
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    read = scans[0].metrics().apply("numOutputRows").value()
    assert 1_200 <= read < 15_000  # of 60,000
    assert pb.read_cube(spark, str(tmp_path / "cube"), pb.cube_offsets(weekly), 200, 300).count() == 0
    assert pb.read_cube(spark, str(tmp_path / "cube"), pb.cube_offsets(weekly), 0, 300).count() == 60_000
