from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from segpanel.operators.ranks import exact_quantiles, rank_within, running_total, top_ranked, top_within, with_row_id
from segpanel.sources.readers import fixed_sample


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one group and one value."""
    df = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 17).cast("string"))).alias("grp"),
        F.when(F.col("id") % 3 == 0, 5).otherwise((F.col("id") * 37) % 101).alias("v"),
    ).repartition(7)
    return df.cache()


def test_row_ids_are_dense_and_in_order(skewed):
    rows = sorted((r["row_id"], -r["v"], r["id"]) for r in with_row_id(skewed, [F.col("v").desc(), "id"]).collect())
    assert [r[0] for r in rows] == list(range(1, 3001))
    assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_numbers_do_not_depend_on_partitioning(spark, skewed):
    def numbers():
        return sorted((r["id"], r["row_id"]) for r in with_row_id(skewed, ["v", "id"]).collect())

    first = numbers()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert numbers() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_hot_value_spreads_over_partitions(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = skewed.repartitionByRange(F.col("v").asc(), F.col("id").asc())
        sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 1000


def test_rank_within_groups(skewed):
    got = {r["id"]: r["rank"] for r in rank_within(skewed, ["grp"], [F.col("v").desc(), "id"]).collect()}
    want = {}
    groups: dict = {}
    for r in skewed.collect():
        groups.setdefault(r["grp"], []).append((-r["v"], r["id"]))
    for members in groups.values():
        for i, (_, ident) in enumerate(sorted(members), 1):
            want[ident] = i
    assert got == want


def test_rank_within_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    assert sorted((r["v"], r["rank"]) for r in rank_within(df, ["g"], ["v"]).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_running_total(skewed):
    rows = sorted((r["v"], r["id"], r["running_total"]) for r in running_total(skewed, ["v", "id"], "v").collect())
    assert [r[2] for r in rows] == list(np.cumsum([r[0] for r in rows]))


def test_quantiles_match_linear_interpolation(skewed):
    values = [r["v"] for r in skewed.collect()]
    got = {r["p"]: r["value"] for r in exact_quantiles(skewed, "v", [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    for p, value in got.items():
        assert value == pytest.approx(np.quantile(values, p))


def test_quantiles_of_one_value_and_of_nothing(spark):
    df = spark.createDataFrame([(2.5,), (None,)], "v double")
    assert exact_quantiles(df, "v", [0.9]).first()["value"] == 2.5
    assert exact_quantiles(df.filter("v > 9"), "v", [0.9]).first()["value"] is None


def test_top_rows(skewed):
    best = [r["id"] for r in top_ranked(skewed, [F.col("v").desc(), "id"], 5).orderBy("rank").collect()]
    assert best == [r["id"] for r in skewed.orderBy(F.col("v").desc(), "id").limit(5).collect()]
    per_group = top_within(skewed, ["grp"], ["id"], 2)
    assert per_group.groupBy("grp").count().agg(F.max("count")).first()[0] == 2


def test_top_within_prunes_before_the_shuffle(skewed, plan):
    assert "WindowGroupLimit" in plan(top_within(skewed, ["grp"], ["id"], 2))


def test_sample_is_exact_and_repeatable(skewed):
    a = {r["id"] for r in fixed_sample(skewed, 100, 7, "id").collect()}
    assert len(a) == 100 and a == {r["id"] for r in fixed_sample(skewed.repartition(3), 100, 7, "id").collect()}
    assert a != {r["id"] for r in fixed_sample(skewed, 100, 8, "id").collect()}
    assert fixed_sample(skewed, 100, 7, "grp").count() == 100  # few distinct identities
    assert fixed_sample(skewed, 5000, 7, "id").count() == 3000


def test_large_groups_are_not_one_task(spark, plan):
    """Without broadcasts no exchange of the rows hashes the group alone."""
    df = spark.range(1000).selectExpr("id", "id % 2 AS g", "id % 7 AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(rank_within(df, ["g"], ["v", "id"], size="n"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    on_group_alone = [x for x in text.splitlines() if "hashpartitioning(g#" in x or "hashpartitioning(coalesce(g#" in x]
    assert "hashpartitioning(coalesce(__part" in text and len(on_group_alone) <= 1  # the pieces: a row for each group and partition


def test_rank_within_gives_group_sizes(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 2), ("b", 9), (None, 1)], "g string, v int")
    assert sorted((r["g"] or "", r["v"], r["rank"], r["n"]) for r in rank_within(df, ["g"], ["v"], size="n").collect()) == [
        ("", 1, 1, 2), ("", 2, 2, 2), ("a", 1, 1, 2), ("a", 3, 2, 2), ("b", 9, 1, 1)]
