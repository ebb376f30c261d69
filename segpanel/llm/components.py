"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segpanel.llm.stage import staged


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (those above it, or those below and itself) to its least neighbour."""
    pairs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    told = pairs.join(least, "a")
    if large:
        out = told.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = told.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of the component, for every node of a link (columns a, b).

    Each round halves long paths at least and is written, so lineage stays short. Minima are summed up
    before the shuffle, and joins of a much-linked node are split by adaptive execution.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = staged(links.filter("a != b").select(high.alias("a"), low.alias("b")).distinct(), "links")
    before = None
    now = _state(edges)
    while now != before and now[0]:
        before = now
        # After the large star every edge points down, as the small star needs it.
        edges = staged(_star(staged(_star(edges, True), "star"), False), "links")
        now = _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
