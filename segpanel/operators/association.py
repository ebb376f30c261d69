"""Bias-corrected Cramér's V for column pairs, from crosstab counts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segpanel.functions.expr import dround

MISSING = "__MISSING__"


def cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column pair.

    Only cells that occur are stored: the sum of (O-E)²/E over all cells equals
    N·(ΣO²/(row·column) - 1), which needs no empty cell and so no cross join of labels.
    """
    filled = df.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("k")
    )
    pairs = F.array(*[
        F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(a).alias("a"), F.col(b).alias("b"))
        for a, b in combinations(columns, 2)
    ])
    pair = ["left_column", "right_column"]
    cells = filled.select("k", F.inline(pairs)).groupBy(*pair, "a", "b").agg(F.sum("k").alias("o"))
    rows = cells.groupBy(*pair, "a").agg(F.sum("o").alias("row_sum"))
    cols = cells.groupBy(*pair, "b").agg(F.sum("o").alias("col_sum"))
    shape = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("r"), F.sum("row_sum").alias("n"))
    width = cols.groupBy(*pair).agg(F.count(F.lit(1)).alias("c"))
    o = F.col("o").cast("double")
    mass = cells.join(rows, [*pair, "a"]).join(cols, [*pair, "b"]).groupBy(*pair).agg(
        F.sum(o * o / (F.col("row_sum").cast("double") * F.col("col_sum"))).alias("mass")
    )
    joined = mass.join(shape, pair).join(width, pair)
    n1 = F.greatest(F.col("n") - 1, F.lit(1)).cast("double")
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    phi2 = F.greatest(F.lit(0.0), F.col("mass") - 1.0 - (r - 1.0) * (c - 1.0) / n1)
    room = F.least(r - (r - 1.0) * (r - 1.0) / n1, c - (c - 1.0) * (c - 1.0) / n1) - 1.0
    usable = (F.least(r, c) >= 2) & (room > 0)
    return joined.select(*pair, dround(F.when(usable, F.sqrt(phi2 / room)), 6).alias("cramers_v"))


def association_matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Symmetric matrix with 1 on the diagonal, one row per column."""
    both = pairs.select(F.col("left_column").alias("row_column"), F.col("right_column").alias("other"), "cramers_v").unionByName(
        pairs.select(F.col("right_column").alias("row_column"), F.col("left_column").alias("other"), "cramers_v")
    )
    return both.groupBy("row_column").agg(*[
        F.when(F.col("row_column") == c, F.lit(1.0)).otherwise(
            F.max(F.when(F.col("other") == c, F.col("cramers_v")))
        ).alias(f"v_{c}") for c in columns
    ])
