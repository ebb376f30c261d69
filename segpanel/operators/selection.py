"""The k-th row of every group by histogram refinement, without sorting the rows.

Rows are counted in buckets of their value; the bucket that holds the k-th row is cut again, and again, until few rows are
left in it, and only these are ranked. Where so many rows have the k-th value itself, the key columns are counted one after the other.
Every round reads the rows once and shuffles one row for each group and bucket that a task has met.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segpanel.session import materialize

#: Rows of a group that may be ranked in one task.
RANKED_ROWS = 100_000
#: Buckets of a round, and of a doubling of the value in the first.
CUTS, PER_DOUBLING = 1024, 64


def _place(value: Column, keys: Sequence[str]) -> Column:
    """Compares as value descending, keys ascending with nulls last."""
    return F.struct((-value).alias("less"), *[p for c in keys for p in (F.col(c).isNull().alias(f"{c}_none"), F.col(c))])


def _group_join(rows: DataFrame, bounds: DataFrame, group: Sequence[str]) -> DataFrame:
    """There is one bound for each group; groups that are null match too. Spark broadcasts the bounds if they are small."""
    other = bounds.withColumnsRenamed({c: f"{c}__b" for c in group})
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(other[f"{c}__b"]) for c in group])
    return rows.join(other, same).drop(*[f"{c}__b" for c in group])


def _boundary(counts: DataFrame, group: Sequence[str], order: Column, carried: Sequence[str]) -> DataFrame:
    """Of each group's buckets (column n, how many rows) the one with row number ``need``; ``need`` is then counted inside it."""
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    return found.withColumn("need", F.col("need") - (F.col("upto") - F.col("n"))).select(*group, *carried, "need", "n", "k")


def kth_places(rows: DataFrame, group: Sequence[str], value: str, keys: Sequence[str], k: Callable[[Column], Column],
               limit: int = RANKED_ROWS, name: str = "place") -> DataFrame:
    """``group``, k and ``name``: the place of the k-th row of every group by ``value`` descending, then ``keys`` ascending.

    ``k`` gives the number from the group's size; rows up to the k-th are those with ``place_of(...) <= name``. ``rows`` should be a
    written table, values finite numbers, and a group's rows differ in ``keys``.
    """
    x = F.col(value).cast("double")
    rows = rows.select(*group, *keys, x.alias("__x"))
    # Buckets by the logarithm, so the first round needs no bounds.
    bucket = F.floor(F.signum("__x") * F.log1p(F.abs("__x")) * (PER_DOUBLING / 0.6931471805599453))
    counts = rows.groupBy(*group, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
    sizes = Window.partitionBy(*group)
    counts = counts.withColumn("k", k(F.sum("n").over(sizes)).cast("bigint")).withColumn("need", F.col("k"))
    bounds = materialize(_boundary(counts, group, F.desc("bucket"), ["low", "high"]))
    known: list[str] = []  # key columns that are settled for the groups that needed them

    def inside() -> DataFrame:
        joined = _group_join(rows, bounds, group)
        held = F.col("__x").between(F.col("low"), F.col("high"))
        for c in known:
            held = held & (F.isnull(f"{c}__open") | F.col(c).eqNullSafe(F.col(f"{c}__is")))
        return joined.filter(held)

    def refined(counted: DataFrame, order: Column, carried: list[str]) -> DataFrame:
        """Bounds in which the groups of ``counted`` stand one step further."""
        small = bounds.filter(F.col("n") <= limit)
        return materialize(_boundary(counted, group, order, carried).unionByName(small, allowMissingColumns=True))
    while not bounds.filter((F.col("n") > limit) & (F.col("low") < F.col("high"))).isEmpty():
        # Values of one bucket, cut evenly; equal ones stay together. Groups with one value left keep their bucket.
        share = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("__x") - F.col("low")) / (F.col("high") - F.col("low")) * CUTS), F.lit(CUTS - 1))).otherwise(F.lit(0))
        counted = inside().filter(F.col("n") > limit).groupBy(*group, "need", "k", share.alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
        bounds = refined(counted, F.desc("bucket"), ["low", "high"])
    for c in keys:
        if bounds.filter(F.col("n") > limit).isEmpty():
            break
        settled = [p for d in known for p in (f"{d}__is", f"{d}__open")]
        counted = inside().filter(F.col("n") > limit).groupBy(*group, "need", "k", "low", "high", *settled, F.col(c).alias(f"{c}__is")).agg(F.count(F.lit(1)).alias("n"))
        counted = counted.withColumn(f"{c}__open", F.lit(True))
        bounds = refined(counted, F.col(f"{c}__is").asc_nulls_last(), ["low", "high", *settled, f"{c}__is", f"{c}__open"])
        known.append(c)
    # Few rows of each group are left.
    place = _place(F.col("__x"), keys)
    last = inside().select(*group, "k", "need", place.alias(name)).withColumn("__at", F.row_number().over(Window.partitionBy(*group).orderBy(name)))
    return last.filter(F.col("__at") == F.col("need")).select(*group, "k", name)


def place_of(value: str, keys: Sequence[str]) -> Column:
    return _place(F.col(value).cast("double"), keys)


def with_place(rows: DataFrame, places: DataFrame, group: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of their group's ``kth_places``."""
    return _group_join(rows, places, group)
