"""Dense numbering, ranks and running totals without a single-task window.

The rows are range partitioned on the complete sort key, so a frequent leading value spreads
over many tasks. The sorted rows are written to the shared folder once: positions
then stay fixed even if an executor is lost. Only one row per partition goes through the final
prefix sum.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segpanel.session import materialize

_POS = "__pos"
_PART = "__part"


def _as_columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


def _staged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    keys = _as_columns(order)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ranged.withColumn(_POS, F.monotonically_increasing_id()))


def _offsets(staged: DataFrame, amount: Column) -> DataFrame:
    """Exclusive prefix sum of one number per partition (as many rows as partitions)."""
    sums = staged.groupBy(F.shiftright(_POS, 33).alias(_PART)).agg(amount.alias("__amount"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(_PART, F.coalesce(F.sum("__amount").over(before), F.lit(0)).alias("__before"))


def _numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Dense 1..N numbers, and the partition that holds the row."""
    staged = _staged(df, order)
    offsets = _offsets(staged, F.count(F.lit(1)))
    local = F.col(_POS).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        staged.withColumn(_PART, F.shiftright(_POS, 33))
        .join(F.broadcast(offsets), _PART)
        .withColumn(name, (local + F.col("__before") + 1).cast("bigint"))
        .drop(_POS, "__before")
    )


def with_row_id(df: DataFrame, order: Sequence[Column | str], name: str = "row_id") -> DataFrame:
    """Dense 1..N numbers in the given total order."""
    return _numbered(df, order, name).drop(_PART)


def running_total(df: DataFrame, order: Sequence[Column | str], value: str,
                  name: str = "running_total") -> DataFrame:
    """Inclusive running sum in the given total order."""
    staged = _staged(df, order)
    offsets = _offsets(staged, F.sum(value))
    within = Window.partitionBy(_PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    return (
        staged.withColumn(_PART, F.shiftright(_POS, 33))
        .withColumn("__local", F.sum(value).over(within))
        .join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col("__local") + F.col("__before"))
        .drop(_POS, _PART, "__before", "__local")
    )


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str], suffix: str) -> Column:
    parts = [left[c].eqNullSafe(right[c + suffix]) for c in columns]
    return reduce(lambda a, b: a & b, parts)


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
                name: str = "rank", size: str | None = None) -> DataFrame:
    """Dense 1..n numbers inside every group, without holding a group in one task; ``size`` names n.

    A group is a run of the global numbering, so the rank is the global number minus the
    number of the group's first row. That number is joined on partition and group: there are at most
    groups + partitions such pairs, and a large group is as many keys as it has partitions.
    """
    numbered = _numbered(df, [F.col(c).asc_nulls_last() for c in by] + _as_columns(order), "__row")
    pieces = numbered.groupBy(_PART, *by).agg(F.min("__row").alias("__least"), F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*by)
    starts = pieces.select(
        F.col(_PART).alias(_PART + "__g"), *[F.col(c).alias(c + "__g") for c in by],
        F.min("__least").over(group).alias("__first"), F.sum("__n").over(group).alias("__size"),
    )
    joined = numbered.join(starts, _same(numbered, starts, [_PART, *by], "__g"))
    ranked = joined.withColumn(name, F.col("__row") - F.col("__first") + 1)
    if size:
        ranked = ranked.withColumn(size, F.col("__size"))
    return ranked.drop("__row", "__first", "__size", _PART, _PART + "__g", *[c + "__g" for c in by])


def top_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int,
               name: str = "rank") -> DataFrame:
    """The first n rows of every group with their rank.

    The rank filter lets Spark keep only n rows per group and task before the shuffle.
    """
    spec = Window.partitionBy(*by).orderBy(*_as_columns(order))
    return df.withColumn(name, F.row_number().over(spec).cast("bigint")).filter(F.col(name) <= n)


def top_ranked(df: DataFrame, order: Sequence[Column | str], n: int, name: str = "rank") -> DataFrame:
    """The first n rows overall with their rank; only those n rows reach the numbering window."""
    keys = _as_columns(order)
    best = df.orderBy(*keys).limit(n)
    return best.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("bigint"))


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles as (p, value) rows.

    Values are counted first, so repeated values cost one row; the running count then finds
    the two neighbours of every position. No task ever holds all values.
    """
    counted = (
        df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    cumulative = running_total(counted, ["__v"], "__n", "__upto")
    size = cumulative.agg(F.max("__upto").alias("__rows")).scalar()

    def at(position: Column) -> Column:
        hit = (F.col("__upto") > position) & (F.col("__upto") - F.col("__n") <= position)
        return F.max(F.when(hit, F.col("__v")))

    columns = []
    spots = []
    for i, p in enumerate(probabilities):
        spot = (F.col("__size") - 1).cast("double") * F.lit(float(p))
        columns += [at(F.floor(spot)).alias(f"lo{i}"), at(F.ceil(spot)).alias(f"hi{i}")]
        spots.append(F.struct(
            F.lit(float(p)).alias("p"),
            (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}"))
             * (((F.col("size") - 1).cast("double") * F.lit(float(p))) % 1.0)).alias("value"),
        ))
    found = cumulative.withColumn("__size", size).agg(F.max("__size").alias("size"), *columns)
    return found.select(F.inline(F.array(*spots)))
