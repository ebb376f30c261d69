"""Aggregations: period counts, profiles, filtered sums, distinct keys, centroids, shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segpanel.functions.expr import UNKNOWN, col, dround, fill_unknown, month_of, pct, week_of


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def sum_if(condition: Column, value: Column | str) -> Column:
    return F.sum(F.when(condition, col(value)))


def sum_or_zero(condition: Column, value: Column | str) -> Column:
    return F.coalesce(sum_if(condition, value), F.lit(0)).cast("bigint")


def period_counts(events: DataFrame, period: Column, name: str, keys: Sequence[str],
                  eligible: Column | None = None, value: str = "n") -> DataFrame:
    """Events per period and key tuple; missing keys are kept under one label."""
    rows = events if eligible is None else events.filter(eligible)
    return rows.groupBy(period.alias(name), *[fill_unknown(k).alias(k) for k in keys]).agg(
        F.count(F.lit(1)).alias(value)
    )


def weekly_counts(events: DataFrame, time: str, keys: Sequence[str],
                  eligible: Column | None = None, week: str = "week", value: str = "n") -> DataFrame:
    return period_counts(events, week_of(time), week, keys, eligible, value)


def monthly_counts(events: DataFrame, time: str, keys: Sequence[str],
                   eligible: Column | None = None, month: str = "month", value: str = "n") -> DataFrame:
    return period_counts(events, month_of(time), month, keys, eligible, value)


def reaggregate(table: DataFrame, period: str, keys: Sequence[str], value: str) -> DataFrame:
    """Sum to one row per period and key tuple, as double, labels filled."""
    return table.groupBy(period, *[fill_unknown(k).alias(k) for k in keys]).agg(
        F.sum(F.col(value).cast("double")).alias(value)
    )


def segment_count(table: DataFrame, keys: Sequence[str], name: str = "segments") -> DataFrame:
    """Number of distinct key tuples; tuples with NULL members count."""
    return table.agg(F.countDistinct(F.struct(*keys)).alias(name))


def segment_profile(weekly: DataFrame, keys: Sequence[str], week: str = "week", value: str = "n") -> DataFrame:
    return weekly.groupBy(*keys).agg(
        F.min(week).alias("first_week"),
        F.max(week).alias("last_week"),
        F.count(F.lit(1)).alias("observed_weeks"),
        F.sum(value).cast("bigint").alias("total"),
    )


def weighted_bins(events: DataFrame, columns: Sequence[Column | str], weight: str = "weight") -> DataFrame:
    """Collapse identical rows to one row with a count."""
    return events.groupBy(*columns).agg(F.count(F.lit(1)).alias(weight))


def weighted_centroid(bins: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y",
                      weight: str = "weight", digits: int = 6) -> DataFrame:
    w = F.sum(weight)
    return bins.groupBy(*keys).agg(
        dround(F.sum(F.col(x) * F.col(weight)) / w, digits).alias("map_x"),
        dround(F.sum(F.col(y) * F.col(weight)) / w, digits).alias("map_y"),
        w.cast("bigint").alias("centroid_weight"),
    )


def centroid(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", digits: int = 6) -> DataFrame:
    return points.groupBy(*keys).agg(
        dround(F.avg(x), digits).alias("centroid_x"),
        dround(F.avg(y), digits).alias("centroid_y"),
        F.count(F.lit(1)).alias("points"),
    )


def dominant_value(df: DataFrame, by: Sequence[str], label: str, amount: Column | None = None,
                   name: str | None = None, count_name: str | None = None) -> DataFrame:
    """Most frequent label per key, ties to the smaller label.

    Two partial aggregations instead of a window: no task holds a key's rows.
    """
    amount = F.count(F.lit(1)) if amount is None else amount
    counts = df.groupBy(*by, label).agg(amount.cast("bigint").alias("__n"))
    best = F.min_by(F.struct(F.col(label).alias("v"), F.col("__n").alias("n")),
                    F.struct((-F.col("__n")).alias("a"), F.col(label).alias("b")))
    out = counts.groupBy(*by).agg(best.alias("__best"))
    columns = [F.col("__best.v").alias(name or f"top_{label}")]
    if count_name:
        columns.append(F.col("__best.n").alias(count_name))
    return out.select(*by, *columns)


def with_total(df: DataFrame, value: str, name: str = "total") -> DataFrame:
    """Attach the grand total as a scalar subquery (one number, no cross join)."""
    return df.withColumn(name, df.agg(F.sum(value)).scalar())


def share_of_total(df: DataFrame, value: str, name: str = "pct_total", digits: int = 2) -> DataFrame:
    return with_total(df, value, "__total").withColumn(
        name, pct(F.col(value), F.col("__total"), digits)
    ).drop("__total")


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """Most frequent values of a column with their share of all rows."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    shares = share_of_total(counts, "rows", "pct", 4)
    return shares.orderBy(F.col("rows").desc(), F.col("value").asc_nulls_last()).limit(n)


def column_profile(df: DataFrame, columns: Sequence[str], exact: bool = False,
                   normalize=None) -> DataFrame:
    """One row per column: rows, missing, distinct, lowest and highest text. One pass.

    ``exact`` counts distinct values per column after a reshape, which shuffles every value
    once; the default keeps a fixed-size sketch per column.
    """
    normalize = normalize or (lambda c: F.col(c).cast("string"))
    texts = df.select(*[normalize(c).alias(c) for c in columns])
    if exact:
        pairs = texts.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in columns
        ])))
        # Count equal values first: a frequent value travels as one row per task.
        counted = pairs.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("k"))
        out = counted.groupBy("column_name").agg(
            F.sum("k").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("missing"),
            F.count("v").alias("distinct_values"),
            F.min("v").alias("low"), F.max("v").alias("high"),
        )
    else:
        stats = []
        for i, c in enumerate(columns):
            stats += [F.count_if(F.col(c).isNull()).alias(f"m{i}"),
                      F.approx_count_distinct(c).alias(f"d{i}"),
                      F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        wide = texts.agg(F.count(F.lit(1)).alias("rows"), *stats)
        out = wide.select("rows", F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing"),
                     F.col(f"d{i}").alias("distinct_values"),
                     F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high"))
            for i, c in enumerate(columns)
        ])))
    missing_pct = pct(F.col("missing"), F.col("rows"), 4)
    return out.select(
        "column_name", "rows", "missing", missing_pct.alias("missing_pct"),
        dround(F.lit(100.0) - missing_pct, 4).alias("present_pct"), "distinct_values", "low", "high",
    )


def column_group_profile(profile: DataFrame, groups: Mapping[str, str]) -> DataFrame:
    """Average and worst missing share per column group. ``groups`` maps column to group."""
    mapping = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    tagged = profile.withColumn("column_group", F.try_element_at(mapping, F.col("column_name")))
    worst = F.min_by("column_name", F.struct((-F.col("missing_pct")).alias("a"), F.col("column_name").alias("b")))
    return tagged.filter(F.col("column_group").isNotNull()).groupBy("column_group").agg(
        F.count(F.lit(1)).alias("columns"),
        dround(F.avg("missing_pct"), 4).alias("avg_missing_pct"),
        F.max("missing_pct").alias("max_missing_pct"),
        worst.alias("worst_column"),
    )


def grouping_levels(stats: DataFrame, dims: Sequence[str], sums: Mapping[str, str],
                    levels: Sequence[Sequence[str]]) -> DataFrame:
    """Sums at several grouping levels in one pass.

    The rows are first summed at the finest grain, so the copies made for the levels are
    copies of that small table and not of the input.
    """
    fine = stats.groupBy(*dims).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    sets = [[F.col(d) for d in level] for level in levels]
    return fine.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        *[F.sum(n).alias(n) for n in sums],
        F.grouping_id(*dims).cast("bigint").alias("level_id"),
    )


def pivot_counts(df: DataFrame, rows: Sequence[str], column: str, values: Sequence,
                 amount: Column, names: Sequence[str] | None = None) -> DataFrame:
    """Crosstab with a fixed column list; absent cells are 0, and values outside the list add up in ``other``."""
    counts = df.groupBy(*rows, column).agg(amount.cast("bigint").alias("__n"))
    names = list(names or [str(v) for v in values])
    cells = [
        F.coalesce(F.sum(F.when(F.col(column) == v, F.col("__n"))), F.lit(0)).cast("bigint").alias(n)
        for v, n in zip(values, names)
    ]
    listed = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    rest = F.coalesce(F.sum(F.when(~listed, F.col("__n"))), F.lit(0)).cast("bigint").alias("other")
    return counts.groupBy(*rows).agg(*cells, rest)


def unknown_volume(weekly: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    """Volume whose label is unknown, one column per dimension."""
    return weekly.agg(*[sum_or_zero(F.col(k) == UNKNOWN, value).alias(f"unknown_{k}") for k in keys])


def label_counts(df: DataFrame, label: str, labels: Sequence[str], aggregates: Sequence[Column],
                 by: Sequence[str] = ()) -> DataFrame:
    """Aggregates per label, with a row for every listed label even when it is absent."""
    spark = df.sparkSession
    want = spark.createDataFrame([(x,) for x in labels], T.StructType([T.StructField(label, T.StringType())]))
    if by:
        groups = df.select(*by).distinct()
        all_labels = F.explode(F.array(*[F.lit(x) for x in labels])).alias(label)
        want = groups.select(*by, all_labels)
    got = df.groupBy(*by, label).agg(*aggregates)
    return want.join(got, [*by, label], "left")
