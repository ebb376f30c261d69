"""Descriptive trends, rankings and cross-sections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segpanel.functions import expr as E
from segpanel.functions.expr import UNKNOWN, dround, pct, pct_change
from segpanel.functions.windows import PriorRows
from segpanel.operators.aggregate import centroid, dominant_value, share_of_total, sum_or_zero, with_total
from segpanel.operators.ranks import top_ranked, with_row_id


def period_trend(table: DataFrame, period: Column, name: str, value: str = "n") -> DataFrame:
    """Volume per period with the change from the period before.

    The window runs over calendar periods (weeks at most), never over events.
    """
    totals = table.groupBy(period.alias(name)).agg(F.sum(value).cast("bigint").alias("total"))
    before = F.lag("total").over(Window.orderBy(name))
    return totals.select(
        name, "total", before.alias("prior_total"),
        (F.col("total") - before).alias("change"), pct_change(F.col("total"), before).alias("change_pct"),
    )


def yearly_trend(monthly: DataFrame, month: str = "month", value: str = "n") -> DataFrame:
    return period_trend(monthly, F.year(month).cast("bigint"), "year", value)


def monthly_trend(monthly: DataFrame, month: str = "month", value: str = "n") -> DataFrame:
    trend = period_trend(monthly, F.col(month), month, value)
    return trend.withColumn("label", F.date_format(month, "yyyy-MM"))


def weekly_trend(weekly: DataFrame, week: str = "week", value: str = "n") -> DataFrame:
    return period_trend(weekly, F.col(week), week, value)


def group_ranking(monthly: DataFrame, keys: Sequence[str], month: str = "month", value: str = "n",
                  known_only: str | None = None, top_n: int | None = None) -> DataFrame:
    """Rank key tuples by volume with share and average per active month.

    ``known_only`` drops rows whose label in that column is unknown, from rows and total alike.
    """
    rows = monthly if known_only is None else monthly.filter(F.col(known_only) != UNKNOWN)
    per_month = rows.groupBy(*keys, month).agg(F.sum(value).alias("m"))
    counts = per_month.groupBy(*keys).agg(
        F.sum("m").cast("bigint").alias("total"), F.count(F.lit(1)).alias("active_months")
    )
    shares = share_of_total(counts, "total")
    order = [F.col("total").desc(), *[F.col(k).asc_nulls_last() for k in keys]]
    ranked = top_ranked(shares, order, top_n) if top_n else with_row_id(shares, order, "rank")
    average = dround(F.col("total").cast("double") / F.col("active_months"), 2)
    return ranked.withColumn("avg_per_month", average)


def category_distribution(monthly: DataFrame, category: str, top_n: int, value: str = "n") -> DataFrame:
    """Top categories and one remainder row without rank."""
    counts = monthly.groupBy(category).agg(F.sum(value).cast("bigint").alias("total"))
    top = top_ranked(counts, [F.col("total").desc(), category], top_n)
    grand = counts.agg(F.sum("total")).scalar()
    shown = top.agg(F.sum("total")).scalar()
    other = monthly.sparkSession.range(1).select(
        F.lit(None).cast("bigint").alias("rank"), F.lit("OTHER").alias(category),
        (grand - shown).cast("bigint").alias("total"),
    )
    both = top.select("rank", category, "total").unionByName(other)
    return both.withColumn("pct_total", pct(F.col("total"), grand))


def class_distribution(monthly: DataFrame, column: str, value: str = "n") -> DataFrame:
    counts = monthly.groupBy(column).agg(F.sum(value).cast("bigint").alias("total"))
    return with_row_id(share_of_total(counts, "total"), [F.col("total").desc(), column], "rank")


def hour_pattern(events: DataFrame, time: str) -> DataFrame:
    counts = events.filter(F.col(time).isNotNull()).groupBy(F.hour(time).cast("bigint").alias("hour")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    label = F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00"))
    return share_of_total(counts, "rows").withColumn("label", label)


def weekday_pattern(events: DataFrame, time: str) -> DataFrame:
    """ISO weekday 1 (Monday) to 7 with its English name."""
    day = (F.weekday(time) + 1).cast("bigint")
    counts = events.filter(F.col(time).isNotNull()).groupBy(day.alias("weekday")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    names = F.array(*[F.lit(d) for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
                                         "Saturday", "Sunday")])
    return share_of_total(counts, "rows").withColumn("name", F.element_at(names, F.col("weekday").cast("int")))


def growth_bounds(monthly: DataFrame, window_months: int, month: str = "month") -> DataFrame:
    """Two adjacent windows of whole months that end at the latest month."""
    last = F.col("last")
    return monthly.agg(F.max(month).alias("last")).select(
        F.add_months(last, -(2 * window_months - 1)).alias("previous_start"),
        F.add_months(last, -window_months).alias("previous_end"),
        F.add_months(last, -(window_months - 1)).alias("current_start"),
        last.alias("current_end"),
    )


def growth(monthly: DataFrame, keys: Sequence[str], direction: str, top_n: int, min_previous: int = 100,
           window_months: int = 12, month: str = "month", value: str = "n") -> DataFrame:
    """Fastest growing or shrinking key tuples between the two windows."""
    if direction not in ("up", "down"):
        raise ValueError("direction must be up or down")
    bounds = growth_bounds(monthly, window_months, month).select(F.struct("*")).scalar()
    rows = monthly.withColumn("__b", bounds)
    for k in keys:
        rows = rows.filter(F.col(k) != UNKNOWN)
    m = F.col(month)
    rows = rows.filter((m >= F.col("__b.previous_start")) & (m <= F.col("__b.current_end")))
    is_current = m >= F.col("__b.current_start")
    sums = rows.groupBy(*keys).agg(
        sum_or_zero(is_current, value).alias("current"), sum_or_zero(~is_current, value).alias("previous")
    )
    enriched = sums.filter((F.col("previous") >= min_previous) & (F.col("previous") > 0)).select(
        *keys, "previous", "current", (F.col("current") - F.col("previous")).alias("change"),
        pct_change(F.col("current"), F.col("previous")).alias("change_pct"),
    )
    way = (lambda c: F.col(c).desc()) if direction == "up" else (lambda c: F.col(c).asc())
    return top_ranked(enriched, [way("change_pct"), way("change"), *keys], top_n)


def area_map_summary(points: DataFrame, area: str = "area", grp: str = "grp", cat: str = "cat") -> DataFrame:
    """Per area: rank, dominant group, count, share, centroid, top category."""
    rows = points.filter(F.col(area).isNotNull() & F.col(grp).isNotNull()).select(
        E.fill_unknown(area).alias(area), grp, E.fill_unknown(cat).alias(cat), "x", "y"
    )
    # One pre-aggregation over the points serves the centroid, the count and both labels.
    fine = rows.groupBy(area, grp, cat).agg(F.count(F.lit(1)).alias("k"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    base = fine.groupBy(area).agg(
        dround(F.sum("sx") / F.sum("k"), 6).alias("centroid_x"), dround(F.sum("sy") / F.sum("k"), 6).alias("centroid_y"),
        F.sum("k").alias("total"))
    groups = dominant_value(fine, [area], grp, F.sum("k"), grp)
    cats = dominant_value(fine, [area], cat, F.sum("k"), "top_cat", "top_cat_count")
    joined = base.join(groups, area, "left").join(cats, area, "left")
    shares = share_of_total(joined, "total", "pct_valid")
    return with_row_id(shares, [F.col("total").desc(), grp, area], "rank")


def heatmap_cells(points: DataFrame, size: float, limit: int, grp: str = "grp", cat: str = "cat") -> DataFrame:
    """Busiest cells with share of all valid points, dominant group and top category."""
    cell = ["cell_x", "cell_y"]
    rows = points.select(
        E.grid_snap("x", size).alias("cell_x"), E.grid_snap("y", size).alias("cell_y"),
        E.fill_unknown(grp).alias(grp), E.fill_unknown(cat).alias(cat),
    )
    # One pre-aggregation serves the count and both labels.
    fine = rows.groupBy(*cell, grp, cat).agg(F.count(F.lit(1)).alias("k"))
    counts = with_total(fine.groupBy(*cell).agg(F.sum("k").alias("total")), "total", "__all")
    top = top_ranked(counts, [F.col("total").desc(), "cell_y", "cell_x"], limit)
    groups = dominant_value(fine, cell, grp, F.sum("k"), "dominant_grp")
    cats = dominant_value(fine, cell, cat, F.sum("k"), "top_cat", "top_cat_count")
    return top.join(groups, cell, "left").join(cats, cell, "left").withColumn(
        "pct_total", pct(F.col("total"), F.col("__all"))
    ).drop("__all")


def coordinate_coverage(events: DataFrame, eligible: Column, valid: Column) -> DataFrame:
    out = events.agg(F.count_if(eligible).alias("eligible_rows"), F.count_if(eligible & valid).alias("valid_rows"))
    return out.withColumn("valid_pct", pct(F.col("valid_rows"), F.col("eligible_rows"), 4))


def rolling_mean(table: DataFrame, keys: Sequence[str], period: str, n: int, min_periods: int,
                 value: str = "n", name: str = "rolling_mean") -> DataFrame:
    """Mean of the current and the n-1 rows before it."""
    return table.withColumn(name, PriorRows(keys, period, value).moving_mean(n, min_periods))


def _first(rows: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """All rows, or the first n of a report."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def recent_vs_prior(events: DataFrame, keys: Sequence[str], time: str, days: int = 90,
                    min_total: int = 100, limit: int | None = None) -> DataFrame:
    """Count per key tuple in the last days against the same span before."""
    last = events.agg(F.max(time)).scalar()
    age = F.datediff(last, F.col(time))
    rows = events.filter(age < 2 * days)
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    counts = rows.groupBy(*keys).agg(
        F.count_if(age < days).alias("recent"), F.count_if(age >= days).alias("prior")
    ).filter(F.col("recent") + F.col("prior") >= min_total)
    change = F.col("recent") - F.col("prior")
    out = counts.select(
        *keys, "recent", "prior", change.alias("change"),
        dround(F.when(F.col("prior") > 0, change * 100.0 / F.col("prior")), 4).alias("change_pct"),
        F.abs(change).alias("magnitude"),
        F.when(change > 0, "increase").when(change < 0, "decrease").otherwise("no change").alias("direction"),
    )
    return _first(out, limit, F.col("change").desc(), *keys)


def monthly_zscore(monthly: DataFrame, keys: Sequence[str], month: str = "month", value: str = "n",
                   months: int = 12, min_prior: int = 6, limit: int | None = None) -> DataFrame:
    """Months far above the trailing observed months of their key tuple."""
    sums = monthly.groupBy(month, *keys).agg(F.sum(value).cast("bigint").alias("total"))
    prior = PriorRows(keys, month, "total")
    scored = sums.select(
        month, *keys, "total", prior.mean(months).alias("mean"), prior.std_sample(months).alias("std"),
        prior.count(months).alias("prior_months"),
    ).filter((F.col("prior_months") >= min_prior) & (F.col("std") > 0))
    z = dround((F.col("total") - F.col("mean")) / F.col("std"), 4)
    out = scored.select(month, *keys, "total", dround("mean", 4).alias("trailing_mean"),
                        dround("std", 4).alias("trailing_std"), z.alias("z_score"))
    return _first(out, limit, F.col("z_score").desc(), month, *keys)


def crosstab(df: DataFrame, keys: Sequence[str], min_rows: int = 0, value: Column | None = None) -> DataFrame:
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) if value is None else value).cast("bigint").alias("rows"))
    return counts.filter(F.col("rows") >= min_rows) if min_rows else counts


def grid_density(points: DataFrame, digits: int, min_rows: int = 10, limit: int | None = None) -> DataFrame:
    """Rounded-grid density; distinct labels come from a second, smaller aggregation."""
    cell = ["cell_x", "cell_y"]
    rows = points.select(E.grid_round("x", digits).alias("cell_x"), E.grid_round("y", digits).alias("cell_y"),
                         "cat", "grp")
    fine = rows.groupBy(*cell, "cat", "grp").agg(F.count(F.lit(1)).alias("k"))
    out = fine.groupBy(*cell).agg(
        F.sum("k").alias("rows"), F.countDistinct("cat").alias("cats"), F.countDistinct("grp").alias("grps")
    ).filter(F.col("rows") >= min_rows)
    return _first(out, limit, F.col("rows").desc(), *cell)


def lag_distribution(df: DataFrame, days: Column) -> DataFrame:
    label = E.bucketize(days, E.LAG_EDGES, E.LAG_LABELS)
    counts = df.select(label.alias("lag_bucket")).filter(F.col("lag_bucket").isNotNull()).groupBy("lag_bucket").agg(
        F.count(F.lit(1)).alias("rows")
    )
    return share_of_total(counts, "rows", "pct", 4)


def lag_summary(df: DataFrame, lags: Mapping[str, Column], probabilities: Sequence[float],
                long_after: int = 30) -> DataFrame:
    """Count, mean, exact quantiles and out-of-range counts of named whole-number lags, in one pass.

    Equal lags are counted first; quantiles then work on one row per distinct lag, of which
    there are no more than calendar days or hours.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), v.cast("bigint").alias("v")) for n, v in lags.items()]))
    counted = df.select(pairs).filter(F.col("v").isNotNull()).groupBy("measure", "v").agg(
        F.count(F.lit(1)).alias("k")
    )
    quantiles = [
        dround(F.percentile("v", F.lit(float(p)), F.col("k")), 4).alias(f"p{int(round(p * 100))}")
        for p in probabilities
    ]
    return counted.groupBy("measure").agg(
        F.sum("k").alias("rows"),
        dround(F.sum(F.col("v") * F.col("k")).cast("double") / F.sum("k"), 4).alias("mean"),
        *quantiles,
        sum_or_zero(F.col("v") < 0, "k").alias("negative"),
        sum_or_zero(F.col("v") > long_after, "k").alias("over_limit"),
    )
