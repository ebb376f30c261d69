"""Sketches that save a sort or a second look at the events, with exact answers where these are asked for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segpanel.session import materialize

#: Size of a quantile sketch, and rows of a bracket that are counted value by value.
KLL_SIZE, COUNTED_ROWS = 1000, 100_000
GRID = 256


def _join(rows: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Null groups match too; Spark broadcasts the smaller table if it can."""
    other = small.withColumnsRenamed({c: f"{c}__s" for c in by})
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(other[f"{c}__s"]) for c in by], F.lit(True))
    return rows.join(other, same).drop(*[f"{c}__s" for c in by])


def quantiles_within(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float],
                     size: int = KLL_SIZE, limit: int = COUNTED_ROWS) -> DataFrame:
    """``by``, p, value: exact linearly interpolated quantiles of every group, without sorting the rows.

    A KLL sketch of each group brackets the two ranks that a quantile lies between; one more pass counts the rows below and inside the
    bracket, which proves it or leaves the old one standing with twice the margin. Brackets that hold more than ``limit`` rows are cut again. What
    is left is counted value by value, and a running count over those values finds the ranks. ``df`` is read a few times, so
    it should be a written table; null and NaN values don't count, groups without values have no rows.
    """
    if not by:
        raise ValueError("name at least one group column")
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    p = F.explode(F.array(*[F.lit(float(x)) for x in probabilities])).alias("p")
    spot = (F.col("n") - 1).cast("double") * F.col("p")
    bounds = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")).select("*", p)
    bounds = materialize(bounds.select(
        *by, "p", F.floor(spot).alias("first"), F.ceil(spot).alias("last"), (spot % 1.0).alias("share"), "low", "high",
        F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"), F.lit(1.0).alias("margin"), F.lit(False).alias("done")))
    wide = (F.col("inside") > limit) & (F.col("low") < F.col("high")) & ~F.col("done")
    error = 2.296 / size**0.9021  # of a rank, as a share of the rows
    while not bounds.filter(wide).isEmpty():
        held = _join(rows, bounds.filter(wide), by).filter(F.col("__v").between(F.col("low"), F.col("high")))
        keys = [*by, "p"]
        sketches = held.groupBy(*keys).agg(F.kll_sketch_agg_double("__v", F.lit(size)).alias("sketch"))

        # Quantiles come at fixed ranks only: the grid's next one outwards is taken.
        steps = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))

        def cut(rank: Column, sign: int) -> Column:
            at = ((rank - F.col("below")).cast("double") / F.col("inside") + sign * error * F.col("margin")) * GRID
            at = F.floor(at) if sign < 0 else F.ceil(at)
            return F.get("steps", F.greatest(F.lit(0), F.least(F.lit(GRID), at)).cast("int"))
        tried = materialize(_join(bounds.filter(wide), sketches, keys).withColumn("steps", steps).withColumns({"new_low": cut(F.col("first"), -1), "new_high": cut(F.col("last") + 1, 1)}).drop("sketch", "steps"))
        counted = _join(rows, tried.select(*keys, "low", "high", "new_low", "new_high"), by).filter(F.col("__v").between(F.col("low"), F.col("high"))).groupBy(*keys).agg(
            F.count_if(F.col("__v") < F.col("new_low")).alias("under"), F.count_if(F.col("__v").between(F.col("new_low"), F.col("new_high"))).alias("within"))
        told = _join(tried, counted, keys).withColumn("proved", (F.col("below") + F.col("under") <= F.col("first")) & (F.col("last") < F.col("below") + F.col("under") + F.col("within")))
        ok = F.col("proved")
        cutted = told.select(
            *keys, "first", "last", "share", F.when(ok, F.col("new_low")).otherwise(F.col("low")).alias("low"), F.when(ok, F.col("new_high")).otherwise(F.col("high")).alias("high"),
            F.when(ok, F.col("below") + F.col("under")).otherwise(F.col("below")).alias("below"), F.when(ok, F.col("within")).otherwise(F.col("inside")).alias("inside"),
            F.when(ok, F.col("margin")).otherwise(2 * F.col("margin")).alias("margin"),
            # Many rows of few values can't be cut; counting by value copes with them.
            (ok & (F.col("within") > 0.9 * F.col("inside"))).alias("done"))
        bounds = materialize(bounds.filter(~wide).unionByName(cutted))
    values = _join(rows, bounds, by).filter(F.col("__v").between(F.col("low"), F.col("high"))).groupBy(*by, "p", "first", "last", "share", "below", "__v").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*by, "p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("upto", upto)

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("n") <= F.col(rank)), F.col("__v")))
    found = ranked.groupBy(*by, "p", "share").agg(at("first").alias("lo"), at("last").alias("hi"))
    return found.select(*by, "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share")).alias("value"))


def counts_with_distinct(events: DataFrame, period: Column, name: str, keys: Sequence[str], identity: str, log_size: int = 14) -> DataFrame:
    """Period counts with a distinct-count sketch of ``identity`` (null ids don't count): n and ids, which ``roll_up_distinct`` adds up."""
    return events.groupBy(period.alias(name), *keys).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(identity, F.lit(log_size)).alias("ids"))


def roll_up_distinct(counts: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """``by``, n and about, the estimated distinct ids, from the sketches alone.

    The relative standard error is 0.84 / sqrt(2 ** log_size): 0.7 % for 14, and no more for a union of many periods.
    """
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids")).withColumn("about", F.hll_sketch_estimate("ids")).drop("ids")


def distinct_both(df: DataFrame, by: str, identity: str, error: float = 0.05) -> DataFrame:
    """``by``, about, exact: estimated and exact distinct ids of every group; null ids don't count.

    The two are aggregated apart: beside an exact distinct count Spark would hold a sketch for every pair of group and id.
    """
    about = df.groupBy(by).agg(F.approx_count_distinct(identity, error).alias("about"))
    exact = df.groupBy(by).agg(F.countDistinct(identity).alias("exact"))
    return _join(exact, about, [by]).select(by, "about", "exact")


def top_values_counted(df: DataFrame, column: str, n: int, tracked: int = 1000) -> DataFrame:
    """value, rows of the ``n`` most frequent values, as ``top_values`` finds them, with only candidates counted.

    A frequent-items sketch of at most ``tracked`` items gives candidates; their rows are counted exactly. What the sketch doesn't hold
    occurs in at most rows / (0.75 * tracked) rows. If the n-th candidate has more than that, no other value can be among the first n; where that isn't
    proved, all values are counted. Nulls are a value.
    """
    values = df.select(F.col(column).cast("string").alias("value"))
    most = tracked // 4  # of the sketch's estimates; a multiple of what is asked for
    if n >= most:
        raise ValueError("track more items")
    found = values.filter("value is not null").agg(F.expr(f"approx_top_k(value, {most}, {tracked})").alias("top"), F.count("*").alias("rows"))
    found = materialize(found)
    candidates = found.select(F.inline("top")).select(F.col("item").alias("value"))  # at most ``most`` rows
    missed = found.first()["rows"] / (0.75 * tracked)
    counted = values.join(F.broadcast(candidates), "value", "left_semi").groupBy("value").agg(F.count("*").alias("rows"))
    nulls = values.filter("value is null").groupBy("value").agg(F.count("*").alias("rows"))
    first = materialize(counted.unionByName(nulls).orderBy(F.desc("rows"), F.col("value").asc_nulls_last()).limit(n))
    last = first.agg(F.count("*").alias("k"), F.min("rows").alias("least")).first()
    if last["k"] == n and last["least"] > missed:
        return first
    return values.groupBy("value").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.col("value").asc_nulls_last()).limit(n)
