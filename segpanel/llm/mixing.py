"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target bytes over its bytes. Each document draws its number of
copies from the Poisson distribution with that mean, by inverting the distribution function at a
hash of document and seed: no counter, no state, the same draw wherever and whenever it is made. Copies
are exploded and ordered by another hash, which shuffles the corpus globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segpanel.llm.stage import shuffle_partitions, staged

#: Sources are broadcast if their steps are at most so many numbers (2 MB); otherwise their table is joined by a shuffle.
BROADCAST_VALUES = 250_000
_DIGITS = 13  # of the hash, in base 16: 52 bits


def hashed(*parts: Column) -> Column:
    """A number from [0, 1) with 52 random bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16 ** _DIGITS))


def with_poisson_steps(rates: DataFrame) -> DataFrame:
    """source_key, steps for rows of source_key, rate: values of the distribution function at 0, 1, 2 ..., so far that 1 minus the last is below 2**-53.

    A row for each source and step, in proportion to the rate. Terms are summed from their logarithms, so a large rate doesn't underflow.
    """
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    terms = rates.select("source_key", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source_key").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = F.sum(F.when(F.col("k") > 0, F.log("rate") - F.log(F.col("k").cast("double"))).otherwise(-F.col("rate"))).over(upto)
    values = terms.withColumn("log", logs).withColumn("value", F.sum(F.exp("log")).over(upto))
    steps = F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"])
    return values.groupBy("source_key").agg(steps.alias("steps"))


def steps_upto(steps: Column, u: Column) -> Column:
    """How many of the ascending ``steps`` are at most ``u``, by bisection."""
    jumps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    return F.aggregate(jumps, F.lit(0), lambda at, jump: F.when((at + jump <= F.size(steps)) & (F.get(steps, at + jump - 1) <= u), at + jump).otherwise(at))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float = 1.0) -> DataFrame:
    """source_key, rows, bytes, rate: mean copies of a document of the source.

    The mixed corpus has about ``total`` times the bytes of ``docs``. Weights are given, or proportional
    to bytes ** power. A source without a given weight gets none. Null and empty sources are one source; a
    text counts its UTF-8 bytes plus one, so that a source of empty texts has a rate too.
    """
    mass = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source_key")).agg(
        F.count("*").alias("rows"), F.sum(mass.cast("long")).alias("bytes"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(power)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        pairs = [F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]
        given = F.create_map(*pairs)[F.col("source_key")] if pairs else F.lit(None).cast("double")
        sizes = sizes.withColumn("weight", F.coalesce(given, F.lit(0.0)))
    sizes = staged(sizes, "source-sizes")
    all_bytes, all_weight = (sizes.agg(F.sum(c)).scalar() for c in ("bytes", "weight"))
    return sizes.withColumns({"all_bytes": all_bytes, "all_weight": all_weight}).select(
        "source_key", "rows", "bytes",
        (F.col("weight") / F.col("all_weight") * F.col("all_bytes") * F.lit(float(total)) / F.col("bytes")).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float = 1.0, seed: int = 7) -> DataFrame:
    """Copies of ``docs`` in a random global order, with copy (from 0), n_copies and order_key.

    A document of a source with rate r appears Poisson(r) times, perhaps never: the expected bytes of every
    source are its share of the target. Rows with equal doc_id draw alike; a row without doc_id draws by
    its text. Columns of ``docs`` that bear the names of the added ones are replaced; all others stay. An
    empty table stays empty.
    """
    columns = [c for c in docs.columns if c not in ("copy", "n_copies", "order_key")]
    rates = staged(with_poisson_steps(source_rates(docs, weights, power, total).filter("rate > 0")), "source-rates")
    held = rates.agg(F.sum(F.size("steps") + 8)).first()[0] or 0
    # The row travels as one value, so its columns can have any names.
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    keyed = docs.select(F.struct(*columns).alias("row"), F.coalesce("source", F.lit("")).alias("source_key"), name.alias("name"))
    drawn = keyed.join(F.broadcast(rates) if held <= BROADCAST_VALUES else rates, "source_key")
    drawn = drawn.withColumn("u", hashed(F.lit(f"copies{seed}"), F.col("name")))
    drawn = drawn.withColumn("n_copies", steps_upto(F.col("steps"), F.col("u"))).drop("steps", "source_key", "u")
    copies = drawn.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    copies = copies.withColumn("order_key", hashed(F.lit(f"order{seed}"), F.col("name"), F.col("copy").cast("string")))
    n = shuffle_partitions(docs.sparkSession)
    out = copies.select(*[F.col("row")[c].alias(c) for c in columns], "n_copies", "copy", "order_key")
    return out.repartitionByRange(n, "order_key").sortWithinPartitions("order_key")
