"""Sharding by a weighted hash tree: regions hold racks, racks hold shards.

At each level every child draws ``-ln(u) / weight`` with u a hash of the key and the child's name, and
the smallest draw wins, so a child is chosen in proportion to its weight. A child whose weight does
not change keeps its draws: when weights change, keys move only into or out of the subtrees whose weight
changed. A shard added as a region of its own takes keys into itself alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segpanel.llm.stage import shuffle_partitions, staged


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def uniform_tree(shards: int, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """``shards`` shards of equal weight, ``per_rack`` in a rack and ``racks`` racks in a region."""
    return [Leaf(f"r{i // (racks * per_rack)}", f"k{i // per_rack}", i) for i in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, as a region of its own: keys only move into it."""
    i = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"own{i}", f"own{i}", i, weight)]


def draw(key: Column, level: str, child: str, weight: float, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{seed}/{level}/{child}")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def _choice(key: Column, level: str, children: Iterable[tuple[str, float]], seed: int) -> Column:
    """Name of the child with the smallest draw."""
    draws = [F.struct(draw(key, level, c, w, seed).alias("d"), F.lit(c).alias("c")) for c, w in children if w > 0]
    return draws[0]["c"] if len(draws) == 1 else F.array_min(F.array(*draws))["c"]


def _sums(leaves: Iterable[Leaf], name) -> dict[str, float]:
    out: dict[str, float] = {}
    for leaf in leaves:
        out[name(leaf)] = out.get(name(leaf), 0.0) + leaf.weight
    return out


def descend(rows: DataFrame, key: Column, tree: list[Leaf], out: str, seed: int = 0) -> DataFrame:
    """Add the shard of ``key``: draw a region, then one of its racks, then one of the rack's shards."""
    if not tree or sum(leaf.weight for leaf in tree) <= 0:
        raise ValueError("the tree has no weight")
    columns = [c for c in rows.columns if c != out]
    # The row travels as one value, so its columns can have any names.
    rows, key = rows.select(F.struct(*columns).alias("row"), key.alias("key")), F.col("key")
    regions = _sums(tree, lambda leaf: leaf.region)
    rows = rows.withColumn("region", _choice(key, "region", regions.items(), seed))
    rack = shard = None
    for region, weight in regions.items():
        if weight > 0:
            racks = _sums((x for x in tree if x.region == region), lambda leaf: leaf.rack)
            chosen = _choice(key, "rack", racks.items(), seed)
            rack = (F if rack is None else rack).when(F.col("region") == region, chosen)
    rows = rows.withColumn("rack", F.concat_ws("/", "region", rack))
    for place, weight in _sums(tree, lambda leaf: f"{leaf.region}/{leaf.rack}").items():
        if weight > 0:
            shards = [(str(x.shard), x.weight) for x in tree if f"{x.region}/{x.rack}" == place]
            shard = (F if shard is None else shard).when(F.col("rack") == place, _choice(key, "shard", shards, seed))
    return rows.select(*[F.col("row")[c].alias(c) for c in columns], shard.cast("int").alias(out))


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add ``slot``: 0, 1, 2 ... within each shard, in the order of a hash of ``order``.

    The hash's range is cut into as many parts as the shuffle has partitions; a shard is numbered part by
    part and moved up by the counts of the parts before (shards x parts rows, which Spark broadcasts only if they are
    small), so no task holds a shard.
    """
    n = shuffle_partitions(rows.sparkSession)
    spread = rows.withColumn("_h", F.xxhash64(*order)).withColumn(
        "_part", F.least(F.floor(F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53)) * n), F.lit(n - 1)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy(shard, "_part").agg(F.count("*").alias("_n")).select(
        shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = spread.withColumn("_at", F.row_number().over(Window.partitionBy(shard, "_part").orderBy(
        F.shiftrightunsigned("_h", 11), *order)) - 1)
    return numbered.join(bases, [shard, "_part"]).withColumn(
        "slot", (F.col("_base") + F.col("_at")).cast("long")).drop("_h", "_part", "_at", "_base")


def shard_documents(docs: DataFrame, tree: list[Leaf], key: str = "doc_id", seed: int = 0, out: str = "shard") -> DataFrame:
    """``docs`` with the column ``out``: only the key and the tree decide, so no row is shuffled.

    Rows with equal keys share a shard; rows whose key is null share one. Null, empty and long texts are
    not looked at. An existing column called ``out`` is replaced. An empty table stays empty.
    """
    return descend(docs.drop(out), F.col(key), tree, out, seed)


def shard_digests(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, and the shard each document has with one shard more.

    A null text counts as empty. Rows with equal doc_id share both shards, and so do all rows without one; each has a slot of its
    own, in the order of a hash of doc_id, text and size (ties: these themselves). Long texts are read once, whole, for their size and
    checksum. Other columns are not looked at. An empty table gives no rows.
    """
    tree = uniform_tree(shards)
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = shard_documents(shard_documents(narrow, tree, seed=seed), grown(tree), seed=seed, out="grown_shard")
    slotted = with_slots(staged(placed, "shards"), "shard", ["doc_id", "text_crc32", "size"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
