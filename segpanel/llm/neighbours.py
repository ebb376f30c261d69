"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree gives every vector a long hash string; its characters are cross-polytope hashes (the axis, of a
random rotation, to which the vector is nearest, with its sign). Lengths are evened out by one more
coordinate, so the largest inner product is the smallest angle. A query descends in every tree to the
strings with which it shares the longest prefix, and ascends in all trees together, one character at a
time, until the trees offer enough candidates: the size of every prefix group is counted beforehand, so
the level where a query stops is known. The index is dealt into chunks of bounded size and the queries into
blocks of bounded size, and each chunk meets each block in a group of its own; in a chunk each tree is a sorted
array in which a prefix is a range, found by binary search. Chunks are dealt by a hash, so a query that is offered
N^0.8 entries has some in most chunks, and no chunk is left out for it.

All candidates of the level are taken and scored on the original vectors in double precision. Equal
vectors are one entry with its k + 1 smallest ids: no more of them can be among k neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segpanel.llm.stage import staged

LENGTH = 3
#: Index entries in a chunk, and queries in a block that meets it.
CHUNK = 8_192
BLOCK = 8_192
QUERY_BLOCK = 256


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


@lru_cache(maxsize=2)
def rotations(trees: int, dimension: int, seed: int) -> np.ndarray:
    """A random rotation for each tree and character."""
    random = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(random.standard_normal((dimension, dimension)))[0] for _ in range(trees * LENGTH)]).astype(np.float32)


def bits(dimension: int) -> int:
    return max(1, (2 * (dimension + 1) - 1).bit_length())


def hash_strings(vectors: np.ndarray, longest: float, query: bool, trees: int, seed: int) -> np.ndarray:
    """Each vector's string in each tree, as an integer of ``LENGTH`` characters."""
    norms = np.linalg.norm(vectors, axis=1)
    extra = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(longest**2 - norms**2, 0))
    scaled = vectors * (longest / norms)[:, None] if query else vectors
    x = np.column_stack([scaled, extra]).astype(np.float32)
    out = np.zeros((len(x), trees), np.int64)
    for k, rotation in enumerate(rotations(trees, x.shape[1], seed)):
        y = x @ rotation
        axis = np.abs(y).argmax(axis=1)
        character = 2 * axis + (y[np.arange(len(y)), axis] > 0)
        out[:, k // LENGTH] = (out[:, k // LENGTH] << bits(vectors.shape[1])) | character
    return out


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def with_strings(vectors: DataFrame, longest: float, dimension: int, query: bool, trees: int, seed: int) -> DataFrame:
    """Add ``strings`` (array<long>) to rep, vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = hash_strings(_matrix(batch.column("vector"), dimension), longest, query, trees, seed)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, strings.size + 1, trees, dtype=np.int32)), pa.array(strings.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vector"), flat], ["rep", "vector", "strings"])
    return vectors.select("rep", "vector").mapInArrow(run, "rep long, vector array<double>, strings array<long>")


def _prefixes(rows: DataFrame, width: int) -> DataFrame:
    return rows.select("rep", F.posexplode("strings").alias("tree", "string")).select(
        "rep", "tree", F.posexplode(F.array(*[F.shiftright("string", width * (LENGTH - level)) for level in range(1, LENGTH + 1)])).alias("at", "prefix")
    ).select("rep", "tree", (F.col("at") + 1).alias("level"), "prefix")


def stop_levels(index: DataFrame, queries: DataFrame, width: int, enough: int) -> DataFrame:
    """rep, level: the longest prefix length at which the trees together offer ``enough`` entries; 0 if none does."""
    strings = index.select(F.posexplode("strings").alias("tree", "string")).groupBy("tree", "string").agg(F.count("*").alias("n"))
    sizes = None
    for level in range(LENGTH, 0, -1):  # from counts of whole strings to counts of ever shorter prefixes
        one = strings.groupBy("tree", F.shiftright("string", width * (LENGTH - level)).alias("prefix")).agg(F.sum("n").alias("n")).withColumn("level", F.lit(level))
        sizes = one if sizes is None else sizes.unionByName(one)
    met = _prefixes(queries, width).join(sizes, ["tree", "level", "prefix"]).groupBy("rep", "level").agg(F.sum("n").alias("n"))
    stops = met.filter(F.col("n") >= enough).groupBy("rep").agg(F.max("level").alias("level"))
    return queries.select("rep").join(stops, "rep", "left").select("rep", F.coalesce("level", F.lit(0)).alias("level"))


def _search(key, index: pa.Table, queries: pa.Table, dimension: int, trees: int, width: int, most: int) -> pa.Table:
    """Best candidates in one chunk: q, rep, score."""
    x, names = _matrix(index.column("vector").combine_chunks(), dimension), index.column("rep").to_numpy()
    strings = index.column("strings").combine_chunks().flatten().to_numpy().reshape(-1, trees)
    orders = [np.argsort(strings[:, t], kind="stable") for t in range(trees)]
    arrays = [strings[o, t] for t, o in enumerate(orders)]
    q_all, q_names, levels = _matrix(queries.column("vector").combine_chunks(), dimension), queries.column("rep").to_numpy(), queries.column("level").to_numpy()
    q_strings = queries.column("strings").combine_chunks().flatten().to_numpy().reshape(-1, trees)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q_all), QUERY_BLOCK):
        q, level = q_all[a:a + QUERY_BLOCK], levels[a:a + QUERY_BLOCK]
        candidate = np.zeros((len(q), len(x)), bool)
        candidate[level == 0] = True  # the root
        down = np.flatnonzero(level > 0)
        shift = width * (LENGTH - level[down])
        for t in range(trees):
            prefix = q_strings[a + down, t] >> shift
            low = np.searchsorted(arrays[t], prefix << shift)
            size = np.searchsorted(arrays[t], (prefix + 1) << shift) - low
            rows = np.repeat(down, size)
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            candidate[rows, orders[t][inside]] = True
        # A block product is cheaper than gathering; only candidates are ranked.
        scores = np.where(candidate, q @ x.T, -np.inf)
        for i in range(len(q)):
            n = int(candidate[i].sum())
            if n:
                bound = np.partition(scores[i], len(x) - min(n, most))[len(x) - min(n, most)]
                at = np.flatnonzero(scores[i] >= bound - 1e-9 * max(1.0, abs(bound)))
                exact = np.array([float(np.dot(q[i], x[j])) for j in at])
                best = np.lexsort((names[at], -exact))[:most]
                found.append((np.full(len(best), q_names[a + i]), names[at][best], exact[best]))
    q, rep, score = (np.concatenate(c) if found else np.empty(0) for c in (zip(*found) if found else ((), (), ())))
    return pa.table({"q": pa.array(q, pa.int64()), "rep": pa.array(rep, pa.int64()), "score": pa.array(score, pa.float64())})


def dealt(index: DataFrame, questions: DataFrame, n: int, n_questions: int, chunk: int = CHUNK, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``chunk`` and ``block``: an entry goes to its chunk in every block, a query to its block in every chunk."""
    chunks, blocks = max(1, -(-n // chunk)), max(1, -(-n_questions // block))
    left = index.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.lit(chunks)).cast("int"))
    right = questions.withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.lit(blocks)).cast("int"))
    return (left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))),
            right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, trees: int = 64, seed: int = 11, power: float = 0.8,
            id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of every query among all other rows.

    score is the inner product in double precision; ties go to the smaller id. A query ascends until the trees
    offer N ** ``power`` entries of the N in the index (an entry counts in each tree that offers it) and k + 1
    different ones besides its own at least; all entries of that level are taken. Rows whose vector is null, empty, zero, holds null or non-finite
    components, or has another number of components than most vectors take no part, nor do rows without id.
    Rows with equal id and vector are one. Other columns are not looked at. Fewer than ``k`` other
    vectors: all of them. No usable vectors: no rows.
    """
    ids = embeddings.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks"))
    ids = ids.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("vector", F.transform("vector", lambda c: c + F.lit(0.0)))
    usual = ids.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return ids.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    dimension = usual["size"]
    ids = ids.filter(F.size("vector") == dimension)
    kept = ids.select("vector", "id").withColumn("nth", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("nth") <= k + 1)
    entries = staged(kept.groupBy("vector").agg(F.min("id").alias("rep"), F.sort_array(F.collect_set("id")).alias("ids")), "entries")
    askers = staged(ids.filter("asks").join(entries.select("vector", "rep"), "vector").select(F.col("id").alias("query_id"), "rep").distinct(), "askers")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, c: s + c * c))
    facts = entries.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    n, width = facts["n"], bits(dimension)
    index = staged(with_strings(entries, facts["longest"], dimension, False, trees, seed), "forest")
    questions = entries.join(askers.select("rep").distinct(), "rep", "left_semi")
    questions = staged(with_strings(questions, facts["longest"], dimension, True, trees, seed), "questions")
    # Entries of one tree differ, so trees * (k + 2) of them are at least k + 2 different ones, the query's own among them.
    enough = max(int(np.ceil(n**power)), trees * (k + 2))
    levels = staged(stop_levels(index, questions, width, enough), "levels")
    left, right = dealt(index, questions.join(levels, "rep"), n, questions.count())
    most = k + 1

    def search(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _search(key, a, b, dimension, trees, width, most)
    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(search, "q long, rep long, score double")
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).filter(F.col("nth") <= most)
    spread = best.join(entries.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    spread = spread.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("nth") <= most)
    answers = askers.join(spread, askers["rep"] == spread["q"]).filter("vec_id != query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
