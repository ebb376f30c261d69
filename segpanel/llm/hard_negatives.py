"""Hard negatives by rotated one-bit codes with stored alignment.

Components are whole numbers. An index entry keeps the signs of its vector under a fixed set of random rotations (its
code), the alignment of vector and code (how much of the vector the code's direction holds) and the length of the rest.
An anchor's rotated components are rounded to a few bits, so its product with a code is a sum of population counts, with a
known rounding error. With w the code turned back, x = a w/|w| + r and r at right angles to w, the product of the anchor q
with x is a <q, w>/|w| + <q, r>, and by Cauchy and Schwarz |<q, r>| is at most |r| times the part of q at right angles to w:
every score lies in a known interval, whatever the data. An entry whose interval cannot reach the k-th best lower bound
(or the band asked for) is left out; all others are scored in whole numbers. So results are exact, and the codes only save work.

Anchors are a stated set. They meet the index in blocks: entries are dealt into chunks, anchors into blocks of bounded size,
positives within each label, negatives over all. Each chunk gives its best few for each anchor, and these are merged.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segpanel.llm.stage import shuffle_partitions, staged

#: Most entries of a chunk and anchors of a block; fewer where the table would otherwise not fill the shuffle's partitions.
CHUNK = 65_536
BLOCK = 16_384
PLANES = 6
#: Larger components (after scaling) are drawn in to this, so that a score of 64 of them fits a long.
LARGEST = 1 << 28
_AT_ONCE = 32
_ENTRY = "vec_id long, key long, label int, v array<long>, code binary, ones int, align double, rest double, turned double"


@lru_cache(maxsize=2)
def rotations(dimension: int, seed: int) -> np.ndarray:
    """Random rotations side by side, for about 1,024 signs: dimension x (rotations * dimension)."""
    random = np.random.default_rng(seed)
    n = min(64, max(2, -(-1024 // dimension)))
    return np.concatenate([np.linalg.qr(random.standard_normal((dimension, dimension)))[0] for _ in range(n)], axis=1)


def _bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(signs, axis=1)
    out = np.zeros((len(signs), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, :packed.shape[1]] = packed
    return out.view(np.uint64)


def codes(vectors: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """code, ones (set bits), align (product with the unit vector of the code turned back), rest (length of what it leaves), turned (its length)."""
    turn = rotations(vectors.shape[1], seed)
    signs = vectors @ turn > 0
    back = np.where(signs, 1.0, -1.0) @ turn.T  # sums over the rotations of the codes turned back
    turned = np.linalg.norm(back, axis=1)
    align = np.einsum("ij,ij->i", vectors, back) / np.maximum(turned, 1e-300)
    square = np.einsum("ij,ij->i", vectors, vectors)
    return {"code": _bits(signs), "ones": signs.sum(axis=1), "align": align, "rest": np.sqrt(np.maximum(square - align**2, 0)), "turned": turned}


def with_codes(rows: DataFrame, dimension: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made = codes(_matrix(batch.column("v"), dimension).astype(np.float64), seed)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("vec_id", "key", "label", "v")], pa.array([c.tobytes() for c in made["code"]], pa.binary()),
                pa.array(made["ones"].astype(np.int32)), *[pa.array(made[c]) for c in ("align", "rest", "turned")]], [c.split()[0] for c in _ENTRY.split(", ")])
    return rows.select("vec_id", "key", "label", "v").mapInArrow(run, _ENTRY)


def _matrix(column, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


class Index:
    """Entries of one chunk."""

    def __init__(self, table: pa.Table, dimension: int, seed: int):
        self.seed = seed
        self.id, self.key, self.label, self.ones = (table.column(c).to_numpy() for c in ("vec_id", "key", "label", "ones"))
        self.align, self.rest, self.turned = (table.column(c).to_numpy() for c in ("align", "rest", "turned"))
        self.v = _matrix(table.column("v"), dimension)
        self.code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(len(self.id), -1)
        self.norm = np.sqrt(self.align**2 + self.rest**2)

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the product of every anchor with every entry."""
        q = anchors.astype(np.float64)
        z = q @ rotations(q.shape[1], self.seed)
        low, high = z.min(axis=1, keepdims=True), z.max(axis=1, keepdims=True)
        step = np.maximum((high - low) / ((1 << PLANES) - 1), 1e-300)
        level = np.clip(np.rint((z - low) / step), 0, (1 << PLANES) - 1).astype(np.int64)
        rounded = low + level * step
        error = np.abs(z - rounded).sum(axis=1, keepdims=True)
        counts = np.zeros((len(q), len(self.id)), np.int64)
        word = np.empty((len(q), len(self.id)), np.uint64)
        for p in range(PLANES):
            plane = _bits((level >> p) & 1 == 1)
            for w in range(self.code.shape[1]):
                np.bitwise_and(plane[:, w, None], self.code[None, :, w], out=word)
                counts += np.bitwise_count(word).astype(np.int64) << p
        # The product with the signs: twice what falls on positive ones, less the sum of all.
        product = 2 * (low * self.ones + step * counts) - rounded.sum(axis=1, keepdims=True)
        turned = np.maximum(self.turned, 1e-300)
        along, off = product / turned, error / turned
        square = np.einsum("ij,ij->i", q, q)[:, None]
        across = np.sqrt(np.maximum(square - np.maximum(np.abs(along) - off, 0) ** 2, 0))
        half = np.abs(self.align) * off + self.rest * across + 1e-6 * (1 + np.sqrt(square) * self.norm)
        middle = self.align * along
        return middle - half, middle + half

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.v[at] @ anchor


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _first(index: Index, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((index.key[at], index.id[at], -scores))[:k]


def best_of_label(index: Index, anchors: Index, k: int) -> list[tuple]:
    """(anchor, its key, entry, its key, score) of the ``k`` best entries of each anchor's label besides itself."""
    out = []
    for a in range(0, len(anchors.id), _AT_ONCE):
        low, high = index.intervals(anchors.v[a:a + _AT_ONCE])
        for i in range(len(low)):
            me = a + i
            may = (index.label == anchors.label[me]) & ((index.id != anchors.id[me]) | (index.key != anchors.key[me]))
            at = np.flatnonzero(may & (high[i] >= _kth(low[i][may], k)))
            scores = index.scores(anchors.v[me], at)
            out += [(anchors.id[me], anchors.key[me], index.id[at[j]], index.key[at[j]], scores[j]) for j in _first(index, at, scores, k)]
    return out


def best_in_bands(index: Index, anchors: Index, wanted: list[list[int]], k: int, percent: tuple[int, int]) -> list[tuple]:
    """(anchor, its key, positive score, entry, score) of the ``k`` best entries of other labels in the band of each positive score."""
    out = []
    for a in range(0, len(anchors.id), _AT_ONCE):
        low, high = index.intervals(anchors.v[a:a + _AT_ONCE])
        for i in range(len(low)):
            me = a + i
            other = index.label != anchors.label[me]
            for score in wanted[me]:
                least, most = -(-percent[0] * score // 100), percent[1] * score // 100
                if least > most:
                    continue
                sure = other & (low[i] >= least) & (high[i] <= most)
                at = np.flatnonzero(other & (low[i] <= most) & (high[i] >= max(least, _kth(low[i][sure], k))))
                scores = index.scores(anchors.v[me], at)
                inside = (scores >= least) & (scores <= most)
                at, scores = at[inside], scores[inside]
                out += [(anchors.id[me], anchors.key[me], score, index.id[at[j]], index.key[at[j]], scores[j]) for j in _first(index, at, scores, k)]
    return out


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({n: pa.array([int(x) for x in c], pa.int64()) for n, c in zip(names, columns)})


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null if the vector is null, empty, or holds null or non-finite components."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    values = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))))
    return F.when(x.isNotNull() & (F.size(x) > 0) & ~bad, values)


def hard_negatives(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95),
                   id_column: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each component x becomes floor(256 * x); a score is the inner product of these whole numbers. For every anchor (a row with
    ``is_anchor``) and each of its ``positives`` best other rows of its label, the ``negatives`` best rows of other labels whose score lies within
    ``percent`` of the positive's. Ties go to the smaller id. Fewer rows: all there are; a pair without such rows is left out.
    Rows without id or label, and rows whose vector is null, empty, holds null or non-finite components or has another number of
    components than most vectors, take no part. Rows alike in id, label and vector are one; rows with equal id alone are rows of
    their own. Components beyond 2**28 after scaling count as 2**28. Other columns are not looked at. An empty table gives no rows.
    """
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), whole(F.col(vector)).alias("v"), is_anchor.alias("asks"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null")
    usual = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if usual is None:
        return rows.sparkSession.createDataFrame([], schema)
    dimension = usual["size"]
    rows = rows.filter(F.size("v") == dimension).withColumn("key", F.xxhash64("label", "v"))
    distinct = rows.groupBy("vec_id", "label", "key", "v").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    index = staged(with_codes(distinct.select("vec_id", "label", "key", "v"), dimension, seed), "codes")
    anchors = staged(distinct.filter("asks").select("vec_id", "key").join(index, ["vec_id", "key"]), "anchors")

    # Positives: chunks and blocks of one label each.
    n = index.count()
    chunk = max(1_024, min(CHUNK, -(-n // shuffle_partitions(rows.sparkSession))))
    parts = staged(index.groupBy("label").agg(F.count("*").alias("rows")).join(
        anchors.groupBy("label").agg(F.count("*").alias("asking")), "label").select(
        "label", F.ceil(F.col("rows") / chunk).cast("int").alias("chunks"), F.ceil(F.col("asking") / BLOCK).cast("int").alias("blocks")), "label-parts")

    def dealt(side: DataFrame, own: str, other: str, name: str) -> DataFrame:
        """Each row in its own part, and once for each part of the other side."""
        return side.withColumn(own, F.pmod(F.xxhash64("vec_id", "key", F.lit(name)), F.col(own + "s")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1))).drop("chunks", "blocks")
    names = ["anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score"]

    def near(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], names)
        return _table(best_of_label(Index(left, dimension, seed), Index(right, dimension, seed), positives), names)
    group = ["label", "chunk", "block"]
    left, right = dealt(index.join(parts, "label"), "chunk", "block", "entry"), dealt(anchors.join(parts, "label"), "block", "chunk", "anchor")
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(near, ", ".join(f"{c} long" for c in names))
    by_score = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("positive_score"), "positive_id", "positive_key")
    pairs = staged(found.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= positives).drop("nth"), "positives")

    # Negatives: every chunk meets every block of anchors with their positives' scores.
    asked = pairs.groupBy("anchor_id", "anchor_key").agg(F.collect_set("positive_score").alias("scores"))
    asked = staged(anchors.join(asked.withColumnsRenamed({"anchor_id": "vec_id", "anchor_key": "key"}), ["vec_id", "key"]), "asked")
    counts = {"chunks": F.lit(max(1, -(-n // chunk))), "blocks": F.lit(max(1, -(-asked.count() // BLOCK)))}
    names2 = ["anchor_id", "anchor_key", "positive_score", "negative_id", "negative_key", "negative_score"]

    def far(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], names2)
        return _table(best_in_bands(Index(left, dimension, seed), Index(right, dimension, seed), right.column("scores").to_pylist(), negatives, percent), names2)
    left, right = dealt(index.withColumns(counts), "chunk", "block", "entry"), dealt(asked.withColumns(counts), "block", "chunk", "anchor")
    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(far, ", ".join(f"{c} long" for c in names2))
    by_score = Window.partitionBy("anchor_id", "anchor_key", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative_key")
    best = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives)
    return pairs.join(best, ["anchor_id", "anchor_key", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB SQL: every anchor against every row.
ORACLE = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same,
  CAST(list_sum(list_transform(list_zip(a.v, e.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3"""
