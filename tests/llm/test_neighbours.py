"""Hash-prefix forest against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segpanel.llm import neighbours
from segpanel.llm.neighbours import dealt, nearest

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(data, k=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in data if v and None not in v and np.isfinite(v).all() and any(v) and i is not None]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = {}
    for q, x in good:
        if q % 20 == 0:
            out[q] = sorted(((-float(np.dot(x, y)), i) for i, y in good if i != q))[:k]
    return out


def table(spark, data):
    return spark.createDataFrame([(i, v, 0) for i, v, *_ in data], SCHEMA).repartition(3)


def answers(spark, data, **more):
    out = {}
    for r in nearest(table(spark, data), F.col("vec_id") % 20 == 0, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def vectors(n, dimension, seed=1, unit=True):
    x = np.random.default_rng(seed).standard_normal((n, dimension))
    return (x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * np.random.default_rng(2).uniform(0.5, 2, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("unit", [True, False])
def test_recall_of_nine_tenths(spark, unit):
    data = [(i, v.tolist()) for i, v in enumerate(vectors(4000, 64, unit=unit))]
    got, want = answers(spark, data), brute(data)
    assert got.keys() == want.keys() and all([r for r, _, _ in a] == list(range(1, 21)) for a in got.values())
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    by_id = dict(data)
    for q, a in got.items():
        assert all(abs(s - np.dot(np.array(by_id[q]), np.array(by_id[i]))) < 1e-12 for _, i, s in a)
        assert [(-s, i) for _, i, s in a] == sorted((-s, i) for _, i, s in a)


def test_odd_vectors_and_copies(spark):
    x = vectors(60, 8)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(100 + i, x[0].tolist()) for i in range(50)] + [data[3], (None, x[1].tolist())]
    data += [(200, None), (220, []), (240, [0.0] * 8), (260, [1.0, None] * 4), (280, [float("nan")] * 8), (300, [float("inf")] * 8), (320, [1.0] * 3)]
    want = brute([d for d in data if d[0] != 320])
    got = answers(spark, data)
    assert got.keys() == want.keys()
    for q in (0, 100, 120, 140):  # the hot vector: its neighbours are its copies, by id
        assert [i for _, i, _ in got[q]] == [i for _, i in want[q]]


def test_few_or_no_vectors(spark):
    data = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, -1.0])]
    assert {q: [i for _, i, _ in a] for q, a in answers(spark, data).items()} == {q: [i for _, i in a] for q, a in brute(data).items()}
    assert answers(spark, [(0, [0.0, 0.0])]) == {} and answers(spark, [(0, [1.0, 2.0])]) == {}


def test_queries_are_dealt_into_bounded_blocks(spark):
    """Every entry meets every query once, in groups that neither side makes large."""
    index, questions = spark.range(2000).withColumnRenamed("id", "rep"), spark.range(0, 2000, 2).withColumnRenamed("id", "rep")
    left, right = dealt(index, questions, 2000, 1000, chunk=200, block=100)
    sizes = [side.groupBy("chunk", "block").count().agg(F.count("*"), F.max("count")).first() for side in (left, right)]
    assert [n for n, _ in sizes] == [100, 100] and sizes[0][1] < 300 and sizes[1][1] < 200
    met = left.select("chunk", "block", F.col("rep").alias("a")).join(right.select("chunk", "block", F.col("rep").alias("q")), ["chunk", "block"])
    assert met.count() == 2000 * 1000 == met.select("a", "q").distinct().count()


def test_blocks_do_not_change_answers(spark, monkeypatch):
    data = [(i, v.tolist()) for i, v in enumerate(vectors(400, 8))]
    want = answers(spark, data)
    monkeypatch.setattr(neighbours, "dealt", lambda *sides: dealt(*sides, chunk=150, block=7))
    assert answers(spark, data) == want and len(want) == 20
