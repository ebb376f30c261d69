"""Hard negatives against plain Python, and the intervals against exact products."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segpanel.llm import hard_negatives as hard
from segpanel.llm.hard_negatives import Index, codes, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, is_anchor, positives=5, negatives=3):
    good = {}
    for i, v, label in data:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good[i, label, tuple(max(-hard.LARGEST, min(hard.LARGEST, math.floor(256 * float(np.float32(x))))) for x in v)] = True
    usual = Counter(len(k[2]) for k in good).most_common(1)[0][0] if good else 0
    good = [k for k in good if len(k[2]) == usual]
    out = []
    for a in good:
        if not is_anchor(a[0]):
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b) for b in good if b is not a]
        best = sorted((x for x in scored if x[1][1] == a[1]), key=lambda x: (-x[0], x[1][0]))[:positives]
        for p, row in best:
            inside = sorted((-s, b[0]) for s, b in scored if b[1] != a[1] and 50 * p <= 100 * s <= 95 * p)[:negatives]
            out += [(a[0], row[0], k + 1, b, p, -s) for k, (s, b) in enumerate(inside)]
    return Counter(out)


def got(df):
    return Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def vectors(n, dimension, seed, labels=4, rounded=False):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((labels, dimension))
    out = []
    for i in range(n):
        v = centres[random.integers(labels)] * 0.7 + random.standard_normal(dimension)
        v = np.round(v) if rounded else v / np.linalg.norm(v)
        out.append((i, [float(x) for x in v.astype(np.float32)], int(random.integers(labels))))
    return out


@pytest.mark.parametrize("n,dimension,rounded", [(300, 16, False), (200, 3, True), (120, 100, False), (40, 1, True)])
def test_equals_brute_force(spark, monkeypatch, n, dimension, rounded):
    """Small chunks and blocks, so that many of both meet; rounded vectors tie."""
    monkeypatch.setattr(hard, "BLOCK", 7)
    data = vectors(n, dimension, n, rounded=rounded)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = brute(data, lambda i: i % 5 == 0)
    assert want and got(hard_negatives(df, F.col("vec_id") % 5 == 0)) == want


def test_awkward_rows(spark):
    data = vectors(60, 8, 3)
    nan, inf = float("nan"), float("inf")
    bad = [(None, data[0][1], 1), (100, None, 1), (105, [], 1), (110, [None] * 8, 1), (115, [nan] * 8, 1), (120, [inf] * 8, 1), (125, [1.0] * 7, 1),
           (130, data[1][1], None), (135, [0.0] * 8, 2), (140, [3e38] * 8, 1), (145, [-3e38] * 8, 2)]
    repeats = [data[5], data[5], (5, data[6][1], 0), (200, data[5][1], data[5][2]), (205, data[5][1], (data[5][2] + 1) % 4)]
    rows = data + bad + repeats
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "key", "asks", "chunk", "block", "code", "blocks")})
    assert got(hard_negatives(df, F.col("vec_id") % 5 == 0)) == brute(rows, lambda i: i % 5 == 0)
    assert hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives(df.filter("label = 9"), F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives(df, F.lit(False)).collect() == []


def test_intervals_hold_and_save_work():
    random = np.random.default_rng(0)
    v = np.floor(256 * random.standard_normal((500, 64)) / 8).astype(np.int64)
    v[0], v[1] = 0, 1 << 20
    made = codes(v.astype(float), 5)
    table = pa.table({"vec_id": np.arange(500), "key": np.arange(500), "label": np.zeros(500, np.int32), "ones": made["ones"], "align": made["align"], "rest": made["rest"],
                      "turned": made["turned"], "code": [c.tobytes() for c in made["code"]], "v": pa.array(v.tolist())})
    index = Index(table, 64, 5)
    low, high = index.intervals(v[:40])
    exact = v[:40] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    norms = np.linalg.norm(v[:40], axis=1)[:, None] * np.linalg.norm(v, axis=1)
    assert np.median(((high - low) / np.maximum(norms, 1))[2:, 2:]) < 0.5
