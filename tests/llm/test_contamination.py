"""Decontamination against plain Python on every awkward row."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from segpanel.llm import contamination as leaks
from segpanel.llm.contamination import contamination, without_contaminated
from tests.llm.cases import SCHEMA, documents, nobody, rows

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))


def brute(text, items, span=10):
    own, hit, met = words(text), set(), set()
    for item, other in items:
        other = words(other)
        size = min(span, len(other))
        runs = {tuple(other[i:i + size]) for i in range(len(other) - size + 1)} if other else set()
        for i in range(len(own) - size + 1):
            if tuple(own[i:i + size]) in runs:
                hit |= set(range(i, i + size))
                met.add("" if item is None else str(item))
    return len(own), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


def items():
    long = rows()[9][1]
    return [
        (1, None), (2, ""), (3, " . "), (4, "one two three"), (4, "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"),
        (5, " ".join(long.split()[2000:2100])), (6, "ONE, two; three four five six seven eight nine TEN"), (7, "日本語"), (None, "w3 w4 w5 w6 w7 w8 w9 w10 w11"),
        (10, "one two one two one two one two one two one"), (11, "Document 7 speaks of thing7 and thing8 with number 49 in 2 lines"),
        (11, "Document 7 speaks of thing7 and thing8 with number 49 in 2 lines"), (12, "a"), (12, "there is no such run of words anywhere in these texts at all"),
    ]


def got_rows(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_awkward_rows(spark):
    bench = spark.createDataFrame(items(), ITEMS)
    clash = documents(spark).withColumns({c: F.lit("x") for c in ("words", "k1", "k2", "fp", "at", "size", "met", "copies", "item_id", "_min", "_g1")})
    data = rows() + [(None, rows()[9][1], None, None, None), (None, rows()[9][1], None, None, None)]
    clash = clash.unionByName(spark.createDataFrame(data[-2:], SCHEMA), allowMissingColumns=True)
    want = Counter((d[0], *brute(d[1], items())) for d in data)
    assert got_rows(contamination(clash, bench)) == want
    kept = without_contaminated(clash, bench)
    assert kept.columns == clash.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d[0] for d in data if not brute(d[1], items())[4])


def test_empty_tables(spark):
    bench = spark.createDataFrame(items(), ITEMS)
    assert contamination(nobody(spark), bench).count() == 0
    none = contamination(documents(spark), bench.limit(0)).collect()
    assert len(none) == len(rows()) and not any(r.contaminated or r.n_hit or r.n_items for r in none)
    assert {r.items_sha256 for r in none} == {hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize("span,gram,shuffled", [(10, 4, False), (10, 1, True), (6, 6, False), (7, 3, True)])
def test_every_shared_run_is_found(spark, monkeypatch, span, gram, shuffled):
    """Few different words, so hashes tie and runs overlap; with and without broadcasts."""
    if shuffled:
        monkeypatch.setattr(leaks, "BROADCAST_ROWS", 0)
    random.seed(span * 10 + gram)
    letters = "ab" if span == 10 else "abc"
    texts = [" ".join(random.choice(letters) for _ in range(random.randint(0, 45))) for _ in range(60)]
    bench = [(i, " ".join(random.choice(letters) for _ in range(random.choice([span - 2, span, span + 1, 25])))) for i in range(12)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    want = Counter((i, *brute(t, bench, span)) for i, t in enumerate(texts))
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)
    assert got_rows(contamination(docs, spark.createDataFrame(bench, ITEMS), span, gram)) == want
