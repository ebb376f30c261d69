"""Line dedup against a plain loop over all pairs of lines."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from segpanel.llm.line_dedup import dedup_lines, within_one_edit
from tests.llm.cases import SCHEMA, documents, nobody, rows

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(data, min_words=8):
    """(doc_id, n_lines, n_exact, n_near, text) of each document; equal rows are one document."""
    distinct, order = {}, sorted({(d[0] is None, d[0] or 0, d[1] or "") for d in data})
    ids = [d for d in order]
    hash_order = {}
    firsts: list[list[str]] = []
    seen: set[tuple] = set()
    out = {}
    for no_id, doc, text in ids:
        gone, n, exact, near = [], 0, 0, 0
        for i, line in enumerate(text.split("\n")):
            words = WORDS.findall(line)
            if not words:
                continue
            n += 1
            if tuple(words) in seen:
                exact += 1
                gone.append(i)
            else:
                if len(words) >= min_words and any(len(f) >= min_words and within_one_edit(f, words) for f in firsts):
                    near += 1
                    gone.append(i)
                seen.add(tuple(words))
                firsts.append(words)
        out[no_id, doc, text] = (n, exact, near, "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
    return out


def edits():
    rng = np.random.default_rng(4)
    base = [[f"b{k}w{i}" for i in range(int(rng.integers(5, 20)))] for k in range(12)]
    data = []
    for doc in range(60):
        lines = []
        for _ in range(6):
            words = list(base[int(rng.integers(0, len(base)))])
            for _ in range(int(rng.integers(0, 3))):
                kind, at = rng.integers(0, 3), int(rng.integers(0, len(words)))
                if kind == 0:
                    words[at] = f"x{rng.integers(0, 4)}"
                elif kind == 1:
                    del words[at]
                else:
                    words.insert(at, f"y{rng.integers(0, 4)}")
            lines.append(" ".join(words))
        data.append((doc, "\n".join(lines), "en", "s", 1))
    return data


def test_one_edit_of_a_word():
    a = "a b c d".split()
    assert all(within_one_edit(a, b.split()) for b in ("a b c d", "a x c d", "b c d", "a b c", "a b x c d", "x a b c d", "a b c d x"))
    assert not any(within_one_edit(a, b.split()) for b in ("a x c y", "b a c d", "b c", "x b c d y", "b c d e"))
    assert within_one_edit("a a a".split(), "a a".split()) and within_one_edit([], ["x"])


def test_lines_equal_the_plain_loop(spark):
    data = [d for d in edits() + [(100 + i, d[1], *d[2:]) for i, d in enumerate(rows()) if d[0] != rows()[6][0]]]
    want = brute(data)
    docs = spark.createDataFrame(data, SCHEMA).withColumn("n_near", F.lit("clash")).repartition(4)
    got = dedup_lines(docs).collect()
    assert len(got) == len(data) and {*docs.columns} < {*got[0].asDict()}
    for r in got:
        source = next(d for d in data if d[0] == r.doc_id)
        assert (r.n_lines, r.n_exact, r.n_near, r.text or "") == want[False, r.doc_id, source[1] or ""], r.doc_id
        assert (r.text is None) == (source[1] is None)
    assert sum(r.n_near for r in got) > 50


def test_repeated_rows_and_missing_ids(spark):
    line = "one two three four five six seven eight nine"
    data = [(5, line, None, None, 1), (5, line, None, None, 1), (None, line + " ten", None, None, 1), (7, line + " ten", None, None, 1), (8, "x\n\n" + line, None, None, 1)]
    got = Counter((r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == Counter({(5, line): 2, (None, ""): 1, (7, ""): 1, (8, "x\n"): 1})
    assert dedup_lines(nobody(spark)).count() == 0 and dedup_lines(documents(spark)).count() == len(rows())
