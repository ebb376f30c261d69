"""Spelling variants against plain Python; the index search against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from segpanel.llm import spelling
from segpanel.llm.spelling import near_pairs, near_words, spelling_forms, suffix_array, vocabulary
from tests.llm.cases import SCHEMA, documents, nobody, rows

import numpy as np

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_words(data, least=7, often=2):
    out = Counter()
    for doc, text, *_ in data:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            out[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= often}


def brute(data):
    words = brute_words(data)
    forms, out = {}, []
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        out.append((w, len(others)))

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w
    return {(w, forms[w], root(w), words[w], k, words[forms[w]] if forms[w] else None) for w, k in out}


def texts():
    """Frequent words, variants of variants, letters beyond ASCII, capitals, ties, very long words."""
    random.seed(4)
    out = []
    base = ["accommodate", "necessary", "straßenbahn", "éléphants", "prefixword", "aaaaaaaa", "überraschung", "x" * 3000, "ÀÀÀÀÀÀÀà"]
    for w in base:
        out += [w] * 120
        for k in range(12):
            i = random.randrange(len(w))
            v = random.choice([w[:i] + w[i + 1:], w[:i] + "q" + w[i:], w[:i] + "é" + w[i + 1:]])
            out += [v] * random.choice([1, 2, 2, 5, 11])
            out += [v[:-1] + "z"] * 2
    out += ["chainworda"] * 400 + ["chainwordab"] * 30 + ["chainwordabb"] * 2
    out += ["prefixwor"] * 30 + ["prefixwords"] * 30 + ["prefixwortt"] * 2 + ["Necessary", "NECESSARY", "short", "a×b÷cdefg", "a×b÷cdefg"]
    random.shuffle(out)
    return [(i, " ".join(out[i * 40:(i + 1) * 40]) + ("-" if i % 2 else ",x1y"), "en", "s", 1) for i in range(len(out) // 40 + 1)]


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_equals_brute_force(spark):
    data = texts() + rows() + [(None, "unwritten unwritten unwriten unwriten", None, None, None)] * 3
    df = spark.createDataFrame(data, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("run", "word", "n", "half", "role", "kind", "near")})
    want = brute(data)
    assert any(f is not None and f != r for _, f, r, *_ in want)
    out = spelling_forms(df)
    assert out.count() == len(want) and got(out) == want


def test_no_words(spark):
    assert spelling_forms(nobody(spark)).collect() == []
    assert spelling_forms(spark.createDataFrame([(1, "a few short words", None, None, None), (2, None, None, None, None)], SCHEMA)).collect() == []
    assert got(spelling_forms(spark.createDataFrame([(1, "lonesome lonesome", None, None, None)], SCHEMA), garble=0)) == {("lonesome", None, "lonesome", 2, 0, None)}


def test_words_are_counted_whole(spark):
    got_words = {r.word: r.n for r in vocabulary(documents(spark)).collect()}
    assert got_words == brute_words(rows())


@pytest.mark.parametrize("part", [5, 40, 10_000])
def test_hot_halves_are_split(spark, part):
    """Half of the words share a half; small parts split it into blocks."""
    random.seed(part)
    words = {"common" + "".join(random.choice("abc") for _ in range(random.randint(4, 6))) for _ in range(80)}
    words |= {"".join(random.choice("abcdé") for _ in range(random.randint(2, 5))) for _ in range(120)}
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    found = Counter((r.word, r.near, r.near_n) for r in near_pairs(df, part).collect())
    assert found == Counter((a, b, len(b)) for a in words for b in words if near(a, b))


def test_index_search_equals_all_pairs():
    random.seed(9)
    for size in (1, 2, 50, 300):
        words = sorted({bytes(random.choice(b"ab\xe9") for _ in range(random.randint(2, 8))) for _ in range(size)})
        pairs = set()
        for last in (False, True):
            own = [w[::-1] for w in words] if last else words
            pairs |= {(int(a), int(b)) for a, b in zip(*near_words(own, own, last))}
        assert pairs == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}


def test_suffixes_are_sorted():
    for data in (b"\0", b"banana\0", b"#aa#aa#a#" * 30 + b"\0", bytes(random.choices(b"ab#", k=500)) + b"\0"):
        order = suffix_array(np.frombuffer(data, np.uint8))
        assert list(order) == sorted(range(len(data)), key=lambda i: data[i:])
    assert spelling.PART > 0
