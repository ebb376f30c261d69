"""N-gram Jaccard join against all pairs."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from segpanel.llm.components import components
from segpanel.llm.similar_sets import Scheme, jaccard_components, one_of_each, signatures
from segpanel.llm.words import shingle_sets, word_hashes
from tests.llm.cases import SCHEMA, documents, nobody, rows

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute_set(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute_components(data):
    sets = [brute_set(d[1]) for d in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(data):
        least[find(i)] = min(least.get(find(i), d[0]), d[0])
    return Counter((d[0], len(sets[i]), least[find(i)]) for i, d in enumerate(data))


def near_copies():
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    out = []
    for i in range(60):  # a chain and a star of edits
        words = list(base[: 60 + 5 * i])
        for k in rng.integers(0, len(words), i % 7):
            words[k] = f"e{i}x{k}"
        out.append(" ".join(words))
    for i in range(60):
        out.append(" ".join([f"u{i}w{j}" for j in range(int(rng.integers(3, 300)))] + passage))
    for n in range(1, 14):  # short sets that differ in one word
        out += [" ".join(f"s{j}" for j in range(n)), " ".join(f"s{j}" for j in range(n - 1)) + " other", " ".join(f"S{j}" for j in range(n + 1))]
    return [(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(out)]


def test_word_hashes_tell_words_apart():
    texts = [b"a b\tc", b"", b"  \n", "é\x0bA a".encode(), b"x" * 5_000_000 + b" y", b"y " * 3_000_000]
    h, text, place = word_hashes(texts)
    assert np.bincount(text, minlength=6).tolist() == [3, 0, 0, 3, 2, 3_000_000] and len(set(h.tolist())) == 7
    assert len(set(h[-3_000_000:].tolist()) | {h[7]}) == 1
    assert word_hashes([b"A b"], lower=True)[0].tolist() == word_hashes([b"a B"], lower=True)[0].tolist()


def test_similar_sets_share_enough_signatures():
    data = [d[1].encode() for d in near_copies()] + [(d[1] or "").encode() for d in rows()]
    shingles, counts = shingle_sets(data, 5)
    assert counts.tolist() == [len(brute_set(d.decode())) for d in data]
    ends = np.cumsum(counts)
    sets = [set(shingles[e - n:e].tolist()) for n, e in zip(counts, ends)]
    scheme = Scheme()
    item_set, bands, needs, owner, value = signatures(shingles, counts, scheme)
    own = [dict(set=s, band=b, need=n, values=set()) for s, b, n in zip(item_set, bands, needs)]
    for o, v in zip(owner, value):
        own[o]["values"].add(int(v))
    by_set = {}
    for x in own:
        by_set.setdefault(x["set"], []).append(x)
    linked = 0
    for i in by_set:
        for j in by_set:
            n = len(sets[i] & sets[j])
            if i < j and scheme.similar(n, len(sets[i]), len(sets[j])):
                linked += 1
                assert any(x["band"] == y["band"] and len(x["values"] & y["values"]) >= max(x["need"], y["need"], 1)
                           or x["band"] == y["band"] and min(x["need"], y["need"]) == 1 and x["values"] & y["values"]
                           for x in by_set[i] for y in by_set[j]), (i, j)
    assert linked > 300


def test_components_of_links(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (2000, 2))] + [(i, i + 1) for i in range(5000, 5400)] + [(9000, i) for i in range(9001, 9800)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_groups_equal_all_pairs(spark):
    data = rows() + near_copies()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(data, SCHEMA).repartition(5)).collect())
    assert got == brute_components(data)
    assert jaccard_components(nobody(spark)).count() == 0


def test_groups_of_test_documents_equal_all_pairs(spark):
    from tests.compare import TESTDATA

    path = f"{TESTDATA}/sf0.01/documents.parquet"
    data = [(r["doc_id"], r["text"]) for r in pq.read_table(path).to_pylist()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.read.parquet(path)).collect())
    assert got == brute_components(data)


def test_one_of_each_group_stays(spark):
    data = near_copies() + [(None, near_copies()[0][1], "en", "s", 1), (7, "", None, None, None), (8, None, None, None, None), (1000, near_copies()[0][1], "en", "s", 1)]
    want = brute_components(near_copies())
    kept = one_of_each(spark.createDataFrame(data, SCHEMA).withColumn("root", F.lit(1))).collect()
    assert sorted(r.doc_id for r in kept) == sorted([7, 8, *{c for _, _, c in want}])


def test_large_group_of_near_copies(spark):
    """Copies with one to six edits of their own or from a small pool, copies of copies, and no original: groups as all pairs give them, from few pairs."""
    import segpanel.llm.similar_sets as module

    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(150)]
    out = []
    for i in range(220):
        words = list(base) if i < 150 else out[int(rng.integers(0, i))].split()
        for _ in range(int(rng.integers(1, 7))):
            at = int(rng.integers(0, len(words)))
            new = ["x", "y", f"own{i}"][int(rng.integers(0, 3))]
            words[at:at + int(rng.integers(0, 2))] = [new]
        out.append(" ".join(words))
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate(out)]
    counted = {}
    original = module.staged

    def counting(df, name):
        table = original(df, name)
        counted[name] = counted.get(name, 0) + table.count()
        return table
    module.staged = counting
    try:
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(data, SCHEMA).repartition(4)).collect())
    finally:
        module.staged = original
    want = brute_components(data)
    assert got == want and 5 < len({c for _, _, c in want}) < 200
    assert counted["cross-pairs"] < 220 * 219 / 2 / 10  # of all pairs; many share edits here
