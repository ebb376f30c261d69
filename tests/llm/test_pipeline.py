"""The pipeline against the brute-force versions of its stages, and the registered queries."""

import math
import zlib
from collections import Counter

import numpy as np
from public_tokenizers import path as tokenizer_path

import corpus_pipeline
from tests.llm.cases import SCHEMA, rows
from tests.llm.test_line_dedup import brute as brute_lines, edits
from tests.llm.test_native import brute_copies, brute_features, four_languages
from tests.llm.test_similar_sets import brute_components, near_copies
from tests.llm.test_tokens import WORD, ids


def brute_pipeline(data):
    """Rows of the packing without places. Too few labels for a cutoff, so the base rules decide alone."""
    kept = []
    for d in data:
        n, *_, again, _ = brute_features(d[1])
        if n >= 20 and 100 * again <= 30 * n:
            kept.append(d)
    lines = brute_lines(kept)
    cleaned = []
    for d in kept:
        n, exact, near, text = lines[d[0] is None, d[0] or 0, d[1] or ""]
        if exact + near == 0 or exact + near < n:
            cleaned.append((d[0], text, d[2], d[3], len(text)))
    groups = {(doc, component) for doc, _, component in brute_components(cleaned)}
    alone = [d for d in cleaned if (d[0], d[0]) in groups]
    sizes = Counter()
    for d in alone:
        sizes[d[3] or ""] += len(d[1].encode()) + 1
    weights = {s: math.sqrt(n) for s, n in sizes.items()}
    rates = {s: weights[s] / sum(weights.values()) * sum(sizes.values()) / n for s, n in sizes.items()}
    mixed = [d for d in alone for _ in range(brute_copies(str(d[0]), rates[d[3] or ""]))]
    out = Counter()
    for d, i in zip(mixed, ids(WORD, [d[1] for d in mixed])):
        tokens = np.array([*i, 1], "<u4")
        for at in range(0, len(tokens), 2048):
            part = tokens[at:at + 2048]
            out[d[0], at, len(part), zlib.crc32(part.tobytes()), len(tokens)] += 1
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    seen, data = set(), []
    for d in [*rows(), *[(500 + i, d[1].replace("\n", " filler\n") * 2, *d[2:]) for i, d in enumerate(edits())], *near_copies()]:
        if d[0] not in seen:
            seen.add(d[0])
            data.append(d)
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == brute_pipeline(data)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]] and sum(n for _, n in held) <= 2048


def test_pipeline_rejects_junk_with_enough_labels(spark, tmp_path):
    docs, labels = four_languages()
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = [d for d in docs if d[0] // 4 % 10]
    assert out == {doc for doc, *_ in brute_pipeline(good)}


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert tokenizer_path("byte_bpe_50k.json").endswith(".json")
