"""Token counts, token files and packing against the tokenizers library."""

import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from segpanel.llm.packing import cutting_stock, pack_documents
from segpanel.llm.token_counts import count_tokens, token_counts
from segpanel.llm.token_files import pack, unpack, write_token_files
from segpanel.llm.tokens import IdTable, encoded, piece_keys, piece_text
from tests.llm.cases import documents, nobody, rows

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def ids(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_join_to_the_text():
    for _, text, *_ in rows():
        assert "".join(map(piece_text, piece_keys(text or ""))) == (text or "")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_counts_equal_the_library(spark, path):
    data = rows()
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(documents(spark), path).collect())
    want = Counter((d[0], len((d[1] or "").encode()), len(i), len(i) > 1024) for d, i in zip(data, ids(path, [d[1] for d in data])))
    assert got == want


def test_counts_keep_other_columns(spark):
    clash = documents(spark).withColumnRenamed("n_chars", "n_tokens")
    assert count_tokens(clash, BYTE).columns == ["doc_id", "text", "lang", "source", "n_tokens"]
    assert token_counts(nobody(spark), BYTE).count() == 0


def test_codes_round_trip():
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        assert (unpack(*pack(values[:n]), n) == values[:n]).all()


def test_token_files_round_trip(spark):
    data = rows()
    want = Counter((d[0], *i, 2) for d, i in zip(data, ids(BYTE, [d[1] for d in data])))
    files = write_token_files(documents(spark), BYTE, end_id=2)
    back = files.documents().orderBy("start").collect()
    assert Counter((r.doc_id, *r.ids) for r in back) == want
    assert [r.doc_id for r in back] == sorted(d[0] for d in data)
    assert [r.start for r in back] == [0, *np.cumsum([r.n_tokens for r in back])[:-1]]
    crcs = {(r.start, r.ids_crc32) for r in files.digests().collect()}
    assert crcs == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in back}
    counts = Counter(t for row in want.elements() for t in row[1:])
    assert [r.n for r in files.ranks.orderBy("rank").collect()] == sorted(counts.values(), reverse=True)


def test_token_files_of_nothing(spark):
    assert write_token_files(nobody(spark), BYTE, end_id=2).digests().count() == 0


def test_token_files_keep_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in write_token_files(docs, BYTE, 2).digests().orderBy("start").collect()] == [(None, 0), (1, 3)]


def test_packing_is_whole_and_tight(spark):
    data = rows()
    got = pack_documents(documents(spark), WORD, end_id=1, capacity=256, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for d, i in zip(data, ids(WORD, [d[1] for d in data])):
        all_ids = np.array([*i, 1], "<u4")
        want[d[0], len(all_ids)] += [(a, len(all_ids[a:a + 256]), all_ids[a:a + 256].tobytes()) for a in range(0, len(all_ids), 256)]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for held in by_sequence.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]] and sum(n for _, n in held) <= 256
    total = sum(r.length for r in got)
    assert len(by_sequence) <= 1.08 * total / 256 + 1
    assert pack_documents(nobody(spark), WORD, end_id=1).count() == 0


def test_cutting_stock_covers_the_demand():
    rng = np.random.default_rng(3)
    sizes, demand = np.arange(1, 65), rng.integers(0, 900, 64)
    sizes, demand = sizes[demand > 0], demand[demand > 0]
    plan = cutting_stock(sizes, demand, 64)
    assert (sum(p * n for p, n in plan) == demand).all() and all(p @ sizes <= 64 for p, _ in plan)
    rooms = np.zeros(65, np.int64)  # best fit, largest first
    for size, n in zip(sizes[::-1], demand[::-1]):
        for _ in range(n):
            fit = next((r for r in range(size, 64) if rooms[r]), 64)
            rooms[fit] -= fit < 64
            rooms[fit - size] += 1
    assert sum(n for _, n in plan) <= rooms.sum() + len(sizes)


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("most", [0, 7, 1000])
def test_ids_equal_the_library_however_few_are_kept(path, most):
    texts = [t for _, t, *_ in rows()] + ["don't", "Ça--va?! l'été, été. Été\nÉté,\nx_y z_ _", "<|endoftext|>a <|endoftext|>, b", "ﬁx e\u0301t\u00e9, \u00df!", "a" * 300, "a,' b'. c'd", "w[x] y[] z<"]
    table = IdTable(path, "I", most)
    for part in (texts[:40], texts[20:], texts, texts[::-1]):
        got, sizes = encoded(pa.array(part, pa.string()), table, "I", 2)
        want = [[*i, 2] for i in ids(path, part)]
        assert got.tolist() == [t for i in want for t in i] and sizes.tolist() == list(map(len, want))


def test_id_tables_are_small():
    """A worker keeps its table while the next stages run, beside them in the executor's memory."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(150_000)]
    table = IdTable(BYTE, "H")
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    for k in range(0, len(words), 30_000):
        encoded(pa.array([" ".join(words[k:k + 30_000])]), table, "H")
    python, arrow = tracemalloc.get_traced_memory()[0], pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert python + arrow < 80 * len(words)
