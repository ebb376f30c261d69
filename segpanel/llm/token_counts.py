"""Token counts by heap-and-linked-list byte-pair merging, without ids.

A word starts as one symbol for each of its bytes, in a doubly linked list. A heap holds the adjacent
pairs that the merge table knows, lowest rank first and then leftmost; popping a pair that still
stands merges it and pushes the two new neighbours. A word's count is its symbols minus its merges:
O(n log n), so a word of a million letters is no special case.
"""

from __future__ import annotations

import gc
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segpanel.llm.tokens import PieceTable, TokenizerFile, WordTable


class MergeCounter:
    """Number of tokens of a word, by the merge ranks of a tokenizers BPE file."""

    def __init__(self, file: TokenizerFile):
        pairs = (m if isinstance(m, list) else m.split(" ") for m in file.spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.suffix = file.suffix

    def count(self, symbols: list[str]) -> int:
        n = len(symbols)
        if n < 2:
            return n
        rank = self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or rank((symbols[i], symbols[j])) != r:
                continue  # one side has been merged since
            symbols[i] += symbols[j]
            symbols[j] = None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left


@lru_cache(maxsize=4)
def count_table(path: str) -> PieceTable:
    """Piece -> number of tokens. One table for each worker process."""
    import regex

    gc.disable()  # millions of strings and no cycles
    file = TokenizerFile(path)
    if file.pattern is None:
        raise ValueError(f"{path} splits texts in a way that this counter doesn't know")
    counter = MergeCounter(file)

    def of_word(word: str) -> int:
        symbols = list(file.symbols(word))
        symbols[-1] += counter.suffix
        return counter.count(symbols)
    words = WordTable(of_word).__getitem__
    specials = regex.compile("|".join(map(regex.escape, sorted(file.special, key=len, reverse=True))))
    fold, find = file.folds, file.pattern.findall

    def value(text: str) -> int:
        if file.special and "<" in text or not text.isascii():
            parts = specials.split(text) if file.special else [text]
            return len(parts) - 1 + sum(sum(map(words, file.words(p))) for p in parts)
        return sum(map(words, find(text.lower() if fold else text)))
    return PieceTable(value)


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of ``text`` (column ``out``, long); every other column stays.

    Null and empty texts have 0 tokens; special strings inside a text count as one token each, as the
    library's default does; nothing is truncated. A column called ``out`` is replaced. Repeated rows are
    counted each; an empty table gives an empty table.
    """
    schema = docs.drop(out).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = count_table(path)
        for batch in batches:
            counts = [sum(table.of(t)) if t else 0 for t in batch.column(text).to_pylist()]
            names = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(counts, pa.int64())], [*names, out])
    return docs.mapInArrow(run, schema)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8 bytes of the text), n_tokens, over_limit (n_tokens > ``limit``)."""
    counted = count_tokens(docs.select("doc_id", "text"), path)
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
