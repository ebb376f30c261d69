"""Line dedup with a deletion-neighbourhood join.

Two lines are near if one edit of a word (put in, taken out or changed) makes them equal; lines of fewer
than ``min_words`` words must be equal. A line goes if an earlier one (by doc_id, then line number) is
equal (the same words in a row) or near; the earliest stays.

Deleting one word of a line in each way gives its variants, as 64-bit hashes. Lines whose variants
without word i are equal differ in word i at most: that is a group in which the earliest decides, so
minima are enough and no pairs are made. A line that equals a variant of another is one word shorter.
Only lines that share one half with another line can be near one, so only these get variants, and
only for deletions in the other half. What was found by hash is verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segpanel.llm.stage import staged
from segpanel.llm.words import _POWERS, by_size, mix, word_hashes

_U = np.uint64
#: Keys of lines or documents are broadcast to the texts if they hold at most so many values (of 8 bytes about);
#: otherwise they are joined by a shuffle.
BROADCAST_VALUES = 4_000_000
_KEYS = ("k0", "k1", "k2", "k3")
LINES = "doc_id long, text_key long, line_no int, n int, h long, k0 long, k1 long, k2 long, k3 long"
POSITION = ("no_id", "doc_id", "text_key", "line_no")


class LineHashes:
    """Hashes of lines and of parts of lines: sums of word hashes times powers, by prefix sums."""

    def __init__(self, words: np.ndarray, line: np.ndarray):
        self.first = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.empty(0, np.int64)
        self.last = np.append(self.first[1:], len(line)) if len(line) else self.first
        self.n = self.last - self.first
        self.up, self.down = _POWERS.get(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, _U)
        np.cumsum(words * self.up[:len(words)], out=self.sums[1:])

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def whole(self) -> np.ndarray:
        return _tagged(self.part(self.first, self.last), self.n)

    def halves(self) -> list[np.ndarray]:
        """Keys of the first and the last half, for partners of as many words and of one word less."""
        out = []
        for m in (self.n, self.n - 1):
            half = m // 2
            out.append(_tagged(self.part(self.first, self.first + half), 2 * m + (1 << 40)))
            out.append(_tagged(self.part(self.last - half, self.last), 2 * m + 1 + (1 << 40)))
        return out

    def without(self, line: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Whole hash of each ``line`` without its word ``i``."""
        a, b = self.first[line], self.last[line]
        return _tagged(self.part(a, a + i) + self.part(a + i + 1, b) * self.up[i], self.n[line] - 1)


def _tagged(x: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return mix(x ^ mix(tag.astype(_U) + _U(0x51ED270B)))


def line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """``LINES``: a row for each line with a word; the half keys are null in lines too short to be near."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a, b in by_size(texts):
                words, text, place = word_hashes(texts[a:b])
                joined = b"\n".join(texts[a:b]) + b"\n"
                breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
                line = np.searchsorted(breaks, place)
                sizes = np.array([len(t) + 1 for t in texts[a:b]])
                first_line = np.searchsorted(breaks, np.cumsum(sizes) - sizes)
                h = LineHashes(words, line)
                owner = text[h.first]
                short = h.n < min_words
                at = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(at), batch.column("text_key").take(at),
                    pa.array((line[h.first] - first_line[owner]).astype(np.int32)), pa.array(h.n.astype(np.int32)), pa.array(h.whole().view(np.int64)),
                    *[pa.array(k.view(np.int64), mask=short) for k in h.halves()]], [c.split()[0] for c in LINES.split(", ")])
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(run, LINES)


def variant_rows(lines: DataFrame) -> DataFrame:
    """key, at (deleted word, -1: none), h for lines (h, text, open: which half keys are shared)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shared = [t.encode() for t in batch.column("text").to_pylist()], batch.column("open").to_pylist()
            for a, b in by_size(texts, 300_000):
                words, line, _ = word_hashes(texts[a:b])
                h = LineHashes(words, line)
                own, deleted = [np.arange(b - a)], [np.full(b - a, -1)]
                for k in range(b - a):
                    n, open_keys = int(h.n[k]), shared[a + k]
                    low, high = n, 0
                    for key, m in zip(range(4), (n, n, n - 1, n - 1)):
                        if open_keys[key]:
                            low, high = (min(low, m // 2), high) if key % 2 == 0 else (low, max(high, n - m // 2))
                    i = np.arange(n)
                    i = i[(i >= low) | (i < high)]
                    own.append(np.full(len(i), k))
                    deleted.append(i)
                own, deleted = np.concatenate(own), np.concatenate(deleted)
                gone = deleted >= 0
                key = h.whole()[own]
                key[gone] = h.without(own[gone], deleted[gone])
                name = batch.column("h").to_numpy()[a:b][own]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(deleted.astype(np.int32)), pa.array(name)], ["key", "at", "h"])
    return lines.select("h", "text", "open").mapInArrow(run, "key long, at int, h long")


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """True if one word put in, taken out or changed at most makes the lists equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    tail = next((i for i in range(short) if a[-1 - i] != b[-1 - i]), short)
    return head + tail >= max(len(a), len(b)) - 1


def _position() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line_no")


def _bounded(rows: DataFrame, values: Column) -> DataFrame:
    """``rows`` (a written table of ``values`` values in each row) marked for a broadcast if they are small."""
    held = rows.agg(F.sum(values)).first()[0] or 0
    return F.broadcast(rows) if held <= BROADCAST_VALUES else rows


def _verified(pairs: DataFrame) -> DataFrame:
    """h of the pairs (h, left, right) whose lines are near indeed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = " \t\n\x0b\x0c\r"
        table = str.maketrans(space, " " * len(space))
        for batch in batches:
            words = [[[w for w in t.translate(table).split(" ") if w] for t in batch.column(c).to_pylist()] for c in ("left", "right")]
            yield pa.RecordBatch.from_arrays([batch.column("h")], ["h"]).filter(pa.array([within_one_edit(a, b) for a, b in zip(*words)], pa.bool_()))
    return pairs.select("h", "left", "right").mapInArrow(run, "h long")


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """h of every distinct line to which an earlier one is near. ``distinct``: h, n, first (position), half keys; written."""
    halves = distinct.filter("k0 is not null").select("h", F.posexplode(F.array(*_KEYS)).alias("which", "half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("x"), F.max("h").alias("y")).filter("x < y").select("half")
    flags = F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.array_contains("found", k))
    wanted = halves.join(shared, "half", "left_semi").groupBy("h").agg(F.collect_set("which").alias("found")).select("h", flags.alias("open"))
    wanted = staged(wanted.join(distinct, "h").select("h", "open", "first"), "half-shared")
    keys = _bounded(wanted.select("h", "open", F.col("first.doc_id").alias("_d"), F.col("first.text_key").alias("_k"), F.col("first.line_no").alias("_l")), F.lit(8))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    lines = lines.join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")) & (F.col("line_no") == F.col("_l")))
    lines = staged(lines.groupBy("h").agg(F.first("text").alias("text"), F.first("open").alias("open")), "near-candidates")
    variants = staged(variant_rows(lines), "variants")
    met = variants.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).filter("x < y").select("key")
    variants = variants.join(met, "key", "left_semi").join(wanted.select("h", F.struct("first.*", "h").alias("pos")), "h")
    variants = staged(variants.distinct(), "met-variants")
    cut, whole = variants.filter("at >= 0"), variants.filter("at < 0")
    found = cut.join(cut.groupBy("key", "at").agg(F.min("pos").alias("by")), ["key", "at"]).select("h", "pos", "by")
    found = found.union(whole.join(cut.groupBy("key").agg(F.min("pos").alias("by")), "key").select("h", "pos", "by"))
    found = found.union(cut.join(whole.select("key", F.col("pos").alias("by")), "key").select("h", "pos", "by"))
    pairs = found.filter("by < pos").groupBy("h").agg(F.min("by").alias("by")).select("h", F.col("by.h").alias("by"))
    left = lines.select("h", F.col("text").alias("left"))
    right = lines.select(F.col("h").alias("by"), F.col("text").alias("right"))
    return _verified(pairs.join(left, "h").join(right, "by"))


def line_verdicts(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc_id, text_key, line_no, exact, near for every line with a word: whether an earlier equal or near line takes it off."""
    rows = staged(line_rows(docs, min_words), "lines")
    firsts = rows.groupBy("h").agg(F.min(_position()).alias("first"), F.first("n").alias("n"), *[F.first(k).alias(k) for k in _KEYS])
    distinct = staged(firsts, "distinct-lines")
    near = staged(near_lines(docs, distinct), "near-lines").withColumn("near", F.lit(True))
    told = distinct.join(near, "h", "left").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    return rows.select("doc_id", "text_key", "line_no", "h").join(told, "h").select(
        "doc_id", "text_key", "line_no", (_position() != F.col("first")).alias("exact"), "near")


def dedup_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """``docs`` with the lines that are equal or near to an earlier line taken out of ``text``.

    Adds n_lines (lines with a word), n_exact and n_near (of these, taken off as equal or as near); columns of
    these names are replaced, all others stay. Lines without words stay. Null texts stay null; a text all
    of whose lines go becomes empty. Documents come in the order of doc_id, those without last; rows with equal
    doc_id and text are one document and keep the same lines; of rows with equal doc_id and different texts, a
    hash of the text decides which is earlier.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    verdicts = line_verdicts(docs, min_words)
    # A repeated row tells each line again; one row for each document and line is left.
    told = verdicts.groupBy("doc_id", "text_key", "line_no").agg(F.max("exact").alias("exact"), F.max("near").alias("near"))
    per_doc = staged(told.groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n_lines"), F.count_if("exact").alias("n_exact"), F.count_if(F.col("near") & ~F.col("exact")).alias("n_near"),
        F.sort_array(F.collect_list(F.when(F.col("exact") | F.col("near"), F.col("line_no")))).alias("gone")), "line-verdicts")
    some = _bounded(per_doc, F.lit(8) + F.size("gone")).alias("v")
    # The row travels as one value, so its columns can have any names.
    keyed = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key")).alias("d")
    out = keyed.join(some, F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("d.text_key") == F.col("v.text_key")), "left")
    # Line numbers that stay, then their lines: in proportion to the text's lines.
    cut = F.size("gone") > 0
    out = out.withColumn("lines", F.when(cut, F.split("row.text", "\n", -1)))
    out = out.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")))
    joined = F.array_join(F.transform("stay", lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(cut, joined).otherwise(F.col("row.text"))
    return out.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in columns],
                      *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_lines", "n_exact", "n_near")])
