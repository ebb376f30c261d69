"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents are cut at multiples of the capacity; the pieces' lengths, rounded up to classes, form a
histogram that has as many rows as there are classes. On it runs the linear program of the cutting
stock problem: the fewest sequences such that patterns (how many pieces of each class a sequence
holds) cover the histogram. A knapsack dynamic program over the dual prices finds the pattern that
helps most, until none helps. The program's values are rounded down, what is left is covered by
patterns filled from the largest class on, and pieces are assigned to the patterns by their rank within
their class: piece -> sequence and slot is arithmetic on a table of one row per pattern and class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segpanel.llm.stage import shuffle_partitions, staged
from segpanel.llm.tokens import chunks, encoded, id_table

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: ``PIECES`` and, if asked for, the ids as 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = id_table(tokenizer)
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                ids, sizes = encoded(texts, table, "I", end_id)
                cuts = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), cuts)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
                length = np.minimum(sizes[owner] - start, capacity)
                first = (np.cumsum(sizes) - sizes)[owner] + start
                raw = [memoryview(ids[a:a + n]).cast("B") for a, n in zip(first, length)]
                columns = [batch.column("doc_id").slice(at, len(texts)).take(pa.array(owner)), pa.array(start), pa.array(length.astype(np.int32)),
                           pa.array(list(map(zlib.crc32, raw)), pa.int64()), pa.array(sizes[owner])]
                if with_ids:
                    columns.append(pa.array([bytes(r) for r in raw], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][:len(columns)])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within ``capacity``."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, side="right")
        value[room], last[room] = value[room - 1], -1
        if fits:
            gains = value[room - sizes[:fits]] + prices[:fits]
            k = int(gains.argmax())
            if gains[k] > value[room] + 1e-12:
                value[room], last[room] = gains[k], k
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= sizes[last[room]]
    return float(value[capacity]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4, steps: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering ``demand`` pieces of the ascending ``sizes``.

    Revised simplex on the master program, columns priced by ``best_pattern``; it ends when no pattern
    has a reduced cost or the dual bound proves the value to be within ``gap`` of the optimum.
    """
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(columns))
    used = inverse @ demand
    for _ in range(steps):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(np.maximum(prices, 0), sizes, capacity)
        if worth <= 1 + 1e-9 or prices @ demand / worth >= (1 - gap) * used.sum():
            break
        direction = inverse @ pattern
        positive = direction > 1e-10
        ratios = np.where(positive, used / np.where(positive, direction, 1), np.inf)
        out = int(ratios.argmin())
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        used = used - direction * ratios[out]
        used[out] = ratios[out]
        used = np.maximum(used, 0)
        columns[:, out] = pattern
    plan, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-used, kind="stable"):
        times = int(used[k] + 1e-7)
        here = columns[:, k]
        if times and here.any():
            # Not more often than the pieces last.
            held = here > 0
            times = min(times, int((left[held] // here[held]).min()))
        if times > 0 and here.any():
            plan.append((here.copy(), times))
            left -= here * times
    while left.any():
        pattern, room = np.zeros(m, np.int64), capacity
        for k in range(m - 1, -1, -1):
            n = min(int(left[k]), room // int(sizes[k]))
            pattern[k], room = n, room - n * int(sizes[k])
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def places(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Class size -> for its ranks in order: first rank, first sequence, uses and first slot of each pattern."""
    out: dict[int, list[list[int]]] = {int(s): [[], [], [], []] for s in sizes}
    taken, sequence = np.zeros(len(sizes), np.int64), 0
    for pattern, times in plan:
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            for column, v in zip(out[int(sizes[k])], (taken[k], sequence, times, slot)):
                column.append(int(v))
            taken[k] += pattern[k] * times
            slot += int(pattern[k])
        sequence += times
    return {size: tuple(np.array(c, np.int64) for c in columns) for size, columns in out.items()}


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0, gapless) within ``group``; a group with most of the rows is numbered in many tasks.

    Rows are spread by a hash of ``order`` over parts, numbered there, and moved up by the counts of the
    parts before (one row for each group and part).
    """
    n = shuffle_partitions(rows.sparkSession)
    parts = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy(group, "part").agg(F.count("*").alias("n")).select(
        group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = parts.withColumn("at", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1)
    # Spark broadcasts the bases only if they are small.
    return numbered.join(bases, [group, "part"]).withColumn("rank", F.col("base") + F.col("at")).drop("part", "base", "at")


def pack(rows: DataFrame, capacity: int, width: int) -> DataFrame:
    """Add sequence_id and offset to ``pieces``; rows must be a written table."""
    classed = rows.withColumn("size", (F.ceil(F.col("length") / width) * width).cast("int"))
    # At most capacity / width rows, whatever the number of documents.
    histogram = sorted((r["size"], r["count"]) for r in classed.groupBy("size").count().collect())
    sizes = np.array([s for s, _ in histogram], np.int64)
    plan = cutting_stock(sizes // width, np.array([n for _, n in histogram], np.int64), capacity // width) if histogram else []
    where = places(sizes, plan)
    numbered = ranked(classed, "size", ["doc_id", "start", "ids_crc32"])
    columns = [c for c in rows.columns]
    schema = numbered.select(*columns).withColumns({"sequence_id": F.lit(0).cast("long"), "slot": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, base, times, start = where[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                ahead = rank[at] - first[k]
                sequence[at], slot[at] = base[k] + ahead % times[k], start[k] + ahead // times[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(slot)], [*columns, "sequence_id", "slot"])
    placed = numbered.select(*columns, "size", "rank").mapInArrow(run, schema)
    # A sequence holds at most capacity / width pieces.
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).drop("slot")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, width: int = 8, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequence_id and offset in the sequence.

    doc_id, start, length (long), ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids. A null
    or empty text is its end token alone; texts longer than ``capacity`` are cut at its multiples. Rows
    with equal doc_id are packed as documents of their own; other columns of ``docs`` are not looked at;
    an empty table gives no rows. ``width`` must divide ``capacity``.
    """
    if capacity % width:
        raise ValueError("width must divide capacity")
    out = pack(staged(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces"), capacity, width)
    return out.withColumn("length", F.col("length").cast("long"))
