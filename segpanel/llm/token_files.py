"""Token ids in files: frequency-ranked, byte-aligned codes of variable length, control bytes apart.

An id is written as its rank by frequency over all documents, so common tokens take one byte. A block
of documents has one array of control bits, two for each id (bytes minus one, four ids in a control
byte), and one of data bytes. Reading looks the control bytes up in a table of 256 x 4 lengths; all
else is array arithmetic. The files are Parquet parts of blocks (``blocks``), with the rank table
(``ranks``) beside them: Spark commits, lists and reads them on any store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segpanel.llm.stage import shuffle_partitions, stage_root, staged
from segpanel.llm.tokens import chunks, encoded, id_table

BLOCK_TOKENS = 1 << 19
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1
BLOCKS = "shard int, block long, first_token long, n_tokens long, doc_ids binary, no_ids binary, doc_tokens binary, control binary, data binary"


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    control = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    control[:len(values)] = extra
    control = (control.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values behind ``pack``'s bytes."""
    if n == 0:
        return np.empty(0, np.uint32)
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = raw[starts]
    for k in (1, 2, 3):
        at = np.flatnonzero(lengths > k)
        out[at] |= raw[starts[at] + k] << np.uint32(8 * k)
    return out


@dataclass
class TokenFiles:
    """Written token files; ``blocks`` are in ascending order of document id by (shard, block)."""

    spark: SparkSession
    path: str

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")

    @property
    def ranks(self) -> DataFrame:
        return self.spark.read.schema("rank int, id int, n long").parquet(f"{self.path}/ranks")

    def documents(self) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens, ids (array<int>)."""
        return self._read("ids array<int>", lambda ids: ids.astype(np.int32))

    def digests(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
        return self._read("ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))

    def _read(self, column: str, value) -> DataFrame:
        back = _by_rank(self.ranks)
        name = column.split()[0]
        kind = pa.list_(pa.int32()) if "array" in column else pa.int64()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    docs, sizes = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["doc_tokens"], np.int64)
                    ends = np.cumsum(sizes)
                    ids = back[unpack(row["control"], row["data"], int(ends[-1]))]
                    yield pa.RecordBatch.from_pydict({
                        "shard": np.full(len(docs), row["shard"], np.int32), "doc_id": pa.array(docs, mask=np.frombuffer(row["no_ids"], bool)),
                        "in_shard": row["first_token"] + ends - sizes, "n_tokens": sizes,
                        name: pa.array([value(ids[e - s:e]) for s, e in zip(sizes, ends)], kind),
                    })
        rows = self.blocks.mapInArrow(run, f"shard int, doc_id long, in_shard long, n_tokens long, {column}")
        # One row for each written part: as many as the shuffle has partitions.
        sizes = self.blocks.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
        return rows.join(F.broadcast(sizes), "shard").select(
            "doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", name)


def _by_rank(ranks: DataFrame) -> np.ndarray:
    """Id of each rank. As many rows as the vocabulary has ids, whatever the documents."""
    rows = ranks.select("rank", "id").collect()
    out = np.zeros(max([r.rank for r in rows], default=-1) + 1, np.uint32)
    for r in rows:
        out[r.rank] = r.id
    return out


def tokenized(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned integers of 2 bytes, or 4 for a large vocabulary) of every row; and from each task one row
    with ``counts`` alone: how often it has met each id, as 64-bit integers."""
    code = _code(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = id_table(path, code), np.zeros(0, np.int64)
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                ids, sizes = encoded(texts, table, code, end_id)
                met = np.bincount(ids, minlength=len(total))
                met[:len(total)] += total
                total = met
                offsets = np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
                yield _token_rows(batch.column("doc_id").slice(at, len(texts)), pa.array(sizes), packed.cast(pa.binary()), pa.nulls(len(sizes), pa.binary()))
        yield _token_rows(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary()))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, counts binary")


def _token_rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n_tokens", "ids", "counts"])


def _code(path: str) -> str:
    from tokenizers import Tokenizer

    return "H" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"


def token_frequencies(tokens: DataFrame) -> DataFrame:
    """id, n over all documents, from the counts of the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                met = np.frombuffer(raw, np.int64)
                long, short = (met, total) if len(met) > len(total) else (total, met)
                total = long.copy()
                total[:len(short)] += short
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])
    return tokens.filter("counts is not null").select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, path: str | None = None) -> TokenFiles:
    """Encode ``text`` of every row with the tokenizers file ``tokenizer`` and write the ids by doc_id.

    Null and empty texts give just ``end_id`` (nothing at all without one). Rows with equal doc_id are
    kept each, in the order of their ids' hash; rows without doc_id come first and stay null. Other
    columns are not looked at. An empty table gives files without blocks.
    """
    spark = docs.sparkSession
    if path is None:
        import uuid

        path = f"{stage_root(spark)}/tokens-{uuid.uuid4().hex}"
    code = _code(tokenizer)
    tokens = staged(tokenized(docs, tokenizer, end_id), "token-ids")
    by_count = Window.orderBy(F.desc("n"), "id")  # over the vocabulary
    counts = token_frequencies(tokens)
    counts.select((F.row_number().over(by_count) - 1).alias("rank"), "id", "n").write.parquet(f"{path}/ranks")
    files = TokenFiles(spark, path)
    back = _by_rank(files.ranks)
    rank = np.zeros(int(back.max()) + 1 if len(back) else 1, np.uint32)
    rank[back] = np.arange(len(back), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs_in: list[int | None] = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            control, data = pack(rank[np.concatenate(parts)])
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": block, "first_token": first, "n_tokens": held, "doc_ids": np.array([d or 0 for d in docs_in], np.int64).tobytes(),
                "no_ids": np.array([d is None for d in docs_in], bool).tobytes(),
                "doc_tokens": np.array(sizes, np.int64).tobytes(), "control": control, "data": data}], schema=_BLOCK_TYPES)
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                part = np.frombuffer(ids, code)
                docs_in.append(doc)
                sizes.append(len(part))
                parts.append(part)
                held += len(part)
                if held >= BLOCK_TOKENS:
                    yield flush()
                    block, first = block + 1, first + held
                    docs_in, sizes, parts, held = [], [], [], 0
        if docs_in:
            yield flush()
    n = shuffle_partitions(spark)
    tie = F.xxhash64("ids").alias("tie")
    ordered = tokens.filter("ids is not null").select("doc_id", "ids", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "ids").mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return files


_BLOCK_TYPES = pa.schema([
    ("shard", pa.int32()), ("block", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("no_ids", pa.binary()),
    ("doc_tokens", pa.binary()), ("control", pa.binary()), ("data", pa.binary()),
])
