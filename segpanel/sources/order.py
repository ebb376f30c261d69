"""Positions and order of the rows of a written table, proved from its files.

A row's place is its file (by name, the order in which a sorted write numbers them) and its index in the file; both come with
the scan. Neighbours are compared in blocks of rows, then at the edges of blocks and of files, so a large file is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows whose neighbours are compared in one window.
BLOCK_ROWS = 1 << 16
_FILE, _ROW = "__file", "__row"


def _placed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))


def _key(columns: Sequence[str]) -> Column:
    """Compares as ``columns`` ascending, nulls last."""
    return F.struct(*[part for c in columns for part in (F.col(c).isNull().alias(f"{c}_none"), F.col(c))])


def with_positions(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """The rows of the Parquet table at ``path`` with their place from 1: files by name, rows as they stand in the file.

    Earlier files count with their rows, which takes one row for each file.
    """
    rows = _placed(spark, path)
    before = Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy(_FILE).agg(F.count(F.lit(1)).alias("__n")).select(_FILE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(files, _FILE).withColumn(name, F.col("__before") + F.col(_ROW) + 1).drop(_FILE, _ROW, "__before")


def order_report(spark: SparkSession, path: str, sort: Sequence[str], strict: bool = False) -> DataFrame:
    """One row for each file: file_no (from 0), rows, breaks (rows that stand behind a greater one), overlaps (its first row does so).

    Rows ascend by ``sort``, nulls last; if ``strict``, an equal neighbour is a break too. The table is in total order if no
    file has breaks or overlaps. Of the table only the sort columns are read.
    """
    rows = _placed(spark, path).select(_FILE, _ROW, _key(sort).alias("key"))

    def wrong(earlier: Column, later: Column) -> Column:
        return F.coalesce(earlier >= later if strict else earlier > later, F.lit(False))
    blocks = rows.withColumn("block", F.floor(F.col(_ROW) / BLOCK_ROWS))
    inside = Window.partitionBy(_FILE, "block").orderBy(_ROW)
    compared = blocks.withColumn("bad", wrong(F.lag("key").over(inside), F.col("key")))
    edges = compared.groupBy(_FILE, "block").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("breaks"), F.min_by("key", _ROW).alias("first"), F.max_by("key", _ROW).alias("last"))
    # From here on there is a row for each block, then for each file.
    along = Window.partitionBy(_FILE).orderBy("block")
    edges = edges.withColumn("bad", wrong(F.lag("last").over(along), F.col("first")))
    files = edges.groupBy(_FILE).agg(
        F.sum("rows").alias("rows"), (F.sum("breaks") + F.count_if("bad")).alias("breaks"), F.min_by("first", "block").alias("first"), F.max_by("last", "block").alias("last"))
    across = Window.orderBy(_FILE)
    return files.select(
        (F.row_number().over(across) - 1).cast("bigint").alias("file_no"), "rows", "breaks",
        wrong(F.lag("last").over(across), F.col("first")).alias("overlaps"))


def in_order(reports: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """name, rows, breaks (of files and between them), sound for each named report."""
    named = [r.agg(F.sum("rows").alias("rows"), (F.sum("breaks") + F.count_if("overlaps")).alias("breaks")).select(F.lit(n).alias("name"), "*") for n, r in reports]
    out = reduce(DataFrame.unionByName, named)
    return out.withColumn("sound", F.col("breaks") == 0)
