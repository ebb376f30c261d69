"""Written intermediate tables: lineage ends in Parquet that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def stage_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local master without one gets its own."""
    context = spark.sparkContext
    root = spark.conf.get(KEY, None) or context.getConf().get(KEY, None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {KEY} to a folder that every executor can read")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="segpanel-stage-"))
    return context.getCheckpointDir()


def write_stage(df: DataFrame, name: str, partition_by: str | None = None) -> str:
    """Write ``df`` below the shared folder and return its path."""
    path = f"{stage_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: later plans start from the files."""
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(write_stage(df, name))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
