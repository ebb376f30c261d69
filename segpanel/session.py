"""Session construction and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str | int = "*", app: str = "segpanel", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only for a local master."""
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY, None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return
    if context.getCheckpointDir() is not None:
        return
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can read")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="segpanel-ckpt-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Used where a table much smaller than its input feeds several branches, and where
    row positions must not change if a lost executor makes Spark recompute a task. Parquet keeps column
    pruning and filters for the readers; ``clear_stages`` removes what a session has written.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{_run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _run_folder(spark: SparkSession) -> str:
    return f"{spark.sparkContext.getCheckpointDir()}/stages-{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` has written in this application; they must not be read any more."""
    if spark.sparkContext.getCheckpointDir() is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
