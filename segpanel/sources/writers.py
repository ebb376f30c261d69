"""Sinks: totally ordered Parquet and metric tables as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, sort: Sequence[Column | str],
                  columns: Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> None:
    """Replace ``path`` with the projected rows.

    Without partition columns the files are range partitioned on the whole sort key, so they
    are in total order; with them the order holds within each directory's files. Columns given by name ascend, nulls
    last. The old rows go before the new ones stand; ``versions.replace_table`` keeps them until then.
    """
    out = df.select(*columns) if columns else df
    sort = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in sort]
    if partition_by:
        out = out.repartitionByRange(*partition_by, *sort).sortWithinPartitions(*partition_by, *sort)
        out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        out.orderBy(*sort).write.mode("overwrite").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
