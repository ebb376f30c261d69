"""Tables that are replaced at once: versioned folders and a pointer written last.

``root/data/<id>`` holds the Parquet files of one version; ``root/versions/<n>`` names the folder of version n. The pointer is
written under another name and renamed when the data stands, and it never replaces another, so readers see a whole old or a
whole new table, a failed write leaves the old one, and of two writers that began with the same version one fails.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession

from segpanel.sources.writers import write_parquet

_NUMBER = re.compile(r"\d{12}$")


class TableChanged(RuntimeError):
    """Another writer has committed a version in the meantime."""


@dataclass(frozen=True)
class Version:
    number: int
    path: str


def _fs(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def _pointer(root: str, number: int) -> str:
    return f"{root}/versions/{number:012d}"


def versions(spark: SparkSession, root: str) -> list[Version]:
    """The committed versions that still stand, oldest first (one small file each)."""
    numbers = [int(n) for n in _names(spark, f"{root}/versions") if _NUMBER.match(n)]
    return [Version(n, f"{root}/data/{_read(spark, _pointer(root, n))}") for n in numbers]


def current(spark: SparkSession, root: str) -> Version | None:
    numbers = [int(n) for n in _names(spark, f"{root}/versions") if _NUMBER.match(n)]
    return Version(numbers[-1], f"{root}/data/{_read(spark, _pointer(root, numbers[-1]))}") if numbers else None


def _read(spark: SparkSession, path: str) -> str:
    hadoop, fs = _fs(spark, path)
    stream = fs.open(hadoop)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, number: int, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    temporary, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{root}/versions/.{folder}", _pointer(root, number)))
    fs = temporary.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(temporary, False)
    stream.write(folder.encode())
    stream.close()
    # The file context's rename doesn't replace a file that stands.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.isAbsolute() and target.toUri().getScheme() else fs.getUri(),
                                                                  spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(temporary, target, none)
    except Py4JJavaError as error:
        fs.delete(temporary, False)
        if "FileAlreadyExists" in str(error.java_exception):
            raise TableChanged(f"version {number} of {root} stands already") from error
        raise


def replace_table(df: DataFrame, root: str, sort: Sequence[Column | str], columns: Sequence[str] | None = None,
                  partition_by: Sequence[str] = (), after: int | None = None) -> Version:
    """Write the rows as the table's next version and make it the current one.

    ``after`` is the version that ``df`` was made from (by default the current one when the write begins); if another version
    has been committed since, ``TableChanged`` is raised and that one stays. ``df`` may read the table itself.
    """
    spark = df.sparkSession
    if after is None:
        now = current(spark, root)
        after = now.number if now else 0
    folder = uuid.uuid4().hex
    write_parquet(df, f"{root}/data/{folder}", sort, columns, partition_by)
    _commit(spark, root, after + 1, folder)
    return Version(after + 1, f"{root}/data/{folder}")


def read_table(spark: SparkSession, root: str, number: int | None = None, schema: str | None = None) -> DataFrame:
    """The rows of the current version, or of version ``number``. What a reader has resolved stays its table until ``expire`` takes it."""
    found = current(spark, root) if number is None else next((v for v in versions(spark, root) if v.number == number), None)
    if found is None:
        raise FileNotFoundError(f"no {'version' if number is None else f'version {number}'} of a table at {root}")
    return spark.read.schema(schema).parquet(found.path) if schema else spark.read.parquet(found.path)


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the newest ``keep`` versions and the folders of failed writes; the names of the folders that went.

    Run it when no write is under way. Pointers go before the data, so no pointer is left without its folder.
    """
    if keep < 1:
        raise ValueError("one version must stay")
    standing = versions(spark, root)
    for v in standing[:-keep]:
        hadoop, fs = _fs(spark, _pointer(root, v.number))
        fs.delete(hadoop, False)
    held = {v.path.rsplit("/", 1)[1] for v in standing[-keep:]}
    gone = [n for n in _names(spark, f"{root}/data") if n not in held]
    for name in gone:
        hadoop, fs = _fs(spark, f"{root}/data/{name}")
        fs.delete(hadoop, True)
    return gone
