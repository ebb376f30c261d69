"""Period counts that follow their input: only the periods that new, changed or removed files touch are counted again.

The counts lie in one folder for each period. Beside them stands a state table with a row for each input file and period
(size, time of change, rows that count), replaced at once. A refresh compares the files that stand with the state, scans the files that are
new or changed for the periods they hold, and counts those periods, and those that changed or removed files held before, anew
from just the files that hold them. Folders are replaced first and the state last, so a refresh that failed is repeated in full by the next.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segpanel.functions.expr import month_of, week_of
from segpanel.operators.aggregate import period_counts
from segpanel.session import materialize
from segpanel.sources import versions

STATE = "part string, size bigint, modified timestamp, period date, n bigint"
_FILE = ("part", "size", "modified")


@dataclass(frozen=True)
class PeriodTable:
    """Counts of ``source`` (a Parquet folder) by period and ``keys`` below ``root``. ``eligible`` is SQL over the source's columns."""

    root: str
    source: str
    time: str
    keys: tuple[str, ...]
    eligible: str = "true"
    period: str = "week"

    def __post_init__(self) -> None:
        if self.period not in ("week", "month"):
            raise ValueError("period must be week or month")

    @property
    def counts(self) -> str:
        return f"{self.root}/counts"

    @property
    def state(self) -> str:
        return f"{self.root}/state"

    def of(self, time: str) -> Column:
        return (week_of if self.period == "week" else month_of)(time)

    def counted(self) -> Column:
        return F.col(self.time).isNotNull() & F.coalesce(F.expr(self.eligible), F.lit(False))


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: the periods counted anew, of which ``emptied`` have no rows any more, and the files scanned and counted."""

    periods: tuple[date, ...]
    emptied: tuple[date, ...]
    scanned: tuple[str, ...]
    counted: tuple[str, ...]


def _parts() -> list[Column]:
    return [F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified")]


def _stretches(periods: Sequence[date], step: str) -> list[tuple[date, date]]:
    """First and last day of every run of periods that follow each other."""
    out: list[tuple[date, date]] = []
    for first in sorted(periods):
        after = first + timedelta(days=7) if step == "week" else (first.replace(day=28) + timedelta(days=4)).replace(day=1)
        if out and out[-1][1] + timedelta(days=1) == first:
            out[-1] = (out[-1][0], after - timedelta(days=1))
        else:
            out.append((first, after - timedelta(days=1)))
    return out


def touched_rows(spark: SparkSession, table: PeriodTable, parts: Iterable[str], periods: Sequence[date]) -> DataFrame:
    """Rows of the given files in the given periods; the stretches of days reach the scan as filters."""
    spans = [F.col(table.time).between(F.lit(a), F.lit(b)) for a, b in _stretches(periods, table.period)]
    return spark.read.parquet(*parts).filter(reduce(lambda a, b: a | b, spans)).filter(table.counted())


def refresh(spark: SparkSession, table: PeriodTable) -> Refreshed:
    """Bring the counts up to date with the files that stand.

    The time column must be a date; rows without one, and rows that are not eligible, don't count. Lists of files and of
    periods pass through the driver, as they do in every scan; rows don't.
    """
    standing = spark.read.parquet(table.source)
    # No column is read: the scan gives file names and row counts alone.
    standing = materialize(standing.select(*_parts()).distinct())
    known = versions.current(spark, table.state)
    state = versions.read_table(spark, table.state, known.number, STATE) if known else spark.createDataFrame([], STATE)
    fresh = [r["part"] for r in standing.join(state.select(*_FILE).distinct(), list(_FILE), "left_anti").select("part").collect()]
    gone = materialize(state.join(standing, list(_FILE), "left_anti"))
    kept = state.join(standing, list(_FILE), "left_semi")
    if not fresh and gone.isEmpty():
        return Refreshed((), (), (), ())
    found = spark.createDataFrame([], STATE)
    if fresh:
        rows = spark.read.parquet(*fresh)
        # A file without rows that count has one row of state, so that it isn't scanned again.
        found = rows.select(*_parts(), F.when(table.counted(), table.of(table.time)).alias("period")).groupBy(*_FILE, "period").agg(F.count("period").alias("n"))
    held = materialize(kept.unionByName(found))
    changed = held.join(standing.filter(F.col("part").isin(fresh)) if fresh else standing.limit(0), list(_FILE), "left_semi")
    periods = sorted(r["period"] for r in changed.select("period").unionByName(gone.select("period")).filter("period is not null").distinct().collect())
    holders = held.filter((F.col("n") > 0) & F.col("period").isin(periods)) if periods else held.limit(0)
    here = holders.groupBy("period").agg(F.collect_set("part").alias("parts")).collect()  # names of files
    counted = sorted({p for r in here for p in r["parts"]})
    if counted:
        rows = touched_rows(spark, table, counted, [r["period"] for r in here])
        counts = period_counts(rows, table.of(table.time), table.period, table.keys)
        counts.repartitionByRange(table.period, *table.keys).sortWithinPartitions(table.period, *table.keys).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(table.period).parquet(table.counts)
    emptied = sorted(set(periods) - {r["period"] for r in here})
    for period in emptied:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table.counts}/{table.period}={period}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    versions.replace_table(held, table.state, ["part", "period"], after=known.number if known else 0)
    versions.expire(spark, table.state)
    return Refreshed(tuple(periods), tuple(emptied), tuple(sorted(fresh)), tuple(counted))


def read_counts(spark: SparkSession, table: PeriodTable) -> DataFrame:
    """period, keys, n as of the last refresh."""
    fields = ", ".join(f"`{c}` string" for c in table.keys)
    return spark.read.schema(f"{fields}, n bigint, {table.period} date").parquet(table.counts).select(table.period, *table.keys, "n")
