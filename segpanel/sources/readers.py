"""Sources: delimited text with every column a string, Parquet, JSON tables, GeoJSON, literals."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segpanel.functions.expr import NULL_TOKENS

POSITION = T.ArrayType(T.DoubleType())
RING = T.ArrayType(POSITION)
POLYGON = T.ArrayType(RING)


CORRUPT = "_corrupt"


def _text_rows(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """All columns text; ``CORRUPT`` holds a line that doesn't fit and is null otherwise.

    Whole lines are parsed whatever columns a query needs, so which lines are malformed depends
    on the file alone.
    """
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).options(
        header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False)
    return reader.csv(path)


def read_raw_csv(spark: SparkSession, path: str, columns: Sequence[str],
                 null_tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """Header CSV, all columns text, malformed lines set aside, null tokens turned into NULL.

    The given column list is the schema, so no pass over the data is spent on inference;
    ``malformed_rows`` counts what was set aside.
    """
    raw = _text_rows(spark, path, columns).filter(F.col(CORRUPT).isNull())
    tokens = sorted({t.upper() for t in null_tokens})
    return raw.select(
        *[F.when(~F.upper(F.trim(F.col(c))).isin(tokens), F.col(c)).alias(c) for c in columns]
    )


def malformed_rows(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """One row: lines read and lines set aside as malformed."""
    # Spark refuses to read the corrupt lines alone, so the first column is read with them.
    read = F.coalesce(F.length(columns[0]), F.lit(0)) >= 0
    return _text_rows(spark, path, columns, header).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(CORRUPT).isNotNull() & read).alias("malformed"))


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet rows. A declared schema saves the job that would read file footers to find it."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_geojson(spark: SparkSession, path: str, properties: Sequence[str],
                 multi_line: bool = True) -> DataFrame:
    """FeatureCollection documents to one row per feature with its MultiPolygon coordinates.

    A multi-line document is read by one task; large collections should be written as one
    collection per line and read with ``multi_line=False``, which splits files.
    """
    feature = T.StructType([
        T.StructField("properties", T.StructType([T.StructField(p, T.StringType()) for p in properties])),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("coordinates", T.ArrayType(POLYGON)),
        ])),
    ])
    schema = T.StructType([T.StructField("features", T.ArrayType(feature))])
    features = (
        spark.read.schema(schema).option("multiLine", multi_line).json(path)
        .select(F.explode("features").alias("f"))
    )
    return features.select(
        *[F.col(f"f.properties.{p}").alias(p) for p in properties],
        F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("coordinates"),
    )


def weekly_calendar(bounds: DataFrame, first: Column | str, last: Column | str,
                    week: str = "week") -> DataFrame:
    """Every seventh day from first to last, for a one-row table of bounds."""
    steps = F.sequence(F.col(first) if isinstance(first, str) else first,
                       F.col(last) if isinstance(last, str) else last,
                       F.expr("INTERVAL 7 DAYS"))
    return bounds.select(F.explode(steps).alias(week))


def limit_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First n rows of a total order, for smoke runs."""
    return df.orderBy(*order).limit(n)


def fixed_sample(df: DataFrame, n: int, seed: int, *identity: str) -> DataFrame:
    """Exactly n rows (all, if fewer), the same ones on every run: those with the n smallest hashes
    of seed and identity. Each task keeps n rows at most before they meet."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))
    return df.orderBy(mark, *identity).limit(n)
