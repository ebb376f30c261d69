"""Role tables over the test data, built with Spark. ``ctes`` holds the oracle's versions."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segpanel.functions import expr as E
from segpanel.operators.aggregate import monthly_counts, weekly_counts, weighted_bins
from segpanel.operators.clean import RAW_COLUMNS, XY_FLAGS, clean_events
from segpanel.roles import Box, GrainLimits, HotspotConfig, QualityConfig
from segpanel.session import ensure_checkpoint_dir
from segpanel.sources.readers import read_parquet
from queries.shared import EVENT_EXPRS, RAW_EXPRS, spark_dialect

KEYS = ["grp", "area", "cat", "cls"]
KEYS2 = ["grp", "cat"]
BOX = Box(-74.27, -73.65, 40.48, 40.93)
MIN_DAY, AS_OF = date(1995, 2, 1), date(2001, 7, 31)
GROUPS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
CLASSES = ("F", "O", "P")
QUALITY = QualityConfig(MIN_DAY, AS_OF, BOX, GROUPS, CLASSES)
HOTSPOTS = HotspotConfig(
    box=BOX, cell_size=0.1, area=GrainLimits(10, 2, 2, 3, 4), grid=GrainLimits(10, 2, 2, 3, 4), min_score=20.0,
)
FLAG_COLUMNS = list(XY_FLAGS)


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return read_parquet(spark, f"{sf}/{table}.parquet", SCHEMAS.get(table))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def base(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the region and nation of their customer. Nation and region have 25 and 5 rows
    at every scale and are broadcast; the customer join is left to Spark's size estimates."""
    orders = read(spark, sf, "orders").selectExpr(
        "o_orderkey AS k", "o_custkey", "CAST(o_orderdate AS DATE) AS odate", "o_totalprice AS price",
        "o_orderpriority AS priority", "o_orderstatus AS status",
    )
    regions = F.broadcast(read(spark, sf, "region"))
    places = F.broadcast(read(spark, sf, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")))
    people = read(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("acct")).join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        "k", "odate", "acct", "price", F.col("r_name").alias("region"), F.col("n_nationkey").alias("nation"),
        "priority", "status",
    )


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Dirty text rows, all strings."""
    out = base(spark, sf).selectExpr(*[f"{spark_dialect(e)} AS {n}" for n, e in RAW_EXPRS.items()])
    return out.select(*RAW_COLUMNS)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_events(raw(spark, sf), QUALITY)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Typed events with keys, a point and the eligibility flag."""
    typed = base(spark, sf).selectExpr(*[f"{spark_dialect(e)} AS {n}" for n, e in EVENT_EXPRS.items()])
    return typed.select(
        "*", F.col("day").between(F.lit(MIN_DAY), F.lit(AS_OF)).alias("is_eligible"),
        E.missing_xy("x", "y").alias("flag_missing_xy"), E.zero_xy("x", "y").alias("flag_zero_xy"),
        E.outside_xy("x", "y", BOX).alias("flag_outside_xy"),
    )


def eligible(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).filter("is_eligible")


def valid_points(spark: SparkSession, sf: str) -> DataFrame:
    return eligible(spark, sf).filter(E.valid_xy("x", "y", BOX, *FLAG_COLUMNS))


def weekly(spark: SparkSession, sf: str, keys=KEYS) -> DataFrame:
    return weekly_counts(events(spark, sf), "day", keys, F.col("is_eligible"))


def monthly(spark: SparkSession, sf: str, keys=KEYS) -> DataFrame:
    return monthly_counts(events(spark, sf), "day", keys, F.col("is_eligible"))


def bins(spark: SparkSession, sf: str) -> DataFrame:
    """Daily weighted bins."""
    return weighted_bins(eligible(spark, sf), [
        "day", *[E.fill_unknown(k).alias(k) for k in KEYS], "x", "y", *FLAG_COLUMNS,
    ])


def stream_events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events")


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the order date of their order."""
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").alias("start_ts"), F.col("l_shipdate").alias("end_ts"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("o_orderpriority").alias("cat"),
    )


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read(spark, sf, "labels"), "doc_id", "left")
