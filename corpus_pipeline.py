"""Documents to training sequences: STAGES, each one's output written as Parquet and read as the next one's input.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last
return the columns of ``documents``. Copies that the mixing makes keep their doc_id, and the packing treats
equal rows as documents of their own. Null and empty texts go with the quality rules (they have
fewer than 20 words); documents that the line dedup leaves without any word go with it, as they were copies.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segpanel.llm.line_dedup import dedup_lines
from segpanel.llm.mixing import mix_sources
from segpanel.llm.packing import pack_documents
from segpanel.llm.quality_rules import keep_good
from segpanel.llm.similar_sets import one_of_each
from segpanel.llm.stage import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled rules keep."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or is near to; ``n_chars`` follows the text."""
    out = dedup_lines(docs).filter((F.col("n_exact") + F.col("n_near") == 0) | (F.col("n_exact") + F.col("n_near") < F.col("n_lines")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group with five-word shingles of a similarity of 0.8 or more."""
    return one_of_each(docs, width=5, percent=80).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies: sources in proportion to the square root of their bytes, in a random order."""
    return mix_sources(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing), ("packing", packing),
]

#: Certified cutoffs, near lines, groups and token ids can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
