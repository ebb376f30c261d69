"""One query for each operator, over whole tables, and oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segpanel.llm import contamination as leaks
from segpanel.llm import hard_negatives as hard
from segpanel.llm import oracles
from segpanel.llm.licenses import license_labels
from segpanel.llm.line_dedup import dedup_lines
from segpanel.llm.mixing import mix_sources
from segpanel.llm.neighbours import nearest
from segpanel.llm.packing import pack_documents
from segpanel.llm.quality_rules import quality_verdicts
from segpanel.llm.sharding import shard_digests
from segpanel.llm.similar_sets import jaccard_components
from segpanel.llm.spelling import spelling_forms
from segpanel.llm.token_counts import token_counts
from segpanel.llm.token_files import write_token_files

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


def op1_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(documents(spark, sf), width=5, percent=80)


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", "text")


def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return write_token_files(documents(spark, sf), tokenizer_path("byte_bpe_50k.json"), end_id=2).digests()


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(documents(spark, sf), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=2048)


def op5_hash_forest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_labels(documents(spark, sf))


def op7_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(documents(spark, sf))


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shard_digests(documents(spark, sf), shards=40)


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(documents(spark, sf), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", label.alias("label"))
    return hard.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_forms(documents(spark, sf))


def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.contamination(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"), span=10)


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_files": op3_token_files,
    "op4_packing": op4_packing,
    "op5_hash_forest": op5_hash_forest,
    "op6_license_scan": op6_license_scan,
    "op7_source_mixing": op7_source_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_decontamination": op13_decontamination,
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": oracles.JACCARD,
    "op6_license_scan": oracles.licences(),
    "op7_source_mixing": oracles.MIXING,
    "op11_hard_negatives": hard.ORACLE,
    "op13_decontamination": leaks.oracle(),
}
