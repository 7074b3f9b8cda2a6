"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintmill.llm import bpe_codec, decontaminate, html_text, quality, secret_scan, sharding, simhash_dedup, token_counts, tokenizer_files, topk, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(_table(spark, sf_dir, "pages"))


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"), sharding.QUERY_LIMIT)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_files.path("word_bpe_49k.json"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_and_decode(_table(spark, sf_dir, "documents"), tokenizer_files.path("byte_bpe_50k.json"))


def queries() -> dict[str, Query]:
    named = (op1_benchmark_decontamination, op2_warc_conversion, op3_extendible_sharding, op4_exact_topk, op5_html_extraction, op6_secret_scan, op7_quality_classifier,
             op8_token_counts, op9_simhash_dedup, op10_bpe_codec)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": decontaminate.ORACLE, "op2_warc_conversion": warc.ORACLE, "op3_extendible_sharding": sharding.ORACLE, "op4_exact_topk": topk.ORACLE, "op6_secret_scan": secret_scan.ORACLE}
