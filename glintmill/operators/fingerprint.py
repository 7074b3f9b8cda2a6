"""Hashes, duplicates, a corpus fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.functions import text as T


def text_hashes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha2(T.normalised(F.col("text")), 256).alias("sha256_norm"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Documents of groups with one normalised hash, two at least: a row a member, with the group's first id and its size."""
    h = text_hashes(docs).select("doc_id", "sha256_norm")
    g = h.groupBy("sha256_norm").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")
    return h.join(g, "sha256_norm").select("sha256_norm", "n", "first_id", "doc_id")


def merkle(rows: DataFrame, name: str) -> DataFrame:
    """One hash of rows (k, h) in the order of k: hashes of hashes over 1024 keys at a time, so no task holds them all."""
    together = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256)
    for _ in range(3):
        rows = rows.groupBy(F.floor(F.col("k") / 1024).alias("b")).agg(together.alias("h")).select(F.col("b").alias("k"), "h")
    return rows.groupBy().agg(together.alias(name))


def corpus_fingerprint(docs: DataFrame) -> DataFrame:
    """One hash of all texts in the order of their ids."""
    return merkle(docs.select(F.col("doc_id").alias("k"), F.sha2("text", 256).alias("h")), "corpus_sha256")


def size_skew(docs: DataFrame, top: int = 3) -> DataFrame:
    """How much of all characters the largest documents hold."""
    sizes = docs.select(F.length("text").cast("long").alias("n"), "doc_id")
    largest = sizes.orderBy(F.desc("n"), "doc_id").limit(top).agg(F.sum("n").alias("top_chars"))
    total = sizes.agg(F.sum("n").alias("total_chars"))
    return total.crossJoin(largest).withColumn("share", F.round(F.col("top_chars") / F.col("total_chars"), 6))
