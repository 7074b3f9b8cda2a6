"""Pools for judging, their key, labels, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED, LEAST = 20260813, 2


def _draw(*parts) -> F.Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, (int, str)) else p.cast("string") for p in parts]).cast("binary"))


def pools(gold: DataFrame, ranking: DataFrame, seed: int = SEED, least: int = LEAST, short: bool = False) -> DataFrame:
    """(item_id, place, doc_id, gold): all gold of a question and max(least, n_gold) others from its own ranking, drawn and shuffled by hashes.

    A question without gold has no pool; one whose ranking has too few others raises when read, or with ``short`` gets all that there are.
    """
    gold = gold.select("item_id", "doc_id").distinct()
    n = gold.groupBy("item_id").agg(F.count("*").alias("n_gold"))
    q, d = F.col("item_id"), F.col("doc_id")
    others = ranking.select("item_id", "doc_id").join(gold, ["item_id", "doc_id"], "left_anti").join(n, "item_id")
    w = Window.partitionBy("item_id")
    want = F.greatest(F.lit(least), F.col("n_gold"))
    drawn = others.withColumn("i", F.row_number().over(w.orderBy(_draw(seed, q, d), "doc_id"))).filter(F.col("i") <= want)
    both = gold.select("item_id", "doc_id", F.lit(True).alias("gold")).union(drawn.select("item_id", "doc_id", F.lit(False)))
    placed = F.row_number().over(w.orderBy(_draw(seed, "shuffle", q, d), "doc_id"))
    if short:
        return both.withColumn("place", placed).select("item_id", "place", "doc_id", "gold")
    # Counted from the gold: a ranking without any other has no row to raise at.
    enough = n.join(others.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left")
    ok = F.when(F.coalesce("n", F.lit(0)) >= want, True).otherwise(F.raise_error(F.concat(F.lit("too few others to draw from: "), F.col("item_id").cast("string"))).cast("boolean"))
    both = both.join(enough.select("item_id", ok.alias("ok")), "item_id").filter("ok")
    return both.withColumn("place", placed).select("item_id", "place", "doc_id", "gold")


def with_text(pool: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the text; a document that isn't there raises when read."""
    joined = pool.join(docs.select("doc_id", "text"), "doc_id", "left")
    return joined.withColumn("text", F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.lit("an unknown document in a pool"))))


def pool_stats(pool: DataFrame) -> DataFrame:
    per = pool.groupBy("item_id").agg(F.count("*").alias("c"), F.count_if("gold").alias("g"))
    return per.agg(F.count("*").alias("n_pools"), F.sum("c").alias("n_pairs"), F.sum("g").alias("n_gold"), (F.sum("c") - F.sum("g")).alias("n_others"), F.min("c").alias("least"), F.max("c").alias("most"))


def parsed_selection(raw: F.Column, n: F.Column) -> F.Column:
    """struct(error, picked): numbers from 1 to n parted by spaces or commas, or "none"; blank, words, strange numbers and repeats are errors."""
    text = F.lower(F.trim(F.regexp_replace(raw, r"[ \t\n\r\f\x0b,]+", " ")))
    tokens = F.filter(F.split(text, " "), lambda t: t != "")
    numbers = F.transform(tokens, lambda t: t.try_cast("int"))
    error = (
        F.when(F.trim(F.regexp_replace(raw, r"[ \t\n\r\f\x0b]+", " ")) == "", "blank").when(text == "none", F.lit(None).cast("string")).when(F.exists(tokens, lambda t: ~t.rlike("^[0-9]+$")), "not a number")
        .when(F.exists(numbers, lambda i: i.isNull() | (i < 1) | (i > n)), "out of range").when(F.size(F.array_distinct(numbers)) < F.size(numbers), "repeated"))
    none = F.array().cast("array<int>")
    return F.struct(error.alias("error"), F.when(error.isNotNull(), none).when(text == "none", none).otherwise(numbers).alias("picked"))


def label_rows(pool: DataFrame, chosen: DataFrame) -> DataFrame:
    """(item_id, doc_id, necessary): a row a candidate, 1 if its place was picked; ``chosen`` (item_id, picked)."""
    return pool.join(chosen, "item_id").select("item_id", "doc_id", F.array_contains("picked", F.col("place")).cast("int").alias("necessary"))


def pending(pool: DataFrame, labels: DataFrame) -> DataFrame:
    """Questions whose pool has no label yet."""
    return pool.select("item_id").distinct().join(labels.select("item_id").distinct(), "item_id", "left_anti")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters' 0/1 labels; null where chance agreement is full."""
    c = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agree"), F.count_if(F.col(a) == 1).alias("a1"), F.count_if(F.col(b) == 1).alias("b1"))
    po = F.try_divide(F.col("agree"), F.col("n"))
    pe = F.try_divide(F.col("a1") * F.col("b1") + (F.col("n") - F.col("a1")) * (F.col("n") - F.col("b1")), F.col("n") * F.col("n"))
    return c.select("n", "agree", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


def majority(labels: DataFrame) -> DataFrame:
    """(item_id, doc_id, necessary) from several runs: 1 if more than half say so."""
    return labels.groupBy("item_id", "doc_id").agg((2 * F.count_if(F.col("necessary") == 1) > F.count("*")).cast("int").alias("necessary"))
