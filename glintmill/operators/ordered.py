"""Running totals, ranks and order statistics without a task that holds a whole group.

Rows fall into buckets of their order; buckets are summed first, their totals run over the few buckets, and rows are only sorted
within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 65536


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, bucket: Column | None = None) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the group that come earlier in ``order``, a whole number without repeats."""
    rows = df.withColumn("_v", value.cast("long")).withColumn("_b", F.floor(F.col(order) / BUCKET) if bucket is None else bucket)
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    up_to = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(up_to), F.lit(0))).drop("_s")
    within = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_in", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return inner.join(sums, [*keys, "_b"]).withColumn("before", F.col("_base") + F.col("_in")).drop("_v", "_b", "_base", "_in")


def ranked_in_buckets(df: DataFrame, keys: list[str], bucket: Column, order: list) -> DataFrame:
    """Adds ``rank`` (from 1) in the order of ``bucket``, then of ``order``: rows are sorted within a bucket, and only the buckets' sizes within a key."""
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    up_to = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(up_to), F.lit(0))).drop("_n")
    inner = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return inner.join(sizes, [*keys, "_b"]).withColumn("rank", (F.col("_base") + F.col("_in")).cast("int")).drop("_b", "_base", "_in")


def deep_ranks(scores: DataFrame, query: str, item: str, levels: int = 4096) -> DataFrame:
    """Adds ``rank`` at full depth: by ``score`` downwards, ties by id.

    Buckets are levels of the score. Rows of score zero, of which there may be as many as documents, have a level of their own, in buckets of
    ids if these are numbers.
    """
    s = F.col("score")
    level = F.when(s > 0, -F.ceil(s * levels)).when(s < 0, F.floor(-s * levels) + 1).otherwise(F.lit(0)).cast("long")
    number = dict(scores.dtypes)[item] in ("bigint", "int")
    part = F.when(s == 0, F.floor(F.col(item) / BUCKET)).otherwise(F.lit(0)).cast("long") if number else F.lit(0).cast("long")
    return ranked_in_buckets(scores, [query], F.struct(level.alias("level"), part.alias("part")), [F.desc("score"), item])


def order_statistics(df: DataFrame, key: str, value: str, places: dict[str, Column], fine: float = 100.0) -> DataFrame:
    """One row a key: for each name the value at that 0-based place of the sorted values; ``places`` are columns of ``n``, the group's rows.

    Buckets are values times ``fine``, rounded down; only the buckets that hold a place are sorted.
    """
    rows = df.select(key, F.col(value).alias("_x"), F.floor(F.col(value) * fine).alias("_b"))
    counts = rows.groupBy(key, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(key).orderBy("_b")
    counts = counts.withColumn("_end", F.sum("_c").over(w)).withColumn("n", F.sum("_c").over(Window.partitionBy(key)))
    wanted = counts.select(key, "_b", "n", (F.col("_end") - F.col("_c")).alias("_start"), "_end", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.cast("long").alias("at")) for k, c in places.items()])).alias("p"))
    wanted = wanted.filter((F.col("p.at") >= F.col("_start")) & (F.col("p.at") < F.col("_end")))
    hit = rows.join(wanted.select(key, "_b", "_start").distinct(), [key, "_b"])
    placed = hit.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_b").orderBy("_x")) - 1 + F.col("_start"))
    found = placed.join(wanted.select(key, "_b", "p"), [key, "_b"]).filter("_i = p.at")
    return found.groupBy(key).agg(*[F.max(F.when(F.col("p.name") == k, F.col("_x"))).alias(k) for k in places])
