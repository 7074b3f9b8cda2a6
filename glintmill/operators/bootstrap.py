"""Seeded bootstrap intervals. A draw is a hash of seed, resample and slot, so results are the same on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.operators import guards
from glintmill.operators.ordered import running_total
from glintmill.sources.tables import beside

REPS, SEED = 2000, 20260806


def resampled_means(values: DataFrame, keys: list[str], reps: int = REPS, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(keys, seed, rep, mean) of ``values`` (keys, cluster, value): clusters are drawn with replacement, their values flattened.

    All keys share the draws, slot by slot, in the order of cluster ids; so differences are paired.
    """
    per = values.groupBy(*keys, "cluster").agg(F.sum(F.col("value").cast("decimal(20,12)")).cast("decimal(20,12)").alias("s"), F.count("value").alias("c"))
    clusters = values.select("cluster").distinct()
    guards.none_of(clusters.filter("cluster IS NULL"), "values of no cluster")
    numbered = running_total(clusters.withColumn("_all", F.lit(0)), ["_all"], "cluster", F.lit(1)).select("cluster", F.col("before").alias("slot"))
    n = clusters.agg(F.count("*").alias("n"))
    spark = values.sparkSession
    draws = spark.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(n)).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("at", F.explode(F.expr("sequence(0, n - 1)")))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "seed", "rep", "at").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")
    picked = draws.select("seed", "rep", draw.alias("slot")).groupBy("seed", "rep", "slot").agg(F.count("*").cast("int").alias("times"))
    joined = picked.join(beside(numbered), "slot").join(per, "cluster")
    return joined.groupBy(*keys, "seed", "rep").agg((F.sum(F.col("s") * F.col("times")).cast("double") / F.sum(F.col("c") * F.col("times"))).alias("mean"))


def intervals(values: DataFrame, keys: list[str], **how) -> DataFrame:
    """(keys, seed, mean, lo, hi, excludes_zero): 95 % percentile interval; a bound of exactly zero doesn't exclude it."""
    means = resampled_means(values, keys, **how)
    ci = means.groupBy(*keys, "seed").agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    observed = values.groupBy(*keys).agg(F.round(F.avg(F.col("value").cast("decimal(20,12)")).cast("double"), 6).alias("mean"))
    # Bounds are interpolated; the last bit of one that lies halfway between two roundings shall not decide.
    lo, hi = F.round(F.col("ci")[0] + 1e-10, 6), F.round(F.col("ci")[1] + 1e-10, 6)
    return ci.join(observed, keys).select(*keys, "seed", "mean", lo.alias("lo"), hi.alias("hi"), ((lo > 0) | (hi < 0)).alias("excludes_zero"))


def needed(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Questions needed to tell a mean difference from zero: round((1.96 * sd / mean) ** 2); null where the mean is zero."""
    m, sd = F.avg("diff"), F.stddev_samp("diff")
    return diffs.groupBy(*keys).agg(F.count("*").alias("n"), F.round(m, 6).alias("mean_diff"), F.when(F.round(m, 6) != 0, F.round(F.pow(1.96 * sd / m, F.lit(2.0)), 0).cast("long")).alias("needed"))
