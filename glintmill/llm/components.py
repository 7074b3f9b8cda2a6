"""Connected components of a graph of links, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.llm import common


def _settled(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), both long; root is the smallest node of the component.

    Each round first links every larger neighbour to the smallest neighbour, then every node's smaller neighbours to the
    smallest of them, so that components become stars in a logarithmic number of rounds. Rounds are written to the shared
    folder; nothing is collected but a count and a checksum. Loops and repeats are dropped; no edges give no rows.
    """
    at = common.materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _settled(at)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = common.materialise(new, "links")
        common.discard(at)
        now, at = _settled(new), new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select("v", "v").distinct())
