"""Checks that raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    pass


def same_fingerprint(one: str | None, other: str | None, what: str) -> None:
    if one != other:
        raise GuardError(f"{what}: made from other data ({one} and {other})")


def none_of(df: DataFrame, what: str, shown: int = 5) -> None:
    """Raises with the first rows if ``df`` has any."""
    rows = df.limit(shown).collect()
    if rows:
        raise GuardError(f"{what}: {rows}")


def cutoff(k: int, length: int) -> None:
    """Raises before anything is scored, whether or not there is gold."""
    if not 0 < k <= length:
        raise GuardError(f"k is {k}, the list has {length}")


def lists_reach(rankings: DataFrame, k: int, keys: tuple[str, ...] = ("variant", "item_id")) -> None:
    """Raises if a ranked list has fewer than ``k`` entries: a cutoff beyond its end would count what isn't there as misses."""
    if k <= 0:
        raise GuardError(f"k is {k}")
    none_of(rankings.groupBy(*keys).agg(F.max("rank").alias("n")).filter(F.col("n") < k), f"lists of under {k}")


def within_tokens(chunks: DataFrame, limit: int) -> None:
    none_of(chunks.filter(F.col("n_tokens") > limit), f"chunks of over {limit} tokens")


def unit_norms(vectors: DataFrame, tolerance: float = 1e-4) -> None:
    none_of(vectors.filter(F.abs(F.col("norm") - 1) > tolerance), "vectors that aren't of length 1")


def exact_cover(clusters: DataFrame, members: DataFrame) -> None:
    """Each member in one cluster, and no other: ``clusters`` (cluster, member), ``members`` (member)."""
    none_of(members.join(clusters, "member", "left_anti"), "in no cluster")
    none_of(clusters.join(members, "member", "left_anti"), "in a cluster, but unknown")
    none_of(clusters.groupBy("member").count().filter("count > 1"), "in several clusters")


def same_ids(left: DataFrame, right: DataFrame, key: str) -> None:
    none_of(left.join(right, key, "left_anti"), f"{key} on the left only")
    none_of(right.join(left, key, "left_anti"), f"{key} on the right only")
