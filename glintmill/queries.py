"""All named queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glintmill.plans import audit, evaluation, lexical, markdown, retrieval, segmentation

PLANS = (lexical, retrieval, evaluation, segmentation, markdown, audit)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for plan in PLANS for f in plan.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from ``benchmark``, ranked over ``documents`` three ways and scored: one row a variant."""
    return evaluation.eval_aggregate(spark, sf_dir)
