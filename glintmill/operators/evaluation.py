"""Scores of rankings against gold: null is undefined, 0.0 is a miss."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.operators.lexical import anchors, candidates
from glintmill.operators.seeking import containing
from glintmill.sources.tables import beside, few

CUT = 10
METRICS = ("recall_3", "recall_10", "precision_3", "reciprocal_rank")


def gold_by_containment(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents that contain the text of a question (item_id, question); an empty one is contained in none.

    Few questions are looked for in every text, as it is read. Of many, candidates come from postings, by the rarest of what the question's text must
    bring along; their texts are looked at.
    """
    q = questions.filter("question <> ''")
    if few(q):
        return containing(docs, q)
    near = candidates(docs, q.select(F.col("item_id").alias("id"), F.explode(anchors(F.col("question"))).alias("anchor")))
    with_words = docs.join(beside(near), "doc_id").join(beside(q), F.col("id") == F.col("item_id")).filter(F.col("text").contains(F.col("question"))).select("item_id", "doc_id")
    # A question without a letter or digit of ASCII has no postings: each such is looked for in every text.
    bare = beside(q.filter(F.size(anchors(F.col("question"))) == 0))
    return with_words.union(docs.join(bare, F.col("text").contains(F.col("question"))).select("item_id", "doc_id")).distinct()


def score_rows(rankings: DataFrame, gold: DataFrame, questions: DataFrame, surface: DataFrame, cut: int = CUT) -> DataFrame:
    """One row a variant and question: n_gold, recall, precision, first relevant rank, reciprocal rank, surface hits.

    n_gold comes from the gold, not from what was found, so a question without hits isn't one without gold.
    """
    n_gold = gold.distinct().groupBy("item_id").agg(F.count("*").alias("n_gold"))
    marked = rankings.join(gold.distinct().withColumn("is_gold", F.lit(1)), ["item_id", "doc_id"], "left").join(surface.select("doc_id").distinct().withColumn("on_surface", F.lit(1)), "doc_id", "left")
    hits = lambda k: F.count_if((F.col("rank") <= k) & (F.col("is_gold") == 1))
    per = marked.groupBy("variant", "item_id").agg(hits(3).alias("h3"), hits(cut).alias("h10"), F.min(F.when(F.col("is_gold") == 1, F.col("rank"))).alias("first_rank"),
                                                   F.count_if((F.col("rank") <= cut) & (F.col("on_surface") == 1)).alias("surface_hits"))
    variants = rankings.select("variant").distinct()
    out = questions.select("item_id").crossJoin(beside(variants)).join(n_gold, "item_id", "left").join(per, ["variant", "item_id"], "left")
    n = F.coalesce("n_gold", F.lit(0))
    defined = lambda x: F.when(n > 0, x)
    return out.select(
        "variant", "item_id", n.alias("n_gold"), (n > 0).alias("answerable"), defined(F.coalesce("h3", F.lit(0)) / n).alias("recall_3"), defined(F.coalesce("h10", F.lit(0)) / n).alias("recall_10"),
        defined(F.coalesce("h3", F.lit(0)) / 3).alias("precision_3"), defined(F.col("first_rank")).alias("first_rank"), defined(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("reciprocal_rank"),
        F.coalesce("surface_hits", F.lit(0)).alias("surface_hits"))


def _mean(c: str) -> F.Column:
    """Over exact decimals, so that it doesn't depend on order."""
    return F.round(F.avg(F.col(c).cast("decimal(20,12)")).cast("double"), 6)


def aggregate(scores: DataFrame) -> DataFrame:
    """One row a variant, over answerable questions; raises when read if there is none. Slots count ten a question."""
    a = scores.groupBy("variant").agg(
        F.count_if("answerable").alias("n_answerable"), *[F.round(F.avg(F.when(F.col("answerable"), F.col(m).cast("decimal(20,12)"))).cast("double"), 6).alias(f"mean_{m}") for m in METRICS],
        F.count_if(F.col("answerable") & (F.col("recall_10") == 0)).alias("no_gold_10"), F.count_if(F.col("answerable") & F.col("first_rank").isNull()).alias("no_gold_at_all"),
        F.count_if(F.col("first_rank") == 1).alias("gold_at_1"), F.sum(F.when(F.col("answerable"), F.col("surface_hits")).otherwise(0)).alias("surface_hits"))
    checked = F.when(F.col("n_answerable") > 0, F.col("n_answerable")).otherwise(F.raise_error(F.lit("no answerable question")).cast("long"))
    return a.withColumn("n_answerable", checked).withColumn("surface_slots", 10 * F.col("n_answerable"))


def long_scores(scores: DataFrame) -> DataFrame:
    """(variant, item_id, metric, value) of answerable questions."""
    s = scores.filter("answerable")
    return s.select("variant", "item_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("x")).select("variant", "item_id", "x.metric", "x.value")


def comparison(scores: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """One row a metric, a column a variant."""
    return long_scores(scores).groupBy("metric").pivot("variant", list(variants)).agg(_mean("value"))


def differences(scores: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """(comparison, metric, item_id, diff): later variant minus earlier, per question."""
    wide = long_scores(scores).groupBy("metric", "item_id").pivot("variant", list(variants)).agg(F.first("value"))
    each = [F.struct(F.lit(f"{b}-{a}").alias("comparison"), (F.col(b) - F.col(a)).alias("diff")) for a, b in combinations(variants, 2)]
    return wide.select("metric", "item_id", F.explode(F.array(*each)).alias("d")).select("d.comparison", "metric", "item_id", "d.diff")


def movement(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("comparison", "metric").agg(F.count_if(F.col("diff") > 0).alias("better"), F.count_if(F.col("diff") < 0).alias("worse"), F.count_if(F.col("diff") == 0).alias("unchanged"))


def prevalence(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of gold by band of ranks, over questions that have gold."""
    band = F.when(F.col("rank") <= 3, "01-03").when(F.col("rank") <= 10, "04-10").when(F.col("rank") <= 20, "11-20")
    r = rankings.join(gold.select("item_id").distinct(), "item_id", "left_semi").join(gold.withColumn("g", F.lit(1)), ["item_id", "doc_id"], "left")
    return r.filter("rank <= 20").groupBy("variant", band.alias("band")).agg(F.count("*").alias("n"), F.round(F.count("g") / F.count("*"), 6).alias("gold_share"))
