"""Dense, keyword and fused ranking. Rankings are long: a query key, rank, an id, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintmill.functions import text as T
from glintmill.operators.lexical import term_rows
from glintmill.operators.ordered import deep_ranks, running_total
from glintmill.sources.holding import hold
from glintmill.sources.tables import beside

K1, B, RRF_K, DIM = 1.2, 0.75, 60, 64
#: Contributions are added as whole billionths, so a sum doesn't depend on its order.
UNIT, RRF_UNIT = 1e9, 1e15


def ranked(scores: DataFrame, query: str, item: str, top: int | None = None) -> DataFrame:
    """Adds ``rank``: by score downwards, ties by id. With ``top`` each partition keeps that many before the shuffle."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item)))
    return out if top is None else out.filter(F.col("rank") <= top)


def postings(docs: DataFrame) -> DataFrame:
    return term_rows(docs).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(T.terms(F.col("text"))).alias("dl"))


def statistics(docs: DataFrame) -> DataFrame:
    """One row: n documents, average length; empty documents count. An empty corpus raises when read."""
    return _checked(lengths(docs).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def _checked(s: DataFrame) -> DataFrame:
    return s.select(F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("an empty corpus")).cast("long")).alias("n"), "avgdl")


def idf(n: F.Column, df: F.Column) -> F.Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, doc_id, score) of documents that hold a query term; ``queries`` (item_id, terms), each occurrence counts; doc_ids are distinct.

    The corpus is read once: postings of query terms go on, each with its document's length, and a posting of no term for every document,
    from which come the number of documents and their average length. Terms of the corpus are joined with those of queries by
    broadcast where a count allows, else by a shuffle on the term. An empty corpus raises when read.
    """
    asked = queries.select("item_id", F.explode("terms").alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("qf"))
    wanted = asked.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    terms = docs.select("doc_id", T.terms(F.coalesce("text", F.lit(""))).alias("ts"))
    every = terms.select("doc_id", F.size("ts").alias("dl"), F.explode(F.array_append("ts", F.lit(""))).alias("term"))
    rows = hold(every.join(beside(wanted), "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl")))
    stats = F.broadcast(_checked(rows.filter("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))))  # one row
    rows = rows.filter("term <> ''")
    whole = rows.join(rows.groupBy("term").agg(F.count("*").alias("df")), "term").crossJoin(stats)
    weight = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    whole = whole.withColumn("weight", weight).select("term", "doc_id", "weight")
    hit = whole.join(beside(asked), "term").withColumn("part", F.floor(F.col("qf") * F.col("weight") * UNIT + 0.5).cast("long"))
    return hit.groupBy("item_id", "doc_id").agg((F.sum("part") / UNIT).alias("score"))


def depth_of(scores: DataFrame, docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(item_id, doc_id, rank): where gold stands at full depth; ``scores`` (item_id, doc_id, score) of scored documents, all others are at 0.0.

    Scored gold is ranked among the scored. Where unscored gold stands follows from counts: all scored, and the unscored of smaller ids.
    """
    gold = gold.select("item_id", "doc_id").distinct()
    found = deep_ranks(scores, "item_id", "doc_id").join(gold, ["item_id", "doc_id"]).select("item_id", "doc_id", "rank")
    rest = gold.join(scores, ["item_id", "doc_id"], "left_anti")
    placed = running_total(docs.select("doc_id").withColumn("_all", F.lit(0)), ["_all"], "doc_id", F.lit(1)).select("doc_id", "before")
    rest = rest.join(placed, "doc_id").withColumnRenamed("doc_id", "gold")
    other = scores.select("item_id", "doc_id")
    counted = rest.join(other, "item_id", "left").groupBy("item_id", "gold", "before").agg(F.count("doc_id").alias("n"), F.count_if(F.col("doc_id") < F.col("gold")).alias("earlier"))
    return found.union(counted.select("item_id", "gold", (F.col("n") + 1 + F.col("before") - F.col("earlier")).cast("int")))


def full_depth(scores: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Every document for every query, 0.0 where it wasn't scored."""
    return beside(queries.select("item_id")).crossJoin(docs.select("doc_id")).join(scores, ["item_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def with_unscored(scores: DataFrame, queries: DataFrame, docs: DataFrame, top: int) -> DataFrame:
    """``scores`` and as many documents at 0.0 as a list of ``top`` can need: of 2 * top smallest ids at least top are unscored where a query has under top scored."""
    spare = docs.select("doc_id").orderBy("doc_id").limit(2 * top)
    zero = beside(queries.select("item_id")).crossJoin(F.broadcast(spare)).join(scores, ["item_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return scores.unionByName(zero)


def hash_vectors(rows: DataFrame, key: str, terms: F.Column) -> DataFrame:
    """The default encoder: (key, v array<long> of DIM counts, square); the vector is v / sqrt(square), zero without a term."""
    counts = lambda ts: F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda b: F.size(F.filter(ts, lambda x: x == b)).cast("long"))
    v = rows.select(key, F.transform(terms, lambda t: T.bucket(t, DIM)).alias("b")).select(key, counts(F.col("b")).alias("v"))
    return v.withColumn("square", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))


def hash_vector_rows(docs: DataFrame) -> DataFrame:
    """The vectors' non-zero places: doc_id, bucket, value. Counted by groups, so a long text is no long array."""
    c = term_rows(docs).withColumn("bucket", T.bucket(F.col("term"), DIM)).groupBy("doc_id", "bucket").agg(F.count("*").alias("c"))
    s = c.groupBy("doc_id").agg(F.sum(F.col("c") * F.col("c")).alias("square"))
    return c.join(s, "doc_id").select("doc_id", "bucket", F.round(F.col("c") / F.sqrt("square"), 6).alias("value"))


def dense_by_terms(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, doc_id, score): cosine of hash vectors; every pair. Queries keep their non-zero places only."""
    c = term_rows(docs).withColumn("bucket", T.bucket(F.col("term"), DIM)).groupBy("doc_id", "bucket").agg(F.count("*").alias("c"))
    d = c.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "c"))).alias("m"), F.sum(F.col("c") * F.col("c")).alias("square"))
    places = F.expr(f"transform(sequence(0, {DIM - 1}), b -> coalesce(try_element_at(m, b), 0L))")
    d = docs.select("doc_id").join(d.select("doc_id", places.alias("v"), "square"), "doc_id", "left")
    q = hash_vectors(queries, "item_id", F.col("terms")).select("item_id", F.expr("filter(transform(v, (x, i) -> struct(i AS b, x AS c)), x -> x.c > 0)").alias("e"), F.col("square").alias("q_square"))
    dot = F.expr("aggregate(e, 0L, (a, x) -> a + x.c * v[x.b])")
    pairs = d.crossJoin(beside(q))
    score = F.when(F.col("square").isNull() | (F.col("q_square") == 0), F.lit(0.0)).otherwise(dot / F.sqrt((F.col("square") * F.col("q_square")).cast("double")))
    return pairs.select("item_id", "doc_id", score.alias("score"))


def dense(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, vec_id, score): inner products in double, components in order; every pair. ``vectors`` (vec_id, embedding), ``queries`` (q, qv)."""
    dot = F.aggregate(F.zip_with("qv", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return vectors.crossJoin(beside(queries)).select("q", "vec_id", dot.alias("score"))


def collapse(hits: DataFrame, query: str, group: str, top: int) -> DataFrame:
    """Each group at its best rank, ranked again; hits are cut before, so fewer than ``top`` may be left."""
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy(query, group).orderBy("rank"))).filter("n = 1").drop("n").withColumnRenamed("rank", "hit_rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("hit_rank"))).filter(F.col("rank") <= top)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(item_id, doc_id, score) from ranked lists: the sum of 1 / (k + rank); a list without the id adds nothing."""
    if not lists:
        raise ValueError("no lists to fuse")
    whole = lists[0].select("item_id", "doc_id", "rank")
    for more in lists[1:]:
        whole = whole.unionByName(more.select("item_id", "doc_id", "rank"))
    part = F.floor(F.lit(RRF_UNIT) / (k + F.col("rank")) + 0.5).cast("long")
    return whole.groupBy("item_id", "doc_id").agg((F.sum(part) / RRF_UNIT).alias("score"))


def drift(one: DataFrame, other: DataFrame) -> DataFrame:
    """(item_id, first_difference): the first rank at which two rankings differ, one being shorter included; null if none."""
    a, b = one.select("item_id", "rank", F.col("doc_id").alias("a")), other.select("item_id", "rank", F.col("doc_id").alias("b"))
    return a.join(b, ["item_id", "rank"], "full").groupBy("item_id").agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("rank"))).alias("first_difference"))
