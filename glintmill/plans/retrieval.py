"""Queries that rank: keyword, dense, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.functions import text as T
from glintmill.operators import provenance as P
from glintmill.operators import retrieval as R
from glintmill.operators import scored
from glintmill.operators.evaluation import gold_by_containment
from glintmill.operators.fingerprint import corpus_fingerprint
from glintmill.operators.nearest import dense_top
from glintmill.plans import sql
from glintmill.sources.holding import hold, kept
from glintmill.sources.tables import table

def questions(spark, d, degraded: bool = False) -> DataFrame:
    terms = T.degraded_terms(F.col("text")) if degraded else T.terms(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), terms.alias("terms"))


def docs_of(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def gold(spark, d) -> DataFrame:
    return kept(spark, d, "gold", lambda: gold_by_containment(docs_of(spark, d), questions(spark, d).select("item_id", "question")))


def asked(spark, d, degraded: bool, keep: bool = False) -> scored.Asked:
    return scored.Asked(docs_of(spark, d), questions(spark, d, degraded), keep)


def keyword_top(spark, d, degraded: bool, top: int = 20) -> DataFrame:
    return scored.top_scores(docs_of(spark, d), asked(spark, d, degraded), top)


def runs(spark, d) -> DataFrame:
    """variant, item_id, doc_id, score, rank: the first 20 of each variant for degraded questions."""
    return kept(spark, d, "runs", lambda: scored.variants(docs_of(spark, d), asked(spark, d, True, keep=True), 20))


def bm25_stats(spark, d):
    docs = docs_of(spark, d)
    p = R.postings(docs).agg(F.count("*").alias("n_postings"), F.countDistinct("term").alias("n_terms"))
    return R.statistics(docs).crossJoin(p).select("n", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings")


def bm25_idf(spark, d):
    docs = docs_of(spark, d)
    df = R.postings(docs).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(R.statistics(docs))).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def bm25_scores(spark, d):
    return scored.full_scores(docs_of(spark, d), asked(spark, d, False)).select("item_id", "doc_id", F.round("score", 6).alias("score"))


def bm25_topk(spark, d):
    return keyword_top(spark, d, False).select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def vector_norms(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dim"), F.round(norm, 6).alias("norm"), (F.abs(norm - 1) <= 1e-4).alias("is_unit"))


def dense_hits(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return dense_top(e, q, 20)


def dense_topk(spark, d):
    return dense_hits(spark, d).select("q", "rank", "vec_id", F.round("score", 6).alias("score"))


def doc_collapse(spark, d):
    hits = dense_hits(spark, d).withColumn("doc", F.expr("vec_id div 100"))
    return R.collapse(hits, "q", "doc", 3).select("q", "rank", "doc", "vec_id", "hit_rank")


def hash_embed(spark, d):
    return R.hash_vector_rows(docs_of(spark, d))


def rrf_scores(spark, d):
    return scored.fused_scores(docs_of(spark, d), asked(spark, d, False)).select("item_id", "doc_id", F.round("score", 9).alias("score"))


def hybrid_topk(spark, d):
    return scored.variants(docs_of(spark, d), asked(spark, d, False, keep=True), 20).filter("variant = 'hybrid'").select("item_id", "rank", "doc_id", F.round("score", 9).alias("score"))


def gold_depth(spark, d):
    return scored.depths(docs_of(spark, d), asked(spark, d, True), gold(spark, d))


def ranking_drift(spark, d):
    """Whole and degraded questions are ranked together, so each text is read twice and not four times."""
    named = lambda mark, degraded: questions(spark, d, degraded).select(F.concat(F.lit(mark), F.col("item_id").cast("string")).alias("item_id"), "terms")
    top = hold(scored.top_scores(docs_of(spark, d), scored.Asked(docs_of(spark, d), named("w", False).union(named("d", True))), 20))
    of = lambda mark: top.filter(F.col("item_id").startswith(mark)).withColumn("item_id", F.substring("item_id", 2, 99).cast("long"))
    return R.drift(of("w"), of("d"))


def index_consistency(spark, d):
    v, t = table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), docs_of(spark, d).select(F.col("doc_id").alias("id"))
    missing, extra = t.join(v, "id", "left_anti").agg(F.count("*").alias("without_vector")), v.join(t, "id", "left_anti").agg(F.count("*").alias("without_document"))
    sizes = table(spark, d, "embeddings").agg(F.countDistinct(F.size("embedding")).alias("n_lengths"))
    return v.agg(F.count("*").alias("n_vectors")).crossJoin(sizes).crossJoin(t.agg(F.count("*").alias("n_documents"))).crossJoin(missing).crossJoin(extra)


def vector_fingerprint(spark, d):
    return P.vector_fingerprint(table(spark, d, "embeddings"))


def index_manifest(spark, d):
    """The manifest of an index of all documents and vectors, but for what depends on the machine."""
    docs = docs_of(spark, d)
    corpus = corpus_fingerprint(docs).first().corpus_sha256
    return P.manifest(corpus, docs, table(spark, d, "embeddings"), "hashed-terms").select("corpus_sha256", "vectors_sha256", "model", "embedding_dim", "normalized", "token_limit", "n_chunks", "n_vectors")


QUERIES = [bm25_stats, bm25_idf, bm25_scores, bm25_topk, vector_norms, dense_topk, doc_collapse, hash_embed, rrf_scores, hybrid_topk, gold_depth, ranking_drift, index_consistency, vector_fingerprint, index_manifest]
_B = sql.bm25(sql.terms("text"))
_HASHED_VECTORS = f"SELECT vec_id AS k, sha256(array_to_string(list_transform(embedding, lambda x: floor(x::DOUBLE * {P.STEPS} + 0.5)::BIGINT::VARCHAR), ',')) AS h FROM embeddings"
_DENSE = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), ds AS (SELECT q.vec_id AS q, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q, e c WHERE q.vec_id % 10 = 0 AND c.vec_id <> q.vec_id),
  hits AS (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id))::INT AS rank FROM ds QUALIFY rank <= 20)"""
SQL = {
    "bm25_stats": f"WITH {_B} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM bdf) AS n_terms, (SELECT count(*) FROM post) AS n_postings FROM st",
    "bm25_idf": f"WITH {_B} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM bdf, st",
    "bm25_scores": f"WITH {_B} SELECT item_id, doc_id, round(score, 6) AS score FROM sc",
    "bm25_topk": f"WITH {_B}, {sql.ranked('sc', 'r')} SELECT item_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 20",
    "vector_norms": "WITH n AS (SELECT vec_id, len(embedding)::INT AS dim, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings) SELECT vec_id, dim, round(norm, 6) AS norm, abs(norm - 1) <= 1e-4 AS is_unit FROM n",
    "dense_topk": f"WITH {_DENSE} SELECT q, rank, vec_id, round(score, 6) AS score FROM hits",
    "doc_collapse": f"WITH {_DENSE}, b AS (SELECT q, vec_id // 100 AS doc, vec_id, rank AS hit_rank FROM hits QUALIFY row_number() OVER (PARTITION BY q, vec_id // 100 ORDER BY rank) = 1) SELECT q, (row_number() OVER (PARTITION BY q ORDER BY hit_rank))::INT AS rank, doc, vec_id, hit_rank FROM b QUALIFY rank <= 3",
    "hash_embed": f"WITH {sql.hashed()} SELECT doc_id, bucket::INT AS bucket, round(c / sqrt(square::DOUBLE), 6) AS value FROM hb JOIN hs USING (doc_id)",
    "rrf_scores": f"WITH {sql.fused(sql.terms('text'))} SELECT item_id, doc_id, round(score, 9) AS score FROM fu",
    "hybrid_topk": f"WITH {sql.fused(sql.terms('text'))} SELECT item_id, rank::INT AS rank, doc_id, round(score, 9) AS score FROM rh WHERE rank <= 20",
    "gold_depth": f"WITH {sql.bm25(sql.degraded('text'))}, {sql.ranked('sc', 'r')}, {sql.GOLD} SELECT item_id, min(rank)::INT AS depth FROM r JOIN gold USING (item_id, doc_id) GROUP BY 1",
    "ranking_drift": f"""WITH a AS (WITH {_B}, {sql.ranked('sc', 'r')} SELECT item_id, rank, doc_id FROM r WHERE rank <= 20), b AS (WITH {sql.bm25(sql.degraded('text'))}, {sql.ranked('sc', 'r')} SELECT item_id, rank, doc_id FROM r WHERE rank <= 20)
      SELECT item_id, min(rank) FILTER (a.doc_id IS DISTINCT FROM b.doc_id)::INT AS first_difference FROM a FULL JOIN b USING (item_id, rank) GROUP BY 1""",
    "vector_fingerprint": f"WITH {sql.merkle(_HASHED_VECTORS, 'vectors_sha256', 'mv')} SELECT * FROM mv",
    "index_manifest": f"""WITH {sql.merkle(_HASHED_VECTORS, 'vectors_sha256', 'mv')}, {sql.merkle('SELECT doc_id AS k, sha256(text) AS h FROM documents', 'corpus_sha256', 'mc')},
      n AS (SELECT max(len(embedding))::INT AS embedding_dim, coalesce(bool_and(abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-4), false) AS normalized, count(*) AS n_vectors FROM embeddings)
      SELECT corpus_sha256, vectors_sha256, 'hashed-terms' AS model, embedding_dim, normalized, 254 AS token_limit, (SELECT count(*) FROM documents) AS n_chunks, n_vectors FROM mc, mv, n""",
    "index_consistency": "SELECT (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(DISTINCT len(embedding)) FROM embeddings) AS n_lengths, (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS without_document",
}
