"""Queries on documents: scans, terms, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintmill.functions import text as T
from glintmill.operators import fingerprint, lexical
from glintmill.plans import sql
from glintmill.sources.tables import table


def scan_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), F.size(F.split("text", "\n", -1)).alias("n_lines"))


def tokenise(spark, d):
    t = T.terms(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_terms"), F.md5(F.array_join(t, " ").cast("binary")).alias("terms_md5"))


def vocabulary(spark, d):
    return lexical.vocabulary(table(spark, d, "documents"))


def plural_fold(spark, d):
    v = lexical.vocabulary(table(spark, d, "documents"))
    return lexical.plural_fold(v, v).filter("term <> folded").select("term", "folded")


def document_frequency(spark, d):
    return lexical.document_frequency(table(spark, d, "documents"))


def text_hashes(spark, d):
    return fingerprint.text_hashes(table(spark, d, "documents"))


def duplicate_groups(spark, d):
    return fingerprint.duplicate_groups(table(spark, d, "documents"))


def corpus_fingerprint(spark, d):
    return fingerprint.corpus_fingerprint(table(spark, d, "documents"))


def size_skew(spark, d):
    return fingerprint.size_skew(table(spark, d, "documents"))


def page_title(spark, d):
    heading = F.concat(F.lit("intro\n#no\n# "), F.when(F.col("doc_id") % 2 == 0, F.lit(" \t ")).otherwise(F.lit("")), "source", F.lit(" \n# second\n"))
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, heading).otherwise(F.lit("")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.title(text).alias("title"))


QUERIES = [scan_documents, tokenise, vocabulary, plural_fold, document_frequency, text_hashes, duplicate_groups, corpus_fingerprint, size_skew, page_title]
_LEVEL = "SELECT b AS k, sha256(string_agg(h, '' ORDER BY k, h)) AS h FROM (SELECT *, k // 1024 AS b FROM {0}) GROUP BY b"
SQL = {
    "scan_documents": "SELECT doc_id, source, length(text)::INT AS n_chars, strlen(text)::INT AS n_bytes, len(string_split(text, chr(10)))::INT AS n_lines FROM documents",
    "tokenise": f"SELECT doc_id, len({sql.terms('text')})::INT AS n_terms, md5(array_to_string({sql.terms('text')}, ' ')) AS terms_md5 FROM documents",
    "vocabulary": f"WITH {sql.VOCAB} SELECT term FROM vocab",
    "plural_fold": f"WITH {sql.VOCAB} SELECT term, folded FROM fold WHERE term <> folded",
    "document_frequency": f"WITH {sql.FREQUENCY} SELECT term, df FROM freq",
    "text_hashes": f"SELECT doc_id, sha256(text) AS sha256, sha256({sql.NORMALISED}) AS sha256_norm FROM documents",
    "duplicate_groups": f"WITH h AS (SELECT doc_id, sha256({sql.NORMALISED}) AS sha256_norm FROM documents) SELECT sha256_norm, count(*) OVER w AS n, min(doc_id) OVER w AS first_id, doc_id FROM h WINDOW w AS (PARTITION BY sha256_norm) QUALIFY n > 1",
    "corpus_fingerprint": f"WITH a AS (SELECT doc_id AS k, sha256(text) AS h FROM documents), b AS ({_LEVEL.format('a')}), c AS ({_LEVEL.format('b')}), e AS ({_LEVEL.format('c')}) SELECT sha256(string_agg(h, '' ORDER BY k, h)) AS corpus_sha256 FROM e",
    "size_skew": "WITH s AS (SELECT doc_id, length(text) AS n FROM documents), t AS (SELECT sum(n)::BIGINT AS top_chars FROM (SELECT n FROM s ORDER BY n DESC, doc_id LIMIT 3)) SELECT (SELECT sum(n)::BIGINT FROM s) AS total_chars, top_chars, round(top_chars / (SELECT sum(n) FROM s), 6) AS share FROM t",
    "page_title": "SELECT doc_id, coalesce(regexp_replace(substring(list_filter(string_split(CASE WHEN doc_id % 3 = 0 THEN 'intro' || chr(10) || '#no' || chr(10) || '# ' || CASE WHEN doc_id % 2 = 0 THEN ' ' || chr(9) || ' ' ELSE '' END || source || ' ' || chr(10) || '# second' || chr(10) ELSE '' END || text, chr(10)), lambda x: x LIKE '# %')[1], 3), '^\\s+|\\s+$', '', 'g'), '(untitled)') AS title FROM documents",
}
