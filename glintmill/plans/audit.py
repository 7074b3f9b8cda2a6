"""Queries that audit labels and links, build judging pools, and measure agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintmill.functions import text as T
from glintmill.operators import audit as A
from glintmill.operators import judging as J
from glintmill.operators.lexical import document_frequency, vocabulary
from glintmill.plans import retrieval as R
from glintmill.plans import sql
from glintmill.sources.holding import kept
from glintmill.sources import tables as S
from glintmill.sources.tables import table

DF_MAX = 200


def shared(spark, d):
    return kept(spark, d, "shared", lambda: A.shared_terms(R.docs_of(spark, d), R.questions(spark, d), R.gold(spark, d)))


def shared_rare_terms(spark, d):
    return shared(spark, d).filter(F.col("df") <= DF_MAX)


def leak_flags(spark, d):
    return A.leak_flags(shared(spark, d), DF_MAX)


def leak_sweep(spark, d):
    return A.leak_sweep(shared(spark, d), 1_000_000_000)


def answers(spark, d):
    """Answers made from ``supplier``: an identifier, a flag, a backticked name, a backticked common word and a span of two words."""
    a = F.concat(F.lit("Set `"), F.col("s_name"), F.lit("` with --use-key in settings.json, not `the thing` or `with`; see cleanupPeriodDays."))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), a.alias("answer"))


def answer_keys(spark, d):
    docs = R.docs_of(spark, d)
    return A.answer_keys(answers(spark, d), document_frequency(docs), vocabulary(docs))


def passage_keys(spark, d):
    """Six keys of each question: its shortest terms."""
    shortest = F.slice(F.transform(F.array_sort(F.transform(F.array_distinct("terms"), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), lambda x: x["t"]), 1, 6)
    return R.questions(spark, d).select(F.col("item_id").alias("id"), F.explode(shortest).alias("key"))


def restatements(spark, d):
    return A.restatements(R.docs_of(spark, d), passage_keys(spark, d), R.gold(spark, d))


def restatement_triage(spark, d):
    q = R.questions(spark, d).select(F.col("item_id").alias("id"))
    return A.triage(q, passage_keys(spark, d), restatements(spark, d))


def find_text(spark, d):
    return A.find(R.docs_of(spark, d), "TOKEN")


def doc_outline(spark, d):
    return R.docs_of(spark, d).select("doc_id", T.preview(F.col("text")).alias("first_line"))


def gold_files(spark, d):
    """A gold file made from ``region``: a question a section, some unanswerable, one type left empty."""
    k, name = F.col("r_regionkey"), F.col("r_name")
    yes = k % 2 == 0
    number = F.lpad((k + 1).cast("string"), 2, "0")
    section = F.concat(
        F.lit("## Q"), number, F.lit("\n\n**Question:** What is "), name, F.lit("?\n**Type:**"), F.when(k == 2, F.lit("")).otherwise(F.lit(" fact")), F.lit("\n**Source:** none\n**Answerable:** "), F.when(yes, F.lit("Yes")).otherwise(F.lit("no")),
        F.lit("\n**Gold chunks:** "), F.when(yes, F.concat(F.lit("`doc-0"), k.cast("string"), F.lit(":c001`, `doc-0"), k.cast("string"), F.lit(":c002`"))).otherwise(F.lit("")),
        F.lit("\n**Gold answer:** "), F.when(yes, F.concat(name, F.lit("  is\na region."))).otherwise(F.lit("")), F.lit("\n**Not covered because:** "), F.when(yes, F.lit("n/a")).when(k == 1, F.lit("nothing says so")).otherwise(F.lit("")),
        F.lit("\n**Authorship:** question=human, answer="), F.when(yes, F.lit("human")).otherwise(F.lit("none")), F.lit("\n\n"))
    body = table(spark, d, "region").groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", section.alias("s")))), lambda x: x["s"]), "").alias("text"))
    return body.select(F.concat(F.lit("# Gold\n\n"), "text").alias("text"))


def gold_parse(spark, d):
    g = S.parsed_gold(gold_files(spark, d))
    return g.select("id", "question", "type", "answerable", F.array_join("gold_chunks", ",").alias("gold_chunks"), "gold_answer", "not_covered_because", "question_author", "answer_author")


def gold_docs(spark, d):
    return S.parsed_gold(gold_files(spark, d)).select("id", F.array_join("gold_docs", ",").alias("gold_docs"))


def gold_counts(spark, d):
    g = S.parsed_gold(gold_files(spark, d))
    return g.agg(F.count("*").alias("n"), F.count_if("answerable").alias("answerable"), F.sum(F.size("gold_chunks")).alias("gold_chunks"), F.count_if(F.col("answer_author") == "none").alias("no_author"))


def gold_violations(spark, d):
    ids = table(spark, d, "region").select(F.concat(F.lit("doc-0"), F.col("r_regionkey").cast("string"), F.lit(":c001")).alias("chunk_id"))
    return A.gold_violations(S.parsed_gold(gold_files(spark, d)), ids, 6)


def surface_docs(spark, d):
    """Rows of a markdown index, made from ``nation``, whose slug has the surface's prefix."""
    line = F.concat(F.lit("| doc-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(" | `"), F.when(F.col("n_regionkey") == 1, F.lit("surface/")).otherwise(F.lit("other/surface/")), F.lower("n_name"), F.lit("` | 10 |"))
    text = table(spark, d, "nation").groupBy().agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return text.select(F.explode(S.index_table(F.col("text"))).alias("e")).select("e.*").filter(F.col("slug").startswith("surface/"))


def link_census(spark, d):
    return A.dangling(table(spark, d, "pages"))


def link_density(spark, d):
    """Links a hundred tokens of visible text, by host group."""
    text = F.regexp_replace("html", "<[^>]*>", " ")
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://(?:m\.)?[^/]*\.(\w+)(?:/|$)", 1).alias("tld"), F.size(F.regexp_extract_all("html", F.lit('<a href="'), F.lit(0))).alias("links"), T.token_count(text).alias("tokens"))
    rate = 100 * F.col("links") / F.col("tokens")
    return p.filter("tokens > 0").groupBy("tld").agg(F.count("*").alias("n_pages"), F.count_if(rate >= 3).alias("n_dense"), F.round(F.avg(rate.cast("decimal(20,10)")).cast("double"), 6).alias("mean_rate"))


def nav_share(spark, d):
    """The share of a page's lines, an element each, that are list items with a link."""
    lines = F.filter(F.split(F.regexp_replace("html", "<li>", "\n* ["), "\n"), lambda x: x.rlike(r"[^ \t]"))
    return table(spark, d, "pages").select("page_id", F.round(F.size(F.filter(lines, lambda x: x.rlike(r"^[ \t]*[*-][ \t]*\**\["))) / F.size(lines), 6).alias("nav_share"))


def judged(spark, d):
    """As its SQL has it, a question with more gold than others among its first 20 has a pool with all of these."""
    return kept(spark, d, "pools", lambda: J.pools(R.gold(spark, d), R.keyword_top(spark, d, True), short=True))


def judge_pools(spark, d):
    p = J.with_text(judged(spark, d), R.docs_of(spark, d))
    return p.select("item_id", "place", "doc_id", F.sha2("text", 256).alias("sha256"))


def judge_key(spark, d):
    return judged(spark, d).select("item_id", "doc_id", "gold")


def pool_stats(spark, d):
    return J.pool_stats(judged(spark, d))


def selections(spark, d):
    """What someone may type for a pool, by the remainder of its id."""
    raw = F.element_at(F.array(*[F.lit(x) for x in ("1 3", "none", " ", "2,2", "x", "9999", "2", "NONE")]), (F.col("item_id") % 8 + 1).cast("int"))
    return judged(spark, d).groupBy("item_id").agg(F.count("*").alias("n")).select("item_id", J.parsed_selection(raw, F.col("n")).alias("s")).select("item_id", "s.*")


def parse_selection(spark, d):
    return selections(spark, d).select("item_id", "error", F.array_join(F.transform("picked", lambda i: i.cast("string")), ",").alias("picked"))


def label_rows(spark, d):
    return J.label_rows(judged(spark, d), selections(spark, d).filter("error IS NULL"))


def label_progress(spark, d):
    return J.pending(judged(spark, d), label_rows(spark, d))


def cohen_kappa(spark, d):
    return J.kappa(table(spark, d, "labels"), "quality", "toxic")


QUERIES = [shared_rare_terms, leak_flags, leak_sweep, answer_keys, restatements, restatement_triage, find_text, doc_outline, gold_parse, gold_docs, gold_counts, gold_violations, surface_docs,
           link_census, link_density, nav_share, judge_pools, judge_key, pool_stats, parse_selection, label_rows, label_progress, cohen_kappa]

_SHARED = f"""{sql.FREQUENCY}, {sql.GOLD}, qf AS (SELECT DISTINCT item_id, coalesce(f.folded, CASE WHEN length(q.term) > 3 AND q.term LIKE '%s' AND left(q.term, length(q.term) - 1) IN (SELECT term FROM vocab) THEN left(q.term, length(q.term) - 1) ELSE q.term END) AS term
    FROM (SELECT item_id, unnest({sql.terms('text')}) AS term FROM benchmark) q LEFT JOIN fold f USING (term)),
  gf AS (SELECT DISTINCT item_id, folded AS term FROM gold JOIN tok USING (doc_id) JOIN fold USING (term)), sh AS (SELECT item_id, term, df FROM qf JOIN gf USING (item_id, term) JOIN freq USING (term))"""
_KEYS = f"kt AS (SELECT DISTINCT item_id AS id, unnest({sql.terms('text')}) AS key FROM benchmark), keys AS (SELECT id, key FROM kt QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(key), key) <= 6)"
_FOUND = f"{_KEYS}, {sql.GOLD}, found AS (SELECT k.id, d.doc_id FROM keys k JOIN documents d ON contains(lower(d.text), k.key) WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.item_id = k.id AND g.doc_id = d.doc_id) GROUP BY k.id, d.doc_id HAVING count(*) = (SELECT count(*) FROM keys x WHERE x.id = k.id))"
_POOLS = f"""{sql.bm25(sql.degraded('text'))}, {sql.ranked('sc', 'r')}, {sql.GOLD}, n AS (SELECT item_id, count(*) AS n_gold FROM gold GROUP BY 1),
  oth AS (SELECT r.item_id, r.doc_id, n_gold FROM r JOIN n USING (item_id) ANTI JOIN gold g ON g.item_id = r.item_id AND g.doc_id = r.doc_id WHERE rank <= 20),
  dr AS (SELECT item_id, doc_id FROM oth QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY md5('{J.SEED}:' || item_id || ':' || doc_id), doc_id) <= greatest({J.LEAST}, n_gold)),
  pool AS (SELECT item_id, doc_id, gold, (row_number() OVER (PARTITION BY item_id ORDER BY md5('{J.SEED}:shuffle:' || item_id || ':' || doc_id), doc_id))::INT AS place FROM (SELECT item_id, doc_id, true AS gold FROM gold UNION ALL SELECT item_id, doc_id, false FROM dr))"""
_SEL = f"""{_POOLS}, pn AS (SELECT item_id, count(*) AS n FROM pool GROUP BY 1), sel AS (SELECT item_id, n, (item_id % 8)::INT AS k FROM pn),
  ps AS (SELECT item_id, CASE k WHEN 2 THEN 'blank' WHEN 3 THEN 'repeated' WHEN 4 THEN 'not a number' WHEN 5 THEN 'out of range' WHEN 0 THEN CASE WHEN n < 3 THEN 'out of range' END WHEN 6 THEN CASE WHEN n < 2 THEN 'out of range' END END AS error,
    CASE WHEN k = 0 AND n >= 3 THEN [1, 3] WHEN k = 6 AND n >= 2 THEN [2] ELSE []::INT[] END AS picked FROM sel)"""
_ROWS = f"{_SEL}, lr AS (SELECT p.item_id, doc_id, list_contains(picked, place)::INT AS necessary FROM pool p JOIN ps USING (item_id) WHERE error IS NULL)"
_K = "r_regionkey % 2 = 0"
_ID = "'Q' || lpad((r_regionkey + 1)::VARCHAR, 2, '0')"
SQL = {
    "shared_rare_terms": f"WITH {_SHARED} SELECT item_id, term, df FROM sh WHERE df <= {DF_MAX}",
    "leak_flags": f"WITH {_SHARED}, f AS (SELECT item_id, count(*) AS n_rare, min(df) AS rarest FROM sh WHERE df <= {DF_MAX} GROUP BY 1 HAVING count(*) >= {A.FLAG_TERMS}) SELECT *, (row_number() OVER (ORDER BY rarest, n_rare DESC, item_id))::INT AS place FROM f",
    "leak_sweep": f"WITH {_SHARED}, m AS (SELECT DISTINCT df AS df_max FROM sh), c AS (SELECT df_max, (SELECT count(*) FROM (SELECT item_id FROM sh WHERE df <= df_max GROUP BY 1 HAVING count(*) >= {A.FLAG_TERMS})) AS flagged FROM m) SELECT df_max, flagged FROM c QUALIFY flagged <> coalesce(lag(flagged) OVER (ORDER BY df_max), 0)",
    "answer_keys": f"""WITH {sql.FREQUENCY}, s AS (SELECT s_suppkey AS id, s_name FROM supplier),
      w AS (SELECT coalesce((SELECT max(df) FROM freq WHERE term = 'with'), 0) AS df)
      SELECT * FROM (SELECT id, unnest(['--use-key', 'settings.json', 'cleanupPeriodDays', CASE WHEN NOT contains(s_name, ' ') THEN s_name END, CASE WHEN df <= {A.RARE_DF} THEN 'with' END]) AS key FROM s, w) WHERE key IS NOT NULL""",
    "restatements": f"WITH {_FOUND} SELECT id, doc_id FROM found",
    "restatement_triage": f"WITH {_FOUND}, t AS (SELECT item_id AS id, (SELECT count(*) FROM keys k WHERE k.id = item_id) AS n_keys, (SELECT count(*) FROM found f WHERE f.id = item_id) AS n_found FROM benchmark) SELECT *, CASE WHEN n_keys = 0 THEN 'no key' WHEN n_found > {A.BROAD} THEN 'too broad' ELSE 'readable' END AS status FROM t",
    "find_text": "WITH h AS (SELECT doc_id, text, strpos(lower(text), 'token') AS hit FROM documents) SELECT doc_id, text[greatest(hit - 100, 1):hit + 199] AS snippet FROM h WHERE hit > 0",
    "doc_outline": "SELECT doc_id, left(string_split(text, chr(10))[1], 84) AS first_line FROM documents",
    "gold_parse": f"""SELECT {_ID} AS id, 'What is ' || r_name || '?' AS question, CASE WHEN r_regionkey <> 2 THEN 'fact' END AS type, {_K} AS answerable,
      CASE WHEN {_K} THEN 'doc-0' || r_regionkey || ':c001,doc-0' || r_regionkey || ':c002' ELSE '' END AS gold_chunks, CASE WHEN {_K} THEN r_name || ' is a region.' END AS gold_answer,
      CASE WHEN r_regionkey = 1 THEN 'nothing says so' END AS not_covered_because, 'human' AS question_author, CASE WHEN {_K} THEN 'human' ELSE 'none' END AS answer_author FROM region""",
    "gold_docs": f"SELECT {_ID} AS id, CASE WHEN {_K} THEN 'doc-0' || r_regionkey ELSE '' END AS gold_docs FROM region",
    "gold_counts": f"SELECT count(*) AS n, count(*) FILTER ({_K}) AS answerable, 2 * count(*) FILTER ({_K}) AS gold_chunks, count(*) FILTER (NOT ({_K})) AS no_author FROM region",
    "gold_violations": f"SELECT {_ID} AS id, 'unknown chunk doc-0' || r_regionkey || ':c002' AS violation FROM region WHERE {_K} UNION ALL SELECT {_ID}, 'unanswerable without evidence' FROM region WHERE NOT ({_K}) AND r_regionkey <> 1 UNION ALL SELECT '', count(*) || ' entries, not 6' FROM region HAVING count(*) <> 6",
    "surface_docs": "SELECT 'doc-' || lpad(n_nationkey::VARCHAR, 2, '0') AS doc_id, 'surface/' || lower(n_name) AS slug FROM nation WHERE n_regionkey = 1",
    "link_census": "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages), p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS href FROM pages) SELECT href, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM l WHERE href NOT IN (SELECT href FROM p) GROUP BY 1",
    "link_density": f"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://(?:m\\.)?[^/]*\\.(\\w+)(?:/|$)', 1) AS tld, len(regexp_extract_all(html, '<a href="')) AS links, {sql.n_tokens("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS tokens FROM pages), r AS (SELECT tld, 100 * links / tokens AS rate FROM p WHERE tokens > 0)
      SELECT tld, count(*) AS n_pages, count(*) FILTER (rate >= 3) AS n_dense, round((sum(rate::DECIMAL(20,10)) / count(*))::DOUBLE, 6) AS mean_rate FROM r GROUP BY 1""",
    "nav_share": r"WITH l AS (SELECT page_id, list_filter(string_split(replace(html, '<li>', chr(10) || '* ['), chr(10)), lambda x: regexp_matches(x, '[^ \t]')) AS l FROM pages) SELECT page_id, round(len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[*-][ \t]*\**\['))) / len(l), 6) AS nav_share FROM l",
    "judge_pools": f"WITH {_POOLS} SELECT item_id, place, doc_id, sha256(text) AS sha256 FROM pool JOIN documents USING (doc_id)",
    "judge_key": f"WITH {_POOLS} SELECT item_id, doc_id, gold FROM pool",
    "pool_stats": f"WITH {_POOLS}, c AS (SELECT item_id, count(*) AS c, count(*) FILTER (gold) AS g FROM pool GROUP BY 1) SELECT count(*) AS n_pools, sum(c)::BIGINT AS n_pairs, sum(g)::BIGINT AS n_gold, (sum(c) - sum(g))::BIGINT AS n_others, min(c) AS least, max(c) AS most FROM c",
    "parse_selection": f"WITH {_SEL} SELECT item_id, error, array_to_string(picked, ',') AS picked FROM ps",
    "label_rows": f"WITH {_ROWS} SELECT item_id, doc_id, necessary FROM lr",
    "label_progress": f"WITH {_ROWS} SELECT DISTINCT item_id FROM pool WHERE item_id NOT IN (SELECT item_id FROM lr)",
    "cohen_kappa": "WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS agree, count(*) FILTER (quality = 1) AS a1, count(*) FILTER (toxic = 1) AS b1 FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), p AS (SELECT n, agree, agree / n AS po, (a1 * b1 + (n - a1) * (n - b1)) / (n * n) AS pe FROM c) SELECT n, agree, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM p",
}
