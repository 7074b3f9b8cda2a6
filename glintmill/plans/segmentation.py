"""Queries on segmentation and markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintmill.functions import markup as M
from glintmill.functions import text as T
from glintmill.operators import segment as S
from glintmill.plans import sql
from glintmill.plans.retrieval import docs_of
from glintmill.sources.holding import kept
from glintmill.sources.tables import table


def chunks(spark, d):
    return kept(spark, d, "chunks", lambda: S.greedy_chunks(docs_of(spark, d)))


def line_spans(spark, d):
    return S.line_spans(docs_of(spark, d))


def token_counts(spark, d):
    return docs_of(spark, d).select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


def greedy_chunks(spark, d):
    return chunks(spark, d).select("doc_id", "idx", "chunk_id", "char_start", "char_end", "n_tokens", F.sha2("text", 256).alias("sha256"))


def partition_invariant(spark, d):
    return S.partition_check(chunks(spark, d), docs_of(spark, d))


def over_limit(spark, d):
    return docs_of(spark, d).select("doc_id", T.token_count(F.col("text")).alias("n_tokens")).filter(F.col("n_tokens") > S.BUDGET)


def chunk_stats(spark, d):
    return chunks(spark, d).agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most"), F.round(F.avg("n_tokens"), 6).alias("mean"))


def chunks_per_doc(spark, d):
    return chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def stratified_sample(spark, d):
    return S.stratified(docs_of(spark, d).select("doc_id", "source"), "source", "doc_id", 0).select("source", "doc_id")


def systematic_sample(spark, d):
    return S.systematic(docs_of(spark, d).select("doc_id", "lang"), "lang", "doc_id", 50).select("lang", "doc_id")


def density_by_kind(spark, d):
    return S.density(docs_of(spark, d), "lang")


def density_verdict(spark, d):
    return S.density_verdict(S.density(docs_of(spark, d), "lang"), "lang")


def marked_up(spark, d):
    """Markdown with components, made from the rows of ``part``; the fence holds what must stay."""
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.concat(
        F.lit('<Note>\n<Tabs><Tab title="'), n, F.lit('">one</Tab><Tab>two</Tab></Tabs>\n{/* build\n note */}\n```\n<div>{/* kept */}</div>\n```\n<Steps>\n<Step title="'), n,
        F.lit('">a</Step><Step>b</Step>\n</Steps>\n<Accordion title="Why '), n, F.lit('?">x</Accordion><Card icon="i" title="'), n, F.lit('" href="h">body</Card>\n<Steps><Step title="again">c</Step></Steps><DIV class="x">y<br /></DIV></Note>\n```\nopen')).alias("text"))


def fence_parity(spark, d):
    t = marked_up(spark, d)
    return t.select("p_partkey", F.size(M.fences(F.col("text"))).alias("n_fences"), F.sha2(F.array_join(M.fences(F.col("text")), ""), 256).alias("fences"))


def mdx_transform(spark, d):
    return marked_up(spark, d).select("p_partkey", M.transform(F.col("text")).alias("text"))


def mdx_steps(spark, d):
    return marked_up(spark, d).select("p_partkey", M.number_steps(F.col("text")).alias("text"))


def html_layout_strip(spark, d):
    out = M.without_layout(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(out).alias("n_chars"), F.sha2(out, 256).alias("sha256"))


def _row(a, b) -> F.Column:
    return F.concat(F.lit("|  "), a, F.lit("   x | `a|b` \\| "), b, F.lit(" |  |\t tail\t| "), b, F.lit(" ``  "), a, F.lit(" `` z |"))


def table_blocks(spark, d):
    """Markdown tables made from ``nation``, one a region."""
    row = _row(F.col("n_name"), F.col("n_nationkey").cast("string"))
    body = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("rows"))
    return body.select("n_regionkey", F.concat(F.lit("| Name | Key | |\n|---|:--|---|\n"), F.array_join(F.transform("rows", lambda x: x["r"]), "\n")).alias("block"))


def table_cells(spark, d):
    row = _row(F.col("n_name"), F.col("n_nationkey").cast("string"))
    return table(spark, d, "nation").select("n_nationkey", F.posexplode(M.cells(row)).alias("pos", "cell"))


def table_rows(spark, d):
    return S.table_rows(table_blocks(spark, d), "n_regionkey").select("n_regionkey", "row", "rendered")


def table_conservation(spark, d):
    return S.table_rows(table_blocks(spark, d), "n_regionkey").groupBy("n_regionkey").agg(F.count("*").alias("n_rows"), F.sum("n_cells").alias("n_cells"))


def combined_offsets(spark, d):
    return S.combined_offsets(combined_pages(spark, d).select("n", "text"), 12)


def combined_pages(spark, d):
    """Documents as pages: every third with a heading, every fifth with line ends at its end, every seventh without text."""
    heading = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("#  "), "source", F.lit(" \n"))).otherwise(F.lit(""))
    body = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(heading, "text"))
    return docs_of(spark, d).select(F.col("doc_id").alias("n"), F.concat(F.lit("page-"), "source").alias("slug"), F.concat(body, F.when(F.col("doc_id") % 5 == 0, F.lit("\n\n")).otherwise(F.lit(""))).alias("text"))


def combined_file(spark, d):
    """The lines of the combined file, as hashes of a hundred lines at a time."""
    header = ["# Combined", "", *[f"line {i}" for i in range(10)]]
    lines = S.combined_lines(combined_pages(spark, d), header)
    part = F.expr("line_no div 100")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")  # a hundred lines
    return lines.groupBy(part.alias("part")).agg(F.count("*").alias("n_lines"), F.sha2(joined, 256).alias("sha256"))


QUERIES = [line_spans, token_counts, greedy_chunks, partition_invariant, over_limit, chunk_stats, chunks_per_doc, stratified_sample, systematic_sample, density_by_kind, density_verdict,
           fence_parity, mdx_transform, mdx_steps, html_layout_strip, table_cells, table_rows, table_conservation, combined_offsets, combined_file]

_UNITS = f"""ln AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), l2 AS (SELECT doc_id, text, length(text) AS n, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM ln),
  sp AS (SELECT doc_id, text, line_no, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS st, n FROM l2),
  sl AS (SELECT s.doc_id, s.text, s.line_no, s.st, least(s.n, coalesce(lead(s.st) OVER (PARTITION BY s.doc_id ORDER BY s.line_no), s.n))::INT AS en FROM sp s),
  spans AS (SELECT * FROM sl WHERE en > st),
  lt AS (SELECT *, {sql.n_tokens('text[st + 1:en]')} AS t FROM spans),
  cut AS (SELECT doc_id, text, st, en, t FROM lt WHERE t <= {S.BUDGET} UNION ALL SELECT doc_id, text, c, least(c + {S.CUT}, en), NULL FROM (SELECT *, unnest(range(st, en, {S.CUT}))::INT AS c FROM lt WHERE t > {S.BUDGET})),
  c1 AS (SELECT doc_id, text, st, en, coalesce(t, {sql.n_tokens('text[st + 1:en]')}) AS t FROM cut),
  c2 AS (SELECT doc_id, st, en, t FROM c1 WHERE t <= {S.BUDGET} UNION ALL SELECT doc_id, c, least(c + {S.BUDGET}, en), {sql.n_tokens(f'text[c + 1:least(c + {S.BUDGET}, en)]')} FROM (SELECT *, unnest(range(st, en, {S.BUDGET}))::INT AS c FROM c1 WHERE t > {S.BUDGET})),
  un AS (SELECT doc_id, st, en, t, row_number() OVER (PARTITION BY doc_id ORDER BY st) AS i FROM c2)"""
_CHUNKS = f"""{_UNITS}, pk AS (SELECT doc_id, i, st, en, t, 0 AS idx, t AS total, t > 0 AS shows FROM un WHERE i = 1 UNION ALL
  SELECT u.doc_id, u.i, u.st, u.en, u.t, p.idx + CASE WHEN u.t > 0 AND p.total + u.t > {S.BUDGET} AND p.shows THEN 1 ELSE 0 END,
    CASE WHEN u.t > 0 AND p.total + u.t > {S.BUDGET} AND p.shows THEN u.t ELSE p.total + u.t END, CASE WHEN u.t > 0 AND p.total + u.t > {S.BUDGET} AND p.shows THEN true ELSE p.shows OR u.t > 0 END
  FROM pk p JOIN un u ON u.doc_id = p.doc_id AND u.i = p.i + 1),
  sl0 AS (SELECT doc_id, idx, min(st) AS char_start, max(en) AS char_end FROM pk GROUP BY ALL),
  ch AS (SELECT doc_id, idx, char_start, char_end, {sql.n_tokens('text[char_start + 1:char_end]')}::INT AS n_tokens FROM sl0 JOIN documents USING (doc_id))"""
_MD = r"""md AS (SELECT p_partkey, '<Note>' || chr(10) || '<Tabs><Tab title="' || p_name || '">one</Tab><Tab>two</Tab></Tabs>' || chr(10) || '{/* build' || chr(10) || ' note */}' || chr(10) || '```' || chr(10) || '<div>{/* kept */}</div>' || chr(10) || '```' || chr(10) || '<Steps>' || chr(10) || '<Step title="' || p_name
  || '">a</Step><Step>b</Step>' || chr(10) || '</Steps>' || chr(10) || '<Accordion title="Why ' || p_name || '?">x</Accordion><Card icon="i" title="' || p_name || '" href="h">body</Card>' || chr(10) || '<Steps><Step title="again">c</Step></Steps><DIV class="x">y<br /></DIV></Note>' || chr(10) || '```' || chr(10) || 'open' AS text FROM part)"""
# What the transformed and the numbered text must be, written out.
_DONE = r"""chr(10) || chr(10) || 'Alternative (' || p_name || '):' || chr(10) || 'one' || chr(10) || 'Alternative:' || chr(10) || 'two' || chr(10) || chr(10) || '```' || chr(10) || '<div>{/* kept */}</div>' || chr(10) || '```' || chr(10) || chr(10) || chr(10) || '1. ' || p_name || chr(10) || 'a' || chr(10) || '2.' || chr(10) || 'b' || chr(10) || chr(10)
  || chr(10) || 'Why ' || p_name || '?' || chr(10) || 'x' || chr(10) || p_name || chr(10) || 'body' || chr(10) || chr(10) || '1. again' || chr(10) || 'cy' || chr(10) || '```' || chr(10) || 'open'"""
_PAGES = r"""WITH p AS (SELECT doc_id AS n, 'page-' || source AS slug, source, CASE WHEN doc_id % 7 = 0 THEN '' ELSE CASE WHEN doc_id % 3 = 0 THEN '#  ' || source || ' ' || chr(10) ELSE '' END || text END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) ELSE '' END AS text FROM documents),
  b AS (SELECT *, regexp_replace(text, '\n+$', '') AS body FROM p), c AS (SELECT *, CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END AS n_lines FROM b),
  o AS (SELECT n, slug, body, n_lines, coalesce(regexp_replace(substring(list_filter(string_split(text, chr(10)), lambda x: x LIKE '# %')[1], 3), '^\s+|\s+$', '', 'g'), '(untitled)') AS title,
    (12 + coalesce(sum(n_lines + 3) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2)::BIGINT AS body_line FROM c)"""
_CELLS = "[n_name || ' x', 'a|b | ' || n_nationkey, '', 'tail', n_nationkey || '  ' || n_name || '  z']"
SQL = {
    "line_spans": f"WITH {_UNITS} SELECT doc_id, line_no::INT AS line_no, st::BIGINT AS start, en::BIGINT AS \"end\" FROM spans",
    "token_counts": f"SELECT doc_id, {sql.n_tokens('text')}::INT AS n_tokens FROM documents",
    "greedy_chunks": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, idx, doc_id || ':c' || CASE WHEN idx < 1000 THEN lpad(idx::VARCHAR, 3, '0') ELSE idx::VARCHAR END AS chunk_id, char_start, char_end, n_tokens, sha256(text[char_start + 1:char_end]) AS sha256 FROM ch JOIN documents USING (doc_id)",
    "partition_invariant": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, count(idx) AS n_chunks, true AS whole FROM documents LEFT JOIN ch USING (doc_id) GROUP BY 1",
    "over_limit": f"SELECT doc_id, {sql.n_tokens('text')}::INT AS n_tokens FROM documents WHERE {sql.n_tokens('text')} > {S.BUDGET}",
    "chunk_stats": f"WITH RECURSIVE {_CHUNKS} SELECT count(*) AS n_chunks, sum(n_tokens)::BIGINT AS n_tokens, max(n_tokens) AS most, round(avg(n_tokens), 6) AS mean FROM ch",
    "chunks_per_doc": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, count(*) AS n_chunks FROM ch GROUP BY 1",
    "stratified_sample": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) = 1",
    "systematic_sample": "WITH n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY lang) // 50) AS step FROM documents) SELECT lang, doc_id FROM n WHERE i % step = 0 AND i // step < 50",
    "density_by_kind": f"""WITH r AS (SELECT lang, length(text) / {sql.n_tokens('text')} AS ratio FROM documents WHERE {sql.n_tokens('text')} > 0), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ratio) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM r)
      SELECT lang, count(*) AS n, {sql.mean('ratio')} AS mean, round(median(ratio), 6) AS median, round(max(ratio) FILTER (i = floor(n * 0.1)), 6) AS p10, round(min(ratio), 6) AS least FROM o GROUP BY lang""",
    "density_verdict": f"""WITH r AS (SELECT lang, length(text) / {sql.n_tokens('text')} AS ratio FROM documents WHERE {sql.n_tokens('text')} > 0), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ratio) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM r),
      p AS (SELECT lang, round(max(ratio) FILTER (i = floor(n * 0.1)), 6) AS p10 FROM o GROUP BY lang), v AS (SELECT arg_min(lang, (p10, lang)) AS binding, min(p10) AS p10, round(max(p10) / min(p10), 6) AS spread FROM p)
      SELECT *, CASE WHEN spread > 1.3 THEN 'by kind' WHEN p10 >= 3.5 THEN 'loose' WHEN p10 >= 2.5 THEN 'usual' ELSE 'tight' END AS verdict FROM v""",
    "fence_parity": f"WITH {_MD} SELECT p_partkey, 1 AS n_fences, sha256('```' || chr(10) || '<div>{{/* kept */}}</div>' || chr(10) || '```' || chr(10)) AS fences FROM md".replace("{{", "{").replace("}}", "}"),
    "mdx_transform": f"SELECT p_partkey, {_DONE} AS text FROM part",
    "mdx_steps": f"""WITH {_MD} SELECT p_partkey, replace(replace(text, '<Steps>' || chr(10) || '<Step title="' || p_name || '">a</Step><Step>b</Step>' || chr(10) || '</Steps>', chr(10) || chr(10) || '1. ' || p_name || chr(10) || 'a' || chr(10) || '2.' || chr(10) || 'b' || chr(10)),
      '<Steps><Step title="again">c</Step></Steps>', chr(10) || '1. again' || chr(10) || 'c') AS text FROM md JOIN part USING (p_partkey)""",
    "html_layout_strip": r"WITH s AS (SELECT page_id, regexp_replace(html, '(?i)</?(?:div|span|br|p|img|a)(?:\s[^>]*)?>', '', 'g') AS h FROM pages) SELECT page_id, length(h)::INT AS n_chars, sha256(h) AS sha256 FROM s",
    "table_cells": f"SELECT n_nationkey, generate_subscripts(c, 1)::INT - 1 AS pos, unnest(c) AS cell FROM (SELECT n_nationkey, {_CELLS} AS c FROM nation)",
    "table_rows": "SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1)::INT AS \"row\", n_name || ' x' || chr(10) || 'Key: a|b | ' || n_nationkey || chr(10) || 'Column 4: tail' || chr(10) || 'Column 5: ' || n_nationkey || '  ' || n_name || '  z' AS rendered FROM nation",
    "table_conservation": "SELECT n_regionkey, count(*) AS n_rows, 5 * count(*) AS n_cells FROM nation GROUP BY 1",
    "combined_offsets": f"{_PAGES} SELECT n, title, n_lines::INT AS n_lines, body_line FROM o",
    "combined_file": f"""{_PAGES}, hl AS (SELECT i AS line_no, ['# Combined', '', 'line 0', 'line 1', 'line 2', 'line 3', 'line 4', 'line 5', 'line 6', 'line 7', 'line 8', 'line 9'][i] AS line FROM (SELECT unnest(range(1, 13)) AS i)),
      bl AS (SELECT body_line - 1 AS line_no, '' AS line FROM o UNION ALL SELECT body_line, '@@PAGE ' || CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END || '/' || (SELECT count(*) FROM o) || ' :: ' || slug FROM o UNION ALL SELECT body_line + 1, '' FROM o
        UNION ALL SELECT body_line + 1 + i, l[i] FROM (SELECT body_line, string_split(body, chr(10)) AS l, unnest(range(1, n_lines + 1)) AS i FROM o)),
      al AS (SELECT * FROM hl UNION ALL SELECT * FROM bl)
      SELECT line_no // 100 AS part, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS sha256 FROM al GROUP BY 1""",
}
