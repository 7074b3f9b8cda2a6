"""Queries on markdown documents: units, chunks in two renderings, and rankings of what is embedded."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintmill.operators import scored
from glintmill.operators import segment as S
from glintmill.plans import sql
from glintmill.plans.retrieval import docs_of, questions
from glintmill.sources.holding import kept

TOP = 20
#: Parts of a document: (which ids have it, what it is). Column names stand for themselves, all else is text as it is.
PARTS = (
    ("doc_id % 3 = 0", ("#   ", "source", "  \n\n")),
    ("true", ("text", "\n\n")),
    ("doc_id % 2 = 0", ("| Name | Kind | |\n|---|:--|---|\n|  ", "source", "   x | `a|b` \\| ", "id", " |  | <Note>tail</Note> |\n| ", "lang", " | y `` z | ", "head", "\n|\t", "id", "\t||x\n\n")),
    ("doc_id % 5 = 0", (" \t\n```js\nconst x = 1;\n\n<div>{/* kept */}</div>\n```\n",)),
    ("doc_id % 4 = 0", ('after\n\n<Tabs><Tab title="', "lang", '">one</Tab><Tab>two</Tab></Tabs>\n{/* note\n */}\n<Steps>\n<Step title="a">x</Step><Step>y</Step>\n</Steps><Steps><Step title="', "source",
                        '">z</Step></Steps>\n<Card icon="i" title="T" href="h">body</Card><DIV class="x">q<br /></DIV>\n<Accordion title="Why?">w</Accordion>\n\n\n')),
    ("doc_id % 7 = 0", ("```\n", "text", "\n\n\nend\n``` tail\n")),
    ("doc_id % 13 = 0", ("dense", "\n\n")),
    ("doc_id % 11 = 0", ("\n```\nopen ", "source")),
)
_SPARK = {"source": "source", "text": "text", "lang": "lang", "id": "CAST(doc_id AS string)", "head": "translate(substring(text, 1, 60), '\n|', ' /')", "dense": "repeat('?!', 300)"}
_DUCK = _SPARK | {"id": "doc_id::VARCHAR", "head": "translate(substring(text, 1, 60), chr(10) || '|', ' /')"}


def documents(spark, d):
    """Markdown made from ``documents``: headings, tables, fences with and without an end, components, lines too long for a chunk."""
    pieces = [F.when(F.expr(when), F.concat(*[F.expr(_SPARK[x]) if x in _SPARK else F.lit(x) for x in parts])).otherwise(F.lit("")) for when, parts in PARTS]
    return docs_of(spark, d).select("doc_id", F.concat(*pieces).alias("text"))


def chunks(spark, d):
    return kept(spark, d, "markdown", lambda: S.greedy_chunks(documents(spark, d), markdown=True))


def embedded(spark, d):
    """What is ranked: each chunk as a document with the text that is embedded."""
    return chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), F.col("text_embed").alias("text"))


def doc_units(spark, d):
    return S.units(documents(spark, d)).select("doc_id", "pos", "start", "end", "kind", "n_tokens", F.length("glue").alias("glue"), F.sha2("shown", 256).alias("sha256"))


def markdown_chunks(spark, d):
    return chunks(spark, d).select("doc_id", "idx", "chunk_id", "char_start", "char_end", "n_tokens", "block_type", F.sha2("text", 256).alias("raw_sha256"), F.sha2("text_embed", 256).alias("embed_sha256"))


def chunk_types(spark, d):
    return S.chunk_types(chunks(spark, d))


def chunk_lookup(spark, d):
    """Chunks by id, one of each of some documents, and all chunks of a document."""
    by_id = S.chunk_records(chunks(spark, d)).filter("id IN ('0:c000', '14:c001', '30:c000', 'none:c000')")
    by_doc = S.chunk_records(chunks(spark, d)).filter("doc_id = '7'")
    return by_id.unionByName(by_doc).select("id", "doc_id", "char_start", "char_end", "chars_raw", "tokens_embed", "block_type", "sha256", "sha256_norm")


def chunk_share(spark, d):
    return S.document_share(chunks(spark, d))


def chunk_sample(spark, d):
    return S.inspected(S.chunk_records(chunks(spark, d)), ("7", "14"), ("<Tab", "<Step")).select("bucket", "id", "tokens_embed")


def chunk_bm25_topk(spark, d):
    docs = embedded(spark, d)
    top = scored.top_scores(docs, scored.Asked(docs, questions(spark, d)), TOP)
    return top.select("item_id", "rank", F.col("doc_id").alias("chunk_id"), F.round("score", 6).alias("score"))


def chunk_dense_topk(spark, d):
    docs = embedded(spark, d)
    return scored.top_scores(docs, scored.Asked(docs, questions(spark, d)), TOP, dense=True).select("item_id", "rank", F.col("doc_id").alias("chunk_id"), F.round("score", 6).alias("score"))


QUERIES = [doc_units, markdown_chunks, chunk_types, chunk_share, chunk_sample, chunk_lookup, chunk_bm25_topk, chunk_dense_topk]


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FENCE = r"(?m)^```(?s:.*?)^```[^\n]*\n?"
_GAP = r"\n\s*\n"
_LEN = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)::BIGINT"
_MADE = " || ".join(f"CASE WHEN {when} THEN {' || '.join(_DUCK[x] if x in _DUCK else _literal(x) for x in parts)} ELSE '' END" for when, parts in PARTS)
_BLANK = r"NOT regexp_matches({0}, '\S')"
_ROW = "array_to_string(list_filter(list_transform(v, lambda x, i: CASE WHEN x = '' THEN NULL WHEN i = 1 OR coalesce(h[i], 'Column ' || i) = '' THEN x ELSE coalesce(h[i], 'Column ' || i) || ': ' || x END), lambda x: x IS NOT NULL), chr(10))"
# Units: fences, then what blank lines part, then lines of tables; each shown, counted, and cut where it is over the budget.
_UNITS = f"""md AS (SELECT doc_id, {_MADE} AS text FROM documents),
  f AS (SELECT doc_id, regexp_extract_all(text, '{_FENCE}') AS fs, string_split_regex(text, '{_FENCE}') AS gs FROM md), fi AS (SELECT *, unnest(range(1, len(gs) + 1)) AS i FROM f),
  fo AS (SELECT *, {_LEN('gs[1:i - 1]')} + {_LEN('fs[1:i - 1]')} AS off FROM fi),
  code AS (SELECT doc_id, off + length(gs[i]) AS st, fs[i] AS raw FROM fo WHERE i <= len(fs)),
  g AS (SELECT doc_id, off, regexp_extract_all(gs[i], '{_GAP}') AS ws, string_split_regex(gs[i], '{_GAP}') AS ps FROM fo WHERE gs[i] <> ''), gi AS (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM g),
  go AS (SELECT *, off + {_LEN('ps[1:j - 1]')} + {_LEN('ws[1:j - 1]')} AS st FROM gi),
  pc AS (SELECT doc_id, st, ps[j] AS raw FROM go WHERE ps[j] <> '' UNION ALL SELECT doc_id, st + length(ps[j]), ws[j] FROM go WHERE j <= len(ws)),
  ln AS (SELECT *, list_filter(string_split(raw, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM pc),
  kd AS (SELECT doc_id, st, raw, CASE WHEN {_BLANK.format('raw')} THEN 'whitespace' WHEN len(l) >= 3 AND len(list_filter(l, lambda x: regexp_matches(x, '^\\s*\\|'))) >= len(l) - 1 THEN 'table' ELSE 'prose' END AS kind FROM ln),
  tb AS (SELECT doc_id, st, string_split(raw, chr(10)) AS l FROM kd WHERE kind = 'table'), ti AS (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM tb),
  tl AS (SELECT doc_id, st + {_LEN('l[1:k - 1]')} + k - 1 AS st, l[k] || CASE WHEN k < len(l) THEN chr(10) ELSE '' END AS raw, k, l[1] AS head FROM ti),
  tk AS (SELECT doc_id, st, raw, k = 1 OR {_BLANK.format('raw')} OR (regexp_full_match({sql.strip('raw')}, '[\\s|:-]+') AND contains(raw, '-')) AS bare, {sql.cells('head')} AS h, {sql.cells('raw')} AS v FROM tl WHERE raw <> ''),
  u0 AS (SELECT doc_id, st, raw, 'code' AS kind, '' AS body FROM code UNION ALL SELECT doc_id, st, raw, kind, CASE WHEN kind = 'prose' THEN raw ELSE '' END FROM kd WHERE kind <> 'table'
    UNION ALL SELECT doc_id, st, raw, CASE WHEN bare THEN 'table_scaffold' ELSE 'table_row' END, CASE WHEN bare THEN '' ELSE {_ROW} END FROM tk),
  {sql.flattened('u0', 'u1')},
  u2 AS (SELECT doc_id, st, raw, kind, CASE WHEN kind = 'code' THEN raw ELSE shown END AS shown FROM u1), u3 AS (SELECT *, {sql.n_tokens('shown')} AS t FROM u2),
  big AS (SELECT *, string_split(raw, chr(10)) AS l FROM u3 WHERE t > {S.BUDGET}), bi AS (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM big),
  b0 AS (SELECT doc_id, st AS unit, kind, st + {_LEN('l[1:k - 1]')} + k - 1 AS st, l[k] || CASE WHEN k < len(l) THEN chr(10) ELSE '' END AS raw, len(list_filter(l, lambda x, i: x <> '' OR i < len(l))) AS n_lines FROM bi),
  b1 AS (SELECT *, raw AS body FROM b0 WHERE raw <> ''), {sql.flattened('b1', 'b2')},
  b3 AS (SELECT * EXCLUDE (shown), CASE WHEN kind = 'code' THEN raw ELSE shown END AS shown FROM b2), b4 AS (SELECT *, {sql.n_tokens('shown')} AS t FROM b3),
  c0 AS (SELECT doc_id, unit, kind, st + c AS st, substring(raw, c + 1, {S.CUT}) AS raw, substring(raw, c + 1, {S.CUT}) AS body FROM (SELECT *, unnest(range(0, length(raw), {S.CUT})) AS c FROM b4 WHERE n_lines = 1 OR t > {S.BUDGET})), {sql.flattened('c0', 'c1')},
  c2 AS (SELECT doc_id, unit, kind, st, raw, CASE WHEN kind = 'code' THEN raw ELSE shown END AS shown FROM c1), c3 AS (SELECT *, {sql.n_tokens('shown')} AS t FROM c2),
  e0 AS (SELECT doc_id, unit, kind, st + c AS st, substring(raw, c + 1, {S.BUDGET}) AS raw, substring(raw, c + 1, {S.BUDGET}) AS body FROM (SELECT *, unnest(range(0, length(raw), {S.BUDGET})) AS c FROM c3 WHERE t > {S.BUDGET})), {sql.flattened('e0', 'e1')},
  e2 AS (SELECT doc_id, unit, kind, st, raw, CASE WHEN kind = 'code' THEN raw ELSE shown END AS shown FROM e1),
  al AS (SELECT doc_id, st AS unit, kind, st, raw, shown, t FROM u3 WHERE t <= {S.BUDGET} UNION ALL SELECT doc_id, unit, kind, st, raw, shown, t FROM b4 WHERE n_lines > 1 AND t <= {S.BUDGET}
    UNION ALL SELECT doc_id, unit, kind, st, raw, shown, t FROM c3 WHERE t <= {S.BUDGET} UNION ALL SELECT doc_id, unit, kind, st, raw, shown, {sql.n_tokens('shown')} FROM e2),
  un AS (SELECT doc_id, kind, st, st + length(raw) AS en, shown, t, CASE WHEN st = unit THEN chr(10) || chr(10) ELSE '' END AS glue, row_number() OVER (PARTITION BY doc_id ORDER BY st) AS i FROM al)"""
_CHUNKS = f"""{_UNITS}, pk AS (SELECT doc_id, i, 0 AS idx, t AS total, t > 0 AS shows FROM un WHERE i = 1 UNION ALL
  SELECT u.doc_id, u.i, p.idx + CASE WHEN u.t > 0 AND p.total + u.t > {S.BUDGET} AND p.shows THEN 1 ELSE 0 END,
    CASE WHEN u.t > 0 AND p.total + u.t > {S.BUDGET} AND p.shows THEN u.t ELSE p.total + u.t END, CASE WHEN u.t > 0 AND p.total + u.t > {S.BUDGET} AND p.shows THEN true ELSE p.shows OR u.t > 0 END
  FROM pk p JOIN un u ON u.doc_id = p.doc_id AND u.i = p.i + 1),
  ck AS (SELECT doc_id, idx, min(st)::INT AS char_start, max(en)::INT AS char_end FROM pk JOIN un USING (doc_id, i) GROUP BY ALL),
  pt AS (SELECT doc_id, idx, i, kind, shown, t, CASE WHEN row_number() OVER (PARTITION BY doc_id, idx ORDER BY i) = 1 THEN '' ELSE glue END AS glue FROM pk JOIN un USING (doc_id, i) WHERE t > 0 OR glue = ''),
  em AS (SELECT doc_id, idx, regexp_replace({sql.strip("string_agg(glue || shown, '' ORDER BY i)")}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS e FROM pt GROUP BY ALL),
  kc AS (SELECT doc_id, idx, kind, count(*) AS c FROM pt WHERE t > 0 GROUP BY ALL), bt AS (SELECT doc_id, idx, arg_min(kind, (-c, kind)) AS block_type FROM kc GROUP BY ALL),
  ch AS (SELECT ck.doc_id, idx, ck.doc_id || ':c' || CASE WHEN idx < 1000 THEN lpad(idx::VARCHAR, 3, '0') ELSE idx::VARCHAR END AS chunk_id, char_start, char_end, {sql.n_tokens("coalesce(e, '')")}::INT AS n_tokens, coalesce(block_type, 'whitespace') AS block_type,
    text[char_start + 1:char_end] AS raw, coalesce(e, '') AS e FROM ck JOIN md USING (doc_id) LEFT JOIN em USING (doc_id, idx) LEFT JOIN bt USING (doc_id, idx)),
  emb AS (SELECT chunk_id AS doc_id, e AS text FROM ch)"""
_TOPK = lambda scores, name: f"WITH RECURSIVE {_CHUNKS}, {scores}, {sql.ranked(name, 'r')} SELECT item_id, rank::INT AS rank, doc_id AS chunk_id, round(score, 6) AS score FROM r WHERE rank <= {TOP}"
_NORM = sql.NORMALISED.replace("text", "raw")
SQL = {
    "doc_units": f"WITH {_UNITS} SELECT doc_id, (i - 1)::INT AS pos, st::INT AS start, en::INT AS \"end\", kind, t::INT AS n_tokens, length(glue)::INT AS glue, sha256(shown) AS sha256 FROM un",
    "markdown_chunks": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, idx, chunk_id, char_start, char_end, n_tokens, block_type, sha256(raw) AS raw_sha256, sha256(e) AS embed_sha256 FROM ch",
    "chunk_types": f"WITH RECURSIVE {_CHUNKS} SELECT block_type, count(*) AS n_chunks, sum(n_tokens)::BIGINT AS n_tokens, max(n_tokens) AS most, round(avg(n_tokens), 6) AS mean FROM ch GROUP BY 1",
    "chunk_lookup": f"""WITH RECURSIVE {_CHUNKS} SELECT chunk_id AS id, doc_id::VARCHAR AS doc_id, char_start::BIGINT AS char_start, char_end::BIGINT AS char_end, length(raw) AS chars_raw, n_tokens AS tokens_embed, block_type, sha256(raw) AS sha256, sha256({_NORM}) AS sha256_norm
      FROM ch WHERE chunk_id IN ('0:c000', '14:c001', '30:c000') OR doc_id = 7""",
    "chunk_share": f"WITH RECURSIVE {_CHUNKS}, per AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY 1), top AS (SELECT n FROM per ORDER BY n DESC, doc_id LIMIT 3) SELECT (SELECT sum(n)::BIGINT FROM per) AS n_chunks, sum(n)::BIGINT AS top_chunks, round(sum(n) / (SELECT sum(n) FROM per), 6) AS share FROM top",
    "chunk_sample": f"""WITH RECURSIVE {_CHUNKS}, bk AS (SELECT 'block_type=' || block_type AS bucket, chunk_id AS id, n_tokens FROM ch UNION ALL SELECT 'document ' || doc_id, chunk_id, n_tokens FROM ch WHERE doc_id IN (7, 14)
      UNION ALL SELECT m || '> region', chunk_id, n_tokens FROM ch, (SELECT unnest(['<Tab', '<Step']) AS m) WHERE contains(raw, m))
      SELECT bucket, id, n_tokens AS tokens_embed FROM bk QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY md5('0:' || id), id) = 1""",
    "chunk_bm25_topk": _TOPK(sql.bm25(sql.terms("text"), docs="emb"), "sc"),
    "chunk_dense_topk": _TOPK(sql.dense(sql.terms("text"), docs="emb"), "de"),
}
