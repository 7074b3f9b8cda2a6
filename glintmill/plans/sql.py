"""Pieces of SQL that the checks of several queries share, for DuckDB."""

from __future__ import annotations

from glintmill.functions.markup import ACCORDIONS, CARDS, COMMENTS, LOOSE_STEPS, STEP, STEPS, TABS, WRAPPERS
from glintmill.functions.text import STRIDE, TOKEN
from glintmill.operators.retrieval import DIM


def terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+'))"


def degraded(text: str) -> str:
    return f"list_filter({terms(text)}, lambda t, i: (i - 1) % {STRIDE} = 0)"


def n_tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{TOKEN}'))"


NORMALISED = r"lower(trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g')))"
VOCAB = f"tok AS (SELECT doc_id, unnest({terms('text')}) AS term FROM documents), vocab AS (SELECT DISTINCT term FROM tok), fold AS (SELECT v.term, coalesce(s.term, v.term) AS folded FROM vocab v LEFT JOIN vocab s ON length(v.term) > 3 AND v.term LIKE '%s' AND s.term = left(v.term, length(v.term) - 1))"
FREQUENCY = f"{VOCAB}, freq AS (SELECT folded AS term, count(DISTINCT doc_id) AS df FROM tok JOIN fold USING (term) GROUP BY 1)"


def bm25(questions: str, name: str = "sc", docs: str = "documents") -> str:
    """CTEs up to ``name`` (item_id, doc_id, score) at full depth; ``questions`` is an expression on benchmark.text, ``docs`` has doc_id and text."""
    return f"""q AS (SELECT item_id, {questions} AS terms FROM benchmark),
      btok AS (SELECT doc_id, unnest({terms('text')}) AS term FROM {docs}), post AS (SELECT doc_id, term, count(*) AS tf FROM btok GROUP BY ALL),
      dl AS (SELECT doc_id, len({terms('text')}) AS dl FROM {docs}), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), bdf AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
      qt AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(terms) AS term FROM q) GROUP BY ALL),
      hit AS (SELECT item_id, doc_id, sum(floor(qf * (ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) * 1e9 + 0.5)::BIGINT)::DOUBLE / 1e9 AS score
        FROM qt JOIN post USING (term) JOIN bdf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
      {name} AS (SELECT item_id, doc_id, coalesce(score, 0.0) AS score FROM q CROSS JOIN (SELECT doc_id FROM {docs}) LEFT JOIN hit USING (item_id, doc_id))"""


def hashed(docs: str = "documents") -> str:
    return f"""hb AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS bucket, count(*) AS c FROM (SELECT doc_id, unnest({terms('text')}) AS term FROM {docs}) GROUP BY ALL),
  hs AS (SELECT doc_id, sum(c * c) AS square FROM hb GROUP BY 1)"""


def dense(questions: str, name: str = "de", docs: str = "documents") -> str:
    return f"""{hashed(docs)}, dq AS (SELECT item_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS bucket, count(*) AS c FROM (SELECT item_id, unnest({questions}) AS term FROM benchmark) GROUP BY ALL),
      dqs AS (SELECT item_id, sum(c * c) AS square FROM dq GROUP BY 1), dots AS (SELECT item_id, doc_id, sum(dq.c * hb.c) AS dot FROM dq JOIN hb USING (bucket) GROUP BY ALL),
      {name} AS (SELECT b.item_id, d.doc_id, CASE WHEN hs.square IS NULL OR dqs.square IS NULL THEN 0.0 ELSE coalesce(dot, 0) / sqrt((hs.square * dqs.square)::DOUBLE) END AS score
        FROM benchmark b CROSS JOIN {docs} d LEFT JOIN hs USING (doc_id) LEFT JOIN dqs USING (item_id) LEFT JOIN dots USING (item_id, doc_id))"""


def ranked(scores: str, name: str) -> str:
    return f"{name} AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM {scores})"


def fused(questions: str) -> str:
    return f"""{bm25(questions)}, {dense(questions)}, {ranked('sc', 'rb')}, {ranked('de', 'rd')},
      fu AS (SELECT item_id, doc_id, sum(floor(1e15 / (60 + rank) + 0.5)::BIGINT)::DOUBLE / 1e15 AS score FROM (SELECT * FROM rb UNION ALL SELECT * FROM rd) GROUP BY ALL), {ranked('fu', 'rh')}"""


RUNS = f"""{fused(degraded('text'))},
  runs AS (SELECT 'bm25' AS variant, * FROM rb WHERE rank <= 20 UNION ALL SELECT 'dense', * FROM rd WHERE rank <= 20 UNION ALL SELECT 'hybrid', * FROM rh WHERE rank <= 20)"""
GOLD = "gold AS (SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND b.text <> '')"
SCORES = f"""{RUNS}, {GOLD}, ng AS (SELECT item_id, count(*) AS n_gold FROM gold GROUP BY 1),
  mk AS (SELECT r.*, g.item_id IS NOT NULL AS is_gold, d.source IN ('src0', 'src1') AS surf FROM runs r LEFT JOIN gold g USING (item_id, doc_id) JOIN documents d USING (doc_id)),
  pq AS (SELECT variant, item_id, count(*) FILTER (rank <= 3 AND is_gold) AS h3, count(*) FILTER (rank <= 10 AND is_gold) AS h10, min(rank) FILTER (is_gold) AS fr, count(*) FILTER (rank <= 10 AND surf) AS surface_hits FROM mk GROUP BY ALL),
  scores AS (SELECT variant, item_id, coalesce(n_gold, 0) AS n_gold, coalesce(n_gold, 0) > 0 AS answerable, h3 / n_gold AS recall_3, h10 / n_gold AS recall_10,
    CASE WHEN n_gold > 0 THEN h3 / 3 END AS precision_3, CASE WHEN n_gold > 0 THEN fr END AS first_rank, CASE WHEN n_gold > 0 THEN coalesce(1 / fr, 0.0) END AS reciprocal_rank, surface_hits FROM pq LEFT JOIN ng USING (item_id))"""
METRICS = ("recall_3", "recall_10", "precision_3", "reciprocal_rank")
LONG = f"{SCORES}, long AS ({' UNION ALL '.join(f'''SELECT variant, item_id, '{m}' AS metric, {m} AS value FROM scores WHERE answerable''' for m in METRICS)})"
DIFFS = f"""{LONG}, diffs AS (SELECT a.metric, a.item_id, b.variant || '-' || a.variant AS comparison, b.value - a.value AS diff FROM long a JOIN long b USING (metric, item_id) WHERE a.variant < b.variant)"""


def mean(x: str) -> str:
    return f"round((sum(({x})::DECIMAL(20,12)) / count({x}))::DOUBLE, 6)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def flattened(source: str, out: str) -> str:
    """CTEs up to ``out``: the rows of ``source`` with ``shown``, its column ``body`` after all component rules."""
    quoted = lambda p: p.replace("'", "''")

    def rules(x: str, which: list[tuple[str, str]]) -> str:
        for pattern, by in which:
            x = f"regexp_replace({x}, '{quoted(pattern)}', '{by.replace('$1', chr(92) + '1')}', 'g')"
        return x

    inner = rf"replace(regexp_replace(b, '^<Steps(?:\s[^>]*)?>|</Steps>$', '', 'g'), '</Step>', '')"
    tag = f"regexp_extract_all({inner}, '{STEP}')[i - 1]"
    title = rf"""regexp_extract({tag}, '^<Step\s+title="([^"]*)"', 1)"""
    block = f"array_to_string(list_transform(string_split_regex({inner}, '{STEP}'), lambda p, i: CASE WHEN i = 1 THEN p ELSE chr(10) || (i - 1) || '.' || CASE WHEN {title} <> '' THEN ' ' || {title} ELSE '' END || chr(10) || p END), '')"
    return f"""{out}_1 AS (SELECT *, {rules('body', COMMENTS + TABS)} AS b1 FROM {source}),
      {out}_2 AS (SELECT *, list_transform(regexp_extract_all(b1, '{STEPS}'), lambda b: {block}) AS done, string_split_regex(b1, '{STEPS}') AS around FROM {out}_1),
      {out} AS (SELECT * EXCLUDE (b1, done, around), {rules("array_to_string(list_transform(around, lambda g, i: g || coalesce(done[i], '')), '')", LOOSE_STEPS + ACCORDIONS + CARDS + WRAPPERS)} AS shown FROM {out}_2)"""


def cells(line: str) -> str:
    inner = rf"regexp_replace(replace({strip(line)}, '\|', chr(1)), '^\||\|$', '', 'g')"
    coded = f"array_to_string(list_transform(string_split({inner}, '`'), lambda x, i: CASE WHEN i % 2 = 0 THEN replace(x, '|', chr(1)) ELSE x END), '`')"
    clean = strip("replace(regexp_replace(" + strip("replace(c, chr(1), '|')") + ", ' {2,}', ' ', 'g'), '`', '')")
    return f"list_transform(string_split({coded}, '|'), lambda c: {clean})"


def merkle(rows: str, column: str, out: str) -> str:
    """CTEs up to ``out``, one row: the hash of rows (k, h) by hashes of hashes."""
    level = lambda source: f"SELECT b AS k, sha256(string_agg(h, '' ORDER BY k, h)) AS h FROM (SELECT *, k // 1024 AS b FROM {source}) GROUP BY b"
    return f"{out}0 AS ({rows}), {out}1 AS ({level(out + '0')}), {out}2 AS ({level(out + '1')}), {out}3 AS ({level(out + '2')}), {out} AS (SELECT sha256(string_agg(h, '' ORDER BY k, h)) AS {column} FROM {out}3)"
