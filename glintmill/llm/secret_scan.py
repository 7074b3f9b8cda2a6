"""Secrets in texts: fixed patterns, and windows of high Shannon entropy in candidate strings.

All of it is DataFrame expressions over one row at a time: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.llm import common

# Fixed patterns: kind, pattern, group that is measured, its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: Characters of a window, and the bits of entropy a character that make a window suspicious, by class of the string.
WINDOW = 20
BITS = {"entropy_hex": 3.0, "entropy_base64": 3.8}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
# Fixed lists: candidates that match one of the first hold no secret; a piece (what / - _ part) with one of the second isn't part of a candidate.
WHOLE = (
    r"^[^0-9]*$",  # words without a digit
    r"^[^A-Za-z]*$",  # numbers
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
)
IN_PIECE = (
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"(?i)0123456789|abcdefghij",
)
_PIECE = rf"(?![A-Za-z0-9+]*?(?:{'|'.join(p.replace('(?i)', '(?i:') + ')' for p in IN_PIECE)}))[A-Za-z0-9+]++"
#: Pieces joined by / - _, with such signs at the ends, but not the // of a URL; a quick look ahead, then at least one piece. May be shorter than a window.
CANDIDATE = rf"(?:(?<![A-Za-z0-9+/_-])(?!//)|(?<=[/_-])(?=[A-Za-z0-9+]))(?=[A-Za-z0-9+/_-]{{{WINDOW}}})[/_-]*+{_PIECE}(?:[/_-]++{_PIECE})*+(?:[/_-]++(?![A-Za-z0-9+]))?"
#: c * log2(c) in millionths, so that sums are exact whatever their order.
PARTS = [round(c * math.log2(c) * 1e6) if c else 0 for c in range(WINDOW + 2)]  # one more: a character enters before one leaves
MOST = {k: math.floor(WINDOW * (math.log2(WINDOW) - b) * 1e6) for k, b in BITS.items()}
REDACTED = "[SECRET]"


#: Elements of an array, and characters of a text, that are taken at once, so that what grows step by step stays short.
PART, BLOCK, BLOCKS = 128, 4096, 64
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _parts(array: str) -> str:
    """An array cut into arrays of ``PART`` elements."""
    return f"transform(sequence(0, greatest(size({array}) - 1, 0) div {PART}), k -> slice({array}, {PART} * k + 1, {PART}))"


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``value``, computed once, under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _matches(name: str, text: str, pattern: str, group: int, least: int, kind: int) -> F.Column:
    """Spans of the matches in column ``text`` whose group is long enough: struct(start, kind, end), in code points.

    Gaps between matches come from split(), matches from regexp_extract_all(): both go left to right without overlap. Their lengths
    are summed part by part, and within each part, so the time is all but linear in the number of matches.
    """
    steps = f"zip_with(slice(split({text}, pattern, -1), 1, size(found)), found, (g, m) -> named_struct('g', length(g), 'm', length(m)))"
    begins = "aggregate(parts, named_struct('at', 0, 'out', CAST(array() AS array<int>)), (a, c) -> named_struct('at', a.at + aggregate(c, 0, (t, x) -> t + x.g + x.m), 'out', concat(a.out, array(a.at))), a -> a.out)"
    within = f"""aggregate(c, named_struct('at', base, 'out', CAST(array() AS {_SPANS})),
        (a, x) -> named_struct('at', a.at + x.g + x.m, 'out', concat(a.out, array(named_struct('start', a.at + x.g, 'kind', {kind}, 'end', a.at + x.g + x.m)))), a -> a.out)"""
    spans = _bound(steps, "steps", _bound(_parts("steps"), "parts", f"flatten(zip_with(parts, {begins}, (c, base) -> {within}))"))
    sql = f"CASE WHEN size(found) = 0 THEN array() ELSE filter(zip_with({spans}, sized, (s, m) -> named_struct('span', s, 'n', length(m))), x -> x.n >= {least}).span END"
    literal = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    sized = f"regexp_extract_all({text}, {literal}, {group})" if group else f"{name}_found"
    return F.expr(sql.replace("found", f"{name}_found").replace("sized", sized).replace("pattern", literal))


def _entropy(text: str) -> F.Column:
    """Spans of candidate strings between the first and the last suspicious window, as :func:`_matches`."""
    allowed = " OR ".join("c.s RLIKE '" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in WHOLE)
    parts = f"array({', '.join(f'{p}L' for p in PARTS)})"
    step_sum = f"(a.s + {parts}[a.n[c.codes[i]] + 1] - {parts}[a.n[c.codes[i]]] + IF(i >= {WINDOW}, {parts}[a.n[c.codes[i - {WINDOW}]] + IF(c.codes[i - {WINDOW}] = c.codes[i], 1, 0) - 1] - {parts}[a.n[c.codes[i - {WINDOW}]] + IF(c.codes[i - {WINDOW}] = c.codes[i], 1, 0)], 0L))"
    hit = f"(i >= {WINDOW - 1} AND {step_sum} <= c.most)"
    return F.expr(f"""
      CASE WHEN size(cand_found) = 0 THEN CAST(array() AS array<struct<start:int,kind:int,end:int>>) ELSE
      filter(transform(
        transform(filter(zip_with({text}_spans, cand_found, (p, s) -> named_struct('start', p.start, 's', s)), c -> length(c.s) >= {WINDOW} AND NOT ({allowed})),
          c -> named_struct('start', c.start, 'codes', transform(slice(split(c.s, ''), 1, length(c.s)), x -> instr('{ALPHABET}', x)),
                            'kind', IF(c.s RLIKE '^[0-9a-fA-F]+$', 3, 4),
                            'most', IF(c.s RLIKE '^[0-9a-fA-F]+$', {MOST['entropy_hex']}L, {MOST['entropy_base64']}L))),
        c -> aggregate(sequence(0, size(c.codes) - 1),
          named_struct('n', array_repeat(0, {len(ALPHABET) + 1}), 's', 0L, 'first', -1, 'last', -1),
          (a, i) -> named_struct(
            'n', transform(a.n, (v, k) -> v + IF(k = c.codes[i], 1, 0) - IF(i >= {WINDOW} AND k = c.codes[greatest(i - {WINDOW}, 0)], 1, 0)),
            's', {step_sum},
            'first', IF(a.first < 0 AND {hit}, i - {WINDOW - 1}, a.first),
            'last', IF({hit}, i, a.last)),
          a -> named_struct('start', c.start + a.first, 'kind', IF(a.first < 0, -1, c.kind), 'end', c.start + a.last + 1))),
        x -> x.kind >= 0) END""")


def _with_spans(df: DataFrame) -> DataFrame:
    """Adds ``base`` and ``spans`` to a frame with ``text``, sorted by start, then kind."""
    for name, pattern, _, _ in BASE:
        df = df.withColumn(f"{name}_found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("cand_found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    for i, (name, pattern, group, least) in enumerate(BASE):
        df = df.withColumn(f"{name}_spans", _matches(name, "text", pattern, group, least, i).cast("array<struct<start:int,kind:int,end:int>>"))
    df = df.withColumn("text_spans", _matches("cand", "text", CANDIDATE, 0, 0, 0).cast("array<struct<start:int,kind:int,end:int>>"))
    df = df.withColumn("base", F.array_sort(F.concat(*[f"{n}_spans" for n, *_ in BASE])))
    df = df.withColumn("added", _entropy("text"))
    # What base spans leave of an added span: base is sorted by start, so each cuts off what is before it and moves on to its end.
    near = "flatten(transform(filter(blocks, b -> b.low < e.end AND e.start < b.high), b -> filter(b.part, x -> x.start < e.end AND e.start < x.end)))"
    left = f"""aggregate({near}, named_struct('at', e.start, 'out', CAST(array() AS {_SPANS})),
        (a, b) -> named_struct('at', greatest(a.at, b.end), 'out', IF(b.start > a.at, concat(a.out, array(named_struct('start', a.at, 'kind', e.kind, 'end', b.start))), a.out)),
        a -> IF(a.at < e.end, concat(a.out, array(named_struct('start', a.at, 'kind', e.kind, 'end', e.end))), a.out))"""
    # A rest of separators alone holds nothing.
    rest = _bound(_span_blocks("base"), "blocks", f"filter(flatten(transform(added, e -> {left})), x -> x.end - x.start >= {WINDOW} OR substring(text, x.start + 1, x.end - x.start) RLIKE '[A-Za-z0-9+]')")
    return df.withColumn("spans", F.expr(f"CASE WHEN size(added) = 0 THEN base ELSE array_sort(concat(base, {rest})) END"))


def _span_blocks(spans: str) -> str:
    """Sorted spans in parts, each with where it begins and ends: struct(low, high, part)."""
    return f"transform(filter({_parts(spans)}, c -> size(c) > 0), c -> named_struct('low', c[0].start, 'high', array_max(c.end), 'part', c))"


def _listed(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', array({kinds})[x.kind], CAST(x.start AS string), CAST(x.end AS string))), ',')"


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    A null text is empty: no spans, the hash of the empty string. Of an added span, what spans of the fixed patterns
    leave is kept, in pieces. A null doc_id stays null; repeated rows each give a row; further columns are ignored; an empty table gives
    no rows.
    """
    df = _with_spans(common.pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))))
    count = lambda name: F.size(f"{name}_spans").cast("long").alias(f"n_{name}")
    return df.select(
        "doc_id", *[count(n) for n, *_ in BASE], F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_entropy"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each run of secret spans in the text replaced by ``REDACTED``; n_chars, if there, follows. A null text stays."""
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = common.place(names, "text")
    df = _with_spans(flat.withColumn("text", F.coalesce(F.col(f"_c{at}"), F.lit(""))))
    # Block by block of the text; a span that began before a block only covers.
    near = "flatten(transform(filter(blocks, b -> b.low < t.at + length(t.s) AND t.at < b.high), b -> filter(b.part, x -> x.start < t.at + length(t.s) AND t.at < x.end)))"
    block = f"""aggregate({near}, named_struct('at', t.at, 'out', CAST('' AS string)),
          (a, x) -> named_struct('at', greatest(a.at, x.end), 'out', IF(x.start < a.at, a.out, concat(a.out, substring(t.s, a.at - t.at + 1, x.start - a.at), '{REDACTED}'))),
          a -> concat(a.out, substring(t.s, a.at - t.at + 1, length(t.s))))"""
    large = BLOCK * BLOCKS
    pieces = f"""flatten(transform(sequence(0, greatest(length(text) - 1, 0) div {large}), k -> {_bound(f"substring(text, {large} * k + 1, {large})", "w",
        f"transform(sequence(0, greatest(length(w) - 1, 0) div {BLOCK}), j -> named_struct('at', {large} * k + {BLOCK} * j, 's', substring(w, {BLOCK} * j + 1, {BLOCK})))")}))"""
    clean = F.expr(f"CASE WHEN size(spans) = 0 THEN _c{at} ELSE {_bound(_span_blocks('spans'), 'blocks', f"array_join(transform({pieces}, t -> {block}), '')")} END")
    out = df.withColumn("_clean", clean)
    picked = [F.col("_clean").alias(f"_c{i}") if i == at else F.col(f"_c{i}") for i in range(len(names))]
    for i, n in enumerate(names):
        if n == "n_chars":
            picked[i] = F.when(F.size("spans") == 0, F.col(f"_c{i}")).otherwise(F.length("_clean").cast(docs.schema[i].dataType)).alias(f"_c{i}")
    return out.select(*picked).toDF(*names)


def _oracle() -> str:
    def case(p: str) -> str:  # letters in either case, spelled out
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in p)

    words = "|".join(case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = "(" + words + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = {"assign": (assign, 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24), "cand": ("[A-Za-z0-9+/_-]{%d,}" % WINDOW, 0, 0)}
    ctes = []
    for i, (name, (p, group, least)) in enumerate(patterns.items()):
        ctes.append(f"""{name}_m AS (SELECT rid, text, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS g,
            string_split_regex(text, '{p}') AS gaps FROM d WHERE regexp_matches(text, '{p}')),
          {name} AS (SELECT rid, {i} AS kind, g[j] AS s, list_sum(list_transform(gaps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j-1], lambda x: length(x))), 0) AS st, length(m[j]) AS n
            FROM {name}_m, (SELECT unnest(range(1, 100000)) AS j) WHERE j <= len(m) AND length(g[j]) >= {least})""")
    allowed = " OR ".join(f"regexp_matches(s, '{p}')" for p in WHOLE)
    hidden = " OR ".join(f"regexp_matches(p, '{p}')" for p in IN_PIECE)
    parts = "[" + ", ".join(f"{p}" for p in PARTS) + "]"
    long = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    {', '.join(ctes)},
    base AS (SELECT rid, kind, st::BIGINT AS st, (st + n)::BIGINT AS en FROM (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex)),
    run AS (SELECT rid, st, s, regexp_extract_all(s, '[A-Za-z0-9+]+') AS ps, string_split_regex(s, '[A-Za-z0-9+]+') AS gs FROM cand),
    piece AS (SELECT rid, st, s, j, len(ps) AS n_ps, ps[j] AS p, ({long('gs[1:j]')} + {long('ps[1:j-1]')})::BIGINT AS po FROM run, (SELECT unnest(range(1, 100000)) AS j) WHERE j <= len(ps)),
    kept AS (SELECT *, j - row_number() OVER (PARTITION BY rid, st ORDER BY j) AS island FROM piece WHERE NOT ({hidden})),
    whole AS (SELECT rid, st, s, CASE WHEN min(j) = 1 AND NOT starts_with(s, '//') THEN 0 ELSE min(po) END AS a, CASE WHEN max(j) = any_value(n_ps) THEN length(s) ELSE max(po + length(p)) END AS z FROM kept GROUP BY rid, st, s, island),
    c0 AS (SELECT rid, (st + a)::BIGINT AS st, s[a + 1:z] AS s FROM whole WHERE z - a >= {WINDOW}),
    c AS (SELECT rid, st, s, CASE WHEN regexp_matches(s, '^[0-9a-fA-F]+$') THEN 3 ELSE 4 END AS kind FROM c0 WHERE NOT ({allowed})),
    w AS (SELECT rid, st, kind, i, s[i:i + {WINDOW - 1}] AS win FROM c, (SELECT unnest(range(1, 100000)) AS i) WHERE i + {WINDOW - 1} <= length(s)),
    e AS (SELECT rid, st, kind, i, list_sum(list_transform(list_distinct(string_split(win, '')), lambda x: {parts}[length(win) - length(replace(win, x, '')) + 1])) AS sm FROM w),
    f AS (SELECT rid, kind, (st + min(i) - 1)::BIGINT AS st, (st + max(i) + {WINDOW - 1})::BIGINT AS en FROM e
          WHERE sm <= CASE WHEN kind = 3 THEN {MOST['entropy_hex']} ELSE {MOST['entropy_base64']} END GROUP BY rid, st, kind),
    over AS (SELECT f.rid, f.kind, f.st, f.en, list(b.st ORDER BY b.st, b.en) FILTER (b.st IS NOT NULL) AS bs, list(b.en ORDER BY b.st, b.en) FILTER (b.st IS NOT NULL) AS be
      FROM f LEFT JOIN base b ON b.rid = f.rid AND b.st < f.en AND f.st < b.en GROUP BY ALL),
    cut AS (SELECT rid, kind, greatest(st, coalesce(list_max(be[1:i]), st)) AS st, least(en, coalesce(bs[i + 1], en)) AS en FROM over, (SELECT unnest(range(0, 100000)) AS i) WHERE i <= coalesce(len(bs), 0)),
    added AS (SELECT cut.* FROM cut JOIN d USING (rid) WHERE st < en AND regexp_matches(text[st + 1:en], '[A-Za-z0-9+]')),
    named AS (SELECT *, {list(KINDS)}[kind + 1] || ':' || st || ':' || en AS label, 0 AS extra FROM base
      UNION ALL SELECT rid, kind, st, en, {list(KINDS)}[kind + 1] || ':' || st || ':' || en, 1 FROM added),
    g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (extra = 1) AS n_entropy,
      string_agg(label, ',' ORDER BY st, kind) FILTER (extra = 0) AS b, string_agg(label, ',' ORDER BY st, kind) AS a FROM named GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_entropy, 0) AS n_entropy FROM d LEFT JOIN g USING (rid)"""


ORACLE = _oracle()
