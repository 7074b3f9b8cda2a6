"""Benchmark passages in documents: item-sized windows, counted exactly from shared five-word runs.

A window has as many words as an item. The runs of five words of the items, with their counts, are joined with those of the
documents. A window that shares no run with an item has similarity 0, and one that doesn't begin at a shared run is no
better than the next that does, so the windows that begin at shared runs are all that count. For each document and item, a
running sum over the places that they share gives the counts of all windows: a place costs the same whatever the length
of the item. From the counts follows the weighted Jaccard similarity of the five-word shingles. Runs are told apart
by a 64-bit hash of their words. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.llm import common

SHINGLE = 5
SIMILARITY = 0.8
WORD = r"[\p{L}\p{N}]+"


def words_of(text) -> F.Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def _runs(words: str) -> F.Column:
    """A hash of the five words from each position on; positions too near the end are cut off."""
    at = F.transform(F.col(words), lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + j) for j in range(1, SHINGLE)]))
    return F.slice(at, 1, F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0)))


def _best_window() -> F.Column:
    """struct(shared, start) of the best window, the first of equal ones, from ``hits``: a set of run, place, times in the item.

    A place counts in the windows that hold it but not, before it, as many equal runs as the item has: those that begin from
    ``low`` to the place. So shared shingles at a begin are the lows up to it less the places before it, a running sum.
    """
    earlier = "get(h, i - x.most)"
    steps = f"""transform(h, (x, i) -> named_struct('k', greatest(0, x.p - size + 1, coalesce(IF({earlier}.run = x.run, {earlier}.p + 1, 0), 0)), 'ask', 0, 'd', 1)),
        transform(h, x -> named_struct('k', x.p + 1, 'ask', 0, 'd', -1)),
        transform(array_distinct(transform(h, x -> least(x.p, greatest(n_doc - n, 0)))), x -> named_struct('k', x, 'ask', 1, 'd', 0))"""
    better = "e.ask = 1 AND a.s > a.shared"
    return F.expr(f"""transform(array(sort_array(hits)), h -> aggregate(sort_array(concat({steps})), named_struct('s', 0, 'shared', 0, 'start', 0),
        (a, e) -> named_struct('s', a.s + e.d, 'shared', IF({better}, a.s, a.shared), 'start', IF({better}, e.k, a.start)),
        a -> named_struct('shared', a.shared, 'start', a.start)))[0]""")


def _once(value) -> F.Column:
    """``value``, computed once a row: a generator's output isn't copied into the expressions that use it."""
    return F.explode(F.array(value))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, words) of items with at least five words, of any length."""
    items = common.pick(benchmark, "item_id", "text").select("item_id", words_of(F.col("text")).alias("words"))
    items = items.filter(F.size("words") >= SHINGLE).withColumn("n", F.size("words"))
    return items.distinct()


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, broadcast_rows: int = common.BROADCAST_ROWS) -> DataFrame:
    """Windows that match an item: doc_id, item_id, start (word), similarity; one row per document and item, the best.

    Of equal windows the first counts. Words are runs of letters and digits in lower case. A document shorter than an item
    is one window. Null and empty texts, and items of under five words, match nothing. Rows with the same doc_id, null
    included, count as one document. Repeated items with different ids each match. Further columns are ignored; an empty
    table on either side gives no rows. Runs of items of up to ``broadcast_rows`` are broadcast, more are shuffled; the result is the same.
    """
    scored = _scored(docs, benchmark, similarity, broadcast_rows)
    best = scored.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.start").alias("start"), F.round(-F.col("best.s"), 6).alias("similarity"))


def _scored(docs: DataFrame, benchmark: DataFrame, similarity: float, broadcast_rows: int) -> DataFrame:
    """The best window of each row and item that match: doc_id, row (hashes of id and text), item_id, start, similarity."""
    items = items_of(benchmark).select("item_id", "n", F.xxhash64("item_id", "words").alias("item"), F.explode(_runs("words")).alias("run"))
    runs = common.materialise(items.groupBy("run", "item_id", "item", "n").agg(F.count("*").cast("int").alias("most")), "runs")
    d = common.pick(docs, "doc_id", "text").select("doc_id", common.text_key(F.col("doc_id"), F.col("text")).alias("row"), words_of(F.col("text")).alias("words")).filter(F.size("words") >= SHINGLE)
    places = d.select("doc_id", "row", F.size("words").alias("n_doc"), F.posexplode(_runs("words")).alias("p", "run"))
    hits = places.join(F.broadcast(runs) if common.small(runs, broadcast_rows) else runs, "run")
    # A set: rows alike in id and text count once.
    each = hits.groupBy("doc_id", "row", "n_doc", "item_id", "item", "n").agg(F.collect_set(F.struct("run", "p", "most")).alias("hits"))
    # No window shares more shingles than it holds, or than there are shared places.
    size, of_item = F.least("n", "n_doc") - (SHINGLE - 1), F.col("n") - (SHINGLE - 1)
    like = lambda shared: shared / (size + of_item - shared)
    each = each.filter(like(F.least(F.size("hits"), size, of_item)) >= similarity).withColumn("size", size).withColumn("best", _once(_best_window()))
    return each.select("doc_id", "row", "item_id", "best.start", like(F.col("best.shared")).alias("similarity")).filter(F.col("similarity") >= similarity)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; all columns as they are. A row goes by its own text, whatever others share its id."""
    found = _scored(docs, benchmark, SIMILARITY, common.BROADCAST_ROWS).select(F.col("row").alias("_row")).distinct()
    found = common.materialise(found, "leaks")
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"_c{common.place(docs.columns, n)}") for n in ("doc_id", "text"))
    return flat.join(common.beside(found), common.text_key(doc_id, text) == F.col("_row"), "left_anti").toDF(*docs.columns)


ORACLE = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
d AS (SELECT doc_id, w, len(w) AS nd FROM words WHERE len(w) >= {SHINGLE}),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
i AS (SELECT item_id, w, len(w) AS n FROM iw WHERE len(w) >= {SHINGLE}),
ds AS (SELECT doc_id, nd, p - 1 AS p, array_to_string(w[p:p + {SHINGLE - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, nd - {SHINGLE - 2})) AS p FROM d)),
isx AS (SELECT item_id, n, s, count(*) AS c FROM (SELECT item_id, n, array_to_string(w[p:p + {SHINGLE - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, n - {SHINGLE - 2})) AS p FROM i)) GROUP BY ALL),
hits AS (SELECT DISTINCT doc_id, nd, item_id, n, greatest(0, least(p, nd - n)) AS start FROM ds JOIN isx USING (s)),
cnt AS (SELECT h.doc_id, h.item_id, h.n, h.nd, h.start, isx.s, least(count(*), any_value(isx.c)) AS m
  FROM hits h JOIN ds ON ds.doc_id = h.doc_id AND ds.p >= h.start AND ds.p <= h.start + h.n - {SHINGLE} JOIN isx ON isx.item_id = h.item_id AND isx.s = ds.s GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, sum(m) / (greatest(least(n, nd) - {SHINGLE - 1}, 0) + n - {SHINGLE - 1} - sum(m)) AS similarity FROM cnt GROUP BY doc_id, item_id, n, nd, start)
SELECT doc_id, item_id, arg_min(start, (-similarity, start))::INT AS start, round(max(similarity), 6) AS similarity FROM sim WHERE similarity >= {SIMILARITY} GROUP BY doc_id, item_id"""
