"""Segmentation of texts into units and of units into chunks within a token budget.

Packing is a recurrence over a document's units in order, which no built-in operator expresses; it runs document by document in
``mapInPandas``, with no shuffle. Units tile their document and chunks join back to it; this is checked for every document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintmill.functions import markup as M
from glintmill.functions import plain as P
from glintmill.functions import text as T
from glintmill.operators.ordered import order_statistics, running_total
from glintmill.sources.holding import hold
from glintmill.sources.tables import beside, small_batches

BUDGET = 254
CUT = 2 * BUDGET
_TOKENS = re.compile(T.TOKEN)
_GAP = re.compile(r"\n\s*\n")
_FENCE_MARK = re.compile(r"^```", re.M)
CHUNK_SCHEMA = "doc_id long, idx int, chunk_id string, char_start int, char_end int, n_tokens int, block_type string, text string, text_embed string"
UNIT_SCHEMA = "doc_id long, pos int, start int, end int, kind string, n_tokens int, glue string, shown string"


def count_tokens(text: str) -> int:
    return sum(1 for _ in _TOKENS.finditer(text)) if text.strip() else 0


@dataclass
class Unit:
    """A piece of a document: where it is, and how it is shown. ``glue`` stands before it when it follows another unit of its chunk."""

    start: int
    end: int
    kind: str
    shown: str
    tokens: int
    glue: str = "\n\n"


def _cuts(text: str, start: int, end: int, kind: str, show: Callable[[str], str], tokens: Callable[[str], int]) -> list[Unit]:
    """A line over the budget, cut every ``CUT`` characters; a cut that is still over it, every ``BUDGET`` characters, each a token at most."""
    out = []
    for at in range(start, end, CUT):
        stop = min(at + CUT, end)
        shown = show(text[at:stop])
        edges = range(at, stop, BUDGET) if tokens(shown) > BUDGET else (at,)
        for edge in edges:
            shown = show(text[edge : min(edge + BUDGET, stop)]) if len(edges) > 1 else shown
            out.append(Unit(edge, min(edge + BUDGET, stop) if len(edges) > 1 else stop, kind, shown, tokens(shown), ""))
    return out


def line_units(text: str, tokens: Callable[[str], int] = count_tokens) -> list[Unit]:
    """Lines with their line ends, as they are; one over the budget is cut."""
    out, at = [], 0
    for line in text.split("\n"):
        end = min(len(text), at + len(line) + 1)
        if end > at:
            n = tokens(text[at:end])
            out += _cuts(text, at, end, "prose", lambda x: x, tokens) if n > BUDGET else [Unit(at, end, "prose", text[at:end], n, "")]
        at = end
    return out


def _fences(text: str) -> Iterator[tuple[int, int]]:
    """Marks at line begins, two by two; a fence runs to the end of its closing line, and one without an end is none."""
    marks = [m.start() for m in _FENCE_MARK.finditer(text)]
    for begin, close in zip(marks[::2], marks[1::2], strict=False):
        line_end = text.find("\n", close)
        yield begin, len(text) if line_end < 0 else line_end + 1


def _lines(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    at = start
    for line in text[start:end].splitlines(keepends=True):
        yield at, at + len(line)
        at += len(line)


def _table(text: str, start: int, end: int) -> Iterator[tuple[int, int, str, str]]:
    """A line each: header, separators and blank lines show nothing; a row is shown with the header's labels."""
    headers = None
    for a, b in _lines(text, start, end):
        line = text[a:b].strip()
        if headers is None:
            headers = P.cells(line)
            yield a, b, "table_scaffold", ""
        elif not line or P.is_separator(line):
            yield a, b, "table_scaffold", ""
        else:
            yield a, b, "table_row", P.transform(P.rendered_row(headers, P.cells(line)))


def _between(text: str, start: int, end: int) -> Iterator[tuple[int, int, str, str]]:
    """What lies outside fences, parted by blank lines, which are pieces of their own."""
    at = start
    for m in [*_GAP.finditer(text, start, end), None]:
        stop = m.start() if m else end
        if stop > at:
            piece = text[at:stop]
            if not piece.strip():
                yield at, stop, "whitespace", ""
            elif P.is_table(piece):
                yield from _table(text, at, stop)
            else:
                yield at, stop, "prose", P.transform(piece)
        if m:
            yield m.start(), m.end(), "whitespace", ""
            at = m.end()


def markdown_units(text: str, tokens: Callable[[str], int] = count_tokens) -> list[Unit]:
    """Fences, table rows, prose and blank runs, which tile the text; prose and rows are shown transformed, fences as they are."""
    out, at = [], 0
    for begin, end in [*_fences(text), (len(text), len(text))]:
        out += [Unit(a, b, kind, shown, tokens(shown)) for a, b, kind, shown in _between(text, at, begin)]
        if end > begin:
            out.append(Unit(begin, end, "code", text[begin:end], tokens(text[begin:end])))
        at = end
    return out


def fitting(units: list[Unit], text: str, tokens: Callable[[str], int] = count_tokens) -> list[Unit]:
    """Units over the budget as their lines, each shown anew, and such lines as cuts. Only the first piece has the unit's glue: the others go on where it ends."""
    out = []
    for u in units:
        if u.tokens <= BUDGET:
            out.append(u)
            continue
        show = (lambda x: x) if u.kind == "code" else P.transform
        lines, pieces = list(_lines(text, u.start, u.end)), []
        for a, b in lines:
            shown = show(text[a:b])
            n = tokens(shown)
            pieces += [Unit(a, b, u.kind, shown, n, "")] if n <= BUDGET and len(lines) > 1 else _cuts(text, a, b, u.kind, show, tokens)
        pieces[0].glue = u.glue
        out += pieces
    return out


def packed(units: list[Unit]) -> list[list[Unit]]:
    """Greedy: a unit that would overflow begins a new chunk if the old one shows anything; units without tokens always join."""
    out: list[list[Unit]] = []
    held: list[Unit] = []
    total, shows = 0, False
    for u in units:
        if u.tokens and total + u.tokens > BUDGET and shows:
            out.append(held)
            held, total, shows = [], 0, False
        held.append(u)
        total += u.tokens
        shows = shows or bool(u.shown.strip())
    if held:
        out.append(held)
    return out


def block_type(units: list[Unit]) -> str:
    """The kind of most units that show anything; at a tie the first by name."""
    counts: dict[str, int] = {}
    for u in units:
        if u.shown.strip():
            counts[u.kind] = counts.get(u.kind, 0) + 1
    return min(counts, key=lambda k: (-counts[k], k)) if counts else "whitespace"


def embedded(units: list[Unit]) -> str:
    """The text that is ranked: units with their glue; blank ones only inside a unit that was split; no two empty lines in a row."""
    parts = [u for u in units if u.shown.strip() or not u.glue]
    return re.sub(r"\n{3,}", "\n\n", "".join([(u.glue if i else "") + u.shown for i, u in enumerate(parts)]).strip())


def greedy_chunks(docs: DataFrame, markdown: bool = False) -> DataFrame:
    """Chunks of each document: doc_id, idx, chunk_id, char_start, char_end, n_tokens, block_type, text, text_embed.

    ``text`` is the slice of the document, ``text_embed`` what is embedded and ranked; its tokens are counted anew. Chunks that don't join
    back to their document, and a chunk over the budget, raise.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                text = text or ""
                chunks = packed(fitting(markdown_units(text), text) if markdown else line_units(text))
                if "".join(text[c[0].start : c[-1].end] for c in chunks) != text:
                    raise AssertionError(f"chunks of {doc_id} don't join back to it")
                for i, c in enumerate(chunks):
                    shown = embedded(c) if markdown else text[c[0].start : c[-1].end]
                    n = count_tokens(shown)
                    if n > BUDGET:
                        raise AssertionError(f"chunk {i} of {doc_id} has {n} tokens")
                    rows.append((doc_id, i, f"{doc_id}:c{i:03d}", c[0].start, c[-1].end, n, block_type(c), text[c[0].start : c[-1].end], shown))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "chunk_id", "char_start", "char_end", "n_tokens", "block_type", "text", "text_embed"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, CHUNK_SCHEMA)


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Chunks as they are stored: with the length and the two hashes of the slice, exact and normalised."""
    raw = F.col("text")
    return chunks.select(F.col("chunk_id").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), raw.alias("text_raw"), "text_embed", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"),
                         F.length(raw).cast("long").alias("chars_raw"), F.col("n_tokens").alias("tokens_embed"), "block_type", F.sha2(raw, 256).alias("sha256"), F.sha2(T.normalised(raw), 256).alias("sha256_norm"))


def chunk_types(chunks: DataFrame) -> DataFrame:
    """(block_type, n_chunks, n_tokens, most, mean) a block type."""
    return chunks.groupBy("block_type").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most"), F.round(F.avg("n_tokens"), 6).alias("mean"))


def units(docs: DataFrame) -> DataFrame:
    """Markdown units of each document, those over the budget split: doc_id, pos, start, end, kind, n_tokens, glue, shown."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, u.start, u.end, u.kind, u.tokens, u.glue, u.shown) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for i, u in enumerate(fitting(markdown_units(t or ""), t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "start", "end", "kind", "n_tokens", "glue", "shown"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, UNIT_SCHEMA)


def line_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, end): lines with their line ends, in code points. Each row by itself, whatever other rows share its id."""
    lengths = F.transform(F.split(F.col("text"), "\n", -1), lambda line: F.length(line) + 1)
    # Sums run within parts of the list, and over the parts: an array that grows by one at a time is copied each time.
    spans = F.expr("""flatten(transform(array(transform(sequence(0, (size(l) - 1) div 256), k -> slice(l, 256 * k + 1, 256))), parts -> flatten(zip_with(parts,
        aggregate(parts, struct(0 AS at, CAST(array() AS array<int>) AS out), (a, c) -> struct(a.at + aggregate(c, 0, (t, x) -> t + x) AS at, concat(a.out, array(a.at)) AS out), a -> a.out),
        (c, base) -> aggregate(c, struct(base AS at, CAST(array() AS array<struct<start:int,end:int>>) AS out),
            (a, x) -> struct(a.at + x AS at, concat(a.out, array(struct(a.at AS start, a.at + x AS end))) AS out), a -> a.out)))))""")
    rows = docs.filter("text IS NOT NULL").select("doc_id", F.length("text").alias("n"), lengths.alias("l")).select("doc_id", "n", F.posexplode(spans).alias("line_no", "s"))
    return rows.select("doc_id", "line_no", "s.start", F.least("n", "s.end").alias("end")).filter("end > start")


def partition_check(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, whole): whether the chunks, joined in order, are the document."""
    joined = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "").alias("again"))
    return docs.join(joined, "doc_id", "left").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), (F.coalesce("again", F.lit("")) == F.col("text")).alias("whole"))


def stratified(rows: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """One row of each stratum, by a seeded hash."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), key)
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def inspected(records: DataFrame, documents: tuple[str, ...], markers: tuple[str, ...], seed: int = 0) -> DataFrame:
    """Chunk records for reading, one of each bucket by a seeded hash: block types, the named documents, and chunks whose raw text has a marker."""
    kinds = F.array(F.concat(F.lit("block_type="), "block_type"))
    docs = F.when(F.col("doc_id").isin(*documents), F.array(F.concat(F.lit("document "), "doc_id"))).otherwise(F.array().cast("array<string>"))
    marked = F.array_compact(F.array(*[F.when(F.col("text_raw").contains(m), F.lit(f"{m}> region")) for m in markers]))
    return stratified(records.withColumn("bucket", F.explode(F.concat(kinds, docs, marked))), "bucket", "id", seed)


def document_share(chunks: DataFrame, top: int = 3) -> DataFrame:
    """How much of all chunks the documents of most chunks have."""
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    largest = per.orderBy(F.desc("n"), "doc_id").limit(top).agg(F.sum("n").alias("top_chunks"))
    return per.agg(F.sum("n").alias("n_chunks")).crossJoin(largest).withColumn("share", F.round(F.col("top_chunks") / F.col("n_chunks"), 6))


def systematic(rows: DataFrame, stratum: str, key: str, size: int) -> DataFrame:
    """Every (n div size)-th row of a stratum in the order of ``key``, ``size`` at most."""
    counts = rows.groupBy(stratum).agg(F.greatest(F.lit(1), F.expr(f"count(*) div {size}")).alias("step"))
    numbered = running_total(rows, [stratum], key, F.lit(1)).join(beside(counts), stratum)
    return numbered.filter((F.col("before") % F.col("step") == 0) & (F.expr("before div step") < size)).drop("before", "step")


def density(docs: DataFrame, kind: str) -> DataFrame:
    """Characters a token by kind: mean, median, the value at a tenth of the sorted list, least; texts without tokens are left out."""
    # Held before it is filtered: three figures read it, and texts are counted once.
    counted = hold(docs.select(kind, F.length("text").alias("c"), T.token_count(F.col("text")).alias("t")))
    r = counted.filter("t > 0").select(kind, (F.col("c") / F.col("t")).alias("ratio"))
    n = F.col("n")
    at = order_statistics(r, kind, "ratio", {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "tenth": F.floor(n * 0.1)})
    plain = r.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg(F.col("ratio").cast("decimal(20,12)")).cast("double"), 6).alias("mean"), F.round(F.min("ratio"), 6).alias("least"))
    return plain.join(at, kind).select(kind, "n", "mean", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), F.round("tenth", 6).alias("p10"), "least")


def density_verdict(by_kind: DataFrame, kind: str) -> DataFrame:
    """The kind that binds, the spread of the tenths, and what to do about it."""
    v = by_kind.agg(F.min_by(kind, F.struct("p10", kind)).alias("binding"), F.min("p10").alias("p10"), F.round(F.max("p10") / F.min("p10"), 6).alias("spread"))
    verdict = F.when(F.col("spread") > 1.3, "by kind").when(F.col("p10") >= 3.5, "loose").when(F.col("p10") >= 2.5, "usual").otherwise("tight")
    return v.withColumn("verdict", verdict)


def table_rows(blocks: DataFrame, key: str) -> DataFrame:
    """(key, row, rendered, n_cells) of the data rows of table blocks (key, block)."""
    lines = F.filter(F.split("block", "\n"), lambda x: x.rlike(r"[^ \t\r\f\x0b]"))
    rows = blocks.filter(M.is_table(F.col("block"))).select(key, M.cells(F.get(lines, F.lit(0))).alias("headers"), F.posexplode(lines).alias("row", "line")).filter((F.col("row") > 0) & ~M.is_separator(F.col("line")))
    return rows.select(key, "row", M.rendered_row(F.col("headers"), M.cells(F.col("line"))).alias("rendered"), F.size(M.cells(F.col("line"))).alias("n_cells"))


def combined_offsets(pages: DataFrame, n_header: int) -> DataFrame:
    """The marker's line number of each page (n, text) in one file with, before each page, a blank line, a marker line and a blank line. Line ends at the end of a page are no lines of it."""
    body = F.regexp_replace("text", r"\n+\z", "")
    sized = pages.withColumn("n_lines", F.when(body == "", 0).otherwise(F.size(F.split(body, "\n", -1)))).withColumn("_all", F.lit(0))
    sized = running_total(sized.select("n", T.title(F.col("text")).alias("title"), "n_lines", "_all"), ["_all"], "n", F.col("n_lines") + 3)
    return sized.select("n", "title", "n_lines", (n_header + F.col("before") + 2).alias("body_line"))


def combined_lines(pages: DataFrame, header: list[str]) -> DataFrame:
    """(line_no, line) of that file: the header's lines, then each page (n, slug, text) under its marker ``@@PAGE n/N :: slug``."""
    offsets = combined_offsets(pages.select("n", "text"), len(header)).select("n", "body_line", "n_lines")
    whole = pages.agg(F.count("*").alias("n_pages"))  # one row
    marked = pages.join(offsets, "n").crossJoin(F.broadcast(whole))
    number = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(2), F.length(c.cast("string"))), F.lit("0"))
    marker = F.concat(F.lit("@@PAGE "), number(F.col("n")), F.lit("/"), F.col("n_pages").cast("string"), F.lit(" :: "), F.col("slug"))
    body = F.when(F.col("n_lines") == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("text", r"\n+\z", ""), "\n", -1))
    lines = F.concat(F.array(F.lit(""), marker, F.lit("")), body)
    rows = marked.select("body_line", F.posexplode(lines).alias("i", "line")).select((F.col("body_line") - 1 + F.col("i")).alias("line_no"), "line")
    top = pages.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(header)], "line_no long, line string")
    return top.union(rows)
