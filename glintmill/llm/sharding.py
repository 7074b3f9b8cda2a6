"""Shards of bounded size by extendible hashing.

A directory is indexed by a prefix of each row's hash bits. It starts as one bucket; a bucket over the byte limit splits on
the next bit, and only such a bucket, until every bucket fits. A bucket's depth is thus the least at which its rows fit.
Sizes are summed once for cells some bits finer than the shards will be, and for every prefix of a cell's bits from these
sums; only cells that still don't fit are looked at again, with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintmill.llm import common

BYTE_LIMIT = 16 << 20
#: The limit of the registered query: so small that tables of every size split.
QUERY_LIMIT = 128 << 10
#: Bits of the hash: 48 of the doc_id, then 48 of the text, so that rows which share an id can be parted. Each half is a long.
HALF = 48
BITS = 2 * HALF
#: Bits that a pass looks at beyond what an even spread would need, and at most.
SLACK, MOST = 4, 20
#: So many rows can be tried on all their bits in one pass.
FEW = 1_000_000


def _half(c: str) -> F.Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), 1, HALF // 4), 16, 10).cast("long")


def _prefix(have: int, depth: str) -> list[F.Column]:
    """(p1, p2): the first ``depth`` bits of (c1, c2), which hold the first ``have`` bits of the hash; bits beyond are zero."""
    first, second = min(have, HALF), have - HALF
    return [F.expr(f"shiftright(c1, {first} - least({depth}, {first}))").alias("p1"), F.expr(f"IF({depth} > {HALF}, shiftright(c2, {second} - greatest({depth} - {HALF}, 0)), 0L)" if second > 0 else "0L").alias("p2")]


def _cell(depth: int) -> list[F.Column]:
    return [F.shiftright("b1", HALF - min(depth, HALF)).alias("c1"), (F.shiftright("b2", BITS - depth) if depth > HALF else F.lit(0).cast("long")).alias("c2")]


def _letters(depth) -> F.Column:
    """The first ``depth`` bits of a row's hash as text."""
    return F.concat(F.lpad(F.bin("b1"), HALF, "0"), F.lpad(F.bin("b2"), HALF, "0")).substr(F.lit(1), depth)


def shards(docs: DataFrame, byte_limit: int = BYTE_LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, shard (the bits of its bucket, "" for the whole), depth, n_bytes (of its text), shard_bytes.

    A null doc_id hashes as the empty string; null and empty texts have no bytes. Rows alike in id and text can't be parted by
    bits: where they don't fit together, at depth 96, they fill pages of the bucket, named by ``+`` and a number, and a row
    that alone is over the limit has a page of its own, the only kind of shard over the limit. Repeated rows each give a row;
    further columns are ignored; an empty table gives no rows.
    """
    if byte_limit < 1:
        raise ValueError("byte_limit must be at least 1")
    return _placed(common.materialise(_hashed(common.pick(docs, "doc_id", "text")), "hashed"), byte_limit, [])


def _hashed(docs: DataFrame, *carried: str) -> DataFrame:
    return docs.select("doc_id", _half("doc_id").alias("b1"), _half("text").alias("b2"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), *carried)


def _placed(rows: DataFrame, byte_limit: int, carried: list[str]) -> DataFrame:
    """The columns of :func:`shards`, and those of ``carried``, from hashed rows."""
    shown = lambda df: df.select("doc_id", _letters(F.col("depth")).alias("shard"), "depth", "n_bytes", "shard_bytes", *carried)
    done: list[DataFrame] = []
    low, pending = 0, rows
    while True:
        total, left = pending.groupBy(*_cell(low)).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).agg(F.max("b"), F.sum("n")).first()
        if total is None:
            break
        if low == BITS:
            done.append(_pages(pending, byte_limit, carried))
            break
        # What is left may be few rows, about an oversized one: all bits can be tried on them at once. The result is the same.
        high = BITS if low and left <= FEW else min(BITS, low + min(MOST, SLACK + math.ceil(math.log2(max(1, total / byte_limit)))))
        cells = common.materialise(pending.groupBy(*_cell(high)).agg(F.sum("n_bytes").alias("b")), "cells")
        depths = F.explode(F.sequence(F.lit(low if low == 0 else low + 1), F.lit(high))).alias("depth")
        prefixes = cells.select("*", depths).select("c1", "c2", "b", "depth", *_prefix(high, "depth"))
        sums = prefixes.groupBy("depth", "p1", "p2").agg(F.sum("b").alias("shard_bytes")).filter(F.col("shard_bytes") <= byte_limit)
        fits = prefixes.join(sums, ["depth", "p1", "p2"]).groupBy("c1", "c2").agg(F.min(F.struct("depth", "shard_bytes")).alias("at")).select("c1", "c2", "at.*")
        fits = common.materialise(fits, "directory")
        in_cells = pending.select("*", *_cell(high))
        done.append(shown(in_cells.join(common.beside(fits), ["c1", "c2"])))
        over = common.materialise(cells.join(fits, ["c1", "c2"], "left_anti").select("c1", "c2"), "oversized")
        if over.isEmpty():
            break
        pending = common.materialise(in_cells.join(common.beside(over), ["c1", "c2"], "left_semi").drop("c1", "c2"), "pending")
        low = high
    out = done[0] if done else shown(rows.withColumn("depth", F.lit(0)).withColumn("shard_bytes", F.lit(0).cast("long")))
    for more in done[1:]:
        out = out.union(more)
    return out


def _pages(rows: DataFrame, byte_limit: int, carried: list[str]) -> DataFrame:
    """Rows alike in all their bits, counted and dealt over pages that hold as many of them as fit."""
    alike = rows.groupBy("doc_id", "b1", "b2", "n_bytes").agg(F.count("*").alias("n"))
    room = F.greatest(F.lit(1), F.floor(F.lit(byte_limit) / F.greatest("n_bytes", F.lit(1)))).cast("long")
    numbered = alike.withColumn("room", room).withColumn("page", F.explode(F.expr("sequence(0L, (n - 1) div room)")))
    held = numbered.withColumn("held", F.least(F.col("room"), F.col("n") - F.col("page") * F.col("room")))
    if carried:  # each row by itself: they may differ in these columns
        w = Window.partitionBy("doc_id", "b1", "b2", "n_bytes").orderBy(F.lit(0))
        numbered = rows.withColumn("room", room).withColumn("page", F.floor((F.row_number().over(w) - 1) / F.col("room")).cast("long"))
        each = numbered.withColumn("held", F.count("*").over(Window.partitionBy("doc_id", "b1", "b2", "n_bytes", "page")))
    else:
        each = held.withColumn("_", F.explode(F.expr("sequence(1L, held)")))
    name = F.concat(_letters(F.lit(BITS)), F.lit("+"), F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10), F.lit("."), F.col("page").cast("string"))
    return each.select("doc_id", name.alias("shard"), F.lit(BITS).alias("depth"), "n_bytes", (F.col("held") * F.col("n_bytes")).alias("shard_bytes"), *carried)


def write_shards(docs: DataFrame, path: str, byte_limit: int = BYTE_LIMIT) -> DataFrame:
    """Writes ``docs`` as Parquet, a folder a shard, and returns the directory: shard, depth, rows, bytes.

    Every row is written once, with all its columns: null and repeated doc_ids as :func:`shards` places them.
    """
    if byte_limit < 1:
        raise ValueError("byte_limit must be at least 1")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(f"_c{common.place(docs.columns, n)}").alias(n) for n in ("doc_id", "text"))
    placed = common.materialise(_placed(_hashed(docs.toDF(*names).select("*", doc_id, text), *names), byte_limit, names), "placed")
    placed.select(*names, "shard").toDF(*docs.columns, "shard").repartition("shard").write.partitionBy("shard").parquet(path)
    return placed.groupBy("shard", "depth").agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, coalesce(doc_id::VARCHAR, '') AS key,
  lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT), {HALF}, '0') || lpad(bin(('0x' || substr(md5(coalesce(text, '')), 1, 12))::BIGINT), {HALF}, '0') AS bits FROM documents),
dd AS (SELECT rid, depth, substr(bits, 1, depth) AS shard, n_bytes FROM d, (SELECT unnest(range(0, {BITS + 1}))::INT AS depth)),
sums AS (SELECT *, (sum(n_bytes) OVER (PARTITION BY depth, shard))::BIGINT AS shard_bytes FROM dd),
fit AS (SELECT rid, arg_min(struct_pack(depth := depth, shard := shard, shard_bytes := shard_bytes), depth) AS best FROM sums WHERE shard_bytes <= {QUERY_LIMIT} GROUP BY rid),
paged AS (SELECT rid, bits, key, n_bytes, (row_number() OVER (PARTITION BY doc_id, bits, n_bytes ORDER BY rid) - 1) // greatest(1, {QUERY_LIMIT} // greatest(n_bytes, 1)) AS page FROM d WHERE rid NOT IN (SELECT rid FROM fit)),
pages_ AS (SELECT rid, bits || '+' || ('0x' || substr(md5(key), 1, 8))::BIGINT || '.' || page AS shard, (sum(n_bytes) OVER (PARTITION BY key, bits, n_bytes, page))::BIGINT AS shard_bytes FROM paged)
SELECT doc_id, coalesce(best.shard, p.shard) AS shard, coalesce(best.depth, {BITS}) AS depth, n_bytes, coalesce(best.shard_bytes, p.shard_bytes) AS shard_bytes FROM d LEFT JOIN fit USING (rid) LEFT JOIN pages_ p USING (rid)"""
