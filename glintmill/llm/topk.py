"""Exact top-k inner products by a pivot-distance index.

Vectors get one more coordinate that makes all norms equal, so that the largest inner product is the nearest vector. Each is
keyed by its nearest pivot and its distance to it; sorted by this key they are cut into blocks, each an annulus around a pivot.
Queries are cut into blocks the same way. A query's k-th best score so far is a radius: a vector whose distance to a pivot
differs from the query's by more than the radius can't be among the best, by the triangle inequality.

Annuli are visited outwards: first those around a query's own pivot at its own distance, whose scores tighten the radius; then,
around every pivot, those that the radius still reaches. The test of reach is part of the join's condition, so annuli beyond it
are never sent to a scorer, and of an annulus that is sent only the part within the radius is scored. Blocks have a bounded number of
vectors whatever the key, so a vector that occurs very often fills many of them. Vectors much longer than those of the sample would
stretch the coordinate that evens out the norms; they are kept apart, and always scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintmill.llm import common

PIVOTS = 32
#: The pivots, and the vectors that give each query its first radius, are a sample of so many rows of the smallest hash, and of so many bytes.
SAMPLE, SAMPLE_BYTES = 512, 8 << 20
BLOCK, QUERIES = 2048, 512
#: Query blocks that are broadcast at once, in bytes; more go in further waves over the index.
WAVE_BYTES = 32 << 20
SCALE = 256
#: Stands for a null id within a block, after all others.
NO_ID = (1 << 63) - 1
_LOWEST = -(1 << 63)
_BLOCK_SCHEMA = "dim int, pivot int, low double, high double, ids binary, dist binary, vectors binary"
_QUERY_SCHEMA = "dim int, pivot int, low double, high double, ids binary, vectors binary, floors binary"
_FOUND_SCHEMA = "block long, at int, query_id long, vec_id long, score long"


def quantised(embeddings: DataFrame, *more: str) -> DataFrame:
    """(vec_id, v array<double>, more): floor(256 * x) of each component; vectors that are null or hold null or non-finite ones go."""
    e = common.pick(embeddings, "vec_id", "embedding", *more).filter("embedding is not null")
    x = f"({SCALE}D * CAST(x AS DOUBLE))"
    e = e.filter(f"forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs({x}) < double('infinity'))")
    # From 2**53 on every double is a whole number, and may be beyond a long.
    return e.select("vec_id", F.expr(f"transform(embedding, x -> IF(abs({x}) < 9007199254740992D, CAST(floor({x}) AS DOUBLE), {x}))").alias("v"), *more)


def _matrix(column: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    at = (ends[rows] - dim)[:, None] + np.arange(dim)[None, :]
    return flat[at].astype(np.float64) if dim else np.zeros((len(rows), 0))


def _by_dim(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        yield int(dim), np.flatnonzero(sizes == dim)


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v**2).sum(axis=1))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of whole numbers, as longs; one beyond the range of a long counts as the nearest long.

    In doubles where no partial sum can reach 2**53, which the rows' norms tell; rows too long for that go by themselves, in whole numbers of
    any size.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    long_a, long_b = _norms(a), _norms(b)
    if long_a.max() * long_b.max() * (1 + 1e-9) < 2**53:
        return (a @ b.T).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    easy_b = long_b * long_a.max() * (1 + 1e-9) < 2**53
    if easy_b.any():
        out[:, easy_b] = (a @ b[easy_b].T).astype(np.int64)
    hard = np.flatnonzero(~easy_b)
    easy_a = long_a * long_b[hard].max() * (1 + 1e-9) < 2**53
    if easy_a.any():
        out[np.ix_(easy_a, hard)] = (a[easy_a] @ b[hard].T).astype(np.int64)
    whole = [[int(x) for x in b[j]] for j in hard]
    for i in np.flatnonzero(~easy_a):
        row = [int(x) for x in a[i]]
        out[i, hard] = [max(_LOWEST + 1, min(NO_ID, sum(x * y for x, y in zip(row, w, strict=True)))) for w in whole]
    return out


def _floors(scores: np.ndarray) -> np.ndarray:
    """What scores tell of the radius: nothing where they are the least long, which stands for none and for all below it."""
    return np.where(scores <= _LOWEST + 1, -np.inf, scores.astype(float))


class Index:
    """What every task knows of the index: the sample, its pivots, and by length of vectors the norm that all are stretched to."""

    def __init__(self, sample: list[tuple[int | None, list[float]]]):
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(v) for _, v in sample}:
            own = [(i, v) for i, v in sample if len(v) == dim]
            self.known[dim] = np.array([NO_ID if i is None else i for i, _ in own], np.int64), np.array([v for _, v in own], float).reshape(len(own), dim)

    def pivots(self, dim: int) -> np.ndarray:
        return self.known[dim][1][:PIVOTS] if dim in self.known else np.zeros((1, dim))

    def most(self, dim: int) -> float:
        """The square of the norm that vectors are stretched to; longer ones are kept apart."""
        return 4.0 * float((self.known[dim][1] ** 2).sum(axis=1).max()) if dim in self.known and dim else 0.0

    def _spare(self, v: np.ndarray, dim: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.most(dim) - (v**2).sum(axis=1)))

    def distances(self, v: np.ndarray, dim: int, query: bool) -> np.ndarray:
        """Of rows to pivots, with the coordinate that evens out the norms; a query's is 0."""
        p = self.pivots(dim)
        more = np.zeros(len(v)) if query else self._spare(v, dim)
        square = (v**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * (v @ p.T) + (more[:, None] - self._spare(p, dim)[None, :]) ** 2
        return np.sqrt(np.maximum(square, 0.0))

    def radius(self, v: np.ndarray, dim: int, floors: np.ndarray) -> np.ndarray:
        """How far a vector of at least the score ``floors`` can be: score = (most + |q|^2 - distance^2) / 2."""
        square = (v**2).sum(axis=1)
        slack = 1e-6 * (self.most(dim) + square) + 1e-3
        return np.where(np.isinf(floors), np.inf, np.sqrt(np.maximum(0.0, self.most(dim) + square - 2 * np.where(np.isinf(floors), 0.0, floors) + slack)))

    def first_floors(self, ids: np.ndarray, v: np.ndarray, dim: int, k: int) -> np.ndarray:
        """Sampled rows are rows of the table: at least k others score as much as this."""
        if dim not in self.known or len(self.known[dim][0]) <= k:
            return np.full(len(ids), -np.inf)
        s = _floors(dots(v, self.known[dim][1]))
        s[ids[:, None] == self.known[dim][0][None, :]] = -np.inf
        return np.sort(s, axis=1)[:, -k]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def top_k(embeddings: DataFrame, queries: F.Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose row fulfils ``queries``, the k others of the highest score.

    ``queries`` may use any column of ``embeddings``. Ties go to the smaller vec_id. A query with fewer than k others gets all.
    Vectors that are null, or hold null or non-finite components, take no part; vectors of different lengths aren't compared. A row
    without an id is a candidate, after others of its score, but no query. Of rows with one id every distinct one is a candidate and
    a query, not for each other. Components may be of any size whose 256-fold is finite; a score beyond the range of a long counts as the
    nearest long. Further columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    common.python_batches(spark)
    flat = embeddings.select("*", F.coalesce(queries, F.lit(False)).alias("_asked"))
    data = common.materialise(quantised(flat, "_asked").distinct(), "vectors")
    widest = data.agg(F.max(F.size("v"))).first()[0] or 1
    size = max(k + 1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, widest))))
    index = Index([(r.vec_id, r.v) for r in data.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(size).select("vec_id", "v").collect()])  # bounded

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pivot, dist, sizes = np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int32)
            for dim, rows in _by_dim(batch, 1):
                v = _matrix(batch.column(1), rows, dim)
                d = index.distances(v, dim, False)
                far = (v**2).sum(axis=1) > index.most(dim)
                pivot[rows], dist[rows], sizes[rows] = np.where(far, -1, d.argmin(axis=1)), np.where(far, 0.0, d.min(axis=1)), dim
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes), pa.array(pivot), pa.array(dist)], names=["vec_id", "v", "asked", "dim", "pivot", "dist"])

    def cut(most: int, make):
        """Sorted rows (vec_id, v, dim, pivot, dist) as blocks of at most ``most`` rows of one key; ``make`` gives a block's last columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, float, np.ndarray]] = []
            key = None

            def flush() -> pa.RecordBatch:
                ids, dist = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held])
                v = np.array([h[2] for h in held], float).reshape(len(held), key[0])
                held.clear()
                names, columns = zip(*make(key[0], ids, dist, v), strict=True)
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *columns], names=["dim", "pivot", *names])

            for batch in batches:
                for i, dim, pivot, dist, v in zip(_ids(batch.column(0)), *(batch.column(c).to_pylist() for c in (2, 3, 4)), batch.column(1), strict=True):
                    if held and ((dim, pivot) != key or len(held) == most):
                        yield flush()
                    key = (dim, pivot)
                    held.append((i, dist, v.values.to_numpy(zero_copy_only=False)))
            if held:
                yield flush()

        return run

    def raw(*named: tuple[str, np.ndarray]) -> list:
        return [(n, pa.array([x.tobytes()], pa.binary())) for n, x in named]

    def annulus(dim: int, ids: np.ndarray, dist: np.ndarray, v: np.ndarray) -> list:
        return [("low", pa.array([float(dist[0])])), ("high", pa.array([float(dist[-1])])), *raw(("ids", ids), ("dist", dist), ("vectors", v))]

    def asking(dim: int, ids: np.ndarray, dist: np.ndarray, v: np.ndarray) -> list:
        d = index.distances(v, dim, True).min(axis=1)
        return [("low", pa.array([float(d.min())])), ("high", pa.array([float(d.max())])), *raw(("ids", ids), ("vectors", v), ("floors", index.first_floors(ids, v, dim, k)))]

    vectors = common.materialise(data.select("vec_id", "v", "_asked").mapInArrow(keyed, "vec_id long, v array<double>, asked boolean, dim int, pivot int, dist double"), "keyed")
    rows = vectors.select("vec_id", "v", "dim", "pivot", "dist")
    annuli = common.materialise(rows.repartitionByRange("dim", "pivot", "dist", "vec_id").sortWithinPartitions("dim", "pivot", "dist", "vec_id").mapInArrow(cut(BLOCK, annulus), _BLOCK_SCHEMA), "annuli")

    # Queries have no coordinate that evens out, so their nearest pivot is another one than as a candidate.
    def own_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, dist = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim, at in _by_dim(batch, 1):
                d = index.distances(_matrix(batch.column(1), at, dim), dim, True)
                pivot[at], dist[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(pivot), pa.array(dist)], names=["vec_id", "v", "dim", "pivot", "dist"])

    asked = vectors.filter("asked AND vec_id IS NOT NULL").select("vec_id", "v", "dim").mapInArrow(own_pivot, "vec_id long, v array<double>, dim int, pivot int, dist double")
    asked = asked.repartitionByRange("dim", "pivot", "dist", "vec_id").sortWithinPartitions("dim", "pivot", "dist", "vec_id").mapInArrow(cut(QUERIES, asking), _QUERY_SCHEMA)
    asked = common.materialise(asked.withColumn("block", F.monotonically_increasing_id()), "asked")
    waves = math.ceil((asked.agg(F.sum(F.octet_length("vectors") + 3 * F.octet_length("ids"))).first()[0] or 0) / WAVE_BYTES)
    found = None
    for wave in range(waves):
        part = _wave(annuli, asked.filter(F.pmod(F.xxhash64("block"), F.lit(waves)) == wave), index, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("block", "at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _wave(annuli: DataFrame, asked: DataFrame, index: Index, k: int) -> DataFrame:
    """The best of the query blocks ``asked``, few enough to be broadcast, from all annuli: first from those at home, then from those in reach."""
    x = annuli.select(F.col("dim").alias("x_dim"), "pivot", F.col("low").alias("x_low"), F.col("high").alias("x_high"), F.col("ids").alias("x_ids"), "dist", F.col("vectors").alias("x"))
    q = asked.withColumnRenamed("pivot", "home")
    at_home = "x_dim = dim AND pivot = home AND x_low <= high AND x_high >= low"
    sent = ("block", "dim", "ids", "vectors", "floors", "pivot", "x_ids", "dist", "x")
    near = common.materialise(x.join(F.broadcast(q), F.expr(at_home)).select(*sent).mapInArrow(_scorer(index, k), _FOUND_SCHEMA), "near")
    w = Window.partitionBy("block", "at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    kth = near.withColumn("n", F.row_number().over(w)).filter(F.col("n") == k).groupBy("block").agg(F.collect_list(F.struct("at", "score")).alias("kth"))  # a query block is bounded

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, new = [], [], []
            for dim, ids, vectors, floors, better in zip(*(batch.column(c).to_pylist() for c in range(2, 7)), strict=True):
                f = np.frombuffer(floors).copy()
                for b in better or ():
                    f[b["at"]] = max(f[b["at"]], float(_floors(np.int64(b["score"]))))
                v = np.frombuffer(vectors).reshape(len(ids) // 8, dim)
                d, r = index.distances(v, dim, True), index.radius(v, dim, f)[:, None]
                low.append((d - r).min(axis=0).tolist())
                high.append((d + r).max(axis=0).tolist())
                new.append(f.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 2, 3, 4, 7, 8)), pa.array(new, pa.binary()), pa.array(low, pa.list_(pa.float64())), pa.array(high, pa.list_(pa.float64()))],
                                             names=["block", "home", "dim", "ids", "vectors", "low", "high", "floors", "lows", "highs"])

    reach = q.join(kth, "block", "left").select("block", "home", "dim", "ids", "vectors", "floors", "kth", "low", "high").mapInArrow(
        reaching, "block long, home int, dim int, ids binary, vectors binary, low double, high double, floors binary, lows array<double>, highs array<double>")
    reach = common.materialise(reach, "reach")
    in_reach = f"x_dim = dim AND (pivot < 0 OR (x_high >= get(lows, pivot) AND x_low <= get(highs, pivot))) AND NOT ({at_home})"
    more = x.join(F.broadcast(reach), F.expr(in_reach)).select(*sent).mapInArrow(_scorer(index, k), _FOUND_SCHEMA)
    return near.unionByName(common.materialise(more, "further"))


def _scorer(index: Index, k: int):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}  # by query block: ids, vectors, k best scores and their ids, floors, distances
        for batch in batches:
            for r in range(batch.num_rows):
                block, dim, ids, vectors, floors, pivot, x_ids, dist, x = (batch.column(c)[r].as_py() for c in range(9))
                if block not in best:
                    if len(best) >= 64:
                        first = next(iter(best))
                        yield _found(first, best.pop(first))
                    q_ids = np.frombuffer(ids, np.int64)
                    v = np.frombuffer(vectors).reshape(len(q_ids), dim)
                    best[block] = [q_ids, v, np.zeros((len(q_ids), 0), np.int64), np.zeros((len(q_ids), 0), np.int64), np.frombuffer(floors), index.distances(v, dim, True)]
                state = best[block]
                q_ids, q, top, top_ids, floor, q_dist = state
                if top.shape[1] == k:
                    floor = np.maximum(floor, _floors(top[:, -1]))
                dist, x_ids = np.frombuffer(dist), np.frombuffer(x_ids, np.int64)
                if pivot < 0:
                    live, a, b = np.arange(len(q_ids)), 0, len(x_ids)
                else:
                    radius = index.radius(q, dim, floor)
                    left = np.searchsorted(dist, q_dist[:, pivot] - radius, "left")
                    right = np.searchsorted(dist, q_dist[:, pivot] + radius, "right")
                    live = np.flatnonzero(left < right)
                    if not len(live):
                        continue
                    a, b = int(left[live].min()), int(right[live].max())
                s = dots(q[live], np.frombuffer(x).reshape(len(x_ids), dim)[a:b])
                merged_s = np.hstack([top[live], s])
                merged_i = np.hstack([top_ids[live], np.broadcast_to(x_ids[a:b], s.shape)])
                own = np.hstack([np.zeros(top[live].shape, bool), x_ids[a:b][None, :] == q_ids[live][:, None]])
                _merge(state, live, merged_s, merged_i, own, k)
        for block, state in best.items():
            yield _found(block, state)

    return scores


def _merge(state: list, live: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> None:
    """Keeps the k best of each live query: by score, then by smaller id. Own rows and empty places hold the least long."""
    scores = np.where(own, _LOWEST, scores)
    width = min(k, scores.shape[1])
    order = np.lexsort((ids, np.negative(np.maximum(scores, _LOWEST + 1)), scores == _LOWEST), axis=1)[:, :width]
    s, i = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
    top, top_ids = state[2], state[3]
    if top.shape[1] < width:
        more = width - top.shape[1]
        top = np.hstack([top, np.full((len(top), more), _LOWEST, np.int64)])
        top_ids = np.hstack([top_ids, np.full((len(top), more), NO_ID, np.int64)])
    if s.shape[1] < top.shape[1]:
        more = top.shape[1] - s.shape[1]
        s, i = np.hstack([s, np.full((len(s), more), _LOWEST, np.int64)]), np.hstack([i, np.full((len(i), more), NO_ID, np.int64)])
    top[live], top_ids[live] = s, i
    state[2], state[3] = top, top_ids


def _found(block: int, state: list) -> pa.RecordBatch:
    q_ids, _, top, top_ids = state[:4]
    rows, cols = np.nonzero(top != _LOWEST)
    ids = top_ids[rows, cols]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block, np.int64)), pa.array(rows.astype(np.int32)), pa.array(q_ids[rows]), pa.array(ids, mask=ids == NO_ID), pa.array(top[rows, cols])],
                                      names=["block", "at", "query_id", "vec_id", "score"])


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
