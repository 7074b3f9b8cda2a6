"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated difference of sizes.

A text is compressed with a dictionary built from good labelled texts and with one from bad ones. The difference of both sizes,
normalised by their sum, says which sort of text it is like: of the whole text, of its worst piece, and as the share of pieces that the
bad dictionary suits better. A text that repeats itself suits both dictionaries alike, so how far it compresses without one
comes on top. Logistic regression on labelled texts that built no dictionary makes a probability of these four.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.llm import common

#: At most so many labelled rows of each label are fetched to the driver, those with the smallest hash of the doc_id.
SAMPLE_ROWS = 1500
#: Of these, in the order of their hash, so many bytes of each label: whole texts, and what doesn't fit any more is left out.
SAMPLE_BYTES = 12 << 20
#: Bytes of each dictionary.
DICTIONARY_BYTES = 48 * 1024
LEVEL = 3
#: Characters of a piece. Pieces cover the whole text.
PIECE = 1000
THRESHOLD = 0.3
#: Texts without a word hold nothing worth keeping: their score.
EMPTY_SCORE = 0.0


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


@functools.lru_cache(maxsize=8)
def _compressors(good: bytes, bad: bytes):
    import zstandard as z

    make = lambda d: z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
    plain = z.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
    return make(good).compress, make(bad).compress, plain.compress


def features(text: str, good: bytes, bad: bytes) -> list[float]:
    """From compressed sizes only: normalised difference, that of the worst piece, share of pieces with a negative one, and the log of how far the text compresses by itself."""
    by_good, by_bad, plain = _compressors(good, bad)
    raw = text.encode()
    pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
    if len(pieces) > 1 and len(pieces[-1]) < PIECE // 2:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    sizes = np.array([(len(by_good(p)), len(by_bad(p))) for p in pieces], float)
    parts = (sizes[:, 1] - sizes[:, 0]) / (sizes[:, 1] + sizes[:, 0])
    g, b = sizes.sum(axis=0)
    return [float((b - g) / (b + g)), float(parts.min()), float((parts < 0).mean()), math.log(len(plain(raw)) / len(raw))]


def score(text: str | None, model: Model) -> float:
    """0 to 1, higher: label 1 is likelier. Texts without a word get ``EMPTY_SCORE``."""
    if not text or not text.strip():
        return EMPTY_SCORE
    x = (np.array(features(text, model.good, model.bad)) - model.mean) / model.scale
    x = np.clip(x, -8, 8)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ np.array(model.weights)) + model.bias))))


def fit(rows: list[tuple[str, int]]) -> Model:
    """From (text, label) rows in a fixed order: even ones build the dictionaries, odd ones calibrate."""
    import zstandard as z

    def dictionary(texts: list[str]) -> bytes:
        raw = [t.encode() for t in texts]
        pieces = [r[i : i + PIECE] for r in raw for i in range(0, len(r), PIECE)]
        try:
            return z.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
        except z.ZstdError:  # too little text to train on: it is its own dictionary
            return b"".join(raw)[-DICTIONARY_BYTES:] or b"\0" * 8

    rows = [(t, y) for t, y in rows if t and t.strip()]
    by = {y: [t for t, v in rows if v == y] for y in (0, 1)}
    good, bad = (dictionary(by[y][::2]) for y in (1, 0))
    held = [(t, y) for y in (0, 1) for t in by[y][1::2]]
    if len({y for _, y in held}) < 2:
        return Model(good, bad, (0.0,) * 4, (1.0,) * 4, (0.0,) * 4, 1.0)
    x = np.array([features(t, good, bad) for t, _ in held])
    y = np.array([v for _, v in held], float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.clip((x - mean) / scale, -8, 8)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(50):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + 0.1 * np.append(w[:-1], 0)
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return Model(good, bad, tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w[:-1])), float(w[-1]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from labelled rows that aren't held out; a bounded sample of them, the same for the same tables."""
    d = common.pick(docs, "doc_id", "text").filter("text is not null")
    y = common.pick(labels, "doc_id", "quality").filter("quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = None
    for label in (0, 1):
        part = y.filter(F.col("quality") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * sample_rows ids. Which of their texts are taken is settled by hashes and sizes, so that only those come to the driver.
    rows = d.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), F.col("quality").cast("int").alias("quality"), F.octet_length("text").alias("n"), "text")
    left, taken = {0: sample_bytes, 1: sample_bytes}, []
    for r in rows.select("h", "t", "quality", "n").distinct().orderBy("h", "t", "quality").limit(2 * sample_rows).collect():
        if r.n <= left[r.quality]:
            left[r.quality] -= r.n
            taken.append((r.h, r.t, r.quality))
    if not taken:
        return fit([])
    wanted = F.broadcast(d.sparkSession.createDataFrame(taken, "h long, t long, quality int"))
    texts = rows.join(wanted, ["h", "t", "quality"], "left_semi").groupBy("h", "t", "quality").agg(F.first("text").alias("text")).collect()
    return fit([(r.text, r.quality) for r in sorted(texts, key=lambda r: (r.h, r.text))])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. Null, empty and blank texts score 0."""
    common.python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([score(t, model) for t in batch.column(2).to_pylist()], pa.float64())], names=["doc_id", "held_out", "score"])

    rows = common.pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {common.kind(docs, 'doc_id')}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`learn`, then :func:`scored` for every row of ``docs``.

    A doc_id may be of any type that is shown as text. Null doc_ids aren't held out and get rows; repeated rows each give a row; labels that are null, not 0 or 1, or of no
    document teach nothing; with labels of one sort only every text with a word scores alike; further columns are
    ignored; an empty table gives no rows.
    """
    return scored(docs, learn(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns as they are."""
    import pyarrow.compute as pc

    model = learn(docs, labels)
    at = common.place(docs.columns, "text")
    common.python_batches(docs.sparkSession)
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.greater_equal(pa.array([score(t, model) for t in batch.column(at).to_pylist()], pa.float64()), THRESHOLD))

    return flat.mapInArrow(run, flat.schema).toDF(*docs.columns)
