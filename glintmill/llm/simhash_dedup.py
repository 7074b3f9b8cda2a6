"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight bytes at eight positions. If two differ in at most four bits, at most four bytes
differ, so they share at least four positional bytes. Postings by one positional byte would pair a fixed share of all
fingerprints, so postings are kept by three positions at a time: ``TRIPLES`` is a family in which every four of the
eight positions hold a whole triple, so no pair with four shared bytes is missed. For pairs that meet in a posting list
the shared positional bytes are tallied, pairs with fewer than four are dropped, and the bits of the rest are compared.

Equal fingerprints are one entry of the index. A list emits no more links than it has entries: those that join its
entries, since components are what is asked for.

A few edits move a fingerprint of shingles by more than four bits, so :func:`without_duplicates` looks for near copies besides: a second index of the same
kind has fingerprints of 128 bits of each document's set of words, which edits hardly move, by 16 positional bytes of which five must be shared;
a third fingerprint, of 256 bits over five-word shingles, verifies a pair: its distance tells their similarity.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.llm import common
from glintmill.llm.components import connected

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Entries of a posting list that one task compares at once; longer lists are split.
BLOCK = 2048


#: Positional bytes of two word-set fingerprints that must be equal. Pairs with seven, so all that differ in at most nine bits, meet in the index for
#: certain; those with five or six do if three of these are in one class.
WORD_BYTES, WORD_SHARED = 16, 5
#: Words of a verifying shingle, and the bits of 256 in which fingerprints over them may differ. Texts of similarity 0.8, and of equal
#: length, have a cosine of 0.889; their fingerprints differ in 39 bits on average, with a deviation of 6.
PROOF_WORDS, PROOF_DISTANCE = 5, 50
#: Triples of the 16 positions within three classes: any seven positions have three in one class.
WORD_TRIPLES = [t for t in itertools.combinations(range(WORD_BYTES), 3) if len({p % 3 for p in t}) == 1]
_NEAR = [f"w{i}" for i in range(2)] + [f"s{i}" for i in range(4)]


def _triples() -> list[tuple[int, int, int]]:
    """Triples of the eight positions such that any four positions hold one.

    Positions are dealt over three classes; a triple is in the family if it lies in one class, or has two of a class and
    one of the next.
    """
    part = [p % 3 for p in range(8)]
    out = []
    for t in itertools.combinations(range(8), 3):
        counts = [sum(part[p] == c for p in t) for c in range(3)]
        if max(counts) == 3 or any(counts[c] == 2 and counts[(c + 1) % 3] == 1 for c in range(3)):
            out.append(t)
    return out


TRIPLES = _triples()


def fingerprint(text: str | None) -> int:
    """The unsigned SimHash of a text's 4-word shingles; zero if it has no word."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII space characters only
    if not words:
        return 0
    of = xxhash.xxh64_intdigest
    if len(words) < SHINGLE_WORDS:
        hashes = [of(b" ".join(words), SEED)]
    else:
        hashes = [of(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)]
    counts = np.zeros(64, np.int64)
    array = np.array(hashes, "<u8")
    for at in range(0, len(array), 1 << 16):
        counts += np.unpackbits(array[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Of rows of hashes, as longs: the bits that are set in over half of them."""
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(np.ascontiguousarray(hashes[at : at + (1 << 14)]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def near_prints(text: str | None) -> np.ndarray:
    """Six longs: two of the fingerprint of a text's set of words, four of that of its five-word shingles, repeats included; zeros without a word."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(6, np.uint64)
    of = xxhash.xxh3_128_digest
    sets = np.frombuffer(b"".join([of(w, SEED) for w in set(words)]), "<u8").reshape(-1, 2)
    shingles = [b" ".join(words)] if len(words) < PROOF_WORDS else [b" ".join(s) for s in zip(*(words[i:] for i in range(PROOF_WORDS)), strict=False)]
    first = np.frombuffer(b"".join([of(s, SEED) for s in shingles]), "<u8").reshape(-1, 2)
    mixed = (first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)  # other bits of the same hashes
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate([_majority(sets), _majority(np.hstack([first, mixed ^ (mixed >> np.uint64(32))]))])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) per row; the unsigned fingerprint's bits as a signed long."""
    docs = common.pick(docs, "doc_id", "text").withColumns({n: F.lit(0).cast("long") for n in "ab"})
    return _keyed_prints(docs, F.col("doc_id"), F.col("text"), near=False).select("doc_id", "fp")


def joining(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a posting list's entries link: within ``a``, or between ``a`` and ``b``.

    Of all linked pairs only those are kept that join two groups not yet joined.
    """
    other = a if b is None else b
    root = list(range(len(a) + (0 if b is None else len(b))))
    shift = 0 if b is None else len(a)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = [], []
    apart = other.view(np.uint8).reshape(-1, 8)
    for i in range(len(a)):
        start = i + 1 if b is None else 0
        if start >= len(other):
            continue
        shared = (apart[start:] == a[i : i + 1].view(np.uint8)).sum(axis=1)
        near = np.flatnonzero(shared >= 8 - RADIUS) + start
        near = near[np.bitwise_count(other[near] ^ a[i]) <= RADIUS]
        for j in near:
            x, y = top(i), top(int(j) + shift)
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(a[i])
                right.append(other[j])
    return np.array(left, np.uint64), np.array(right, np.uint64)


def joining_near(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`joining`, for entries (fp, then the six longs of :func:`near_prints`): the fps of the links."""
    other = a if b is None else b
    group = np.arange(len(a) + (0 if b is None else len(b)))
    shift = 0 if b is None else len(a)
    own, apart = (np.ascontiguousarray(x[:, 1:3]).view(np.uint8).reshape(-1, WORD_BYTES) for x in (a, other))
    left, right = [], []
    for i in range(len(a)):
        rest = np.flatnonzero(group[shift:] != group[i])
        rest = rest[rest > i] if b is None else rest
        rest = rest[(apart[rest] == own[i]).sum(axis=1) >= WORD_SHARED]
        rest = rest[np.bitwise_count(other[rest, 3:] ^ a[i, 3:]).sum(axis=1) <= PROOF_DISTANCE]
        for j in rest:
            if group[j + shift] != group[i]:
                group[group == group[j + shift]] = group[i]
                left.append(a[i, 0])
                right.append(other[j, 0])
    return np.array(left, np.uint64), np.array(right, np.uint64)


def _links(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, side, fp, more), sorted so that a list's rows follow each other: the joining links of each list."""
    held: list[np.ndarray] = []
    key = None

    def emit(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        rows = np.concatenate(parts)
        if len(rows) < 2:
            return None
        side, entries = rows[:, 0], np.ascontiguousarray(rows[:, 1:]).view(np.uint64)
        join, entries = (joining, entries[:, 0]) if entries.shape[1] == 1 else (joining_near, entries)
        return join(entries[side == 0], entries[side == 1] if (side == 1).any() else None) if (side == 0).any() else None

    out: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        left = np.concatenate([x for x, _ in out]) if out else np.array([], np.uint64)
        right = np.concatenate([y for _, y in out]) if out else np.array([], np.uint64)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(left.astype(np.uint64).view(np.int64)), pa.array(right.astype(np.uint64).view(np.int64))], names=["u", "v"])

    for batch in rows:
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        values = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(2, batch.num_columns)], axis=1)
        if not len(keys):
            continue
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(keys)]
        for start, end in zip(starts, ends, strict=True):
            this = (int(keys[start, 0]), int(keys[start, 1]))
            if this != key:
                if sum(map(len, held)) > 1 and (found := emit(held)) is not None and len(found[0]):
                    out.append(found)
                held, key = [], this
            held.append(values[start:end])
        yield flush()
    if sum(map(len, held)) > 1 and (found := emit(held)) is not None and len(found[0]):
        out.append(found)
    yield flush()


def linked(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between different fingerprints of ``prints`` (fp, distinct), enough to join all that are linked.

    A list of over ``block`` entries is split by what its linked pairs must share beside the three bytes: a fourth byte, at one of the other
    five positions; a list that is still too long, by one of five parts of the bits of the four bytes left, since at most four of
    these bits differ; and one that is too long even then into pairs of blocks.
    """
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(n << 24).bitwiseOR(F.shiftleft(byte(a), 16)).bitwiseOR(F.shiftleft(byte(b), 8)).bitwiseOR(byte(c)) for n, (a, b, c) in enumerate(TRIPLES)]
    index = prints.select("fp", F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"))
    others = ", ".join(f"array({', '.join(str(p) for p in range(8) if p not in t)})" for t in TRIPLES)
    fourth = "transform(array({0})[CAST(shiftright(key, 24) AS int)], p -> key * 2048 + p * 256 + (shiftrightunsigned(fp, 8 * p) & 255L))".format(others)
    rest = "aggregate(filter(array({0})[CAST(shiftright(key, 35) AS int)], p -> p <> (shiftright(key, 8) & 7)), 0L, (a, p) -> a * 256 + (shiftrightunsigned(fp, 8 * p) & 255L))".format(others)
    parts = ", ".join(f"key * 640 + {128 * i} + (shiftrightunsigned({rest}, {shift}) & {(1 << bits) - 1}L)" for i, (shift, bits) in enumerate(((25, 7), (18, 7), (12, 6), (6, 6), (0, 6))))
    plain = None
    for level, split in enumerate((fourth, f"array({parts})", None)):
        long = index.groupBy("key").count().filter(F.col("count") > block)
        long = common.materialise(long.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "long-lists")
        some = not long.isEmpty()
        short = (index.join(long, "key", "left_anti") if some else index).select("key", F.lit(-level).alias("part"), F.lit(0).alias("side"), "fp")
        plain = short if plain is None else plain.union(short)
        if not some:
            break
        index = index.join(long, "key")
        if split:
            index = common.materialise(index.select("fp", F.explode(F.expr(split)).alias("key")), "split-lists")
            continue
        plain = plain.union(_pairs_of_blocks(index, "fp"))
    return plain.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_links, "u long, v long")


def _pairs_of_blocks(entries: DataFrame, *carried: str) -> DataFrame:
    """Entries of long lists (key, blocks) dealt over blocks; each pair of blocks, and each block by itself, is a part."""
    dealt = entries.withColumn("b", F.pmod(F.xxhash64(*carried), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    part = (F.least("b", "o") * F.col("blocks") + F.greatest("b", "o") + 1).alias("part")
    return dealt.select("key", *carried, "b", "blocks", other).select("key", part, (F.col("b") > F.col("o")).cast("int").alias("side"), *carried)


def near_copies(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between the fps of near copies, enough to join all; ``prints`` (fp, w0, w1, s0 to s3) are those of texts with words, distinct.

    A list of over ``block`` entries, which only very many different near copies make, is compared by pairs of blocks; within one, entries that are joined
    already aren't compared.
    """
    byte = lambda p: F.shiftrightunsigned(f"w{p // 8}", 8 * (p % 8)).bitwiseAND(F.lit(255))
    keys = [F.lit(n << 24).bitwiseOR(F.shiftleft(byte(a), 16)).bitwiseOR(F.shiftleft(byte(b), 8)).bitwiseOR(byte(c)) for n, (a, b, c) in enumerate(WORD_TRIPLES)]
    index = prints.select("fp", *_NEAR, F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"))
    long = index.groupBy("key").count().filter(F.col("count") > block)
    long = common.materialise(long.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "long-lists")
    some = not long.isEmpty()
    plain = (index.join(common.beside(long), "key", "left_anti") if some else index).select("key", F.lit(0).alias("part"), F.lit(0).alias("side"), "fp", *_NEAR)
    if some:
        plain = plain.union(_pairs_of_blocks(index.join(common.beside(long), "key"), "fp", *_NEAR))
    return plain.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_links, "u long, v long").filter("u <> v")


def _components(rows: DataFrame, near: bool = False) -> DataFrame:
    """(fp, root) of every fingerprint in ``rows``; root is one fingerprint of its component. With ``near`` near copies are linked too."""
    prints = common.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    links = linked(prints.select("fp"))
    if near:
        links = links.union(near_copies(rows.filter("w0 <> 0 OR w1 <> 0").select("fp", *_NEAR).distinct()))
    roots = connected(links)
    return prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Null, empty and blank texts have fingerprint zero and are linked like any other. A doc_id may be of any type with an order. A null doc_id keeps its row, and
    takes part in links, but is no component's id unless all ids of it are null. Repeated rows each give a row; further
    columns are ignored; an empty table gives no rows.
    """
    rows = common.materialise(fingerprints(docs), "prints")
    named = _components(rows)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(ids, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id, null ids last.

    Groups are joined by links of fingerprints, as in :func:`near_duplicates`, and by those of near copies: word sets whose fingerprints share at least five
    positional bytes, three of them in a class, five-word shingles whose fingerprints tell a similarity of about 0.8 or more. Of rows that share an id the one with the smaller hash of its text stays, of wholly repeated rows any one. All columns
    are kept as they are. An empty table gives no rows.
    """
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"_c{common.place(names, n)}") for n in ("doc_id", "text"))
    flat = flat.select("*", common.text_key(doc_id, F.coalesce(text, F.lit(""))).alias("_row")).select("*", "_row.a", "_row.b").drop("_row")
    rows = common.materialise(_keyed_prints(flat, doc_id, text), "prints")
    named = _components(rows, near=True)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "a", "b"))
    by_print = rows.groupBy("fp").agg(best.alias("best"))
    by_root = by_print.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best"))
    keep = common.materialise(by_root.select("best.a", "best.b"), "kept")
    times = rows.join(keep, ["a", "b"], "left_semi").groupBy("a", "b").count().filter("count > 1").select("a", "b")
    times = common.materialise(times, "repeated")
    kept = flat.join(keep, ["a", "b"], "left_semi")
    if not times.isEmpty():
        times = common.beside(times)
        kept = kept.join(times, ["a", "b"], "left_anti").unionByName(kept.join(times, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]))
    return kept.drop("a", "b").toDF(*names)


def _keyed_prints(flat: DataFrame, doc_id, text, near: bool = True) -> DataFrame:
    """(doc_id, a, b, fp, and with ``near`` the longs of :func:`near_prints`): a and b are the row's key, hashes of the id and the text."""
    common.python_batches(flat.sparkSession)
    longs = ["fp", *_NEAR] if near else ["fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            prints = np.array([fingerprint(t) for t in texts], np.uint64).reshape(-1, 1)
            if near:
                prints = np.hstack([prints, np.array([near_prints(t) for t in texts], np.uint64).reshape(-1, len(_NEAR))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(np.ascontiguousarray(c).view(np.int64), pa.int64()) for c in prints.T)], names=["doc_id", "a", "b", *longs])

    return flat.select(doc_id.alias("doc_id"), "a", "b", text.alias("text")).mapInArrow(run, f"doc_id {common.kind(flat.select(doc_id.alias('doc_id')), 'doc_id')}, a long, b long, " + ", ".join(f"{n} long" for n in longs))
