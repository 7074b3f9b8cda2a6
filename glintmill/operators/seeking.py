"""Few questions, looked for in every text as it is read, not question by question.

Passages are looked for by eight bytes of each, at all places of many texts at once. Sets of keys are looked for by the runs of ASCII letters and
digits that a text has: it is taken apart once, and a set costs a look at its own runs, and a search only where these are found. So the work grows
with the texts. Texts are compared as bytes of UTF-8. Nothing but hits leaves a task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glintmill.operators.wordwise import parts
from glintmill.sources.tables import small_batches

#: Runs whose keys a task remembers, and how long such a run may be.
REMEMBERED, SHORT = 200_000, 64
#: First bytes of keys that are compared at once.
HEAD = 3
_RUN = re.compile(rb"[A-Za-z0-9]+")
#: Bytes of runs as they are, spaces for others.
_APART = bytes(c if _RUN.match(bytes([c])) else 32 for c in range(256))


#: Bytes by which a passage is looked for, bits of the table of these, and a factor that spreads them.
WINDOW, BITS, SPREAD = 8, 18, np.uint64(0x9E3779B97F4A7C15)


def _spread(windows: np.ndarray) -> np.ndarray:
    return (windows * SPREAD) >> np.uint64(64 - BITS)


class Passages:
    """Texts that are looked for as they are; an empty one is in none."""

    def __init__(self, passages: list[bytes]) -> None:
        self.at: dict[bytes, list[tuple[int, int, bytes]]] = {}
        self.bare = [(i, p) for i, p in enumerate(passages) if 0 < len(p) < WINDOW]
        usual = Counter(p[a : a + 4] for p in passages for a in range(len(p) - 3))
        for i, p in enumerate(passages):
            if len(p) >= WINDOW:  # by the bytes that are least like those of the others; any would do
                a = min(range(len(p) - WINDOW + 1), key=lambda a: usual[p[a : a + 4]] + usual[p[a + 4 : a + 8]])
                self.at.setdefault(p[a : a + WINDOW], []).append((i, a, p))
        self.table = np.zeros(1 << BITS, dtype=bool)
        self.table[_spread(np.frombuffer(b"".join(self.at), "<u8"))] = True

    def finder(self) -> Callable[[bytes], list[int]]:
        return lambda text: [i for i, _ in self.found(text, np.array([0, len(text)]))]

    def found(self, data: bytes, bounds: np.ndarray) -> list[tuple[int, int]]:
        """(passage, text) of what is in texts that lie one after another."""
        out = set()
        for shift in range(WINDOW if self.at else 0):
            n = (len(data) - shift) // WINDOW
            if n <= 0:
                break
            hits = np.flatnonzero(self.table[_spread(np.frombuffer(data, "<u8", n, shift))]) * WINDOW + shift
            for here, row in zip(hits.tolist(), (np.searchsorted(bounds, hits, side="right") - 1).tolist(), strict=True):
                for i, a, p in self.at.get(data[here : here + WINDOW], ()):
                    if here - a >= bounds[row] and here - a + len(p) <= bounds[row + 1] and data.startswith(p, here - a):
                        out.add((i, row))
        for i, p in self.bare:
            out.update((i, row) for row in range(len(bounds) - 1) if data.find(p, bounds[row], bounds[row + 1]) >= 0)
        return sorted(out)


class _Within(dict):
    """The places of the keys that are part of a run, remembered."""

    def __init__(self, places: dict[bytes, int]) -> None:
        super().__init__()
        self.places, self.heads = places, {}
        for k, i in places.items():  # by their first bytes
            self.heads.setdefault(len(k[:HEAD]), {}).setdefault(k[:HEAD], []).append((k, i))

    def __missing__(self, run: bytes) -> tuple[int, ...]:
        if len(run) > SHORT:
            return tuple(i for k, i in self.places.items() if k in run)
        if len(self) >= REMEMBERED:
            self.clear()
        out = []
        for n, heads in self.heads.items():
            for a in range(len(run) - n + 1):
                keys = heads.get(run[a : a + n])
                if keys:
                    out += [i for k, i in keys if run.startswith(k, a)]
        self[run] = out = tuple(out)
        return out


class KeySets:
    """Sets of lower-case keys that are looked for in lower-case texts, all of a set; an empty one is in none."""

    def __init__(self, sets: list[list[bytes]]) -> None:
        plain = lambda k: _RUN.fullmatch(k) is not None
        self.places = {k: i for i, k in enumerate(sorted({k for s in sets for k in s if plain(k)}))}
        self.by_key: dict[int, list[tuple[int, set[int], list[bytes]]]] = {}
        self.bare: list[tuple[int, list[bytes]]] = []
        for i, s in enumerate(sets):
            inner, others = [k for k in s if plain(k)], [k for k in s if not plain(k)]
            if inner:
                self.by_key.setdefault(self.places[max(inner, key=lambda r: (len(r), r))], []).append((i, {self.places[k] for k in inner}, others))
            elif others:
                self.bare.append((i, others))

    def finder(self) -> Callable[[bytes], list[int]]:
        within = _Within(self.places)

        def found(text: bytes) -> list[int]:
            held = set().union(*map(within.__getitem__, set(text.translate(_APART).split())))
            out = [i for k in self.by_key.keys() & held for i, inner, others in self.by_key[k] if inner <= held and all(o in text for o in others)]
            return out + [i for i, others in self.bare if all(o in text for o in others)]

        return found


def _sought(docs: DataFrame, text, ids: list, item: str, id_type, sought: Passages | KeySets) -> DataFrame:
    """(``item``, doc_id) of what is found in ``text``; ``ids`` are those of ``sought``."""
    small_batches(docs.sparkSession)
    arrow, doc_type = to_arrow_type(id_type), docs.schema["doc_id"].dataType
    sent = docs.sparkSession.sparkContext.broadcast((ids, sought))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sought = sent.value
        items, find = pa.array(ids, arrow), sought.finder()
        for batch in batches:
            if isinstance(sought, Passages):  # in null there is none, as it has no bytes
                bounds, data = parts(batch.column(1).fill_null(b""))
                hits = sought.found(bytes(data), bounds)
            else:
                hits = [(i, row) for row, t in enumerate(batch.column(1)) if t.is_valid for i in find(t.as_py())]
            if hits:
                which, rows = (pa.array(x, pa.int64()) for x in zip(*hits, strict=True))
                yield pa.RecordBatch.from_arrays([items.take(which), batch.column(0).take(rows)], names=[item, "doc_id"])

    return docs.select("doc_id", text.cast("binary").alias("text")).mapInArrow(run, f"{item} {id_type.simpleString()}, doc_id {doc_type.simpleString()}").distinct()


def containing(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents whose text contains that of a question (item_id, question)."""
    rows = questions.select("item_id", F.col("question").cast("binary").alias("q")).filter("q IS NOT NULL").collect()
    passages = Passages([bytes(r.q) for r in rows])
    return _sought(docs, F.col("text"), [r.item_id for r in rows], "item_id", questions.schema["item_id"].dataType, passages)


def holding_all(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, doc_id): documents whose text, in lower case, holds every key of a set (id, keys), which are lower case."""
    rows = sets.select("id", F.transform("keys", lambda k: k.cast("binary")).alias("keys")).collect()
    keys = KeySets([[bytes(k) for k in r["keys"]] for r in rows])
    return _sought(docs, F.lower("text"), [r.id for r in rows], "id", sets.schema["id"].dataType, keys)
