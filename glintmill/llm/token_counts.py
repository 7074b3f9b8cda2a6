"""Token counts without identifiers: byte-pair merging with a heap of adjacent pairs over a linked list of symbols.

The lowest-rank pair is popped again and again and its two symbols become one; the count of a word is its initial
symbols minus the merges made. Words repeat, so each worker keeps the counts of the words it has seen, up to
``CACHE_WORDS``, and starts anew beyond.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glintmill.llm import common, tokenizer_files

CACHE_WORDS = 1_000_000
SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"
#: Below this code point the letters, digits and spaces of all Unicode versions agree and NFC changes nothing.
PLAIN_BELOW = "ɐ"
_SHIFT = 20
_MASK = (1 << _SHIFT) - 1


class WordCounter:
    """Counts as the tokenizer of ``file`` does: special strings count one each, all else is normalised and split into words."""

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer

        spec = tokenizer_files.load(file)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.letters = tokenizer_files.byte_letters()
        self.pairs: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            key = self.vocab[left] << _SHIFT | self.vocab[right]
            self.pairs.setdefault(key, rank << _SHIFT | self.vocab[left + right])
        self.first = {b: self.vocab.get(c) for b, c in enumerate(self.letters)}
        self.last = {b: self.vocab.get(c + self.suffix) for b, c in enumerate(self.letters)}
        special = self.strings = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        # The pattern of the file's Split step.
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z]+|[0-9]|[^ \t\n\r\x0b\x0ca-zA-Z0-9]+").findall
        whole = Tokenizer.from_file(file)
        self.normalise, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        self.seen: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if text.isascii():
            return self.ascii_words(text.lower())
        if max(text) < PLAIN_BELOW:
            return self.words(text.lower())
        letters = self.bytes_of
        return [bytes(letters[c] for c in w).decode() for w, _ in self.split(self.normalise(text))]

    def merged(self, word: str) -> int:
        """Symbols left of one word."""
        raw = word.encode()
        ids = [self.first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return n
        pairs = self.pairs
        get = pairs.get
        heap = []
        for at in range(n - 1):
            made = get(ids[at] << _SHIFT | ids[at + 1])
            if made is not None:
                heap.append((made >> _SHIFT, at, made & _MASK))
        if not heap:
            return n
        heapq.heapify(heap)
        after = list(range(1, n)) + [-1]
        before = list(range(-1, n - 1))
        left = n
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, at, new = pop(heap)
            right = after[at]
            if right < 0 or ids[at] < 0:
                continue
            made = get(ids[at] << _SHIFT | ids[right])
            if made is None or made >> _SHIFT != rank:
                continue  # one of the two has been merged meanwhile
            ids[at], ids[right] = new, -1
            left -= 1
            then = after[at] = after[right]
            if then >= 0:
                before[then] = at
                made = get(new << _SHIFT | ids[then])
                if made is not None:
                    push(heap, (made >> _SHIFT, at, made & _MASK))
            prior = before[at]
            if prior >= 0:
                made = get(ids[prior] << _SHIFT | new)
                if made is not None:
                    push(heap, (made >> _SHIFT, prior, made & _MASK))
        return left

    def count(self, text: str) -> int:
        total = 0
        parts = [text]
        if self.special and any(s in text for s in self.strings):
            parts = self.special.split(text)
            total = len(parts) - 1
        seen = self.seen
        for part in parts:
            if not part:
                continue
            words = self.pieces(part)
            try:
                total += sum(map(seen.__getitem__, words))
            except KeyError:
                if len(seen) > CACHE_WORDS:
                    seen.clear()
                for w in set(words):
                    if w not in seen:
                        seen[w] = self.merged(w)
                total += sum(map(seen.__getitem__, words))
        return total


@functools.cache
def counter(file: str) -> WordCounter:
    return WordCounter(file)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    A null text is empty (0, 0, false); a doc_id may be of any type, a null one stays null; repeated rows each give a row; further columns are
    ignored; an empty table gives no rows. ``vocabulary`` is the file's path on the executors.
    """
    common.python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(vocabulary)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            counts = [words.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return common.pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {common.kind(docs, 'doc_id')}, {SCHEMA}")
