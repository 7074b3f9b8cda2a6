"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word exactly one token can end its encoding. An automaton over the vocabulary gives the tokens that
end at a position; the one that fits is the one which is compatible with the last token of the prefix before it. Two
tokens are compatible if byte-pair merging of their joined bytes gives the two back. Back-pointers give the ids.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glintmill.llm import common, tokenizer_files

CACHE_WORDS = 600_000
CACHE_PAIRS = 2_000_000
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_NEVER = 1 << 60
#: Below this code point the letters, digits and spaces of all Unicode versions agree.
PLAIN_BELOW = "ɐ"
#: The split of byte-level vocabularies.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"""


class PrefixCodec:
    def __init__(self, file: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        spec = tokenizer_files.load(file)
        letters = tokenizer_files.byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if all(c in byte for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.find_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: rank of a pair; the parts and the rank of a merged token
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank.setdefault((a, b), rank)
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = (a, b), rank
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            if text not in self.special:
                self.automaton.add_word(bytes(byte[c] for c in text).decode("latin-1"), (i, len(text)))
        self.automaton.make_automaton()
        self.words = regex.compile(WORDS).findall
        self.ascii_words = re.compile(ASCII_WORDS).findall
        self.split = Tokenizer.from_file(file).pre_tokenizer.pre_tokenize_str
        self.byte = byte
        self.fits: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, tuple[str, int, bytes]] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of ``token`` while it is being made, each with the rank that ends it."""
        if (token, side) not in self.edges:
            chain, at, until = [], token, _NEVER
            while True:
                chain.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.made[at], self.parts[at][side]
            self.edges[token, side] = chain
        return self.edges[token, side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses from ``a`` into ``b`` when their joined bytes are merged.

        A pair at the border merges if its rank comes before either part is merged further inside its own token. At the
        same rank the one further left goes first.
        """
        found = self.fits.get((a, b))
        if found is None:
            found, rank = True, self.rank.get
            for x, x_ends in self.edge(a, 1):
                for y, y_ends in self.edge(b, 0):
                    r = rank((x, y))
                    if r is not None and r < x_ends and r <= y_ends:
                        found = False
                        break
                if not found:
                    break
            if len(self.fits) > CACHE_PAIRS:
                self.fits.clear()
            self.fits[a, b] = found
        return found

    def encode_word(self, raw: bytes) -> list[int]:
        n = len(raw)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        fits, compatible = self.fits, self.compatible
        for end, (token, length) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            before = last[start]
            if start == 0:
                last[end], back[end] = token, 0
            elif before >= 0:
                fit = fits.get((before, token))
                if fit is None:
                    fit = compatible(before, token)
                if fit:
                    last[end], back[end] = token, start
        if last[n] < 0:
            raise ValueError("no encoding: the vocabulary lacks a byte or its merges contradict each other")
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words(text)
        if max(text) < PLAIN_BELOW:
            return self.words(text)
        byte = self.byte
        return [bytes(byte[c] for c in w).decode() for w, _ in self.split(text)]

    def known(self, words: list[str]) -> list[tuple[str, int, bytes]]:
        seen = self.seen
        try:
            return list(map(seen.__getitem__, words))
        except KeyError:
            if len(seen) > CACHE_WORDS:
                seen.clear()
            bytes_of = self.bytes_of
            for w in set(words):
                if w not in seen:
                    ids = self.encode_word(w.encode())
                    seen[w] = ",".join(map(str, ids)), len(ids), b"".join([bytes_of[i] for i in ids])
            return list(map(seen.__getitem__, words))

    def parts_of(self, text: str) -> list[tuple[str, int, bytes]]:
        """For each word or special string: its ids joined by commas, their number, and the bytes that the ids decode to."""
        if not text:
            return []
        if self.find_special is None or not any(s in text for s in self.special):
            return self.known(self.pieces(text))
        out = []
        for part in self.find_special.split(text):
            if part in self.special:
                i = self.special[part]
                out.append((str(i), 1, self.bytes_of[i]))
            elif part:
                out += self.known(self.pieces(part))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.parts_of(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, unknown ids nothing."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        parts = self.parts_of(text)
        ids = ",".join([p[0] for p in parts])
        decoded = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
        return sum([p[1] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@functools.cache
def codec(file: str) -> PrefixCodec:
    return PrefixCodec(file)


def encode_and_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256.

    A null text is empty: no ids, both hashes those of the empty string. A doc_id may be of any type, a null one stays null; repeated rows each
    give a row; further columns are ignored; an empty table gives no rows.
    """
    common.python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(vocabulary).digest
        for batch in batches:
            rows = [of(t or "") for t in batch.column(1).to_pylist()]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {common.kind(docs, 'doc_id')}, {SCHEMA}")


def encode_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row: doc_id and the ids themselves, for a training set; else as :func:`encode_and_decode`."""
    common.python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(vocabulary).encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return common.pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {common.kind(docs, 'doc_id')}, ids array<int>")
