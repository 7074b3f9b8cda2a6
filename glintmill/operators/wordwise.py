"""Words of many texts at once, in columns: nothing is made for each word, so a vocabulary that grows with the corpus costs no more."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters and digits of ASCII as they are, spaces for others; and the same in lower case.
AS_IS = bytes(c if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))
LOWER = bytes(ord(chr(c).lower()) if AS_IS[c] != 32 else 32 for c in range(256))
#: The characters beyond ASCII whose lower case has a letter of ASCII.
_ODD = ((b"\xc4\xb0", b"i "), (b"\xe2\x84\xaa", b"k"))
#: The longest word that MD5 takes in one block, and how many are hashed at once.
BLOCK, AT_ONCE = 55, 8192
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]


def gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows or ``size`` bytes, from smaller ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def parts(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where the strings of a column without nulls begin and end in its bytes, and these."""
    bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    return bounds - bounds[0], memoryview(column.buffers()[2] or b"")[bounds[0] : bounds[-1]]


def words(texts: pa.Array, shown: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in UTF-8, and the row of each; there may be empty ones. ``shown`` is :data:`AS_IS` or :data:`LOWER`; null has none."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    bounds, data = parts(texts)
    data = bytes(data)
    if shown is LOWER and any(odd in data for odd, _ in _ODD):
        each = texts.to_pylist()
        for odd, plain in _ODD:
            each = [t.replace(odd, plain) for t in each]
        bounds, data = parts(pa.array(each, pa.binary()))
        data = bytes(data)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(data.translate(shown)))
    split = pc.ascii_split_whitespace(plain)
    return split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))


def are_terms(known: pa.Array) -> np.ndarray:
    """Which words have three characters or more, not all of them digits."""
    bounds, data = parts(known)
    letters = np.cumsum(np.concatenate([[0], np.frombuffer(data, np.uint8) > ord("9")]))
    return (np.diff(bounds) >= 3) & (letters[bounds[1:]] > letters[bounds[:-1]])


def _one_block(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of strings that lie one after another, as they are written in hexadecimal."""
    n, at = len(size), np.repeat(np.arange(len(size)), size)
    block = np.zeros((n, 64), np.uint8)
    block[at, np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)] = data
    block[np.arange(n), size] = 0x80
    block[:, 56], block[:, 57] = size * 8 & 255, size * 8 >> 8
    m = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + _SINES[i] + m[g]
        a, d, c, b = d, c, b, b + ((f << np.uint32(_TURNS[i])) | (f >> np.uint32(32 - _TURNS[i])))
    return (a + np.uint32(0x67452301)).byteswap()


def hashes(known: pa.Array, remembered: dict[bytes, int]) -> np.ndarray:
    """The first eight hexadecimal digits of the MD5 of each word, as a number; ``remembered`` has those of words of several blocks."""
    size = np.diff(parts(known)[0])
    fits = size <= BLOCK
    short = known if fits.all() else known.filter(pa.array(fits))
    bounds, data = parts(short)
    data, some, out = np.frombuffer(data, np.uint8), np.diff(bounds).astype(np.int64), np.zeros(len(known), np.int64)
    pieces = [_one_block(data[bounds[a] : bounds[min(a + AT_ONCE, len(short))]], some[a : a + AT_ONCE]) for a in range(0, len(short), AT_ONCE)]
    out[fits] = np.concatenate(pieces) if pieces else 0
    for i in np.flatnonzero(~fits):
        word = known[i].as_py().encode()
        if word not in remembered:
            remembered[word] = int(hashlib.md5(word).hexdigest()[:8], 16)
        out[i] = remembered[word]
    return out
