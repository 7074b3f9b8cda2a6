"""Vocabulary files of public tokenizers, read as data; each worker process reads a file once."""

from __future__ import annotations

import functools
import json


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_letters() -> tuple[str, ...]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else U+0100 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return tuple(letters[b] for b in range(256))


def load(file: str) -> dict:
    with open(file, encoding="utf-8") as f:
        return json.load(f)
