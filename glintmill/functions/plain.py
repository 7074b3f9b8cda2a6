"""The rules of :mod:`glintmill.functions.markup` on Python strings, for operators that walk through a document."""

from __future__ import annotations

import re

from glintmill.functions import markup as M

_FENCE = re.compile(M.FENCE.replace("(?md)", "(?m)"))
_STEPS, _STEP = re.compile(M.STEPS), re.compile(M.STEP)
_STEPS_EDGES = re.compile(r"^<Steps(?:\s[^>]*)?>|</Steps>$")
_STEP_TITLE = re.compile(r'<Step\s+title="([^"]+)"')
_CELL = re.compile(r"\\\||`|\||\\|[^\\`|]+")


def _compiled(rules: list[tuple[str, str]]) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(pattern), by.replace("$1", r"\1")) for pattern, by in rules]


_BEFORE, _AFTER = _compiled(M.COMMENTS + M.TABS), _compiled(M.LOOSE_STEPS + M.ACCORDIONS + M.CARDS + M.WRAPPERS)


def _numbered(block: re.Match) -> str:
    count = 0

    def head(tag: re.Match) -> str:
        nonlocal count
        count += 1
        title = _STEP_TITLE.match(tag[0])
        return f"\n{count}. {title[1]}\n" if title else f"\n{count}.\n"

    return _STEP.sub(head, _STEPS_EDGES.sub("", block[0]).replace("</Step>", ""))


def flattened(text: str) -> str:
    """All rules, on text without fences."""
    if "<" not in text and "{/*" not in text:
        return text
    for pattern, by in _BEFORE:
        text = pattern.sub(by, text)
    text = _STEPS.sub(_numbered, text)
    for pattern, by in _AFTER:
        text = pattern.sub(by, text)
    return text


def transform(text: str) -> str:
    """All rules outside code fences; a fence without an end is text."""
    out, at = [], 0
    for m in _FENCE.finditer(text):
        out += [flattened(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, flattened(text[at:])])


def cells(line: str) -> list[str]:
    """Cells of a table row, as :func:`glintmill.functions.markup.cells` has them."""
    line = line.strip().removeprefix("|")
    if line.endswith("|") and not line.endswith("\\|"):
        line = line[:-1]
    out, coded = [""], False
    for token in _CELL.findall(line):
        if token == "|" and not coded:
            out.append("")
            continue
        coded ^= token == "`"
        out[-1] += "|" if token == "\\|" else token
    return [re.sub(" {2,}", " ", c.strip()).replace("`", "").strip() for c in out]


def is_separator(line: str) -> bool:
    return "-" in line and re.fullmatch(r"[\s|:\-]+", line) is not None


def is_table(block: str) -> bool:
    """Three lines at least that aren't blank, all but one of them piped at the beginning."""
    lines = [x for x in block.splitlines() if x.strip()]
    return len(lines) >= 3 and sum(x.lstrip().startswith("|") for x in lines) >= len(lines) - 1


def rendered_row(headers: list[str], values: list[str]) -> str:
    """The first cell, then ``label: value`` lines; empty cells go, cells beyond the header get a number for a label."""
    labels = [*headers, *(f"Column {i + 1}" for i in range(len(headers), len(values)))]
    lines = [v if i == 0 or not labels[i] else f"{labels[i]}: {v}" for i, v in enumerate(values) if v]
    return "\n".join(lines)
