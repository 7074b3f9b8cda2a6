"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, spelled out so that all engines agree.
SPACE = r"[ \t\n\r\f\x0b]"
#: White space of any script, at the ends of what is trimmed.
ANY_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The default token: a run of ASCII letters and digits, or one other character that isn't space.
TOKEN = r"[A-Za-z0-9]+|[^ \t\n\r\f\x0bA-Za-z0-9]"
#: Every so many tokens one is kept in a degraded question.
STRIDE = 12


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of at least three characters, not all digits; repeats and order kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$"))


def degraded_terms(text: Column) -> Column:
    return F.filter(terms(text), lambda _, i: i % STRIDE == 0)


def token_count(text: Column) -> Column:
    """How many :data:`TOKEN` s: each run becomes one letter, spaces go, and what is left is counted. A list of all tokens takes several times as long."""
    one_each = F.regexp_replace(F.coalesce(text, F.lit("")), "[A-Za-z0-9]+", "a")
    return F.length(F.translate(one_each, " \t\n\r\f\x0b", ""))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")))


def bucket(term: Column, n: int) -> Column:
    """A stable number below ``n`` from a string."""
    return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{ANY_SPACE}+|{ANY_SPACE}+$", "")


def runs(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case, of any length; repeats and order kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def title(text: Column) -> Column:
    """What follows the ``# `` of the first top heading, trimmed."""
    heading = F.get(F.filter(F.split(text, "\r\n|\r|\n", -1), lambda line: line.startswith("# ")), F.lit(0))
    return F.coalesce(stripped(F.substr(heading, F.lit(3))), F.lit("(untitled)"))


def snippet(text: Column, needle: str) -> Column:
    """From 100 characters before the first hit to 200 after its beginning."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - 100, F.lit(1))
    return F.substring(text, start, at + 200 - start)


def preview(text: Column, width: int = 84) -> Column:
    return F.substring(F.substring_index(text, "\n", 1), 1, width)


def shown(value: Column, digits: int) -> Column:
    """A number with fixed digits, ``undefined`` for null."""
    return F.coalesce(F.regexp_replace(F.format_number(value, digits), ",", ""), F.lit("undefined"))
