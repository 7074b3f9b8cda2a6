"""Column functions on markdown, its components and its tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glintmill.functions.text import stripped

# Fixed lists: components and layout tags that are dropped, their content kept.
PRESENTATIONAL = ("Note", "Tip", "Warning", "Info", "Check", "Danger", "CodeGroup", "CardGroup", "Frame", "Columns", "Expandable")
HTML_LAYOUT = ("div", "span", "br", "p", "img", "a")

FENCE = r"(?md)^```(?s:.*?)^```[^\n]*\n?"
# Fixed rules, in the order in which they apply outside fences. Numbering of steps comes after the second.
COMMENTS = [(r"(?s)\{/\*.*?\*/\}", "")]
TABS = [(r'<Tab\s+title="([^"]*)"[^>]*>', "\nAlternative ($1):\n"), (r"<Tab(?:\s[^>]*)?>", "\nAlternative:\n"), (r"</Tabs?>", ""), (r"<Tabs(?:\s[^>]*)?>", "")]
LOOSE_STEPS = [(r'<Step\s+title="([^"]*)"[^>]*>', "\n$1\n"), (r"</?Steps?(?:\s[^>]*)?>", "")]
ACCORDIONS = [(r'<Accordion\s+title="([^"]*)"[^>]*>', "\n$1\n"), (r"</?Accordion(?:Group)?(?:\s[^>]*)?>", "")]
CARDS = [(r'<Card\s+[^>]*?title="([^"]*)"[^>]*>', "\n$1\n"), (r"</?Card(?:Group)?(?:\s[^>]*)?>", "")]
WRAPPERS = [(rf"</?(?:{'|'.join(PRESENTATIONAL)})(?:\s[^>]*)?>", ""), (rf"(?i)</?(?:{'|'.join(HTML_LAYOUT)})(?:\s[^>]*)?>", "")]
# Fixed patterns: a block of steps, and the tag of one.
STEPS = r"(?s)<Steps(?:\s[^>]*)?>.*?</Steps>"
STEP = r"<Step(?:\s[^>]*)?>"


def _apply(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def _woven(text: Column, pattern: str, inside, outside) -> Column:
    """``text`` with ``inside`` applied to matches of ``pattern`` and ``outside`` to what is between them."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # One gap more than matches: an empty match evens them out.
    woven = F.zip_with(gaps, F.concat(found, F.array(F.lit(""))), lambda g, m: F.concat(outside(g), F.when(m == "", F.lit("")).otherwise(inside(m))))
    return F.array_join(woven, "")


def number_steps(text: Column) -> Column:
    """Steps inside each ``<Steps>`` block become ``1. title``, counted anew in each block."""

    def block(b: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(b, r"^<Steps(?:\s[^>]*)?>|</Steps>$", ""), "</Step>", "")
        pieces = F.split(body, STEP, -1)
        tags = F.regexp_extract_all(body, F.lit(STEP), F.lit(0))
        title = lambda t: F.regexp_extract(t, r'^<Step\s+title="([^"]*)"', 1)
        heads = F.transform(tags, lambda t, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit("."), F.when(title(t) != "", F.concat(F.lit(" "), title(t))).otherwise(F.lit("")), F.lit("\n")))
        return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), heads), pieces, lambda h, g: F.concat(h, g)), "")

    return _woven(text, STEPS, block, lambda g: g)


def flattened(text: Column) -> Column:
    """All rules, on text without fences."""
    text = _apply(text, COMMENTS + TABS)
    return _apply(number_steps(text), LOOSE_STEPS + ACCORDIONS + CARDS + WRAPPERS)


def transform(text: Column) -> Column:
    """All rules outside code fences; a fence without an end is text."""
    return _woven(text, FENCE, lambda m: m, flattened)


def fences(text: Column) -> Column:
    """Whole fences, each with its closing line."""
    return F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))


def cells(line: Column) -> Column:
    """Cells of a table row. Escaped pipes and pipes in code spans are content. Padding goes, runs of spaces become one, and then backticks go."""
    masked = F.replace(stripped(line), F.lit("\\|"), F.lit("\u0001"))
    inner = F.regexp_replace(masked, r"^\||\|$", "")
    spans = F.transform(F.split(inner, "`", -1), lambda s, i: F.when(i % 2 == 1, F.replace(s, F.lit("|"), F.lit("\u0001"))).otherwise(s))
    clean = lambda c: stripped(F.replace(F.regexp_replace(stripped(F.replace(c, F.lit("\u0001"), F.lit("|"))), " {2,}", " "), F.lit("`"), F.lit("")))
    return F.transform(F.split(F.array_join(spans, "`"), r"\|", -1), clean)


def is_separator(line: Column) -> Column:
    return line.rlike(r"^[ \t\n\r\f\x0b|:-]+$") & line.contains("-")


def is_table(block: Column) -> Column:
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"[^ \t\r\f\x0b]"))
    piped = F.filter(lines, lambda x: x.rlike(r"^[ \t\r\f\x0b]*\|"))
    return (F.size(lines) >= 3) & (F.size(piped) >= F.size(lines) - 1)


def rendered_row(headers: Column, values: Column) -> Column:
    """The first cell, then ``label: value`` lines; empty cells go, cells beyond the header get a number for a label."""
    label = lambda i: F.coalesce(F.get(headers, i), F.concat(F.lit("Column "), (i + 1).cast("string")))
    line = lambda v, i: F.when((i == 0) | (label(i) == ""), v).otherwise(F.concat(label(i), F.lit(": "), v))
    kept = F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), line(v, i).alias("line"))), lambda x: x["v"] != "")
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def without_layout(html: Column) -> Column:
    return F.regexp_replace(html, WRAPPERS[1][0], "")
