"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes the sequence of its text blocks, each with its ancestors. Features are the ancestors' tags, words of their
class, id and role, and properties of the block's text. Two labels, content and other, are decoded with Viterbi. The field is
trained by gradient steps on the likelihood of labelled pages, which are made here by rule: layouts with and without semantic
tags, in many combinations, with text of random letters, so that structure and shape decide and not words.
"""

from __future__ import annotations

import functools
import html
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glintmill.llm import common

SCHEMA = "url string, text string, n_chars long"
# Tags that begin and end blocks, tags without an end, and tags whose content is no text of the page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template title iframe noframes noembed xmp svg math object canvas audio video".split())
CLOSES_P = BLOCK_TAGS - {"body", "html", "option", "optgroup", "button", "caption", "legend", "summary"}
SAME_CLOSES = frozenset("li dt dd tr td th option p".split())

_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_SPECIAL = re.compile("[>\"']")
_NAME_END = re.compile(r"[\s/>]")


@dataclass
class Block:
    """``tags`` and ``names`` are those of all ancestors, each once; ``parent`` is the nearest one's tag."""

    text: str
    tags: tuple[str, ...]
    parent: str
    names: tuple[str, ...]
    linked: int


class Tags:
    """Where the tags of a page end. A pass over its quotes and ``>`` from the end tells, for each, where a tag that comes to it outside
    quotes is closed, so no tag without an end is looked at to the end of the page again and again.
    """

    def __init__(self, page: str):
        self.page, self.closed, self.stop = page, True, -1
        self.at = [m.start() for m in _SPECIAL.finditer(page)]
        self.ends = [-1] * (len(self.at) + 1)
        following: dict[str, int] = {}
        for i in range(len(self.at) - 1, -1, -1):
            c = page[self.at[i]]
            if c == ">":
                self.ends[i] = self.at[i] + 1
            else:
                self.ends[i] = self.ends[following[c] + 1] if c in following else -1
                following[c] = i

    def read(self, p: int) -> tuple[int, str, bool, str] | None:
        """The token that begins with the ``<`` at ``p``: its end, tag (empty for comments and the like), whether it closes, attributes."""
        page = self.page
        c = page[p + 1 : p + 2]
        if c in ("!", "?"):
            for begin, end in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if page.startswith(begin, p):
                    e = page.find(end, p + len(begin))
                    return (len(page) if e < 0 else e + len(end)), "", False, ""
            e = page.find(">", p + 2) if self.closed else -1
            self.closed = e >= 0
            return (e + 1, "", False, "") if self.closed else None
        closes = c == "/"
        name = p + 1 + closes
        if not (page[name : name + 1].isascii() and page[name : name + 1].isalpha()):
            return None
        if self.stop < name:
            m = _NAME_END.search(page, name)
            self.stop = m.start() if m else len(page)
        end = self.ends[bisect_left(self.at, self.stop)]
        return (end, page[name : self.stop].lower(), closes, page[self.stop : end - 1]) if end >= 0 else None


@functools.lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for m in _ATTR.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        out += [w.lower() for w in _NAMES.findall(value)]
    return tuple(dict.fromkeys(out))


def blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """The text blocks of a page in order: references decoded, white space runs made one space, ends trimmed.

    With ``known`` only those names of classes, ids and roles are kept. Time is linear in the length of the page, whatever its markup.
    """
    page = page or ""
    tags = Tags(page)
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_tags: dict[str, int] = {}  # how often each is open
    open_names: dict[str, int] = {}
    without_end: set[str] = set()  # raw tags that are closed nowhere in what is left
    parts: list[str] = []
    linked = anchor = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, tuple(open_tags), stack[-1][0] if stack else "", tuple(open_names), linked))
            parts.clear()
        linked = 0

    def push(tag: str, names: tuple[str, ...]) -> None:
        stack.append((tag, names))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        for n in names:
            open_names[n] = open_names.get(n, 0) + 1

    def pop() -> str:
        tag, names = stack.pop()
        for counts, keys in ((open_tags, (tag,)), (open_names, names)):
            for x in keys:
                counts[x] -= 1
                if not counts[x]:
                    del counts[x]
        return tag

    def skipped(tag: str, at: int) -> int:
        """After the end of a raw tag's content, which is no text."""
        if tag not in without_end:
            m = _raw_end(tag).search(page, at)
            end = page.find(">", m.end()) if m else -1
            if end >= 0:
                return end + 1
            without_end.add(tag)
        return len(page) if tag in ("script", "style", "title", "template") else at

    at, look, end = 0, 0, len(page)
    while at < end:
        p = page.find("<", look)
        token = tags.read(p) if p >= 0 else None
        if p >= 0 and token is None:
            look = p + 1
            continue
        text = page[at : p if p >= 0 else end]
        if text:
            parts.append(text)
            if anchor and not text.isspace():
                linked += len(text)
        if token is None:
            break
        at, tag, closes, attributes = token
        look = at
        if not tag:
            continue
        if tag in RAW_TAGS:
            if not closes and not attributes.endswith("/"):
                at = look = skipped(tag, at)
            continue
        if tag == "a":
            anchor = max(0, anchor + (-1 if closes else 1))
        elif tag == "br":
            parts.append("\n")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if closes:
            if tag in open_tags:
                while pop() != tag:
                    pass
            anchor = 0
        elif tag not in VOID_TAGS:
            if tag in CLOSES_P and stack and stack[-1][0] == "p":
                pop()
            if tag in SAME_CLOSES and stack and stack[-1][0] == tag:
                pop()
            names = _names(attributes)
            push(tag, names if known is None else tuple(n for n in names if n in known))
    flush()
    return out


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s>])", re.I)


def features(found: list[Block]) -> list[list[str]]:
    out = []
    n = len(found)
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        share = b.linked / max(1, len(b.text))
        own = [f"has={t}" for t in b.tags] + [f"name={w}" for w in b.names]
        own.append(f"tag={b.parent}")
        own.append(f"words={min(6, words.bit_length())}")
        own.append(f"links={0 if not share else 1 if share < 0.4 else 2 if share < 0.9 else 3}")
        own.append(f"stops={min(3, sum(b.text.count(c) for c in '.!?,;'))}")
        own.append(f"ends={b.text[-1] in '.!?:;' + chr(34)}")
        own.append(f"sign={'©' in b.text or '|' in b.text or '·' in b.text}")
        own.append(f"place={'first' if i == 0 else 'last' if i == n - 1 else 'inner'}")
        own.append("bias")
        out.append(own)
    return out


@dataclass(frozen=True)
class Field:
    """Weights of features for content over other, and of label pairs."""

    weights: dict[str, float]
    pairs: tuple[tuple[float, float], tuple[float, float]]

    @functools.cached_property
    def names(self) -> frozenset[str]:
        """The names of classes, ids and roles that it has weights for."""
        return frozenset(f.removeprefix("name=") for f in self.weights if f.startswith("name="))

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi's best labels; 1 is content. At a tie content wins."""
        if not rows:
            return []
        get = self.weights.get
        (a00, a01), (a10, a11) = self.pairs
        s0, s1 = 0.0, sum([get(f, 0.0) for f in rows[0]])
        back = []
        for row in rows[1:]:
            e = sum([get(f, 0.0) for f in row])
            from0 = (0, s0 + a00) if s0 + a00 > s1 + a10 else (1, s1 + a10)
            from1 = (0, s0 + a01) if s0 + a01 > s1 + a11 else (1, s1 + a11)
            back.append((from0[0], from1[0]))
            s0, s1 = from0[1], from1[1] + e
        out = [0 if s0 > s1 else 1]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Adaptive gradient steps on the log-likelihood, with forward and backward sums."""
    index = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
    w, seen = np.zeros(len(index)), np.full(len(index), 1e-2)
    t, t_seen = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    coded = [([np.array([index[f] for f in row]) for row in rows], y) for rows, y in pages if rows]
    order = list(range(len(coded)))
    rng = random.Random(7)
    for _ in range(rounds):
        rng.shuffle(order)
        for at in order:
            rows, y = coded[at]
            n = len(rows)
            e = np.zeros((n, 2))
            e[:, 1] = [w[r].sum() for r in rows]
            f, b = np.zeros((n, 2)), np.zeros((n, 2))
            f[0] = e[0]
            for i in range(1, n):
                f[i] = e[i] + np.logaddexp.reduce(f[i - 1][:, None] + t, axis=0)
            for i in range(n - 2, -1, -1):
                b[i] = np.logaddexp.reduce(t + (e[i + 1] + b[i + 1])[None, :], axis=1)
            z = np.logaddexp.reduce(f[-1])
            p1 = np.exp(f[:, 1] + b[:, 1] - z)
            g = np.zeros(len(w))
            for i, r in enumerate(rows):
                np.add.at(g, r, y[i] - p1[i])
            gt = np.zeros((2, 2))
            for i in range(1, n):
                gt -= np.exp(f[i - 1][:, None] + t + (e[i] + b[i])[None, :] - z)
                gt[y[i - 1], y[i]] += 1
            used = np.flatnonzero(g)
            g[used] -= ridge * w[used]
            seen[used] += g[used] ** 2
            w[used] += rate * g[used] / np.sqrt(seen[used])
            t_seen += gt**2
            t += rate * gt / np.sqrt(t_seen)
    return Field({f: float(w[i]) for f, i in index.items()}, tuple(tuple(map(float, r)) for r in t))


# ---- labelled pages, by rule -------------------------------------------------------------------------------------------------

# Fixed lists: how pages name their parts.
OTHER_NAMES = {
    "nav": "nav navbar navigation menu mainmenu breadcrumb breadcrumbs topnav links tabs pagination pager toc",
    "header": "header masthead topbar banner site-header branding logo",
    "footer": "footer site-footer bottom copyright legal colophon credits",
    "side": "sidebar side aside rail widget related recommended trending popular archive tags tagcloud more-stories author-box bio",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad commercial",
    "notice": "cookie cookies consent notice alert gdpr popup modal newsletter subscribe paywall disclaimer warning toast",
    "form": "form search searchbox login signup subscribe-form contact feedback poll",
    "comments": "comments comment reply replies discussion disqus respond reader-comments commentlist",
    "share": "share social sharing social-links follow toolbar buttons",
}
GOOD_NAMES = "article post content entry main body story text page post-content entry-content article-body main-content story-body single prose"
_WRAP = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"), "ad": ("div", "aside", "section"),
         "notice": ("div", "aside", "section", "dialog"), "form": ("form", "div"), "comments": ("section", "div", "ol"), "share": ("div", "ul")}


def made_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page, and the label of each of its blocks."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9)))
    stop = lambda: rng.choice([".", ".", ".", "!", "?", "", "..."])

    def prose(low: int, high: int, noise: bool = False) -> str:
        words = [word() for _ in range(rng.randint(low, high))]
        words[0] = words[0].capitalize()
        words = [w + ("," if rng.random() < 0.1 else "") + (rng.choice(["***", "###", "%%%", "&amp;&amp;", "!!", " |"]) if noise else "") for w in words]
        return " ".join(words) + stop()

    out: list[str] = []
    labels: list[int] = []

    def attrs(names: str, always: bool = False) -> str:
        if not always and rng.random() < 0.35:
            return ""
        return f' {rng.choice(["class", "class", "id", "role"])}="{rng.choice(names.split())}"'

    def block(tag: str, text: str, label: int) -> None:
        out.append(f"<{tag}>{text}</{tag}>" if rng.random() < 0.9 or tag not in ("p", "li") else f"<{tag}>{text}")
        labels.append(label)

    def other(kind: str) -> None:
        tag = rng.choice(_WRAP[kind])
        semantic = tag not in ("div", "section", "ul", "ol") or (tag == "ul" and kind == "nav")
        out.append(f"<{tag}{attrs(OTHER_NAMES[kind], not semantic)}>")
        shape = {"nav": "links", "share": "links", "comments": "prose", "ad": "text", "notice": "text"}.get(kind) or rng.choice(["links", "text", "prose"])
        if kind == "footer":
            text = f"&copy; {word()}.{word()}.com &middot; {prose(1, 12)}" if rng.random() < 0.6 else prose(2, 14)
            if rng.random() < 0.5:
                out.append(text)
                labels.append(0)
            else:
                block("p", text, 0)
        elif kind == "form":
            block("p", prose(1, 5), 0)
            out.append("<input type=text>")
            block("button", word(), 0)
        elif shape == "links":
            if tag not in ("ul", "ol"):
                out.append("<ul>")
            for _ in range(rng.randint(1, 8)):
                block("li", f'<a href="/{word()}">{prose(1, 4).rstrip(".!?")}</a>', 0)
            if tag not in ("ul", "ol"):
                out.append("</ul>")
        elif shape == "text" or rng.random() < 0.3:
            if rng.random() < 0.6 and tag not in ("ul", "ol"):
                out.append(prose(2, 24, rng.random() < 0.15))
                labels.append(0)
            else:
                block("p", prose(2, 24), 0)
        else:
            if rng.random() < 0.5:
                block(rng.choice(["h2", "h3", "h4"]), prose(1, 3), 0)
            for _ in range(rng.randint(1, 5)):
                block("li" if tag in ("ul", "ol") else rng.choice(["p", "p", "div"]), prose(2, 40, rng.random() < 0.1), 0)
        out.append(f"</{tag}>")

    def article() -> None:
        style = rng.random()
        tag, names = ("article", attrs(GOOD_NAMES)) if style < 0.6 else ("main", attrs(GOOD_NAMES)) if style < 0.75 else ("div", attrs(GOOD_NAMES, True))
        if rng.random() < 0.2 and tag == "article":
            out.append("<main>")
        out.append(f"<{tag}{names}>")
        noise = rng.random() < 0.25
        if rng.random() < 0.85:
            block(rng.choice(["h1", "h1", "h2"]), prose(2, 12, noise).rstrip("."), 1)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
            r = rng.random()
            if r < 0.78:
                low, high = rng.choice([(1, 4), (4, 20), (15, 80), (40, 160)])
                text = prose(low, high, noise)
                if rng.random() < 0.15:
                    text = f"<b>{text}"
                if rng.random() < 0.12:
                    text += f' <a href="/{word()}">{prose(1, 3)}</a> {prose(3, 9)}'
                if rng.random() < 0.1:
                    text += "<br>"
                block("p", text, 1)
            elif r < 0.84:
                block(rng.choice(["h2", "h3"]), prose(1, 6).rstrip("."), 1)
            elif r < 0.90:
                out.append("<ul>" if rng.random() < 0.7 else "<ol>")
                for _ in range(rng.randint(1, 5)):
                    block("li", prose(2, 14), 1)
                out.append("</ul>")
            elif r < 0.93:
                block("blockquote", prose(5, 30), 1)
            elif r < 0.96:
                block("pre", prose(3, 20), 1)
            elif r < 0.98:
                out.append("<table><tr>")
                for _ in range(rng.randint(1, 4)):
                    block("td", prose(1, 4), 1)
                out.append("</tr></table>")
            elif rng.random() < 0.6:
                other(rng.choice(["ad", "share", "side", "notice", "form"]))
            else:
                out.append(f"<div>{prose(8, 40)}</div>")
                labels.append(1)
        if rng.random() < 0.12:
            other("comments")
        out.append(f"</{tag}>")

    for kind in rng.sample(["nav", "header", "notice", "ad", "form", "share"], rng.randint(0, 4)):
        other(kind)
    wrapped = rng.random() < 0.3
    if wrapped:
        out.append(f'<div class="{rng.choice(["wrapper", "container", "site", "layout", "row"])}">')
    if rng.random() < 0.2:
        other("side")
    article()
    for kind in rng.sample(["comments", "side", "share", "ad", "notice"], rng.randint(0, 3)):
        other(kind)
    if wrapped:
        out.append("</div>")
    if rng.random() < 0.85:
        other("footer")
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{''.join(out)}</body></html>", labels


#: Labelled pages that train the field.
TRAINING_PAGES = 500


@functools.cache
def field(pages: int = TRAINING_PAGES, seed: int = 11) -> Field:
    rng = random.Random(seed)
    rows = []
    for _ in range(pages):
        page, labels = made_page(rng)
        found = blocks(page)
        if len(found) == len(labels):
            rows.append((features(found), labels))
    return train(rows)


def main_text(page: str | None, model: Field) -> str:
    found = blocks(page, model.names)
    return "\n".join([b.text for b, y in zip(found, model.decode(features(found)), strict=True) if y])


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (main text blocks joined by newlines, empty if none), n_chars (code points).

    A null html is empty. Text without any markup is one block. A page_id may be of any type; a null page_id or url stays null; repeated rows each give a
    row; further columns are ignored; an empty table gives no rows. Time is linear in the length of a page, unclosed markup
    included.
    """
    common.python_batches(pages.sparkSession)
    model = model or field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return common.pick(pages, "page_id", "url", "html").mapInArrow(run, f"page_id {common.kind(pages, 'page_id')}, {SCHEMA}")
