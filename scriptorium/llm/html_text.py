"""Main text of web pages from flat text blocks.

A page becomes a flat sequence of text blocks, cut at block-level tags, in one pass: open elements are counted as they come
and go, so a page costs time in proportion to its length. Each block knows its word count and link density, those of its
neighbours, and what the tags around it say (how many are navigation, advert, form, comment and the like, whether an
article or main element holds it). A decision tree, grown on the small labelled table in `html_pages`, says which blocks
are main text. They are joined in page order.

Defined results: null html and a page without main text give an empty string. Character references are decoded, white
space inside a block becomes one space, blocks are trimmed, empty blocks go; nothing else is dropped or capped. Text in
comments, script, style and other elements that aren't shown is no block. Unclosed and stray tags are tolerated, and a tag
that the page's end cuts is dropped. Quotes count after an equals sign only; from a tag on whose
quote is never closed they are ordinary characters. Names of an element that holds an article or main element say nothing about what is in there, nor do those of an
element that holds most of the page's unlinked words with its first-level heading or under an article's name. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import html_pages
from scriptorium.llm.common import ship

#: Element names by what HTML says of them.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object head title textarea select canvas audio video".split())
FURNITURE = frozenset("nav footer aside form button menu dialog".split())
#: Words of class, id and role values that mark what is no main text.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget related recommended share sharing social comment comments reply replies discussion respond cookie cookies consent notice notices popup modal overlay newsletter subscribe signup login search pagination pager toolbar copyright legal disclaimer alert complementary contentinfo dialog outbrain taboola".split())
#: Words of class and id values that name the article itself.
ARTICLE_WORDS = frozenset("article blog entry news post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li td dd dt".split())
#: Elements whose start ends others of these names that are still open around it.
IMPLIED = {"p": "p", "li": "li p", "tr": "tr td th p", "td": "td th p", "th": "td th p", "dt": "dt dd p", "dd": "dt dd p", "option": "option"}
IMPLIED = {k: frozenset(v.split()) for k, v in IMPLIED.items()}

# Possessive throughout, so that no part of a page is read twice for one tag.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'])(class|id|role|hidden|aria-hidden|style|data-main)(?![^\s=/>])(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW = {name: re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I) for name in ("script", "style", "textarea", "iframe", "noscript", "title", "svg", "math", "template")}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: int  # elements around it that are no main text by name
    marked: int  # or by class, id or role
    header: int  # that are headers, by name or class
    article: bool
    heading: bool
    item: bool
    labelled: bool = False  # main text, on pages of the labelled table
    marks: tuple[int, ...] = ()  # the elements that `marked` counts
    title: bool = False  # an h1

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class _Element:
    name: str
    counts: tuple[str, ...]  # the counters that it raises
    outer: tuple[int, int, int, list[int]] | None = None  # of an article: the counters and marks outside


def _described(name: str, attributes: str) -> set[str]:
    """What an element's name and attributes say of the text in it."""
    says = {k for k, names in (("furniture", FURNITURE), ("hidden", HIDDEN), ("heading", HEADINGS), ("item", ITEMS)) if name in names}
    says |= {name} & {"a", "header", "h1"} | ({"article"} if name in ("article", "main") else set())
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*+:\s*+none", value, re.I):
            says.add("hidden")
        elif key == "data-main":
            says.add("labelled")
        elif key in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
            words = [w.lower() for w in _WORD.findall(value)]
            said = {w for before, w in zip(["", *words], words, strict=False) if before not in ("has", "with", "no", "without")}
            says |= ({"named"} if said & ARTICLE_WORDS else set()) | ({"marked"} if said & MARKS else set()) | ({"header"} if "header" in said else set())
    return says


class _Page:
    """The elements that are open, counted by name and by what they say."""

    def __init__(self) -> None:
        self.stack: list[_Element] = []
        self.at: dict[str, list[int]] = {}  # where elements of a name stand in the stack
        self.blocks: list[int] = []  # where block-level ones do
        self.count = dict.fromkeys(("furniture", "marked", "header", "hidden", "heading", "item", "article", "a", "labelled", "named", "h1"), 0)
        self.marks: list[int] = []  # numbers of the open elements that are marked
        self.named: set[int] = set()  # those of marked elements that are named after an article too
        self.opened = 0

    def open(self, name: str, attributes: str) -> None:
        says = _described(name, attributes)
        outer = None
        if "article" in says:  # what stands around an article says nothing about it
            outer = (*(self.count[k] for k in ("furniture", "marked", "header")), self.marks)
            self.count |= {"furniture": 0, "marked": 0, "header": 0}
            self.marks = []
        for k in says:
            self.count[k] += 1
        self.opened += 1
        if "marked" in says:
            self.marks.append(self.opened)
            if "named" in says:
                self.named.add(self.opened)
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(_Element(name, tuple(says), outer))

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            e = self.stack.pop()
            for k in e.counts:
                self.count[k] -= 1
            if "marked" in e.counts:
                self.marks.pop()
            if e.outer is not None:
                *outside, self.marks = e.outer
                self.count |= dict(zip(("furniture", "marked", "header"), outside, strict=True))
            self.at[e.name].pop()
            if e.name in BLOCK:
                self.blocks.pop()

    def close(self, name: str) -> None:
        places = self.at.get(name)
        # inline ends don't reach over the block around them
        if places and (name in BLOCK or not self.blocks or self.blocks[-1] < places[-1]):
            self.close_to(places[-1])

    def imply(self, name: str) -> None:
        """Close what the start of an element closes, but nothing around a link."""
        names, link = IMPLIED[name], (self.at.get("a") or [-1])[-1]
        depth, i = None, len(self.blocks) - 1
        while i >= 0 and self.blocks[i] > link and self.stack[self.blocks[i]].name in names:
            depth, i = self.blocks[i], i - 1
        if depth is not None:
            self.close_to(depth)


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    state, parts, linked = _Page(), [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            c = state.count
            counts = (len(text.split()), len(html.unescape("".join(linked)).split()), c["furniture"], c["marked"], c["header"])
            out.append(Block(text, *counts, *(c[k] > 0 for k in ("article", "heading", "item", "labelled")), tuple(state.marks), c["h1"] > 0))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        if text and not state.count["hidden"]:
            parts.append(text)
            if state.count["a"]:
                linked.append(text + " ")

    at, tag = 0, _TAG
    while at < len(page):
        start = page.find("<", at)
        add(page[at:] if start < 0 else page[at:start])
        if start < 0:
            break
        closer = next((c for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")) if page.startswith(o, start)), None)
        if closer:
            end = page.find(closer, start + 2)
            at = len(page) if end < 0 else end + len(closer)
            continue
        if not re.match(r"/?[a-zA-Z]", page[start + 1 : start + 3]):
            add("<")
            at = start + 1
            continue
        m = tag.match(page, start)
        if not m and tag is _TAG:  # a quote is open to the page's end: from here on quotes are ordinary characters
            tag = _PLAIN_TAG
            m = tag.match(page, start)
        if not m:  # the page's end has cut it
            break
        at, name = m.end(), m[2].lower()
        if name in BLOCK:
            flush()
        elif name == "br":
            add(" ")
        if m[1]:
            state.close(name)
        elif name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            if name in IMPLIED:
                state.imply(name)
            state.open(name, m[3])
    flush()
    return _unmarked(out, state.named)


def _unmarked(found: list[Block], named: set[int]) -> list[Block]:
    """found, where the class words of an element that is the page's body don't count: it holds more than half of the words that are no
    links, and its first-level heading or an article's name."""
    held, total, bodies = Counter(), 0, set(named)
    for b in found:
        if not b.furniture:
            total += b.words - b.linked
            held.update(dict.fromkeys(b.marks, b.words - b.linked))
            if b.title:
                bodies.update(b.marks)
    bodies = {m for m in bodies if 2 * held[m] > total}
    if bodies:
        for b in found:
            b.marked -= len(bodies.intersection(b.marks))
    return found


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "furniture", "marked", "header", "article", "heading", "item", "outside")
#: The order in which columns are asked where they are of equal worth: what tags say comes before counts.
_ASKED = tuple(FEATURES.index(x) for x in ("furniture", "marked", "outside", "article", "density", "header", "density_before", "density_after", "words", "words_before", "words_after", "heading", "item"))


def block_features(found: list[Block]) -> np.ndarray:
    """A row per block, columns as FEATURES."""
    none = Block("", 0, 0, 0, 0, 0, False, False, False)
    around = [none, *found, none]
    has = any(b.article for b in found)
    rows = [
        (b.words, b.density, p.words, p.density, n.words, n.density, b.furniture, b.marked, b.header, b.article, b.heading, b.item, has and not b.article)
        for p, b, n in zip(around, around[1:], around[2:], strict=False)
    ]
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


def labelled(pages: list[str]) -> np.ndarray:
    """Features of the pages' blocks, then whether they are main text."""
    rows = []
    for page in pages:
        found = blocks(page)
        rows.append(np.column_stack([block_features(found), [b.labelled for b in found]]))
    return np.concatenate(rows)


def grow(rows: np.ndarray, depth: int = 8) -> tuple:
    """A decision tree by Gini impurity: (share of main text,) or (column, limit, tree up to it, tree above it)."""
    y = rows[:, -1]
    share = float(y.mean())
    best = (2 * share * (1 - share) * len(y), None, None)
    if depth and 0 < share < 1:
        for column in _ASKED:
            values = np.unique(rows[:, column])
            for limit in (values[1:] + values[:-1]) / 2:
                left = rows[:, column] <= limit
                a, b = y[left], y[~left]
                cost = 2 * (a.mean() * (1 - a.mean()) * len(a) + b.mean() * (1 - b.mean()) * len(b))
                if cost < best[0] - 1e-9:
                    best = (cost, column, limit)
    if best[1] is None:
        return (share,)
    _, column, limit = best
    left = rows[:, column] <= limit
    return column, limit, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Which rows of features are main text."""
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    column, limit, low, high = tree
    left = x[:, column] <= limit
    out = np.empty(len(x), bool)
    out[left], out[~left] = classify(low, x[left]), classify(high, x[~left])
    return out


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, classify(tree, block_features(found)), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    tree = grow(labelled(html_pages.pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), tree) for x in b.column("html")]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
