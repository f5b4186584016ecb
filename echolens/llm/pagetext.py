"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block elements from the root to it. For every path the
lengths and the punctuation of its blocks are summed and divided by the number of blocks, link texts counting
nothing. These ratios are smoothed over neighbouring blocks, fused with those of the enclosing container, and blocks
that stay under a share of the page's mean are left out, inside an article or main element as elsewhere. Tags and names
are weights of the ratios: elements that are hidden or whose tag, role, class or id names navigation, page headers and
footers, sidebars, notices, adverts, forms or comments weigh little; blocks outside the page's article or main elements
weigh as much as the share of the text that lies there, and blocks inside them more. Being a form, being hidden, or a
role, class or id counts nothing for an element that holds most of the page's text, unless an article or main element
stands beside it. Scripts and styles are no text.

Null and empty pages, and pages without text, give an empty text. Unclosed and misnested tags are closed as
browsers do for paragraphs, list items and table cells; an unfinished tag at the end is dropped. Repeated rows give
equal texts.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?¿¡。，、；：！？]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg math iframe object select option canvas video audio".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_CHROME_TAGS = frozenset("nav footer aside button dialog head menu fieldset".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promotions banner nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs footer sidebar sidebars aside rail widget widgets cookie cookies consent "
    "gdpr notice notices notification notifications alert popup modal overlay comment comments disqus reply replies respond "
    "discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "search form toolbar pagination pager copyright disclaimer skip teaser teasers trending".split()
)
#: Names that articles use too: inside article and main they count only for elements with this share of linked text.
_LOOSE_NAMES = frozenset(
    "aside discussion form head menu notice notices notification popup rail related reply replies respond search share sharing "
    "skip social submenu trending widget widgets".split()
)
LINKED = 0.3
_HEADER_NAMES = frozenset("header masthead topbar".split())
_MAIN_TAGS = frozenset(("article", "main"))
_NEVER_CHROME = frozenset(("html", "body", "article", "main"))
_CLOSES = {  # a start tag that ends open elements of these tags, up to the nearest container
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "body": ("head",),
}
_LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Blocks whose fused ratio is under this share of the page's mean are left out.
THRESHOLD = 0.15
#: Weight of hidden and named elements, and the least of blocks outside article and main; what a block inside counts in
#: the comparison with the mean.
LITTLE, INSIDE = 0.05, 5.0
#: Share of the page's text from which an element is no form or name; share of its text that an article beside it needs.
MOST, BESIDE = 0.7, 0.05
#: What one mark of punctuation counts, in characters.
MARK_WEIGHT = 8.0


@dataclass
class Block:
    """``path`` and ``named`` are numbers of the tag path and of the innermost named element, -1 without one."""

    path: int
    chrome: bool
    named: int
    main: bool
    text: str
    linked: int


@dataclass
class _Open:
    tag: str
    chrome: bool
    named: int
    main: bool
    path: int


@dataclass
class _Page:
    """Paths and named elements point to the one around them, so a block costs the same at any depth.

    ``outer`` is that of each named element (forms, hidden and named ones), ``loose`` whether only its look tells it from content;
    ``parents`` is the path one tag shorter, the root its own.
    """

    stack: list[_Open] = field(default_factory=lambda: [_Open("", False, -1, False, 0)])
    opened: Counter = field(default_factory=Counter)
    outer: list[int] = field(default_factory=list)
    loose: list[bool] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [0])
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    blocks: list[Block] = field(default_factory=list)

    def path(self, parent: int, tag: str) -> int:
        if tag in _INLINE:
            return parent
        if (parent, tag) not in self.paths:
            self.paths[parent, tag] = len(self.parents)
            self.parents.append(parent)
        return self.paths[parent, tag]

    def add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.links:
            self.linked += len(text.strip())

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(top.path, top.chrome, top.named, top.main, text, self.linked))
            self.pieces, self.linked = [], 0

    def close(self, tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in limits:
                break
            if self.stack[at].tag in tags:
                self._pop_to(at)
                break

    def _pop_to(self, at: int) -> None:
        self.links -= sum(x.tag == "a" for x in self.stack[at:])
        self.opened.subtract(x.tag for x in self.stack[at:])
        del self.stack[at:]

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
        if tag in _VOID:
            if tag == "hr":
                self.flush()
            return
        if tag not in _INLINE:
            self.flush()
            self.close(("p",), ("td", "th", "li", "div", "section", "article", "main", "body", "table", "blockquote"))
            if tag in _CLOSES:
                self.close(_CLOSES[tag], _LIMITS.get(tag, ()))
        top = self.stack[-1]
        named, evidence = top.named, _FIRM if tag == "form" else _named_chrome(tag, attrs, top.main)
        if evidence:
            self.outer.append(named)
            self.loose.append(evidence == _LOOSE)
            named = len(self.outer) - 1
        chrome = tag in _CHROME_TAGS or (tag == "header" and not top.main)
        self.links += tag == "a"
        self.opened[tag] += 1
        self.stack.append(_Open(tag, top.chrome or chrome, named, top.main or tag in _MAIN_TAGS, self.path(top.path, tag)))
        if not top.main and 'main' in attrs and _attribute(attrs, "role") == "main":
            self.stack[-1].main = True

    def end(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        if self.opened[tag] <= 0:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                self._pop_to(at)
                return
            if tag in _INLINE and self.stack[at].tag not in _INLINE:
                return


def _attribute(attrs: str, name: str) -> str:
    for key, *values in _ATTR.findall(attrs):
        if key.lower() == name:
            return html.unescape("".join(values)).strip()
    return ""


_FIRM, _LOOSE = 2, 1


def _named_chrome(tag: str, attrs: str, main: bool) -> int:
    """Whether role, class, id or visibility say that the element is no content; a name says so as a whole or by its last part."""
    if not attrs.strip() or tag in _NEVER_CHROME:
        return 0
    found = 0
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return _FIRM
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _FIRM
        if key == "role" and value.strip().lower() in _CHROME_ROLES:
            return _FIRM
        if key in ("class", "id"):
            for name in value.split():
                parts = [part.lower() for part in _PART.findall(name)]
                for said in {"".join(parts), *parts[-1:]}:
                    if said in _CHROME_NAMES or said in _HEADER_NAMES and not main:
                        found = max(found, _LOOSE if main and said in _LOOSE_NAMES else _FIRM)
    return found


def parsed(page: str) -> _Page:
    made, at = _Page(), 0
    for token in iter(lambda: _TOKEN.search(page, at), None):
        if token.start() > at:
            made.add(page[at:token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            if token[0].startswith("<![CDATA["):
                made.pieces.append(token[0][9:].removesuffix("]]>"))
            continue
        tag, attrs = tag.lower(), token["attrs"] or ""
        if token["end"]:
            made.end(tag)
        elif tag in _RAW:
            if not attrs.endswith("/"):
                closing = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = closing.end() if closing else len(page)
        else:
            made.start(tag, attrs)
    if at < len(page) and not page.startswith("<", at):
        made.add(page[at:])
    made.flush()
    return made


def weights(page: _Page) -> tuple[np.ndarray, np.ndarray]:
    """For each block, what its tags and names leave of its ratio, and whether it stands in an article or main freely."""
    blocks = page.blocks
    own = np.array([max(len(b.text) - b.linked, 0) for b in blocks], dtype=float)
    total, held, linked = 0.0, [0.0] * len(page.outer), [0] * len(page.outer)
    for block, length in zip(blocks, own):
        if not block.chrome:
            total += length
            if block.named >= 0:
                held[block.named] += length
                linked[block.named] += block.linked
    for name in range(len(page.outer) - 1, -1, -1):  # an element comes after the one around it
        if page.outer[name] >= 0:
            held[page.outer[name]] += held[name]
            linked[page.outer[name]] += linked[name]
    beside = sum(n for b, n in zip(blocks, own) if b.main and not b.chrome and b.named < 0)
    lifted = []
    for name, (n, links) in enumerate(zip(held, linked)):
        most = n >= MOST * total and beside < BESIDE * n
        lifted.append((most or page.loose[name] and links < LINKED * (n + links)) and (page.outer[name] < 0 or lifted[page.outer[name]]))
    free = np.array([not b.chrome and (b.named < 0 or lifted[b.named]) for b in blocks])
    main = np.array([b.main for b in blocks]) & free
    outside = max(1 - own[main].sum() / max(own[free].sum(), 1), LITTLE) if main.any() else 1.0
    return np.where(free, 1.0, LITTLE) * np.where(main, 1.0, outside), main


def path_ratios(blocks: list[Block], weight: np.ndarray) -> np.ndarray:
    """Text and punctuation of a block's path by the path's number of blocks of its weight; links count nothing."""
    mass, count = defaultdict(float), defaultdict(int)
    for block, w in zip(blocks, weight):
        length = max(len(block.text) - block.linked, 0)
        mass[block.path, w] += length + MARK_WEIGHT * len(_PUNCTUATION.findall(block.text)) * (length > 0)
        count[block.path, w] += 1
    return np.array([mass[b.path, w] / count[b.path, w] for b, w in zip(blocks, weight)])


def smoothed(values: np.ndarray, weight: np.ndarray, radius: int = 2) -> np.ndarray:
    """Weighted Gaussian mean over neighbouring blocks."""
    kernel = np.exp(-0.5 * np.arange(-radius, radius + 1) ** 2)
    total = np.convolve(weight, kernel)[radius:radius + len(values)]
    return np.convolve(values * weight, kernel)[radius:radius + len(values)] / total


def fused(page: _Page, ratios: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Geometric mean of a block's ratio with that of its container, the mean of its blocks by length and weight."""
    mass, length = defaultdict(float), defaultdict(float)
    parents = [page.parents[b.path] for b in page.blocks]
    for block, parent, ratio, w in zip(page.blocks, parents, ratios, weight):
        for container in (parent, page.parents[parent]):
            mass[container] += ratio * len(block.text) * w
            length[container] += len(block.text) * w
    around = np.array([mass[parent] / length[parent] for parent in parents])
    return np.sqrt(ratios * around)


def main_text(html_text: str) -> str:
    page = parsed(html_text)
    blocks = page.blocks
    if not blocks:
        return ""
    weight, main = weights(page)
    ratios = path_ratios(blocks, weight)
    scores = fused(page, smoothed(ratios * weight, weight), weight)
    lengths = np.array([len(b.text) for b in blocks]) * weight
    mean = float((scores * lengths).sum() / lengths.sum())
    # A path that is all links has no text of its own.
    chosen = (scores * weight * np.where(main, INSIDE, 1.0) >= THRESHOLD * mean) & (ratios > 0)
    return " ".join(b.text for b, c in zip(blocks, chosen) if c)


def extract(pages: DataFrame, column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of ``column``; a column named ``name`` is replaced."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.fillna("").map(main_text)

    return pages.withColumn(name, extracted(F.col(column)))
