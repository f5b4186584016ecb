"""Title and main text of an HTML page.

Most pages have one content element and plain markup; regular expressions read those inside the JVM.
Nested elements are beyond a regular expression, so any page that is not plainly of that shape goes
through the standard library's HTML parser in an Arrow-batched UDF, which gets NULL for all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolens.functions.text import strip
from echolens.operators.plan import evaluated_once

# Content elements by preference, and elements whose text is not content.
CONTENT_TAGS = ("article", "main")
CONTENT_CLASSES = ("content", "docs-content", "markdown-body")
DROPPED_TAGS = ("script", "style", "nav", "footer")
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr".split()
)
PAGE = T.StructType().add("title", "string").add("content", "string")

# Entities decoded in the JVM, the ampersand last so that nothing is decoded twice.
_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", "\xa0"),
    ("&amp;", "&"),
)
_ANY_TAG = r"</?[A-Za-z][^>]*>"


def _occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _texts(markup: Column) -> Column:
    """Non-empty trimmed text nodes."""

    def decode(text: Column) -> Column:
        for entity, char in _ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(char))
        return strip(text)

    nodes = F.transform(F.split(markup, _ANY_TAG), decode)
    return F.filter(nodes, lambda text: text != "")


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the column ``html`` by ``title`` and ``content``, NULL without a content element."""
    kept = [name for name in pages.columns if name != html]
    # Scripts, styles and comments separate text nodes as tags do, so a tag takes their place.
    markup = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "<x>")
    rows = evaluated_once(pages, *kept, html, _markup=markup)
    inner = F.regexp_extract("_markup", r"(?is)<article\b[^>]*>(.*)</article\s*>", 1)
    rows = evaluated_once(
        rows,
        *kept,
        html,
        "_markup",
        _body=F.regexp_replace(inner, r"(?is)<(nav|footer)\b[^>]*>.*?</\1\s*>", "<x>"),
        _heading=F.regexp_extract("_markup", r"(?is)<(h1)\b[^>]*>(.*?)</h1\s*>", 2),
    )
    markup, body, heading = F.col("_markup"), F.col("_body"), F.col("_heading")
    odd_text = r"&(?!(?:lt|gt|quot|#39|nbsp|amp);)[#A-Za-z]|<[^A-Za-z/]|</[^A-Za-z]|<$"
    plain = (
        (_occurrences(markup, r"(?i)<article\b") == 1)
        & (_occurrences(markup, r"(?i)</article\s*>") == 1)
        & (_occurrences(markup, r"(?i)<h1\b") == 1)
        & (_occurrences(markup, r"(?i)</h1\s*>") == 1)
        & ~body.rlike(r"(?i)</?(?:nav|footer|script|style|template)\b")
        & ~markup.rlike(r"(?i)<(?:template|textarea|plaintext|xmp)\b|<!\[|<\?|<!--")
        & ~markup.rlike(r"""<[A-Za-z][^<>]*=\s*(?:"[^"<>]*>|'[^'<>]*>)""")
        & ~F.concat(heading, body).rlike(odd_text)
    )
    rows = evaluated_once(rows, *kept, html, "_heading", "_body", _plain=plain)
    by_regex = F.struct(
        F.array_join(_texts(heading), "").alias("title"),
        F.array_join(_texts(body), "\n").alias("content"),
    )
    page = F.when(F.col("_plain"), by_regex).otherwise(_parse(F.when(~F.col("_plain"), F.col(html))))
    return evaluated_once(rows.select(*kept, page.alias("_page")), *kept, _page=F.col("_page")).select(
        *kept, "_page.title", "_page.content"
    )


class _Tree(HTMLParser):
    """Element tree as nested lists ``[tag, attributes, children]``; text children are strings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return
        self._separate()

    def handle_data(self, data: str) -> None:
        children = self.open[-1][2]
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)

    def handle_comment(self, data: str) -> None:
        self._separate()

    def _separate(self) -> None:
        """End the current text node; comments and unmatched end tags do."""
        self.open[-1][2].append(["", {}, []])


def _elements(root: list) -> Iterator[list]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(child for child in reversed(node[2]) if not isinstance(child, str))


def _strings(root: list, dropped: tuple[str, ...]) -> list[str]:
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if text := node.strip():
                found.append(text)
        elif node is root or node[0] not in dropped:
            stack.extend(reversed(node[2]))
    return found


def parse_page(html: str) -> tuple[str | None, str | None]:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes = list(_elements(tree.root))

    def first(test) -> list | None:
        return next((node for node in nodes if test(node)), None)

    content = None
    for tag in CONTENT_TAGS:
        content = content or first(lambda node: node[0] == tag)
    for name in CONTENT_CLASSES:
        content = content or first(lambda node: name in (node[1].get("class") or "").split())
    content = content or first(lambda node: node[1].get("role") == "main")
    content = content or first(lambda node: node[0] == "body")
    if content is None:
        return None, None
    heading = first(lambda node: node[0] == "h1") or first(lambda node: node[0] == "title")
    title = None if heading is None else "".join(_strings(heading, ("script", "style", "template")))
    return title, "\n".join(_strings(content, DROPPED_TAGS + ("template",)))


@F.pandas_udf(PAGE)
def _parse(pages: pd.Series) -> pd.DataFrame:
    parsed = [(None, None) if html is None else parse_page(html) for html in pages]
    return pd.DataFrame(parsed, columns=["title", "content"], dtype=object)
