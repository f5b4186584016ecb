"""Repository files and web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolens.functions.clock import Clock, now
from echolens.functions.text import computed_once, is_filled, strip
from echolens.operators.plan import evaluated_once
from echolens.sources.html import extract_pages
from echolens.sources.landing import to_messages

# File name rules and the shortest text worth keeping.
README_NAMES = ("readme.md", "readme.rst", "readme.txt")
SKIPPED_PARTS = ("test_", "_test.py", "__init__", "__pycache__")
BINARY_EXTENSIONS = (".png", ".jpg", ".gif", ".pdf", ".zip")
SHORTEST_TEXT = 100
QUOTES = '"""'


def doc_files(files: DataFrame, per_repo: int | None = None) -> DataFrame:
    """Readme and example files that are long enough, of the first ``per_repo`` of each repository if given.

    A rank is then cut to ``per_repo`` rows per repository in every task before the shuffle.
    """
    path = F.col("path")
    lower = F.lower(path)
    readme = F.lit(False)
    for name in README_NAMES:
        readme = readme | lower.endswith(name)
    skipped = F.lit(False)
    for part in SKIPPED_PARTS:
        skipped = skipped | lower.contains(part)
    example = path.endswith(".py") & path.contains("/") & ~skipped
    chosen = files.where(readme | example)
    if per_repo is not None:
        order = Window.partitionBy("owner", "repo").orderBy("position", "path")
        chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_repo).drop("rank")
    return chosen.where(F.length("content") >= SHORTEST_TEXT)


def _docstring(lines: Column) -> Column:
    def first_line(among: Column, test) -> Column:
        return F.array_position(F.transform(among, lambda line: test(strip(line), F.lit(QUOTES))), F.lit(True))

    start = first_line(lines, F.startswith).cast("int")
    first = strip(F.get(lines, start - 1))
    one_line = F.endswith(first, F.lit(QUOTES)) & (F.length(first) > 3)
    opening = F.array(F.substring(first, F.lit(4), F.length(first)))
    rest = F.slice(lines, start + 1, F.size(lines))
    end = first_line(rest, F.endswith).cast("int")
    last = strip(F.get(rest, end - 1))
    closed = F.concat(
        F.slice(rest, 1, F.greatest(end - 1, F.lit(0))),
        F.array(F.substring(last, F.lit(1), F.length(last) - 3)),
    )
    text = F.when(
        one_line, F.substring(first, F.lit(4), F.greatest(F.length(first) - 6, F.lit(0)))
    ).otherwise(F.array_join(F.concat(opening, F.when(end > 0, closed).otherwise(rest)), "\n"))
    return F.when(start > 0, strip(text))


def python_doc(content: Column, path: Column, module: str, most_lines: int | None = None) -> Column:
    """Module docstring of a Python file, then the whole file where it imports ``module``.

    NULL when there is neither. With ``most_lines`` the docstring must open within so many lines, and one that does
    not close within them ends there; else one that does not close runs to the end.
    """
    lines = F.split(content, "\n", -1)
    lines = lines if most_lines is None else F.slice(lines, 1, most_lines)
    docstring = computed_once(lines, _docstring)
    imports = content.contains(f"import {module}") | content.contains(f"from {module}")
    example = F.when(
        imports, F.concat(F.lit("\n\n--- Code Example: "), path, F.lit(" ---\n\n"), content)
    )
    return F.when(
        docstring.isNotNull() | example.isNotNull(), F.concat_ws("\n", docstring, example)
    )


def file_texts(files: DataFrame, module: str) -> DataFrame:
    """Readme text as it is, Python files by ``python_doc``; files that give nothing are dropped."""
    path = F.col("path")
    text = F.when(path.endswith(".py"), python_doc(F.col("content"), path, module)).otherwise(
        F.col("content")
    )
    kept = [name for name in files.columns if name != "content"]
    rows = evaluated_once(files, *kept, content=text)
    return rows.where(is_filled(F.col("content")))


def file_messages(files: DataFrame, module: str, as_of: Clock = None, per_repo: int | None = None) -> DataFrame:
    repo = F.concat_ws("/", "owner", "repo")
    return to_messages(
        file_texts(doc_files(files, per_repo), module),
        "docs",
        F.concat_ws(
            "_", F.lit("github"), F.col("owner"), F.col("repo"), F.replace(F.col("path"), F.lit("/"), F.lit("_"))
        ),
        as_of=as_of,
        content=F.col("content"),
        title=F.element_at(F.split("path", "/"), -1),
        url=F.concat(F.lit("https://github.com/"), repo, F.lit("/blob/main/"), F.col("path")),
        created_at=now(as_of),
        content_type=F.lit("documentation"),
        metadata=F.struct(repo.alias("repo"), "path", F.lit("github_file").alias("type")),
    )


def url_path(url: Column) -> Column:
    """Path of a URL, without query, fragment and the parameters of its last segment."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, ";[^/]*$", "")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def crawlable(url: Column, host: str, prefix: str = "/docs") -> Column:
    path = url_path(url)
    binary = F.lit(False)
    for extension in BINARY_EXTENSIONS:
        binary = binary | path.endswith(extension)
    return (
        url_host(url).isin("", host)
        & path.startswith(prefix)
        & (F.regexp_extract(url, "#(.*)$", 1) == "")
        & ~binary
    )


def page_texts(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by the ``title`` and ``content`` of the page; short pages are dropped."""
    return extract_pages(pages).where(F.length("content") >= SHORTEST_TEXT)


def page_messages(pages: DataFrame, is_docs: bool = False, as_of: Clock = None) -> DataFrame:
    """Pages as messages. Ids always carry the docs prefix, whatever the source."""
    path = url_path(F.col("url"))
    name = F.replace(F.btrim(path, F.lit("/")), F.lit("/"), F.lit("_"))
    return to_messages(
        page_texts(pages.select("url", "html")),
        "docs" if is_docs else "blog",
        F.when(name == "", F.lit("index")).otherwise(name),
        id_prefix="docs",
        as_of=as_of,
        content=F.col("content"),
        title=F.col("title"),
        url=F.col("url"),
        created_at=now(as_of),
        content_type=F.lit("documentation"),
        metadata=F.struct(
            F.lit(is_docs).alias("is_docs"), F.get(F.split(path, "/", -1), F.lit(2)).alias("section")
        ),
    )


@F.pandas_udf(T.StringType())
def _join_dotted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for bases, hrefs in batches:
        yield pd.Series(
            [None if href is None else urljoin(base, href) for base, href in zip(bases, hrefs)]
        )


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base``; only hrefs with dot segments leave the JVM."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*[^?#]*/)", 1)
    dotted = href.rlike(r"(^|/)\.\.?(/|[?#]|$)")
    plain = (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .when(folder == "", F.concat(origin, F.lit("/"), href))
        .otherwise(F.concat(folder, href))
    )
    return F.when(dotted, _join_dotted(base, F.when(dotted, href))).otherwise(plain)


@F.pandas_udf(T.StringType())
def _unescaped(hrefs: pd.Series) -> pd.Series:
    return hrefs.map(lambda href: None if href is None else unescape(href))


def decoded(href: Column) -> Column:
    """``href`` without character references; only one that has any leaves the JVM."""
    has_any = href.contains("&")
    return F.when(has_any, _unescaped(F.when(has_any, href))).otherwise(href)


def page_links(pages: DataFrame, marker: str = "/blog/") -> DataFrame:
    """Distinct absolute targets of links whose href contains ``marker`` and is more than it."""
    visible = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    value = r"""(?i)<a\s(?:(?:"[^"]*"|'[^']*'|[^>"'])*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
    hrefs = F.regexp_extract_all(visible, F.lit(value), 1)
    links = pages.select("url", F.explode(F.array_distinct(hrefs)).alias("href"))
    href = F.regexp_replace("href", r"""^(["'])(.*)\1$""", "$2")
    links = links.select("url", decoded(href).alias("href")).where(
        F.col("href").contains(marker) & (F.col("href") != marker)
    )
    return links.select(absolute_url(F.col("url"), F.col("href")).alias("link")).distinct()
