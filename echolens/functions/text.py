"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular expression class.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TAG = "<[^>]+>"

# Entities in decoding order. The ampersand goes first, so "&amp;lt;" becomes "<".
ENTITIES = (
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
)

# Words that mark a title as a question, matched as substrings.
TITLE_QUESTION_WORDS = ("how", "why", "what", "help")
FEED_QUESTION_WORDS = TITLE_QUESTION_WORDS + ("can i",)
THREAD_QUESTION_WORDS = ("how", "why", "what", "when", "where", "can i", "is it possible")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(word) for word in words])


def truncate(text: Column, length: int | None) -> Column:
    """The first ``length`` characters; all of them without a length."""
    return text if length is None else F.substring(text, 1, length)


def is_filled(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def decoded(text: Column) -> Column:
    """``text`` with ``ENTITIES`` replaced in their order: looked for at ampersands only, and behind one that was decoded."""
    (ampersand, _), others = ENTITIES[0], ENTITIES[1:]

    def behind(piece: Column, entity: str) -> Column:
        return F.substr(piece, F.lit(len(entity)))

    def named(piece: Column) -> Column:
        found = F.concat(F.lit("&"), piece)
        for entity, char in others:
            found = F.when(piece.startswith(entity[1:]), F.concat(F.lit(char), behind(piece, entity))).otherwise(found)
        return found

    def decode(piece: Column) -> Column:
        twice = computed_once(behind(piece, ampersand), named)
        return F.when(piece.startswith(ampersand[1:]), twice).otherwise(named(piece))

    return F.array_join(F.transform(F.split(text, "&"), lambda piece, i: F.when(i == 0, piece).otherwise(decode(piece))), "")


def strip_html(text: Column) -> Column:
    return F.coalesce(strip(decoded(F.regexp_replace(text, TAG, ""))), F.lit(""))


def clean_content(text: Column) -> Column:
    """Collapse blank lines and spaces, then drop tags, then trim."""
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    text = F.regexp_replace(text, " {2,}", " ")
    return strip(F.regexp_replace(text, TAG, ""))


def preview_text(text: Column, length: int = 220) -> Column:
    text = strip(text)
    cut = F.concat(rstrip(truncate(text, length)), F.lit("..."))
    return F.when(F.length(text) > length, cut).otherwise(text)


def display_title(
    title: Column, content: Column, from_content: int = 140, longest: int | None = None
) -> Column:
    """The title, or the head of the content where there is none, cut to ``longest``."""
    shown = F.when(is_filled(title), title).otherwise(
        truncate(F.coalesce(content, F.lit("")), from_content)
    )
    return truncate(shown, longest or from_content)


def safe_url(url: Column) -> Column:
    web = url.startswith("http://") | url.startswith("https://")
    return F.when(web, url).otherwise(F.lit("#"))


def source_label(source: Column) -> Column:
    return F.initcap(F.replace(source, F.lit("_"), F.lit(" ")))


def title_to_question(title: Column, product: str) -> Column:
    """Question form of a heading; NULL when it is shorter than five characters."""
    title = strip(title)
    lower = F.lower(title)

    def swap(text: Column, *pairs: tuple[str, str]) -> Column:
        for old, new in pairs:
            text = F.replace(text, F.lit(old), F.lit(new))
        return text

    def starts(*heads: str) -> Column:
        return reduce(or_, [lower.startswith(head) for head in heads])

    def ask(lead: str, text: Column, tail: str = "?") -> Column:
        return F.concat(F.lit(lead), text, F.lit(tail))

    how_to = swap(lower, ("how to ", ""), ("getting started with ", "get started with "))
    using = swap(lower, ("using ", "use "), ("working with ", "work with "))
    return (
        F.when(F.length(title) < 5, F.lit(None).cast("string"))
        .when(title.endswith("?"), title)
        .when(starts("how to", "getting started"), ask("How do I ", how_to))
        .when(starts("using", "working with"), ask("How do I ", using))
        .when(
            starts("create", "build", "deploy", "run", "install", "configure"),
            ask("How do I ", lower),
        )
        .when(starts("the", "a ", "an "), ask("What is ", lower))
        .otherwise(ask("What is ", title, f" in {product}?"))
    )


@dataclass(frozen=True)
class RelevanceRules:
    """Keyword lists that tell posts about a brand from other uses of its name."""

    brand: str
    strong: tuple[str, ...]
    false_positive: tuple[str, ...]
    context: tuple[str, ...]

    # Phrase patterns around the brand word.
    STRONG = (
        "{}.com",
        "{} labs",
        "{} cloud",
        "{} serverless",
        "{}.run",
        "{} deploy",
        "@{}",
        "{}.function",
        "{}.app",
        "{}.cls",
        "{}.volume",
        "{}.image",
        "pip install {}",
    )
    FALSE_POSITIVE = (
        "multi{}",
        "multi-{}",
        "{} dialog",
        "{} window",
        "{} popup",
        "{} verb",
        "bi{}",
        "uni{}",
        "inter{}",
    )
    CONTEXT = ("serverless", "gpu cloud", "deploy", "container", "python cloud", "inference api")

    @classmethod
    def for_brand(cls, brand: str) -> RelevanceRules:
        brand = brand.lower()
        return cls(
            brand,
            tuple(pattern.format(brand) for pattern in cls.STRONG),
            tuple(pattern.format(brand) for pattern in cls.FALSE_POSITIVE),
            cls.CONTEXT,
        )


def around(text: Column, word: str, margin: int) -> Column:
    """``text`` without what lies further than ``margin`` characters from every ``word``; NUL stands for what is left out."""

    def ends(piece: Column) -> Column:
        cut = F.concat(F.substring(piece, 1, margin), F.lit("\0"), F.substring(piece, -margin, margin))
        return F.when(F.length(piece) > 2 * margin, cut).otherwise(piece)

    return F.array_join(F.transform(F.split(text, re.sub(r"(\W)", r"\\\1", word)), ends), word)


def is_relevant(title: Column, content: Column, rules: RelevanceRules) -> Column:
    """Strong keyword keeps; else a false friend drops; else the lone brand word needs context.

    Keywords that hold the brand word are looked for around it only.
    """
    lone = f" {rules.brand} "
    margin = max(len(word) for word in (lone, *rules.strong, *rules.false_positive))

    def judge(text: Column, near: Column) -> Column:
        def has(words: tuple[str, ...]) -> Column:
            by_brand = tuple(word for word in words if rules.brand in word)
            others = tuple(word for word in words if rules.brand not in word)
            parts = [contains_any(place, found) for place, found in ((near, by_brand), (text, others)) if found]
            return reduce(or_, parts, F.lit(False))

        alone = F.concat(F.lit(" "), near, F.lit(" ")).contains(lone)
        return (
            F.when(has(rules.strong), True)
            .when(has(rules.false_positive), False)
            .otherwise(alone & contains_any(text, rules.context))
        )

    def judged(text: Column) -> Column:
        if not rules.brand:
            return judge(text, text)
        return computed_once(around(text, rules.brand, margin), lambda near: judge(text, near))

    empty = F.lit("")
    text = F.lower(F.concat(F.coalesce(title, empty), F.lit(" "), F.coalesce(content, empty)))
    return computed_once(text, judged)
