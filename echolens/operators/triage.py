"""Impact-ranked lists and the explorer search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.functions.clock import Clock, days_before_now
from echolens.functions.scoring import explorer_impact_score, impact_score, topics_array
from echolens.operators.filters import as_cards, is_voice, newest, within_days
from echolens.operators.replies import some_with_has_reply
from echolens.schemas import KNOWLEDGE_SOURCES

# Triage names, sort orders and the score that counts as high impact.
BUG_REPORTS = "bug_reports"
FEATURE_REQUESTS = "feature_requests"
UNANSWERED = "unanswered_questions"
HIGH_IMPACT = "high_impact"
NEWEST, MOST_NEGATIVE, HIGHEST_IMPACT = "newest", "most_negative", "highest_impact"
HIGH_IMPACT_SCORE = 6.0
#: Rows of a page that are broadcast to find its texts.
BROADCAST_PAGE = 10_000


def high_impact(
    messages: DataFrame,
    days: int = 30,
    candidates: int | None = None,
    limit: int = 8,
    as_of: Clock = None,
) -> DataFrame:
    """Best-scored voice messages of the window that are not neutral; of the newest ``candidates`` only, if given."""
    sentiment = F.col("sentiment_simple")
    rows = messages.where(
        is_voice() & within_days(days, as_of) & ((sentiment != "neutral") | sentiment.isNull())
    )
    scored = newest(rows, candidates).withColumn("impact_score", impact_score(as_of))
    return (
        scored.orderBy(F.desc("impact_score"), F.desc("created_at"), "id")
        .limit(limit)
        .select(
            "id", "title", "content", "source", "created_at", "sentiment_simple",
            "sentiment_rich", "content_type", "metadata", "url", "impact_score",
        )
    )


def high_impact_cards(messages: DataFrame, limit: int = 6, as_of: Clock = None) -> DataFrame:
    cards = as_cards(high_impact(messages, limit=limit, as_of=as_of))
    return cards.select("id", "title", "source", "created_at", "sentiment_simple", "url", "impact_score")


@dataclass(frozen=True)
class Search:
    """Explorer settings. ``days`` None means all time; empty tuples mean no restriction."""

    sources: tuple[str, ...] = ()
    sentiments: tuple[str, ...] = ()
    content_types: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    text: str = ""
    days: int | None = None
    triage: tuple[str, ...] = ()
    sort: str = NEWEST
    limit: int | None = None
    offset: int = 0


def explore(messages: DataFrame, search: Search = Search(), as_of: Clock = None) -> DataFrame:
    """All matching messages in the order asked for, then the page of ``limit`` rows after ``offset``.

    Every filter acts before the page is cut, so a page is full as long as there are rows. Filters, replies and the order of
    a page work on narrow rows; texts are joined to the rows that are shown. Of the texts only those move that pass all
    filters but the one that asks for replies. Where all rows are shown, texts move once, to their place in the order, and who
    has a reply goes there too.
    """
    matching = _matching(messages, search, as_of)
    shown = {
        "sentiment": F.coalesce("sentiment_simple", F.lit("neutral")),
        "content_type": F.coalesce("content_type", F.lit("discussion")),
        "impact_score": explorer_impact_score(),
    }
    columns = (
        "id", "source", "content", "author", "created_at", "sentiment", "sentiment_rich", "content_type", "topics", "metadata",
        "url", "title", "impact_score", "has_reply",
    )
    unread = F.lit(False).alias("has_reply")  # as if nobody had replied: no row is lost here
    texts = _narrowed(matching.withColumns(shown).select("*", unread), search).select(*columns[:-1])
    if search.limit is None and not search.offset:
        return _all_sorted(texts.where(F.col("id").isNotNull()), messages, search).select(*columns)
    narrow = matching.select("id", "created_at", "topics", *[column.alias(name) for name, column in shown.items()])
    narrow = _sorted(_narrowed(some_with_has_reply(narrow, messages), search), search.sort)
    narrow = narrow.offset(search.offset) if search.offset else narrow
    narrow = narrow if search.limit is None else narrow.limit(search.limit)
    if search.limit is not None and search.limit <= BROADCAST_PAGE:
        narrow = F.broadcast(narrow)  # as many rows as the limit says
    page = texts.drop(*[name for name in narrow.columns if name != "id"]).join(narrow, "id")
    return _sorted(page.select(*columns), search.sort)


def _all_sorted(rows: DataFrame, messages: DataFrame, search: Search) -> DataFrame:
    """``rows`` that match once it is known who has a reply, in order.

    Rows and, without their texts, those with a reply are dealt to ranges of the order, where each row finds its own by the order's
    columns, of which the id is one.
    """
    keyed, order, keys = _keyed(rows, search.sort)
    replied = some_with_has_reply(keyed.select(*keys), messages).where("has_reply")
    both = keyed.unionByName(replied.withColumn("_reply", F.lit(True)), allowMissingColumns=True).repartitionByRange(*order)
    known = both.withColumn("has_reply", F.coalesce(F.max("has_reply").over(Window.partitionBy(*keys)), F.lit(False)))
    return _narrowed(known.where(F.col("_reply").isNull()), search).orderBy(*order)


def _keyed(rows: DataFrame, sort: str) -> tuple[DataFrame, list[Column], list[str]]:
    """``rows`` with the columns that the order needs, the order, and these columns' names."""
    order, keys = [F.desc("created_at"), F.asc("id")], ["created_at", "id"]
    if sort in (MOST_NEGATIVE, HIGHEST_IMPACT):  # a score has two decimals; equal doubles would be normalised, and dealt anew for it
        rows = rows.withColumn("_impact", F.col("impact_score").cast("decimal(18,2)"))
        order, keys = [F.desc("_impact"), *order], ["_impact", *keys]
    if sort == MOST_NEGATIVE:
        sentiment = F.col("sentiment")
        rank = F.when(sentiment == "negative", 0).when(sentiment == "neutral", 1).when(sentiment == "positive", 2).otherwise(3)
        rows, order, keys = rows.withColumn("_rank", rank), [F.asc("_rank"), *order], ["_rank", *keys]
    return rows, order, keys


def _matching(messages: DataFrame, search: Search, as_of: Clock) -> DataFrame:
    # Naming a knowledge source lifts the voice filter; the source list itself still applies.
    if not set(search.sources) & set(KNOWLEDGE_SOURCES):
        messages = messages.where(is_voice())
    chosen = {
        "source": search.sources,
        "sentiment_simple": search.sentiments,
        "content_type": search.content_types,
    }
    for column, values in chosen.items():
        if values:
            messages = messages.where(F.col(column).isin(*values))
    if search.days:
        messages = messages.where(F.col("created_at") >= days_before_now(search.days, as_of))
    text = search.text.strip().lower()
    if text:
        # "%" and "_" of the search text stay wildcards; a backslash is an ordinary character.
        pattern = "%" + text.replace("\\", "\\\\") + "%"
        messages = messages.where(
            F.lower("content").like(pattern) | F.lower(F.coalesce("title", F.lit(""))).like(pattern)
        )
    return messages


def _narrowed(page: DataFrame, search: Search) -> DataFrame:
    if search.topics:
        wanted = F.array(*[F.lit(topic) for topic in search.topics])
        page = page.where(F.arrays_overlap(topics_array(F.col("topics")), wanted))
    kind = F.col("content_type")
    masks = {
        BUG_REPORTS: kind == "bug_report",
        FEATURE_REQUESTS: kind == "feature_request",
        UNANSWERED: (kind == "question") & ~F.col("has_reply"),
        HIGH_IMPACT: F.col("impact_score") >= HIGH_IMPACT_SCORE,
    }
    chosen = [masks[name] for name in search.triage if name in masks]
    return page.where(reduce(or_, chosen)) if chosen else page


def _sorted(page: DataFrame, sort: str) -> DataFrame:
    keyed, order, _ = _keyed(page, sort)
    return keyed.orderBy(*order).select(*page.columns)
