"""Filters, facets and ordered lists over ``messages``."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions.clock import Clock, days_before_midnight, timestamp
from echolens.functions.scoring import topics_array
from echolens.functions.text import display_title, safe_url
from echolens.schemas import KNOWLEDGE_SOURCES


def is_knowledge() -> Column:
    return F.col("source").isin(*KNOWLEDGE_SOURCES)


def is_voice() -> Column:
    return ~is_knowledge()


def within_days(days: int, as_of: Clock = None) -> Column:
    return F.col("created_at") >= days_before_midnight(days, as_of)


def newest(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """Newest ``limit`` rows after ``offset``; ``id`` makes the order total. Without either, all rows unsorted."""
    if limit is None and not offset:
        return rows
    ordered = rows.orderBy(F.desc("created_at"), "id")
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def get_messages(
    messages: DataFrame,
    source: str | None = None,
    start: date | datetime | None = None,
    end: date | datetime | None = None,
    sentiment: str | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """Page of messages; both date bounds are inclusive."""
    if source:
        messages = messages.where(F.col("source") == source)
    if start:
        messages = messages.where(F.col("created_at") >= timestamp(start))
    if end:
        messages = messages.where(F.col("created_at") <= timestamp(end))
    if sentiment:
        messages = messages.where(F.col("sentiment_simple") == sentiment)
    return newest(messages, limit, offset)


def limit_per_run(messages: DataFrame, limit: int) -> DataFrame:
    return newest(messages, limit)


def sample_rows(messages: DataFrame, limit: int = 5) -> DataFrame:
    return messages.select("id", "title").orderBy("id").limit(limit)


def facet_values(messages: DataFrame) -> DataFrame:
    """Distinct sources, sentiments and content types as (facet, value), in one pass."""
    names = ("source", "sentiment_simple", "content_type")
    # The distinct combinations are few, so the unpivot runs on hundreds of rows.
    combinations = messages.select(*names).distinct()
    pairs = F.explode(
        F.array(*[F.struct(F.lit(name).alias("facet"), F.col(name).alias("value")) for name in names])
    )
    return (
        combinations.select(pairs.alias("p"))
        .select("p.facet", "p.value")
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("facet", "value")
    )


def facet_topics(messages: DataFrame) -> DataFrame:
    topics = messages.where(F.col("topics") != "[]").select(
        F.explode(topics_array(F.col("topics"))).alias("topic")
    )
    return topics.distinct().orderBy("topic")


def recent_voice(messages: DataFrame, limit: int = 6) -> DataFrame:
    rows = messages.where(is_voice() & F.col("title").isNotNull())
    return newest(rows, limit).select("id", "title", "source", "sentiment_simple", "created_at")


def recent_negative(messages: DataFrame, days: int = 7, limit: int = 20, as_of: Clock = None) -> DataFrame:
    rows = messages.where((F.col("sentiment_simple") == "negative") & within_days(days, as_of))
    return newest(rows, limit).select("id", "title", "source", "sentiment_simple", "created_at")


def recent_questions(messages: DataFrame, days: int = 30, limit: int = 20, as_of: Clock = None) -> DataFrame:
    rows = messages.where((F.col("content_type") == "question") & within_days(days, as_of))
    return newest(rows, limit).select("id", "title", "source", "created_at", "url")


def uncategorized(messages: DataFrame, days: int = 30, limit: int = 20, as_of: Clock = None) -> DataFrame:
    """Voice messages without a topic, or with the topic "other" among theirs."""
    topics = topics_array(F.col("topics"))
    no_topic = (
        F.col("topics").isNull()
        | (F.col("topics") == "[]")
        | F.coalesce(F.array_contains(topics, "other"), F.lit(False))
    )
    rows = messages.where(is_voice() & within_days(days, as_of) & no_topic)
    return newest(rows, limit).select(
        "id", "title", "content", "source", "created_at", "sentiment_simple", "url"
    )


def as_cards(rows: DataFrame, from_content: int = 140, longest: int | None = None) -> DataFrame:
    """Replace title and url by what a list shows: a never-empty title and a web link or ``#``."""
    return rows.withColumns(
        {
            "title": display_title(F.col("title"), F.col("content"), from_content, longest),
            "url": safe_url(F.col("url")),
            "sentiment_simple": F.coalesce("sentiment_simple", F.lit("unknown")),
        }
    ).drop("content")
