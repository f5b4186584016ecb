"""Counters, distributions and trends over ``messages``.

Every group key here has few values (day, source, label, topic), so map-side partial aggregation
leaves a handful of rows per task to shuffle, however the rows are spread over the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.functions.clock import Clock
from echolens.functions.scoring import topics_array
from echolens.operators.filters import is_knowledge, is_voice, within_days
from echolens.schemas import FRICTION_EMOTIONS, SENTIMENTS


def _count_rows(name: str = "count") -> Column:
    return F.count("*").alias(name)


def _count_where(column: str, value: str, name: str) -> Column:
    return F.count_if(F.col(column) == value).alias(name)


def _sentiment_counters() -> list[Column]:
    return [_count_where("sentiment_simple", value, value) for value in SENTIMENTS]


def _type_counters() -> list[Column]:
    return [
        _count_where("content_type", "bug_report", "bug_reports"),
        _count_where("content_type", "feature_request", "feature_requests"),
        _count_where("content_type", "question", "questions"),
    ]


def _day() -> Column:
    return F.to_date("created_at").alias("date")


def voice_stats(messages: DataFrame) -> DataFrame:
    return messages.where(is_voice()).agg(
        _count_rows("total_messages"), *_sentiment_counters(), *_type_counters()
    )


def positive_pct(messages: DataFrame) -> DataFrame:
    """Share of positive voice messages in per cent; 0.0 without messages."""
    total, positive = F.col("total_messages"), F.col("positive")
    pct = F.when(total > 0, positive / total * 100).otherwise(0.0)
    return voice_stats(messages).select(pct.alias("positive_pct"))


def new_bug_reports(messages: DataFrame, days: int = 30, as_of: Clock = None) -> DataFrame:
    rows = messages.where(is_voice() & (F.col("content_type") == "bug_report") & within_days(days, as_of))
    return rows.agg(_count_rows("new_bug_reports"))


def summary_stats(messages: DataFrame, days: int = 30, as_of: Clock = None) -> DataFrame:
    """Counters over all sources. Counting per source first needs no distinct aggregate."""
    counters = _sentiment_counters() + _type_counters()
    by_source = (
        messages.where(within_days(days, as_of))
        .groupBy("source")
        .agg(_count_rows("total_messages"), *counters)
    )
    names = [name for name in by_source.columns if name not in ("source", "total_messages")]
    return by_source.agg(
        F.coalesce(F.sum("total_messages"), F.lit(0)).alias("total_messages"),
        F.count("source").alias("sources"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names],
    )


def sentiment_over_time(
    messages: DataFrame, source: str | None = None, days: int = 30, as_of: Clock = None
) -> DataFrame:
    """Rows per day and sentiment; a missing sentiment is a group of its own."""
    rows = messages.where(within_days(days, as_of))
    if source:
        rows = rows.where(F.col("source") == source)
    return rows.groupBy(_day(), "sentiment_simple").agg(_count_rows()).orderBy("date", "sentiment_simple")


def sentiment_daily(messages: DataFrame, days: int = 30, voice_only: bool = False, as_of: Clock = None) -> DataFrame:
    rows = messages.where(within_days(days, as_of))
    if voice_only:
        rows = rows.where(is_voice())
    return rows.groupBy(_day()).agg(*_sentiment_counters()).orderBy("date")


def sentiment_moving_avg(messages: DataFrame, days: int = 30, as_of: Clock = None) -> DataFrame:
    """Three-row moving averages of the daily voice counts; days without messages have no row.

    The window has no partition key, but it only sees one row per day of the look-back.
    """
    last_three = Window.orderBy("date").rowsBetween(-2, Window.currentRow)
    daily = sentiment_daily(messages, days, voice_only=True, as_of=as_of)
    return daily.select("date", *[F.avg(name).over(last_three).alias(name) for name in SENTIMENTS])


def mentions(messages: DataFrame) -> DataFrame:
    """One row per message and topic. Filter before this: it multiplies rows."""
    rows = messages.where(F.col("topics") != "[]")
    return rows.withColumn("topic", F.explode(topics_array(F.col("topics")))).drop("topics")


def _ranked(counts: DataFrame, limit: int | None, measure: str = "count") -> DataFrame:
    ordered = counts.orderBy(F.desc(measure), "topic")
    return ordered if limit is None else ordered.limit(limit)


def topic_distribution(
    messages: DataFrame,
    source: str | None = None,
    days: int = 30,
    limit: int = 20,
    as_of: Clock = None,
) -> DataFrame:
    rows = messages.where(within_days(days, as_of))
    if source:
        rows = rows.where(F.col("source") == source)
    return _ranked(mentions(rows).groupBy("topic").agg(_count_rows()), limit)


def top_topics(messages: DataFrame, limit: int = 10) -> DataFrame:
    rows = mentions(messages.where(is_voice()))
    return _ranked(rows.groupBy("topic").agg(_count_rows()), limit)


def topic_counts(messages: DataFrame) -> DataFrame:
    return _ranked(mentions(messages).groupBy("topic").agg(_count_rows()), None)


def negative_by_topic(messages: DataFrame) -> DataFrame:
    rows = mentions(messages.where(F.col("sentiment_simple") == "negative"))
    counts = rows.groupBy("topic").agg(_count_rows("negative_count"))
    return _ranked(counts, None, "negative_count")


def pain_points(messages: DataFrame, days: int = 30, limit: int = 8, as_of: Clock = None) -> DataFrame:
    """Topics with the most negative and friction mentions."""
    rows = mentions(messages.where(is_voice() & within_days(days, as_of)))
    return (
        rows.groupBy("topic")
        .agg(
            _count_rows("mentions"),
            _count_where("sentiment_simple", "negative", "negative_mentions"),
            F.count_if(F.col("sentiment_rich").isin(*FRICTION_EMOTIONS)).alias("friction_mentions"),
        )
        .orderBy(F.desc(F.col("negative_mentions") + F.col("friction_mentions")), F.desc("mentions"), "topic")
        .limit(limit)
    )


def by_source(messages: DataFrame, voice_only: bool = False) -> DataFrame:
    rows = messages.where(is_voice()) if voice_only else messages
    return rows.groupBy("source").agg(_count_rows()).orderBy(F.desc("count"), "source")


def total_messages(messages: DataFrame) -> DataFrame:
    return messages.agg(_count_rows("total"))


def by_sentiment(messages: DataFrame) -> DataFrame:
    rows = messages.where(F.col("sentiment_simple").isNotNull())
    return (
        rows.groupBy("sentiment_simple").agg(_count_rows()).orderBy(F.desc("count"), "sentiment_simple")
    )


def sentiment_coverage(messages: DataFrame) -> DataFrame:
    label = F.coalesce("sentiment_simple", F.lit("unlabeled")).alias("sentiment")
    return messages.groupBy(label).agg(_count_rows()).orderBy(F.desc("count"), "sentiment")


def corpus_split(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.count_if(is_knowledge()).alias("knowledge_messages"),
        F.count_if(is_voice()).alias("voice_messages"),
    )


def processing_snapshot(messages: DataFrame) -> DataFrame:
    """How far processing has come, in one pass."""
    return messages.agg(
        _count_rows("total_messages"),
        F.count_if(is_voice()).alias("voice_messages"),
        F.count_if(is_knowledge()).alias("knowledge_messages"),
        F.count("processed_at").alias("processed"),
        F.count("embedding_id").alias("embedded"),
        F.count_if(F.col("embedding_id").isNull()).alias("pending_embeddings"),
        F.count_if(F.col("sentiment_simple").isNull()).alias("pending_sentiment"),
    )


def latest_fetch(state: DataFrame) -> DataFrame:
    """The last fetch of every source that the state names, also of sources that the library has no reader for."""
    return state.groupBy("source").agg(F.max("last_fetched_at").alias("last_fetched_at"))


def source_freshness(messages: DataFrame, state: DataFrame) -> DataFrame:
    """Per source: rows, newest message and last fetch."""
    totals = messages.groupBy("source").agg(
        _count_rows("total"), F.max("created_at").alias("latest_message_at")
    )
    joined = totals.join(latest_fetch(state), "source", "left")
    return joined.orderBy(F.desc("total"), "source")


def daily_metrics(messages: DataFrame) -> DataFrame:
    """Full refresh of the (date, source) rollup over processed messages."""
    counters = {
        "positive_count": ("sentiment_simple", "positive"),
        "negative_count": ("sentiment_simple", "negative"),
        "neutral_count": ("sentiment_simple", "neutral"),
        "frustration_count": ("sentiment_rich", "frustration"),
        "confusion_count": ("sentiment_rich", "confusion"),
        "delight_count": ("sentiment_rich", "delight"),
        "gratitude_count": ("sentiment_rich", "gratitude"),
        "questions_count": ("content_type", "question"),
        "bug_reports_count": ("content_type", "bug_report"),
        "feature_requests_count": ("content_type", "feature_request"),
    }
    rows = messages.where(F.col("processed_at").isNotNull()).groupBy(_day(), "source")
    return rows.agg(
        F.count("*").alias("total_messages"),
        *[
            F.count_if(F.col(column) == value).alias(name)
            for name, (column, value) in counters.items()
        ],
        F.lit(None).cast("string").alias("top_topics"),
    )
