"""The frames behind each page: one per panel, nothing computed until a panel is read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from echolens.functions.clock import Clock
from echolens.operators import filters, metrics, replies, triage


def dashboard(messages: DataFrame, as_of: Clock = None) -> dict[str, DataFrame]:
    return {
        "stats": metrics.voice_stats(messages),
        "positive_pct": metrics.positive_pct(messages),
        "unanswered_questions": replies.unanswered_count(messages, as_of=as_of),
        "new_bug_reports": metrics.new_bug_reports(messages, as_of=as_of),
        "sentiment_data": metrics.sentiment_moving_avg(messages, as_of=as_of),
        "topics": metrics.top_topics(messages),
        "sources": metrics.by_source(messages, voice_only=True),
        "pain_points": metrics.pain_points(messages, as_of=as_of),
        "high_impact": triage.high_impact_cards(messages, as_of=as_of),
        "recent_messages": filters.recent_voice(messages),
        "uncategorized": filters.as_cards(filters.uncategorized(messages, as_of=as_of), 100, 120),
    }


def explorer(
    messages: DataFrame, search: triage.Search = triage.Search(), as_of: Clock = None
) -> dict[str, DataFrame]:
    return {
        "facets": filters.facet_values(messages),
        "topics": filters.facet_topics(messages),
        "messages": triage.explore(messages, search, as_of),
    }


def admin(messages: DataFrame, state: DataFrame) -> dict[str, DataFrame]:
    return {
        "snapshot": metrics.processing_snapshot(messages),
        "sources": metrics.source_freshness(messages, state),
        "coverage": metrics.sentiment_coverage(messages),
        "corpus": metrics.corpus_split(messages),
        "samples": filters.sample_rows(messages),
    }
