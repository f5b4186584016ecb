"""JSON field access and the two impact scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echolens.functions.clock import Clock, age_in_days
from echolens.schemas import FRICTION_EMOTIONS

# JSON scalars that count as absent when a fallback field exists.
_FALSY = ("", "0", "0.0", "-0", "-0.0", "false", "[]", "{}")


def topics_array(topics: Column) -> Column:
    """Topics text as an array; NULL where it is missing or not a JSON array."""
    return F.from_json(topics, "array<string>")


def metadata_int(metadata: Column, field: str, fallback: str) -> Column:
    """Integer under ``field``, or under ``fallback`` when that is absent or zero; else 0."""
    parsed = F.try_parse_json(metadata)

    def text(name: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", "string")

    def number(name: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", "bigint")

    present = text(field).isNotNull() & ~text(field).isin(*_FALSY)
    return F.coalesce(F.when(present, number(field)).otherwise(number(fallback)), F.lit(0))


def engagement(shredded: bool = False) -> tuple[Column, Column]:
    """Comments and points of a message, from its metadata or from the columns of a shredded table."""
    if shredded:
        return F.col("comments"), F.col("points")
    metadata = F.col("metadata")
    return metadata_int(metadata, "num_comments", "comments"), metadata_int(metadata, "points", "score")


def _base_score(sentiment: Column, emotion: Column, content_type: Column, shredded: bool) -> Column:
    comments, points = engagement(shredded)
    mood = F.when(sentiment == "negative", 4.0).when(sentiment == "neutral", 1.0).otherwise(0.0)
    friction = F.when(emotion.isin(*FRICTION_EMOTIONS), 2.0).otherwise(0.0)
    kind = (
        F.when(content_type == "bug_report", 3.0)
        .when(content_type == "feature_request", 2.0)
        .when(content_type == "question", 1.0)
        .otherwise(0.0)
    )
    # Only an upper cap: negative points lower the score.
    attention = F.least(comments / F.lit(5.0), F.lit(3.0)) + F.least(points / F.lit(20.0), F.lit(3.0))
    return mood + friction + kind + attention


def impact_score(as_of: Clock = None, shredded: bool = False) -> Column:
    """Dashboard form: engagement, sentiment and kind, plus up to two points for recency."""
    base = _base_score(
        F.col("sentiment_simple"), F.col("sentiment_rich"), F.col("content_type"), shredded
    )
    age = age_in_days(F.col("created_at"), as_of)
    recency = F.when(
        F.col("created_at").isNotNull(), F.greatest(F.lit(0.0), F.lit(2.0) - age / F.lit(7.0))
    ).otherwise(0.0)
    return F.round(base + recency, 2)


def explorer_impact_score(shredded: bool = False) -> Column:
    """Explorer form: no recency, and a missing sentiment counts as neutral."""
    base = _base_score(
        F.coalesce(F.col("sentiment_simple"), F.lit("neutral")),
        F.col("sentiment_rich"),
        F.coalesce(F.col("content_type"), F.lit("discussion")),
        shredded,
    )
    return F.round(base, 2)
