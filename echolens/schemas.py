"""Table schemas and the closed value sets of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The source, label and topic vocabularies.
KNOWLEDGE_SOURCES = ("docs", "blog")
VOICE_SOURCES = ("github", "hackernews", "reddit", "twitter", "slack")
SOURCES = KNOWLEDGE_SOURCES + VOICE_SOURCES
SENTIMENTS = ("positive", "negative", "neutral")
EMOTIONS = ("frustration", "confusion", "delight", "gratitude", "curiosity", "complaint", "neutral")
FRICTION_EMOTIONS = ("frustration", "confusion", "complaint")
CONTENT_TYPES = (
    "question",
    "bug_report",
    "feature_request",
    "praise",
    "complaint",
    "discussion",
    "documentation",
    "announcement",
)
TOPICS = (
    "gpu_availability",
    "pricing",
    "performance",
    "documentation",
    "ease_of_use",
    "reliability",
    "support",
    "functions",
    "volumes",
    "secrets",
    "images",
    "scheduling",
    "web_endpoints",
    "other",
)

_STR = T.StringType()
_NTZ = T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


MESSAGES = _table(
    id=_STR,
    source=_STR,
    source_id=_STR,
    content=_STR,
    title=_STR,
    author=_STR,
    url=_STR,
    parent_id=_STR,
    thread_id=_STR,
    created_at=_NTZ,
    fetched_at=_NTZ,
    processed_at=_NTZ,
    metadata=_STR,
    sentiment_simple=_STR,
    sentiment_rich=_STR,
    content_type=_STR,
    topics=_STR,
    embedding_id=_STR,
)

INGESTION_STATE = _table(
    source=_STR, last_fetched_at=_NTZ, last_item_id=_STR, cursor=_STR, metadata=_STR
)

VECTORS = _table(
    id=_STR,
    text=_STR,
    vector=T.ArrayType(T.FloatType()),
    source=_STR,
    created_at=_NTZ,
    url=_STR,
    metadata=_table(title=_STR),
)

CHAT = T.ArrayType(_table(role=_STR, content=_STR))

LABELS = _table(
    sentiment_simple=_STR,
    sentiment_rich=_STR,
    content_type=_STR,
    topics=T.ArrayType(_STR),
)


def as_messages(rows: DataFrame, **columns: Column) -> DataFrame:
    """Project ``rows`` onto the message schema; columns not given are NULL."""
    return rows.select(
        *[
            columns.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in MESSAGES.fields
        ]
    )
