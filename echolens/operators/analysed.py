"""Messages with what models said about them, kept apart: runs append narrow rows, readers merge them.

A run over a few hundred messages writes a few hundred rows next to the table instead of the table anew. The last
value of each field wins, by ``made_at``, then by version, then by a hash of the row. ``fold`` makes one whole table of both
from time to time. Both tables are bucketed by id alike, so they merge without moving a message: a queue is found in the
narrow columns where they lie, and texts are read for the chosen ids only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolens.functions.clock import Clock, now
from echolens.operators import metrics, tables
from echolens.operators.tables import update_analysis
from echolens.schemas import INGESTION_STATE, MESSAGES, VECTORS
from echolens.sources.snapshots import (
    Buckets, buckets_of, default_buckets, read_apart, read_snapshot, remove, void_column, write_messages, write_snapshot,
)

ANALYSIS = (
    T.StructType()
    .add("id", T.StringType())
    .add("sentiment_simple", T.StringType())
    .add("sentiment_rich", T.StringType())
    .add("content_type", T.StringType())
    .add("topics", T.ArrayType(T.StringType()))
    .add("embedding_id", T.StringType())
    .add("made_at", T.TimestampNTZType())
)


def analysis_path(messages_path: str) -> str:
    return messages_path.rstrip("/") + "-analysis"


def append_analysis(delta: DataFrame, messages_path: str, as_of: Clock = None) -> int:
    """Store the rows of ``delta``, which has ``id`` and any other column of ``ANALYSIS``; returns the version."""
    given = delta.withColumn("made_at", now(as_of))
    rows = given.select(*[
        (F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ANALYSIS
    ])
    return write_snapshot(rows, analysis_path(messages_path), added=True, buckets=_buckets(rows.sparkSession, messages_path))


def _buckets(spark: SparkSession, messages_path: str) -> Buckets:
    return replace(buckets_of(spark, messages_path) or default_buckets(spark), folders="", apart="")


def merged(messages: DataFrame, analysis: DataFrame) -> DataFrame:
    """``messages`` with the last analysis of each; ``processed_at`` is when its last label or topic was made."""
    order = [name for name in ("made_at", "_version") if name in analysis.columns]
    return update_analysis(messages, analysis, order_by=order, stamp="made_at")


def _read_apart(
    spark: SparkSession, messages_path: str, versions: tuple[int, int] | None = None
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The stored messages with their analysis and what adds texts that are kept apart."""
    of_messages, of_analysis = versions or (None, None)
    analysis = read_snapshot(spark, analysis_path(messages_path), ANALYSIS, of_analysis, with_version=True)
    messages, completed = read_apart(spark, messages_path, MESSAGES, of_messages)
    return merged(messages, analysis), lambda rows: completed(rows, tables.ANALYSED).select(*MESSAGES.names)


def read_messages(
    spark: SparkSession, messages_path: str, versions: tuple[int, int] | None = None, texts: bool = True
) -> DataFrame:
    """The stored messages with their analysis, as of now or of ``versions`` of the two tables.

    Unless ``texts`` are asked for, those kept apart are NULL.
    """
    rows, completed = _read_apart(spark, messages_path, versions)
    if texts or "content" in rows.columns:
        return completed(rows)
    return rows.withColumn("content", F.lit(None).cast("string")).select(*MESSAGES.names)


def queued_ids(
    spark: SparkSession, messages_path: str, queue: Callable[[DataFrame, int | None], DataFrame], limit: int | None = None
) -> DataFrame:
    """Ids of a queue of the stored messages. Only the columns that the queue asks for are read, and nothing but a limit's
    candidates is shuffled."""
    return queue(read_messages(spark, messages_path, texts=False), limit).select("id")


def messages_with(spark: SparkSession, messages_path: str, ids: DataFrame) -> DataFrame:
    """Whole rows of the stored messages with these distinct ids."""
    rows, completed = _read_apart(spark, messages_path)
    return completed(rows.join(ids, "id", "left_semi"))


def reset_embeddings(spark: SparkSession, messages_path: str, vectors_path: str) -> int:
    """Forget all vectors and every pointer to one, for good; returns the number of pointers there were.

    The vectors start anew as an empty whole version; both tables that hold pointers are marked. A run lost in between can
    be repeated.
    """
    pointers = read_messages(spark, messages_path, texts=False).where(F.col("embedding_id").isNotNull()).count()
    write_snapshot(spark.createDataFrame([], VECTORS), vectors_path)
    for path in (messages_path, analysis_path(messages_path)):
        void_column(spark, path, "embedding_id")
    return pointers


def clear_source(spark: SparkSession, source: str, messages_path: str, vectors_path: str, state_path: str) -> dict[str, int]:
    """Remove a source from messages, their analysis, vectors and ingestion state; returns the earlier counts by table.

    Messages that are fetched again later start without labels: the analysis loses the ids that the source has now.
    """
    of_source = F.col("source") == source
    messages = read_snapshot(spark, messages_path, MESSAGES, wide=False).where(of_source)
    state = read_snapshot(spark, state_path, INGESTION_STATE)
    counts = {
        "messages": messages.count(), "vectors": read_snapshot(spark, vectors_path, VECTORS).where(of_source).count(),
        "ingestion_state": state.where(of_source).count(),
    }
    remove(messages.select("id"), analysis_path(messages_path))
    for path in (vectors_path, messages_path):
        remove(spark.createDataFrame([(source,)], "source string"), path)
    write_snapshot(tables.clear_source(state, source), state_path)
    return counts


def fold(spark: SparkSession, messages_path: str) -> int:
    """Write messages and their analysis as one whole version, then start an empty analysis."""
    version = write_messages(read_messages(spark, messages_path), messages_path)
    write_snapshot(
        spark.createDataFrame([], ANALYSIS), analysis_path(messages_path), buckets=_buckets(spark, messages_path)
    )
    return version


def refresh_days(spark: SparkSession, messages: DataFrame, touched: DataFrame, metrics_path: str) -> int:
    """Compute the daily rollup anew for the days of ``touched`` messages (all, the first time) and keep the others.

    The rollup has one row per day and source, so writing it whole costs little.
    """
    day = F.to_date("created_at")
    schema = metrics.daily_metrics(messages).schema
    stored = read_snapshot(spark, metrics_path, schema)
    if stored.isEmpty():
        return write_snapshot(metrics.daily_metrics(messages), metrics_path)
    days = touched.select(day.alias("date")).distinct()
    rows = messages.withColumn("date", day).join(days, "date", "left_semi").drop("date")
    return write_snapshot(stored.join(days, "date", "left_anti").unionByName(metrics.daily_metrics(rows)), metrics_path)
