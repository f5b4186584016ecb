"""Who was replied to, kept beside the stored messages: a table from the replied id to its first reply.

A refresh adds the edges of the messages that were inserted since the last one. The table is bucketed by the replied id as the
messages are by id, so questions find their replies where both lie, without a shuffle and without making all reply keys
distinct. Every row names the version of the messages it leads to, in the same write, so a lost refresh is repeated and nothing is
missed. Where messages were removed or written whole in between, the table is written anew.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolens.functions.clock import Clock
from echolens.operators.filters import is_voice, newest, within_days
from echolens.schemas import MESSAGES
from echolens.sources import snapshots

REPLIES = (
    T.StructType()
    .add("replied_id", T.StringType())
    .add("first_reply", T.StringType())
    .add("replied_at", T.TimestampNTZType())
    .add("messages_version", T.LongType())
)


def replies_path(messages_path: str) -> str:
    return messages_path.rstrip("/") + "-replies"


def _edges(messages: DataFrame) -> DataFrame:
    """The first reply of each id that some message names as parent or thread; a thread costs a task one row."""
    targets = F.explode(F.array_distinct(F.array_compact(F.array("parent_id", "thread_id"))))
    named = messages.select(targets.alias("replied_id"), F.struct("created_at", "id").alias("reply"))
    first = named.groupBy("replied_id").agg(F.min("reply").alias("reply"))
    return first.select("replied_id", F.col("reply.id").alias("first_reply"), F.col("reply.created_at").alias("replied_at"))


def refresh(spark: SparkSession, messages_path: str) -> int:
    """Bring the table up to the stored messages; returns its version."""
    path, now = replies_path(messages_path), snapshots.latest_version(spark, messages_path) or 0
    stored = snapshots.read_snapshot(spark, path, REPLIES)
    last = stored.agg(F.max("messages_version")).first()[0]
    whole = last is None
    if not whole:
        changes = snapshots.changes_since(spark, messages_path, last)
        whole = changes.whole or bool(changes.removed)
    messages = snapshots.read_snapshot(spark, messages_path, MESSAGES, since=None if whole else last + 1, wide=False)
    pointer = F.lit(now).cast("long").alias("messages_version")
    rows = _edges(messages).select("*", pointer)
    blank = spark.createDataFrame([(None, None, None, now)], REPLIES)  # the version is known where nothing was added
    buckets = snapshots.buckets_of(spark, messages_path) or snapshots.default_buckets(spark)
    return snapshots.write_snapshot(
        rows.unionByName(blank), path, added=not whole, buckets=replace(buckets, key="replied_id", folders="", apart="")
    )


def read_replies(spark: SparkSession, messages_path: str) -> DataFrame:
    """Edges as refreshes added them; an id that several of them found replies to has a row of each."""
    rows = snapshots.read_snapshot(spark, replies_path(messages_path), REPLIES)
    return rows.where(F.col("replied_id").isNotNull())


def first_replies(spark: SparkSession, messages_path: str) -> DataFrame:
    """One row for each replied id, with its first reply."""
    reply = F.min(F.struct("replied_at", "first_reply")).alias("reply")
    rows = read_replies(spark, messages_path).groupBy("replied_id").agg(reply)
    return rows.select("replied_id", F.col("reply.first_reply").alias("first_reply"), F.col("reply.replied_at").alias("replied_at"))


def unanswered_questions(
    spark: SparkSession, messages_path: str, messages: DataFrame, days: int = 30, limit: int | None = 50,
    voice_only: bool = False, as_of: Clock = None,
) -> DataFrame:
    """``replies.unanswered_questions`` of the stored ``messages``, by the table."""
    asked = messages.where((F.col("content_type") == "question") & within_days(days, as_of))
    asked = asked.where(is_voice()) if voice_only else asked
    asked = asked.select("id", "title", "source", "created_at", "url")
    answered = read_replies(spark, messages_path).select("replied_id")
    rows = asked.join(answered, F.col("id") == F.col("replied_id"), "left_anti")
    return rows if limit is None else newest(rows, limit)


def with_has_reply(spark: SparkSession, messages_path: str, rows: DataFrame) -> DataFrame:
    """Add the flag ``has_reply`` to rows of the stored messages, by the table."""
    replied = first_replies(spark, messages_path).select("replied_id")
    joined = rows.join(replied, F.col("id") == F.col("replied_id"), "left")
    return joined.withColumn("has_reply", F.col("replied_id").isNotNull()).drop("replied_id")
