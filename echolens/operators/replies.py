"""Which messages have replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.functions.clock import Clock
from echolens.operators.filters import is_voice, newest, within_days

def reply_keys(messages: DataFrame) -> DataFrame:
    """Distinct ids that some message names as parent or thread.

    An ``OR`` over two key columns would plan as a nested loop join; one key column hash-joins.
    The distinct is pre-aggregated in the map tasks, so a thread with most replies costs one row each.
    """
    targets = F.array_distinct(F.array_compact(F.array("parent_id", "thread_id")))
    return messages.select(F.explode(targets).alias("replied_id")).distinct()


def replied_among(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Distinct ids of ``rows`` that some message names, ``replied_id``.

    The keys are cut down to the ids asked for before anything is made distinct. Where these are few they are broadcast at run
    time and no key is shuffled at all; where they are many, Spark may filter the keys by a Bloom filter of them first.
    """
    targets = F.array_distinct(F.array_compact(F.array("parent_id", "thread_id")))
    keys = messages.select(F.explode(targets).alias("replied_id"))
    return keys.join(rows.select(F.col("id").alias("asked_id")), F.col("replied_id") == F.col("asked_id"), "left_semi").distinct()


def without_reply(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows nobody replied to. Replies of any source and date count."""
    return rows.join(replied_among(rows, messages), F.col("id") == F.col("replied_id"), "left_anti")


def unanswered_questions(
    messages: DataFrame,
    days: int = 30,
    limit: int | None = 50,
    voice_only: bool = False,
    as_of: Clock = None,
) -> DataFrame:
    asked = messages.where((F.col("content_type") == "question") & within_days(days, as_of))
    if voice_only:
        asked = asked.where(is_voice())
    asked = asked.select("id", "title", "source", "created_at", "url")
    rows = without_reply(asked, messages)
    return rows if limit is None else newest(rows, limit)


def unanswered_count(messages: DataFrame, days: int = 30, as_of: Clock = None) -> DataFrame:
    rows = unanswered_questions(messages, days, None, True, as_of)
    return rows.agg(F.count("*").alias("unanswered_questions"))


def with_has_reply(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Add the flag ``has_reply`` to any number of rows, such as the whole table."""
    return _flagged(rows, reply_keys(messages))


def some_with_has_reply(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """The same for a part of the table: only keys of its rows are made distinct."""
    return _flagged(rows, replied_among(rows, messages))


def _flagged(rows: DataFrame, replied: DataFrame) -> DataFrame:
    return (
        rows.join(replied, F.col("id") == F.col("replied_id"), "left")
        .withColumn("has_reply", F.col("replied_id").isNotNull())
        .drop("replied_id")
    )
