"""One ingestion run: what the source changed since its last fetch, normalised, inserted, and remembered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.functions.clock import Clock, now
from echolens.operators.plan import materialised
from echolens.operators.tables import among_new_messages, new_messages, update_ingestion_state
from echolens.schemas import INGESTION_STATE, MESSAGES
from echolens.sources.github import since_filter
from echolens.sources.snapshots import holding, read_snapshot, write_messages, write_snapshot

Normaliser = Callable[[DataFrame], DataFrame]


def fresh_messages(
    stored: DataFrame, state: DataFrame, landed: DataFrame, source: str, normalise: Normaliser
) -> DataFrame:
    """Messages of ``landed`` that the run adds: made since the last fetch of ``source`` and not stored yet.

    Only the source's own rows of the table are read, which a table stored by source keeps in folders of their own.
    """
    rows = since_filter(normalise(landed), state, "created_at")
    return new_messages(stored.where(F.col("source") == source), rows.select(*stored.columns))


def insert(rows: DataFrame, messages_path: str, source: str | None = None) -> int:
    """Add the messages that the stored table does not hold yet; returns the version.

    Of the table only versions are opened whose key range and filter admit an id of ``rows``, and of those only the ids,
    with ``source`` only its own. Only the ids are kept in between, texts go straight to the table; an id that was not
    looked up is not added, should ``rows`` have changed meanwhile.
    """
    spark = rows.sparkSession
    rows = rows.select(*MESSAGES.names)
    ids = materialised(rows.select("id"))
    stored = read_snapshot(spark, messages_path, MESSAGES, only=holding(spark, messages_path, ids), wide=False)
    stored = stored.where(F.col("source") == source) if source else stored
    candidates, exactly = among_new_messages(stored, rows)
    return write_messages(
        candidates, messages_path, added=True, chosen=lambda rows: exactly(rows).join(ids, "id", "left_semi")
    )


def state_row(inserted: DataFrame, source: str, as_of: Clock = None) -> DataFrame:
    """The row that remembers a run: when it was, its newest item (NULL if it added none) and how many it added."""
    newest = F.max(F.struct("created_at", "source_id"))
    return inserted.agg(newest.alias("newest"), F.count("*").alias("inserted")).select(
        F.lit(source).alias("source"), now(as_of).alias("last_fetched_at"), F.col("newest.source_id").alias("last_item_id"),
        F.lit(None).cast("string").alias("cursor"), F.to_json(F.struct("inserted")).alias("metadata"),
    )


def state_after(state: DataFrame, inserted: DataFrame, source: str, as_of: Clock = None) -> DataFrame:
    return update_ingestion_state(state, state_row(inserted, source, as_of))


def run_ingestion(
    spark: SparkSession,
    source: str,
    landed: DataFrame,
    normalise: Normaliser,
    messages_path: str,
    state_path: str,
    as_of: Clock = None,
) -> int:
    """Insert what is new in ``landed`` and then move the state; returns the inserted rows.

    The messages are a complete version before the state moves, so a run that is lost in between is repeated and adds
    nothing twice.
    """
    state = read_snapshot(spark, state_path, INGESTION_STATE)
    version = insert(since_filter(normalise(landed), state, "created_at"), messages_path, source)
    inserted = read_snapshot(spark, messages_path, MESSAGES, version, since=version, wide=False)
    write_snapshot(state_after(state, inserted, source, as_of), state_path)
    return inserted.count()
