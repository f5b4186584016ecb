"""Incremental ingestion of a landing folder with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from echolens.operators.ingestion import insert, state_after
from echolens.schemas import INGESTION_STATE, MESSAGES
from echolens.sources.landing import ATOM_ENTRY, LANDED
from echolens.sources.snapshots import read_snapshot, write_snapshot

ATOM = "atom"


def ingest(
    spark: SparkSession,
    landing_path: str,
    kind: str,
    normalise: Callable[[DataFrame], DataFrame],
    messages_path: str,
    checkpoint_path: str,
    source: str | None = None,
    state_path: str | None = None,
) -> StreamingQuery:
    """Insert the messages of every landed file not seen yet, then stop. Run it on a timer.

    ``kind`` is one of the landed JSON kinds or ``ATOM``. With ``source`` only its part of the table is read to find
    what is stored, and with ``state_path`` its row of the ingestion state moves with each batch.

    The stream's checkpoint remembers the files. A batch repeated after a failure changes nothing:
    stored messages win over it. Only new rows are written. The table must have no other writer meanwhile.
    """
    if kind == ATOM:
        reader = spark.readStream.format("xml").option("rowTag", "entry")
        landed = reader.schema(ATOM_ENTRY + ", subreddit STRING").load(landing_path)
    else:
        landed = spark.readStream.schema(LANDED[kind]).json(landing_path)

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        version = insert(normalise(batch), messages_path, source)
        if source and state_path:
            inserted = read_snapshot(session, messages_path, MESSAGES, version, since=version, wide=False)
            state = read_snapshot(session, state_path, INGESTION_STATE)
            write_snapshot(state_after(state, inserted, source), state_path)

    return (
        landed.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
