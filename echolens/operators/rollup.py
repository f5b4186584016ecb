"""The daily rollup kept current by signed changes.

A refresh finds the messages that changed between two states of the stored tables: inserted, labelled anew, removed with
their source or by id. It counts them as they were and as they are now and adds the differences as rows of the rollup, so
what is written grows with the changes. Reading sums the rows of a day and source. Every row names the versions of messages and
analysis it leads to, in the same write as the counts, so a refresh that is lost is repeated and none is counted twice.

Where a state cannot be compared with the one before, because a whole version was written or a counted column was voided in
between, the rollup is computed anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolens.operators import metrics
from echolens.operators.analysed import ANALYSIS, analysis_path, read_messages
from echolens.operators.plan import materialised
from echolens.schemas import MESSAGES
from echolens.sources import snapshots

_KEYS = ("date", "source")
_POINTERS = ("messages_version", "analysis_version")


def _counters(rollup: DataFrame) -> list[str]:
    return [name for name in rollup.columns if name not in (*_KEYS, "top_topics", *_POINTERS)]


def _schema(spark: SparkSession) -> T.StructType:
    rows = metrics.daily_metrics(spark.createDataFrame([], MESSAGES)).drop("top_topics")
    return T.StructType([*rows.schema.fields, *[T.StructField(name, T.LongType()) for name in _POINTERS]])


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The rollup as ``metrics.daily_metrics`` gives it."""
    rows = snapshots.read_snapshot(spark, path, _schema(spark))
    counters = _counters(rows)
    summed = rows.groupBy(*_KEYS).agg(*[F.sum(name).alias(name) for name in counters]).where("total_messages > 0")
    return summed.withColumn("top_topics", F.lit(None).cast("string"))


def _state(spark: SparkSession, messages_path: str) -> tuple[int, int]:
    paths = (messages_path, analysis_path(messages_path))
    return tuple(snapshots.latest_version(spark, path) or 0 for path in paths)  # type: ignore[return-value]


def _changed_ids(spark: SparkSession, messages_path: str, before: tuple[int, int], old: DataFrame) -> DataFrame | None:
    """Ids of the messages that may count differently now; None where that cannot be told."""
    found = []
    for path, schema, version in zip((messages_path, analysis_path(messages_path)), (MESSAGES, ANALYSIS), before):
        changes = snapshots.changes_since(spark, path, version)
        if changes.whole or set(changes.voided) - {"embedding_id"}:
            return None
        found.append(snapshots.read_snapshot(spark, path, schema, since=version + 1, wide=False).select("id"))
        for column, values in changes.removed.items():
            gone = values.select(F.col(column).alias("_gone"))
            found.append(gone.select(F.col("_gone").alias("id")) if column == "id"
                         else old.join(gone, F.col(column) == F.col("_gone"), "left_semi").select("id"))
    return reduce(DataFrame.unionByName, found).distinct()


def refresh(spark: SparkSession, messages_path: str, path: str) -> int:
    """Bring the rollup at ``path`` up to the stored messages and their analysis; returns its version."""
    now = _state(spark, messages_path)
    stored = snapshots.read_snapshot(spark, path, _schema(spark))
    last = stored.agg(F.max(F.struct(*_POINTERS)).alias("at")).first()["at"]
    current = read_messages(spark, messages_path, texts=False)
    changed = None
    if last is not None:
        old = read_messages(spark, messages_path, tuple(last), texts=False)
        changed = _changed_ids(spark, messages_path, tuple(last), old)
    pointers = {name: F.lit(version).cast("long") for name, version in zip(_POINTERS, now)}
    if changed is None:
        rows = metrics.daily_metrics(current).drop("top_topics").withColumns(pointers)
        return snapshots.write_snapshot(_with_pointers(spark, rows, now), path)
    changed = materialised(changed)
    parts = []
    for sign, state in ((1, current), (-1, old)):
        counts = metrics.daily_metrics(state.join(changed, "id", "left_semi")).drop("top_topics")
        parts.append(counts.select(*_KEYS, *[(F.col(name) * sign).alias(name) for name in _counters(counts)]))
    signed = parts[0].unionByName(parts[1])
    counters = _counters(signed)
    delta = signed.groupBy(*_KEYS).agg(*[F.sum(name).alias(name) for name in counters])
    delta = delta.where(reduce(lambda a, b: a | b, [F.col(name) != 0 for name in counters])).withColumns(pointers)
    return snapshots.write_snapshot(_with_pointers(spark, delta, now), path, added=True)


def _with_pointers(spark: SparkSession, rows: DataFrame, now: tuple[int, int]) -> DataFrame:
    """The rows and one that counts nothing, so that the versions are known where nothing changed."""
    schema = _schema(spark)
    blank = spark.createDataFrame([(None, None, *[0] * (len(schema) - 4), *now)], schema)
    return rows.select(*schema.names).unionByName(blank)
