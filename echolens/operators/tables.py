"""Table maintenance: old snapshot and delta in, new snapshot out.

Plain Parquet has no MERGE, so each operator is a join of the snapshot with the delta. Ids are unique
in the snapshot; several delta rows for one id are reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.functions.clock import Clock, now
from echolens.functions.text import is_filled
from echolens.operators.filters import is_voice, newest
from echolens.operators.plan import brought_to_lots, marked_among, perhaps_among

_LABELS = ("sentiment_simple", "sentiment_rich", "content_type")
#: Columns that ``update_analysis`` may change.
ANALYSED = (*_LABELS, "topics", "embedding_id", "metadata", "processed_at")
#: Blocks of the filter of changed ids, 32 MB in all: a delta may change a good part of the messages.
_DELTA_BLOCKS = 8192


def row_hash(rows: DataFrame) -> Column:
    """A number that differs for different rows: it ends an order that would else leave ties."""
    hashed = [F.to_json(c) if kind.startswith(("map", "variant")) else F.col(c) for c, kind in rows.dtypes]
    return F.xxhash64(*hashed)


def first_per_key(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """First row per key, ties by a hash of the row; each task keeps one row per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order, row_hash(rows)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def first_of_shared_keys(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """``first_per_key`` for wide rows, most of which are alone with their key: those stay where they are.

    Keys that several rows share are found by the keys alone. Rows are read once more for each step instead of being moved,
    and none is sorted before it moves.
    """
    shared = rows.groupBy(key).count().where("count > 1").select(key)
    marked = marked_among(rows, shared, "_shared", key)
    moved = marked.where("_shared").drop("_shared").repartition(key)
    return marked.where(~F.col("_shared")).drop("_shared").unionByName(first_per_key(moved, key, *order))


def new_messages(snapshot: DataFrame, batch: DataFrame, order_by: tuple[str, ...] = ("fetched_at",)) -> DataFrame:
    """Rows of ``batch`` that ``insert_if_absent`` adds: ids not stored yet, the first of each; never a NULL id.

    Only the ids of the snapshot are read. The rows to add are chosen by id and order alone, and by hash where these are equal. Of
    the whole rows only those move, with the few that the filter lets pass, and none is sorted before; adaptive execution
    broadcasts the batch's ids if they turn out small. Rows of an id with equal hashes count as one.
    """
    candidates, exactly = among_new_messages(snapshot, batch, order_by)
    return exactly(candidates).select(*snapshot.columns)


def among_new_messages(
    snapshot: DataFrame, batch: DataFrame, order_by: tuple[str, ...] = ("fetched_at",)
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Rows of ``batch`` with all that ``new_messages`` adds, few others and a ``_hash``, and what finds the exact ones of them.

    No row has moved yet, and the exact ones are found by ``id`` and ``_hash``, whatever other columns there are.
    """
    batch = batch.where(F.col("id").isNotNull())
    keys = list(dict.fromkeys(("id", *order_by)))
    chosen = first_per_key(batch.select(*keys), "id", *order_by)  # the least order of each id, which several rows may have
    stored = snapshot.select("id").join(chosen.select("id"), "id", "left_semi")
    chosen = chosen.join(stored, "id", "left_anti")
    candidates = perhaps_among(batch, chosen, *keys)

    def exactly(rows: DataFrame) -> DataFrame:
        first = first_per_key(rows.select(*keys, "_hash"), "id", *order_by, "_hash").select("id", "_hash")
        first = first.join(chosen.select("id"), "id", "left_semi")
        fresh = rows.join(first, ["id", "_hash"]).dropDuplicates(["id", "_hash"])
        return fresh.select(*[name for name in rows.columns if name != "_hash"])

    candidates = candidates.withColumn("_hash", row_hash(batch))
    filled = {"metadata": F.coalesce("metadata", F.lit("{}")), "topics": F.coalesce("topics", F.lit("[]"))}
    return candidates.withColumns(filled), exactly


def insert_if_absent(snapshot: DataFrame, batch: DataFrame, order_by: tuple[str, ...] = ("fetched_at",)) -> DataFrame:
    """Stored rows always win; within the batch the first row by ``order_by`` wins."""
    return snapshot.unionByName(new_messages(snapshot, batch, order_by))


def replace_by_key(snapshot: DataFrame, delta: DataFrame, key: str, *last_by: str) -> DataFrame:
    """Delta rows replace the stored rows of their key; the last by ``last_by`` wins in the delta.

    The delta is reduced to one row per key in any case, so that repeated keys never multiply rows.
    """
    delta = first_per_key(delta, key, *[F.desc(name) for name in last_by])
    kept = snapshot.join(delta.select(key), key, "left_anti").select(*snapshot.columns)
    return kept.unionByName(delta.select(*snapshot.columns))


def ingestion_state_of(state: DataFrame, source: str) -> DataFrame:
    """The state row of a source, its metadata as a map; no row before the first run."""
    parsed = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return state.where(F.col("source") == source).withColumn("metadata", parsed)


def update_ingestion_state(state: DataFrame, rows: DataFrame) -> DataFrame:
    filled = rows.withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
    return replace_by_key(state, filled, "source", "last_fetched_at")


def update_analysis(
    messages: DataFrame,
    delta: DataFrame,
    order_by: str | Sequence[str] | None = None,
    as_of: Clock = None,
    stamp: str | None = None,
    among: Column | None = None,
    sparing: bool = False,
    in_lots: bool = False,
) -> DataFrame:
    """Set the labels, topics and embedding pointer that ``delta`` gives; NULL keeps the old value.

    ``delta`` has ``id`` and any of the label columns, ``topics`` (array) and ``embedding_id``. An empty
    topics array does overwrite. ``processed_at`` moves only where a label or topic was given. Ids not
    stored are ignored. Later rows by ``order_by`` win per field, of equal ones that with the larger hash of the row;
    without it, the first rows by that hash.
    ``stamp`` names the column of ``delta`` that says when a row was made; without it, that is now.
    ``among`` is a condition that every message with an id in ``delta`` meets; messages that do not meet it stay where they are.
    ``sparing`` is for messages with their texts: only those that ``delta`` changes move, with the few that a Bloom filter lets
    pass. Messages and ``delta`` are read once more for it, so both must give the same rows each time, as no model may.
    ``in_lots`` is for messages from ``plan.stored_in_lots``: they stay where they are altogether, what they become is brought to them.
    """
    if among is not None:
        among = F.coalesce(among, F.lit(False))
        changed = update_analysis(messages.where(among), delta, order_by, as_of, stamp)
        return changed.unionByName(messages.where(~among))
    fields = [name for name in (*_LABELS, "topics", "embedding_id") if name in delta.columns]
    analysed = F.lit(False)
    for name in fields:
        if name in _LABELS:
            analysed = analysed | is_filled(F.col(name))
        elif name == "topics":
            analysed = analysed | F.coalesce(F.size("topics") > 0, F.lit(False))
    made = F.col(stamp) if stamp else now(as_of)
    delta = delta.withColumns({"_analysed": analysed, "_made": F.when(analysed, made)})
    giving = delta.where(reduce(or_, [F.col(name).isNotNull() for name in fields], F.lit(False)))
    if order_by is None:
        delta = first_per_key(delta, "id")
    else:
        order = F.struct(*[F.col(name) for name in ([order_by] if isinstance(order_by, str) else order_by)], row_hash(delta))
        last = [F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias(name) for name in fields]
        delta = delta.groupBy("id").agg(*last, F.max("_analysed").alias("_analysed"), F.max("_made").alias("_made"))
    given = {name: f"_new_{name}" for name in fields}
    delta = delta.select("id", "_analysed", "_made", *[F.col(name).alias(new) for name, new in given.items()])
    touched = F.col("_analysed").isNotNull()
    changed: dict[str, Column] = {
        name: F.coalesce(new, name) for name, new in given.items() if name != "topics"
    }
    topics = F.to_json("_new_topics") if "topics" in given else F.lit(None).cast("string")
    changed["topics"] = F.when(touched, F.coalesce(topics, "topics", F.lit("[]"))).otherwise(F.col("topics"))
    changed["metadata"] = F.when(touched, F.coalesce("metadata", F.lit("{}"))).otherwise(F.col("metadata"))
    changed["processed_at"] = F.when(F.col("_analysed"), F.col("_made")).otherwise(F.col("processed_at"))

    def met(rows: DataFrame) -> DataFrame:
        joined = rows.join(delta, "id", "left")
        return joined.select(*[changed.get(name, F.col(name)).alias(name) for name in rows.columns])

    if in_lots:
        moved = [name for name in messages.columns if name in (*ANALYSED, "_lot", "_place")]
        lots = messages.drop(*[name for name in moved if name in ANALYSED])
        names = [name for name in messages.columns if name not in ("_lot", "_place")]
        return brought_to_lots(met(messages.select("id", *moved)).drop("id"), lots).select(*names)
    if not sparing:
        return met(messages)
    # An id in the delta fills topics and metadata even where nothing is given.
    unfilled = reduce(or_, [F.col(name).isNull() for name in ("topics", "metadata") if name in messages.columns], F.lit(False))
    marked = marked_among(messages, giving, "_moves", "id", blocks=_DELTA_BLOCKS)
    moves = F.col("_moves") | unfilled
    return marked.where(~moves).drop("_moves").unionByName(met(marked.where(moves).drop("_moves")))


def embedding_queue(messages: DataFrame, limit: int | None = None) -> DataFrame:
    return newest(messages.where(F.col("embedding_id").isNull()), limit)


def sentiment_queue(messages: DataFrame, limit: int | None = None) -> DataFrame:
    return newest(messages.where(F.col("sentiment_simple").isNull() & is_voice()), limit)


def reset_embeddings(messages: DataFrame) -> DataFrame:
    """Forget every embedding pointer; the caller also starts an empty vector table."""
    return messages.withColumn("embedding_id", F.lit(None).cast("string"))


def clear_source(table: DataFrame, source: str) -> DataFrame:
    """Any of the tables without one source. It goes by the column, not by the id prefix; rows without a source stay."""
    return table.where(~F.col("source").eqNullSafe(source))


def cleared_counts(source: str, **tables: DataFrame) -> DataFrame:
    """Rows ``clear_source`` removes from each table, counted in one pass each."""
    counts = [
        rows.where(F.col("source") == source).agg(F.count("*").alias("deleted")).select(
            F.lit(name).alias("table_name"), "deleted"
        )
        for name, rows in tables.items()
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result
