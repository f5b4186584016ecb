"""Versioned Parquet tables and JSON-lines files.

A table is a folder of numbered folders: ``version=N-whole`` holds the whole table, ``version=N-added`` only
the rows added to the version before, so an insert does not copy the table. ``version=N-removed_<column>`` holds values of
a column whose rows are gone from all versions before, and ``version=N-voided_<column>`` says that a column of
all rows before is NULL: readers apply them, so a delete lasts and costs its own size only. A write makes a new folder and
never touches those being read; a folder counts once its ``_SUCCESS`` marker is there, so a lost job leaves
the table as it was. A table has one writer at a time. ``compact`` folds all into a whole version, ``vacuum`` deletes what
came before it.

A table may be bucketed by a key: every version deals its rows to the same number of buckets, all versions are one scan,
and joins and aggregates by the key need no shuffle. The session's catalog then knows each state of the table that was read,
under a name made from its path and versions, with the versions as partitions. Beside each version of it lie its key range and a Bloom filter of its keys, in blocks
that Spark's bitmap aggregate builds, so that a look-up opens only versions that may hold one of its keys.

A bucketed table may keep its widest column apart. Whole rows are then stored once more beside it, in lots, where they lay
when they were written, and the buckets hold the other columns with each row's lot and place. So no row is shuffled with its
wide column: what is found in the buckets is brought to the lots when the column is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Collection
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolens.functions.text import strip
from echolens.operators.plan import BLOCK_BITS, bit_set, brought_to_lots, placed_in_lots

_PREFIX, WHOLE, ADDED = "version=", "whole", "added"
_REMOVED, _VOIDED = "removed_", "voided_"
_BUCKETS = "_buckets="
_FACTS = "version string, n long, low string, high string, blocks long"
#: Bits of a Bloom filter for each key and places they are set at.
_KEY_BITS, _PLACES = 16, 8
#: Texts are most of what a table holds; they take a third less than with Parquet's default codec.
_CODEC = "zstd"
#: Where a row's wide column is kept, and bits of the number of a lot within its version: for 2 million tasks.
_PLACE = T.StructType().add("_lot", T.LongType()).add("_place", T.IntegerType())
_LOTS_BITS = 40


@dataclass(frozen=True)
class Buckets:
    """The key and number of a table's buckets, the column whose values have folders of their own, and the one kept apart, if any."""

    key: str
    number: int
    folders: str = ""
    apart: str = ""

    @property
    def marker(self) -> str:
        return f"{_BUCKETS}{self.key}={self.number}={self.folders}" + (f"={self.apart}" if self.apart else "")


@dataclass(frozen=True)
class _Version:
    number: int
    kind: str

    @property
    def name(self) -> str:
        return f"{self.number:010d}-{self.kind}"

    @property
    def has_rows(self) -> bool:
        return self.kind in (WHOLE, ADDED)


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    system, jvm_path = _file_system(spark, path)
    return system.exists(jvm_path)


def _base(path: str) -> str:
    return path.rstrip("/")


def _folder(path: str, version: _Version) -> str:
    return f"{_base(path)}/{_PREFIX}{version.name}"


def _lots_path(path: str) -> str:
    return _base(path) + "-lots"


def _filters_path(path: str) -> str:
    return _base(path) + "-filters"


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match."""
    system, jvm_path = _file_system(spark, pattern)
    return [status.getPath().toString() for status in system.globStatus(jvm_path) or ()]


def _versions(spark: SparkSession, path: str) -> list[_Version]:
    """Complete versions in order, from one listing."""
    found = []
    for marker in _names(spark, f"{_base(path)}/{_PREFIX}*/_SUCCESS"):
        number, kind = marker.rsplit("/", 2)[1].removeprefix(_PREFIX).split("-", 1)
        found.append(_Version(int(number), kind))
    return sorted(found, key=lambda v: v.number)


def buckets_of(spark: SparkSession, path: str) -> Buckets | None:
    """How the table is bucketed, if it is."""
    for name in _names(spark, f"{_base(path)}/{_BUCKETS}*"):
        key, number, folders, *apart = name.rsplit("/", 1)[1].removeprefix(_BUCKETS).split("=")
        return Buckets(key, int(number), folders, *apart)
    return None


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest complete version."""
    versions = _versions(spark, path)
    return versions[-1].number if versions else None


def live_versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions that hold the table's rows."""
    versions = _versions(spark, path)
    whole = max((v.number for v in versions if v.kind == WHOLE), default=0)
    return [v.name for v in versions if v.has_rows and v.number >= whole]


# States of tables that the catalog of an application knows: the versions by path and catalog name.
_KNOWN: dict[tuple[str, str], dict[str, list[str]]] = {}
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _partitions(spark: SparkSession, path: str, buckets: Buckets, name: str) -> list[str]:
    """The version's folders, one or one for each value, as clauses that add them to a catalog table."""
    folder = f"{_base(path)}/{_PREFIX}{name}"
    if not buckets.folders:
        return [f"PARTITION (version = '{name}') LOCATION {_quoted(folder)}"]
    clauses = []
    for inner in _names(spark, f"{folder}/{buckets.folders}=*"):
        value = unquote(inner.rsplit("/", 1)[1].removeprefix(f"{buckets.folders}="))
        value = "NULL" if value == _NULL_FOLDER else _quoted(value)
        clauses.append(f"PARTITION (version = '{name}', {buckets.folders} = {value}) LOCATION {_quoted(inner)}")
    return clauses


def _bucketed_rows(spark: SparkSession, path: str, schema: T.StructType, buckets: Buckets, names: list[str]) -> DataFrame:
    """The versions as one bucketed scan, of a table that the session's catalog is told of.

    A state of the table has a catalog table of its own, so what was read once stays the same whatever is written later.
    """
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
    table = "stored_" + hashlib.md5(" ".join([path, columns, *names]).encode()).hexdigest()
    known = _KNOWN.setdefault((spark.sparkContext.applicationId, _base(path)), {})
    if table not in known:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        by = "version" + (f", {buckets.folders}" if buckets.folders else "")
        spark.sql(
            f"CREATE TABLE {table} ({columns}, version STRING) USING parquet PARTITIONED BY ({by}) CLUSTERED BY ({buckets.key}) "
            f"SORTED BY ({buckets.key}) INTO {buckets.number} BUCKETS LOCATION {_quoted(_base(path))}"
        )
        clauses = [clause for name in names for clause in _partitions(spark, path, buckets, name)]
        if clauses:
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(clauses))
        known[table] = list(names)
    return spark.table(table)


def _number() -> Column:
    return F.substring("version", 1, 10).cast("long")


def _marks(spark: SparkSession, path: str, versions: list[_Version], column: str) -> DataFrame:
    """The values removed and the newest version that removes them."""
    rows = spark.read.option("basePath", path).parquet(*[_folder(path, v) for v in versions])
    return rows.groupBy(F.col(column).alias("_mark")).agg(F.max(_number()).alias("_before"))


def read_snapshot(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    version: int | None = None,
    since: int | None = None,
    only: Collection[str] | None = None,
    with_version: bool = False,
    wide: bool = True,
) -> DataFrame:
    """The table as of the given or newest version; an empty table where there is none.

    ``since`` names the first version to read: only what it and later ones added. ``only`` names the versions to open, of
    those that are live. ``with_version`` adds the number of the version that holds the row, ``_version``. Unless ``wide``, a
    column kept apart is NULL and not read.
    """
    rows, completed = read_apart(spark, path, schema, version, since, only)
    names = [*schema.names, "_version"] if with_version else schema.names
    return (completed(rows, ()) if wide else _with_null(rows, schema)).select(*names)


def _with_null(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in rows.columns})


def read_apart(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    version: int | None = None,
    since: int | None = None,
    only: Collection[str] | None = None,
) -> tuple[DataFrame, Callable[[DataFrame, Collection[str]], DataFrame]]:
    """``read_snapshot`` with ``_version`` and without the column kept apart, and what adds that to any of these rows.

    The rows have their places for it. Columns that were changed meanwhile are named then; the others come from the lots as well.
    Where nothing is kept apart, the rows are whole.
    """
    versions = [v for v in _versions(spark, path) if version is None or v.number <= version]
    whole = max((v.number for v in versions if v.kind == WHOLE), default=0) if since is None else since
    live = [v.name for v in versions if v.has_rows and v.number >= whole]
    names = live if only is None else [name for name in live if name in only]
    if not names:
        return spark.createDataFrame([], schema).withColumn("_version", F.lit(0).cast("long")), lambda rows, _: rows
    buckets = buckets_of(spark, path)
    apart = buckets is not None and buckets.apart in schema.names

    def versions_of(path: str, schema: T.StructType, buckets: Buckets) -> DataFrame:
        rows = _bucketed_rows(spark, path, schema, buckets, live)
        return rows if names == live else rows.where(F.col("version").isin(names))

    kept = T.StructType([field for field in schema if field.name != buckets.apart] + _PLACE.fields) if apart else schema
    if buckets:
        rows = versions_of(path, kept, buckets)
    else:  # the base path makes the version a partition column, so all folders are one scan
        rows = spark.read.schema(schema).option("basePath", path).parquet(*[f"{_base(path)}/{_PREFIX}{name}" for name in names])
    rows = rows.select(*kept.names, _number().alias("_version"))
    marks = [v for v in versions if not v.has_rows and v.number > whole]
    for column in dict.fromkeys(v.kind.removeprefix(_REMOVED) for v in marks if v.kind.startswith(_REMOVED)):
        gone = _marks(spark, path, [v for v in marks if v.kind == _REMOVED + column], column)
        if buckets and column == buckets.key:
            gone = gone.repartition(buckets.number, "_mark")  # meets the buckets where they are
        rows = rows.join(gone, (F.col(column) == F.col("_mark")) & (F.col("_version") < F.col("_before")), "left_anti")
    voided = [(v.number, v.kind.removeprefix(_VOIDED)) for v in marks if v.kind.startswith(_VOIDED)]
    for number, column in voided:
        if column in rows.columns:
            rows = rows.withColumn(column, F.when(F.col("_version") >= number, F.col(column)))
    if not apart:
        return rows, lambda rows, _: rows

    def completed(rows: DataFrame, changed: Collection[str]) -> DataFrame:
        moved = {*changed, *[name for _, name in voided]} - {buckets.apart}
        fields = [field for field in schema if field.name not in moved]
        lots = versions_of(_lots_path(path), T.StructType([*fields, *_PLACE]), Buckets("_lot", buckets.number)).drop("version")
        moved = [name for name in schema.names if name in moved]
        rows = brought_to_lots(rows.select("_version", *moved, *_PLACE.names), lots, buckets.number)
        for number, name in voided:
            if name == buckets.apart:
                rows = rows.withColumn(name, F.when(F.col("_version") >= number, F.col(name)))
        return rows

    return rows, completed


@dataclass(frozen=True)
class Changes:
    """What happened to a table besides added rows: whether it was written whole, removed values by column, voided columns."""

    whole: bool
    removed: dict[str, DataFrame]
    voided: tuple[str, ...]


def changes_since(spark: SparkSession, path: str, version: int) -> Changes:
    later = [v for v in _versions(spark, path) if v.number > version]
    columns = dict.fromkeys(v.kind.removeprefix(_REMOVED) for v in later if v.kind.startswith(_REMOVED))
    removed = {
        column: spark.read.parquet(*[_folder(path, v) for v in later if v.kind == _REMOVED + column]).select(column)
        for column in columns
    }
    voided = tuple(v.kind.removeprefix(_VOIDED) for v in later if v.kind.startswith(_VOIDED))
    return Changes(any(v.kind == WHOLE for v in later), removed, voided)


def _next_version(spark: SparkSession, path: str, kind: str) -> _Version:
    version = _Version((latest_version(spark, path) or 0) + 1, kind)
    for parts in (path, _lots_path(path)):  # of a job that was lost
        for leftover in _names(spark, f"{_base(parts)}/{_PREFIX}{version.number:010d}-*"):
            system, jvm_path = _file_system(spark, leftover)
            system.delete(jvm_path, True)
    return version


def write_snapshot(
    rows: DataFrame,
    path: str,
    partition_by: str | None = None,
    sort_by: str | None = None,
    added: bool = False,
    buckets: Buckets | None = None,
    chosen: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Write ``rows`` as a new version, the whole table or only ``added`` rows; returns its number.

    ``partition_by`` lets readers skip folders; rebalancing splits a value that holds most rows over
    several files. ``sort_by`` orders each file for row-group skipping. ``buckets`` makes a new table bucketed; one that
    exists stays as it is. ``chosen`` leaves out rows that are not to be written, and columns that the table has not, but changes
    no other; a column kept apart it neither gets nor needs.
    """
    spark = rows.sparkSession
    version = _next_version(spark, path, ADDED if added else WHOLE)
    held = buckets_of(spark, path)
    if held is None and buckets and version.number == 1:
        held = buckets
        system, marker = _file_system(spark, f"{_base(path)}/{held.marker}")
        system.create(marker).close()
    if held and held.apart:
        rows = _in_lots(rows, path, version, held)
    rows = chosen(rows) if chosen else rows
    if held:
        _write_bucketed(rows, _folder(path, version), held)
        _write_filter(spark, path, version, rows.schema, held)
        return version.number
    if partition_by:
        rows = rows.hint("rebalance", partition_by)
    order = [name for name in (partition_by, sort_by) if name]
    if order:
        rows = rows.sortWithinPartitions(*order)
    writer = rows.write.mode("overwrite").option("compression", _CODEC)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(_folder(path, version))
    return version.number


def _write_bucketed(rows: DataFrame, folder: str, buckets: Buckets) -> None:
    """One sorted file for each bucket (and folder). Bucketed files are written through a table of the catalog, which is then forgotten."""
    _save_bucketed(rows.repartition(buckets.number, buckets.key), folder, buckets)


def _in_lots(rows: DataFrame, path: str, version: _Version, buckets: Buckets) -> DataFrame:
    """Whole rows stored where they lie; returns them without the column kept apart, with their places."""
    placed, folder = placed_in_lots(rows, version.number << _LOTS_BITS), _folder(_lots_path(path), version)
    _save_bucketed(placed, folder, Buckets("_lot", buckets.number))
    return rows.sparkSession.read.schema(placed.schema).parquet(folder).drop(buckets.apart)


def _save_bucketed(rows: DataFrame, folder: str, buckets: Buckets) -> None:
    table = "written_" + hashlib.md5(folder.encode()).hexdigest()
    writer = rows.write.format("parquet").bucketBy(buckets.number, buckets.key).sortBy(buckets.key)
    if buckets.folders:
        writer = writer.partitionBy(buckets.folders)
    writer.option("path", folder).option("compression", _CODEC).mode("overwrite").saveAsTable(table)
    rows.sparkSession.sql(f"DROP TABLE {table}")


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(1, _PLACES + 1)]


def _write_filter(spark: SparkSession, path: str, version: _Version, schema: T.StructType, buckets: Buckets) -> None:
    """The range of the version's keys and a Bloom filter of them: each key sets its places in the block its hash names.

    The filter has a row for each 4 KB block, so it is built and looked up in parallel and grows with the version.
    """
    keys = spark.read.schema(schema).parquet(_folder(path, version)).select(F.col(buckets.key).cast("string").alias("key"))
    facts = keys.where("key is not null").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    n, low, high = facts.first()
    blocks = max(-(-n * _KEY_BITS // BLOCK_BITS), 1)
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    bits = keys.where("key is not null").select(block, F.explode(F.array(*_places(F.col("key")))).alias("place"))
    bits = bits.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
    bits.write.mode("overwrite").parquet(f"{_filters_path(path)}/blocks/{_PREFIX}{version.name}")
    row = spark.createDataFrame([(version.name, n, low, high, blocks)], _FACTS)
    row.coalesce(1).write.mode("overwrite").json(f"{_filters_path(path)}/facts/{version.name}")


def holding(spark: SparkSession, path: str, keys: DataFrame) -> list[str]:
    """Names of the live versions that may hold one of ``keys`` (one column). Versions without a filter count as well.

    Every version's facts reach the driver, one row each; the keys are compared with its range and its filter in Spark.
    """
    live = live_versions(spark, path)
    folders = [name for name in live if exists(spark, f"{_filters_path(path)}/facts/{name}/_SUCCESS")]
    if not folders:
        return live
    facts = spark.read.schema(_FACTS).json([f"{_filters_path(path)}/facts/{name}" for name in folders]).collect()
    ranges = [row for row in facts if row["n"]]
    open_ = sorted(set(live) - set(folders))
    if not ranges:
        return open_
    versions = F.array(*[
        F.struct(*[F.lit(row[name]).alias(name) for name in ("version", "low", "high", "blocks")]) for row in ranges
    ])
    asked = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).where("key is not null").distinct()
    asked = asked.select("key", F.inline(versions)).where("key between low and high")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    root = f"{_filters_path(path)}/blocks"
    filters = spark.read.schema("block long, bits binary, version string").option("basePath", root).parquet(
        *[f"{root}/{_PREFIX}{row['version']}" for row in ranges]
    )
    hits = asked.join(filters, ["version", "block"])
    for place in _places(F.col("key")):
        hits = hits.where(bit_set(F.col("bits"), place))
    return sorted(open_ + [row[0] for row in hits.select("version").distinct().collect()])


def _mark(rows: DataFrame, path: str, kind: str) -> int:
    version = _next_version(rows.sparkSession, path, kind)
    rows.write.mode("overwrite").parquet(_folder(path, version))
    return version.number


def remove(values: DataFrame, path: str) -> int:
    """From now on the table has no rows with these values of the one column, until some are added again; NULLs stay."""
    (column,) = values.columns
    return _mark(values.where(F.col(column).isNotNull()).distinct(), path, _REMOVED + column)


def void_column(spark: SparkSession, path: str, column: str) -> int:
    """From now on a column is NULL in all rows there are."""
    return _mark(spark.createDataFrame([(column,)], "voided string"), path, _VOIDED + column)


def compact(spark: SparkSession, path: str, schema: T.StructType, partition_by: str | None = None) -> int:
    """One whole version instead of many that added or removed rows; returns its number."""
    return write_snapshot(read_snapshot(spark, path, schema), path, partition_by)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete what came before the last ``keep`` whole versions, for readers that started long ago; returns the names."""
    versions = _versions(spark, path)
    wholes = [v.number for v in versions if v.kind == WHOLE]
    if len(wholes) < keep:
        return []
    old = [v for v in versions if v.number < wholes[-keep]]
    gone = {v.name for v in old}
    for parts in (path, _lots_path(path)):
        known = _KNOWN.get((spark.sparkContext.applicationId, _base(parts)), {})
        for table in [table for table, names in known.items() if gone & set(names)]:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            del known[table]
    for v in old:
        for folder in (
            _folder(path, v), _folder(_lots_path(path), v),
            f"{_filters_path(path)}/facts/{v.name}", f"{_filters_path(path)}/blocks/{_PREFIX}{v.name}",
        ):
            system, jvm_path = _file_system(spark, folder)
            system.delete(jvm_path, True)
    return [v.name for v in old]


def write_messages(
    messages: DataFrame, path: str, added: bool = False, chosen: Callable[[DataFrame], DataFrame] | None = None, apart: bool = False
) -> int:
    """A table of messages has a folder for each source, bucketed by id; with ``apart`` a new one keeps texts apart.

    Then no text is shuffled when messages are written or merged with their analysis. Otherwise whole messages are
    found by id without any shuffle.
    """
    buckets = default_buckets(messages.sparkSession, folders="source", apart="content" if apart else "")
    return write_snapshot(messages, path, added=added, buckets=buckets, partition_by="source", sort_by="created_at", chosen=chosen)


def default_buckets(spark: SparkSession, key: str = "id", folders: str = "", apart: str = "") -> Buckets:
    """As many buckets as the session shuffles to when the table is first written."""
    return Buckets(key, int(spark.conf.get("spark.sql.shuffle.partitions")), folders, apart)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per row, as a folder of text files."""
    rows.write.mode("overwrite").json(path)


def count_jsonl(spark: SparkSession, path: str) -> int:
    """Lines that are not blank; 0 where there is no such file."""
    return jsonl_lines(spark, path).count() if exists(spark, path) else 0


def jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(strip(F.col("value")) != "")
