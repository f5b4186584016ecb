"""Small helpers that steer how Spark runs a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one block of a Bloom filter, as many as the bitmap aggregate gives.
BLOCK_BITS = 32_768
#: Blocks of a filter that tasks look up in memory, 8 MB in all, and places that a key sets.
_BLOCKS, _PLACES = 2048, 3
#: Bits of the number of a row within its lot.
_LOT_BITS = 14


def evaluated_once(rows: DataFrame, *kept: str, **columns: Column) -> DataFrame:
    """The ``kept`` columns and costly new ones, computed in one place.

    Filters on plainly projected columns are pushed below the projection, which computes the column
    a second time. They cannot pass a generator, and ``inline`` of one struct is one row.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return rows.select(*kept, F.inline(F.array(made)))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster.

    Only a local session may leave ``spark.checkpoint.dir`` unset; a cluster would lose the rows with a node.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def materialised(rows: DataFrame) -> DataFrame:
    """Rows computed once and stored in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def placed_in_lots(rows: DataFrame, first: int = 0) -> DataFrame:
    """Rows with their lot, numbered from ``first``, and their place in it. They must be stored before they are read twice."""
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    return placed.withColumns({
        "_lot": F.shiftright("_at", _LOT_BITS) + F.lit(first).cast("long"),
        "_place": F.col("_at").bitwiseAND((1 << _LOT_BITS) - 1).cast("int"),
    }).drop("_at")


def stored_in_lots(rows: DataFrame) -> DataFrame:
    """Rows computed once and stored where they lie, as a table bucketed by ``_lot``, for ``joined_in_lots``.

    A lot is a run of rows of one task, and ``_place`` the number of a row within it. No row is shuffled. The session's
    catalog knows the table.
    """
    spark = rows.sparkSession
    name = f"lots_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = placed_in_lots(rows).write.format("parquet").bucketBy(buckets, "_lot").option("compression", "zstd")
    writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def joined_in_lots(rows: DataFrame, found: DataFrame, key: str, *columns: str) -> DataFrame:
    """``columns`` of ``rows`` with what ``found`` has for their key, one row a key at most; others are left out.

    If ``rows`` are from ``stored_in_lots``, they stay where they are: the rows of ``found`` are dealt to the lots, one array a lot.
    """
    added = [name for name in found.columns if name != key]
    result = [key, *added, *[name for name in columns if name != key]]
    if "_lot" not in rows.columns:
        return found.join(rows.select(key, *columns), key).select(*result)
    matched = found.withColumn("_found", F.lit(True))
    dealt = rows.select(key, "_lot", "_place").join(matched, key, "left").drop(key)
    dealt = dealt.groupBy("_lot").agg(F.sort_array(F.collect_list(F.struct("_place", "_found", *added))).alias("_row"))
    joined = rows.join(dealt.hint("shuffle_hash"), "_lot").withColumn("_row", F.get("_row", F.col("_place")))
    return joined.where("_row._found").select(key, *[F.col(f"_row.{name}") for name in added], *result[1 + len(added) :])


def brought_to_lots(found: DataFrame, lots: DataFrame, number: int | None = None) -> DataFrame:
    """Rows of ``found``, each of which has a lot and a place, with the other columns of that row of ``lots``.

    ``lots`` is bucketed by ``_lot`` into ``number`` buckets, as many as the session shuffles to if not given, and stays where it
    is: the rows of ``found`` are dealt to it, one array a lot.
    """
    number = number or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = [name for name in found.columns if name not in ("_lot", "_place")]
    dealt = found.select("_lot", F.struct("_place", *added).alias("_row")).repartition(number, "_lot")
    dealt = dealt.groupBy("_lot").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    kind = dealt.schema["_rows"].dataType.elementType

    def with_gap(row: Column, i: Column) -> Column:  # NULLs for the places between the row before and this one
        before = F.coalesce(F.get("_rows", i - 1)["_place"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(None).cast(kind), row["_place"] - before - 1), F.array(row))

    dealt = dealt.select("_lot", F.flatten(F.transform("_rows", with_gap)).alias("_row"))
    joined = lots.join(dealt.hint("shuffle_hash"), "_lot").withColumn("_row", F.get("_row", F.col("_place")))
    others = [name for name in lots.columns if name not in ("_lot", "_place")]
    return joined.where(F.col("_row").isNotNull()).select(*[F.col(f"_row.{name}").alias(name) for name in added], *others)


def bit_set(bits: Column, place: Column) -> Column:
    """Whether a bitmap has the bit at ``place``."""
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def marked_among(rows: DataFrame, keys: DataFrame, mark: str, *columns: str, blocks: int = _BLOCKS) -> DataFrame:
    """``rows`` with a column that is true where ``columns`` are among those of ``keys``, and for a few others; no row moves.

    A Bloom filter of the keys is built in Spark and broadcast; it never exceeds 8 MB, so more than some ten million keys
    mark more other rows. More ``blocks`` of 4 KB take more keys. All rows are marked where broadcasts are off.
    """
    if rows.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):
        return rows.withColumn(mark, F.lit(True))
    key, block = F.xxhash64(*columns), F.pmod("_key", F.lit(blocks)).alias("_block")
    places = [F.pmod(F.xxhash64("_key", F.lit(i)), F.lit(BLOCK_BITS)) for i in range(1, _PLACES + 1)]
    bits = keys.select(key.alias("_key")).select(block, F.explode(F.array(*places)).alias("_place"))
    bits = bits.groupBy("_block").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    found = F.lit(True)
    for place in places:
        found = found & bit_set(F.col("_bits"), place)
    marked = rows.withColumn("_key", key).withColumn("_block", block).join(F.broadcast(bits), "_block", "left")
    return marked.select(*rows.columns, F.coalesce(found, F.lit(False)).alias(mark))


def perhaps_among(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows that ``marked_among`` marks."""
    return marked_among(rows, keys, "_among", *columns).where("_among").drop("_among")
