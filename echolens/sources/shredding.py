"""Messages with their metadata taken apart when they are written, so that scores parse no JSON when they are read.

``metadata_variant`` holds all of it as VARIANT, ``comments`` and ``points`` the two counts that the scores use, typed, with
their fallbacks applied. The text stays as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolens.functions.scoring import metadata_int
from echolens.schemas import MESSAGES
from echolens.sources.snapshots import read_snapshot, write_messages

SHREDDED = T.StructType([
    *MESSAGES.fields,
    T.StructField("comments", T.LongType()),
    T.StructField("points", T.LongType()),
    T.StructField("metadata_variant", T.VariantType()),
])


def shredded(messages: DataFrame) -> DataFrame:
    """Messages with the columns of ``SHREDDED``; metadata that is no JSON gives a NULL variant and counts of 0."""
    metadata = F.col("metadata")
    return messages.select(
        *MESSAGES.names,
        metadata_int(metadata, "num_comments", "comments").cast("long").alias("comments"),
        metadata_int(metadata, "points", "score").cast("long").alias("points"),
        F.try_parse_json(metadata).alias("metadata_variant"),
    )


def write_shredded(messages: DataFrame, path: str, added: bool = False) -> int:
    return write_messages(shredded(messages), path, added)


def read_shredded(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshot(spark, path, SHREDDED)
