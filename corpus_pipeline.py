"""A corpus pipeline: toxic and bad documents go, one of each near-duplicate group stays, sources are mixed, tokens packed.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.llm import mixing, ngramjoin, packing, quality, toxicity
from echolens.llm.common import cut, fresh_folder, table
from echolens.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM, GOOD_FROM = 0.5, 0.3
#: One document of each group of near duplicates stays: five words, a similarity of 0.8 or more.
SIMILAR = ngramjoin.Rule(n=5, percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC_FROM``; the model learns from labelled rows of ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, "__score").where(F.col("__score") < TOXIC_FROM).drop("__score")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is ``GOOD_FROM`` or more; the model learns from labelled rows of ``docs``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model, "__score").where(F.col("__score") >= GOOD_FROM).drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest id, of its texts the one with the smallest digest.

    Rows are told apart by id and digest of the text, so a repeated id loses only the rows that are near copies, and of
    rows equal in both one stays. Rows without words or without id stay all.
    """
    rows = docs.select(*COLUMNS)
    repeated = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        rows = rows.withColumn("__row", F.col("doc_id"))
    else:  # a number for each id and text, in their order
        rows, keys = rows.withColumn("digest", F.sha2("text", 256)), ("doc_id", "digest")
        numbers = rows.where("doc_id is not null").select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
        numbers = cut(numbers.withColumn("__row", F.monotonically_increasing_id())).withColumnsRenamed({"doc_id": "i", "digest": "d"})
        same = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("digest").eqNullSafe(F.col("d"))
        rows = rows.join(numbers, same, "left").select(*COLUMNS, "__row")
    grouped = ngramjoin.join(rows.where("__row is not null").select(F.col("__row").alias("doc_id"), "text"), SIMILAR)
    grouped = grouped.where("n_shingles > 0").select(F.col("doc_id").alias("__row"), "component_id").groupBy("__row").agg(
        F.min("component_id").alias("component"), F.count("*").alias("copies")
    )
    touched = cut(grouped.where((F.col("__row") != F.col("component")) | (F.col("copies") > 1)).select(
        "__row", (F.col("__row") == F.col("component")).alias("once")
    ))
    touched = F.broadcast(touched) if touched.count() <= ngramjoin.BROADCAST_ROWS else touched
    free = rows.join(touched, "__row", "left_anti").select(*COLUMNS)
    once = rows.join(touched.where("once"), "__row", "left_semi").groupBy("__row").agg(F.min(F.struct(*COLUMNS)).alias("of"))
    return free.unionByName(once.select("of.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix repeats it; ``n_chars`` follows a text that is repeated in part."""
    rows = mixing.repeated(mixing.mix(docs.select(*COLUMNS)))
    length = F.length("text").cast("long")
    return rows.withColumn("n_chars", F.when(length < F.col("n_chars"), length).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: the pieces of all documents with their ids and places."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic), ("quality", keep_good), ("near_copies", drop_near_copies), ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Trained models and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows from the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
