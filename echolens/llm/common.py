"""Helpers shared by the operators: folds, samples of labelled rows, stored tables, text arrays."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that one numpy pass handles; longer texts are passes of their own.
CHUNK_CHARS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local session that sets none."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """Rows computed once and stored in the shared folder, without their lineage."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Rows written as Parquet in the shared folder and read back."""
    folder = fresh_folder(rows.sparkSession, label)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], fold: int) -> pd.DataFrame:
    """At most ``most[v]`` texts of each value v of ``label`` with their label.

    The rows with the smallest hashes of their ids are taken, outside the fold ``crc32 % fold = 0``. Ids are chosen
    from the narrow table of labels; only the chosen texts are read. A null id, text or label takes no part; of
    repeated rows of one id the largest label and the first text in code point order count.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), fold, 0))
    known = known.select(F.col("doc_id"), F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    chosen = None
    for value, rows in most.items():
        part = known.where(F.col("y") == value).distinct().orderBy("h", "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y"))  # as many rows as ``most`` allows: safe to broadcast
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))  # one text of each chosen id
    return texts.toPandas().sort_values("doc_id").reset_index(drop=True)


def give_back() -> None:
    """Returns the memory of arrays that are no longer used to the system; the C library would keep it for the process."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(texts: Sequence[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` characters, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


_letters: np.ndarray | None = None


def alphanumeric() -> np.ndarray:
    """For each code point, whether it is a letter or a digit."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _letters


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
