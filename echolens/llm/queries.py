"""The registered queries of the operators: each applies one to its whole table and returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.llm import (
    language, mixing, mtree, nearvec, ngramjoin, packing, pagetext, quality, secrets, spelling, toxicity, warc, whitening,
)
from echolens.llm.common import fresh_folder, in_fold, table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; every machine of a cluster has it there."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return _classified(scored, 5, 0, 0.5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return _classified(scored, 5, 0, 0.3)


def _classified(scored: DataFrame, modulus: int, remainder: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", in_fold(F.col("doc_id"), modulus, remainder).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op2_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(mtree.usable(F.col("embedding")))
    vectors = rows.select("vec_id", mtree.scaled(F.col("embedding")).alias("vector"))
    return mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvec.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "warc")
    records = warc.read(warc.write(table(spark, sf_dir, "pages"), folder), folder)
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pagetext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), with_ids=False)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = language.predict(docs.select("doc_id", "text"), language.fit(docs, tokenizer_file("piece_bpe_32k.model")))
    return named.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn(
        "spans", secrets.span_text(F.col("found"))
    )
    counts = [secrets.count_of(F.col("found"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    queries = (
        op1_toxicity, op2_top_products, op3_near_vectors, op4_ngram_join, op5_warc, op6_quality, op7_page_text,
        op8_packing, op9_mixing, op10_language, op11_spelling, op12_whitening, op13_secrets,
    )
    return {query.__name__: query for query in queries}
