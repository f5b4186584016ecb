"""Context retrieval for tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions.text import is_filled, truncate
from echolens.operators import vectors as V

# The texts that stand in for missing context, and the separator.
NOTHING_FOUND = "No specific context found."
NOTHING_AVAILABLE = "No specific context available."
SEPARATOR = "\n\n---\n\n"

SOURCE_LIST = "array<struct<text:string,source:string,url:string>>"


def system_text(product: str) -> tuple[str, str]:
    """The support assistant's instruction, before and after the place of the context."""
    return (
        f"You answer questions about {product}. Use the excerpts from its documentation and community "
        "below where they apply, show code where it helps, keep to the point, and say when you are "
        "not sure.\n\nContext:\n",
        "\n",
    )


def retrieve(questions: DataFrame, vectors: DataFrame, k: int = 5, **search: object) -> DataFrame:
    """The ``k`` nearest stored texts per question: ``question_id``, ``rank``, text, source, url."""
    asked = questions.select(F.col("question_id").cast("string").alias("query_id"), "vector")
    hits = V.search(asked, vectors, k, payload=True, **search)
    return hits.select(
        F.col("query_id").alias("question_id"), "rank", "id", "distance", "text", "source", "url"
    )


def _per_question(hits: DataFrame, item: Column, name: str) -> DataFrame:
    """Items in rank order. A question has at most ``k`` hits, so the lists stay short."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))))
    return hits.groupBy("question_id").agg(F.transform(ranked, lambda hit: hit["item"]).alias(name))


def format_context(questions: DataFrame, hits: DataFrame, longest: int | None = None) -> DataFrame:
    """One context text per question, also for questions without hits; of whole texts or their first ``longest`` characters."""
    url_line = F.when(is_filled(F.col("url")), F.concat(F.lit("\nURL: "), F.col("url"))).otherwise("")
    part = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), F.coalesce("source", F.lit("unknown")),
        url_line, F.lit("\n"), truncate(F.coalesce("text", F.lit("")), longest),
    )
    parts = _per_question(hits, part, "parts")
    context = F.coalesce(F.array_join("parts", SEPARATOR), F.lit(NOTHING_FOUND))
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"))
    return asked.join(parts, "question_id", "left").select("question_id", context.alias("context"))


def context_sources(
    questions: DataFrame, hits: DataFrame, use_rag: bool = True, longest: int | None = None
) -> DataFrame:
    """The cited sources of each question and whether any context was used."""
    cited = F.struct(truncate(F.coalesce("text", F.lit("")), longest).alias("text"), "source", "url")
    found = _per_question(hits if use_rag else hits.limit(0), cited, "sources")
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"))
    sources = F.coalesce("sources", F.array().cast(SOURCE_LIST))
    return asked.join(found, "question_id", "left").select(
        "question_id", sources.alias("sources"), (F.size(sources) > 0).alias("used_rag")
    )


def build_prompts(
    questions: DataFrame, hits: DataFrame, product: str, use_rag: bool = True, longest: int | None = None
) -> DataFrame:
    """Chat messages per question (``question_id``, ``question``): instruction with context, question."""
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"), "question")
    contexts = format_context(questions, hits if use_rag else hits.limit(0), longest)
    context = F.when(F.col("context") == NOTHING_FOUND, NOTHING_AVAILABLE).otherwise(F.col("context"))
    head, tail = system_text(product)
    system = F.concat(F.lit(head), context, F.lit(tail))
    messages = F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
    )
    return asked.join(contexts, "question_id").select("question_id", messages.alias("messages"))
