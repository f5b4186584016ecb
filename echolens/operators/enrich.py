"""Batch embedding and classification with models the caller supplies.

A model comes as a factory that every Python worker calls once per task; the function it returns takes
a list of inputs. Tasks stream Arrow batches through it, so no partition is held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolens.functions.clock import Clock
from echolens.functions.text import strip, truncate
from echolens.operators import tables, vectors
from echolens.operators.analysed import (
    ANALYSIS, analysis_path, append_analysis, messages_with, queued_ids, read_messages, refresh_days,
)
from echolens.operators.plan import evaluated_once, materialised
from echolens.schemas import CHAT, CONTENT_TYPES, EMOTIONS, LABELS, SENTIMENTS, TOPICS, VECTORS
from echolens.sources.snapshots import read_snapshot, write_snapshot

Embedder = Callable[[list[str]], list[list[float]]]
Classifier = Callable[[list[list[dict[str, str]]]], list[str]]

# Batch size and the labels of a response that cannot be used.
BATCH = 32
DEFAULT_LABELS = {
    "sentiment_simple": "neutral",
    "sentiment_rich": "neutral",
    "content_type": "discussion",
}
ON_ERROR_DEFAULTS, ON_ERROR_SKIP = "defaults", "skip"
NO_ANSWER = "NoAnswer: the model gave none"


def _chunks(batch: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    for start in range(0, len(batch), size):
        yield batch.iloc[start : start + size]


def embed(
    rows: DataFrame, load_embedder: Callable[[], Embedder], text: str = "text", batch_size: int = BATCH
) -> DataFrame:
    """Add ``vector``, the embedding of the column ``text``."""
    schema = T.StructType(rows.schema.fields + [T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = load_embedder()
        for batch in batches:
            for chunk in _chunks(batch, batch_size):
                yield chunk.assign(vector=embedder(chunk[text].tolist()))

    return rows.mapInPandas(run, schema)


def vector_records(
    messages: DataFrame, load_embedder: Callable[[], Embedder], batch_size: int = BATCH, longest: int | None = None
) -> DataFrame:
    """Rows of the vector table for messages, of their whole texts; ``longest`` cuts them for a model that must."""
    rows = messages.select(
        "id",
        truncate(F.col("content"), longest).alias("text"),
        "source",
        "created_at",
        "url",
        F.struct("title").alias("metadata"),
    )
    return embed(rows, load_embedder, "text", batch_size).select(*VECTORS.names)


def search_text(
    questions: DataFrame,
    stored: DataFrame,
    load_embedder: Callable[[], Embedder],
    k: int = 10,
    **search: object,
) -> DataFrame:
    """Embed ``question`` texts (``query_id``, ``question``) and search with them."""
    asked = materialised(embed(questions, load_embedder, "question"))
    return vectors.search(asked, stored, k, **search)


def taxonomy_text(product: str) -> str:
    """The classifier's instruction, made from the label sets."""
    lists = {
        "sentiment_simple": ("the overall sentiment, one of", SENTIMENTS),
        "sentiment_rich": ("the dominant emotion, one of", EMOTIONS),
        "content_type": ("the kind of message, one of", CONTENT_TYPES),
        "topics": ("every topic it touches, a list from", TOPICS),
    }
    lines = [f"- {name}: {what} {', '.join(values)}" for name, (what, values) in lists.items()]
    return (
        f"Classify a community message about {product}. Give\n"
        + "\n".join(lines)
        + "\nAnswer with one JSON object that has exactly these keys, and nothing else."
    )


def sentiment_prompts(messages: DataFrame, system: str, longest: int | None = None) -> DataFrame:
    """Chat messages that ask for the labels of each message, whole or cut to ``longest`` characters."""
    asked = F.concat(
        F.lit("Analyze this message:\n\n"), truncate(F.coalesce("content", F.lit("")), longest)
    )
    prompt = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), asked.alias("content")),
    )
    return messages.select("id", prompt.cast(CHAT).alias("prompt"))


def _error(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def classify(
    prompts: DataFrame,
    load_classifier: Callable[[], Classifier],
    on_error: str = ON_ERROR_DEFAULTS,
    batch_size: int = 8,
    errors: bool = False,
) -> DataFrame:
    """Model ``response`` per prompt. A failed prompt gets NULL, or is left out with ``skip``.

    The model is asked for ``batch_size`` prompts at a time, and its answers leave the worker by Arrow batches, as prompts come in.
    When a batch fails its prompts are tried one by one, so one bad message costs no other. With ``errors`` the column
    ``error`` says what went wrong, NULL where nothing did, so that failures can be counted and told apart.
    """

    def one_by_one(model: Classifier, asked: list) -> tuple[list[str | None], list[str | None]]:
        answers, failed = [], []
        for prompt in asked:
            try:
                (answer,) = model([prompt])
                answers.append(answer)
                failed.append(None)
            except Exception as error:  # whatever a model raises; it is named in the result
                answers.append(None)
                failed.append(_error(error))
        return answers, failed

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_classifier()
        for batch in batches:
            prompts = batch.column("prompt").to_pylist()
            responses, errors = [], []
            for start in range(0, len(prompts), batch_size):
                asked = prompts[start : start + batch_size]
                failed: list[str | None] = [None] * len(asked)
                try:
                    answers = list(model(asked))
                    if len(answers) != len(asked):
                        raise ValueError(f"{len(answers)} answers to {len(asked)} prompts")
                except Exception:
                    answers, failed = one_by_one(model, asked)
                responses.extend(answers)
                errors.extend(f or (NO_ANSWER if a is None else None) for a, f in zip(answers, failed))
            texts = [pa.array(column, pa.string(), from_pandas=True) for column in (responses, errors)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *texts], ["id", "response", "error"])

    responses = prompts.select("id", "prompt").mapInArrow(run, "id string, response string, error string")
    responses = responses.where(F.col("response").isNotNull()) if on_error == ON_ERROR_SKIP else responses
    return responses if errors else responses.drop("error")


def error_counts(rows: DataFrame) -> DataFrame:
    """How many rows failed by kind of error."""
    kind = F.split_part("error", F.lit(":"), F.lit(1)).alias("error")
    return rows.where(F.col("error").isNotNull()).groupBy(kind).agg(F.count("*").alias("count"))


def response_json(response: Column) -> Column:
    """Text inside the first json fence, else inside the first fence, else all of it."""
    fence = F.lit("```")

    def after(text: Column, mark: str) -> Column:
        return F.substring(text, F.instr(text, F.lit(mark)) + len(mark), F.length(text))

    def up_to_fence(text: Column) -> Column:
        end = F.instr(text, fence)
        return F.when(end > 0, F.substring(text, F.lit(1), end - 1)).otherwise(text)

    text = strip(response)
    return (
        F.when(text.contains("```json"), up_to_fence(after(text, "```json")))
        .when(text.contains("```"), up_to_fence(after(text, "```")))
        .otherwise(text)
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Labels from model responses; a missing key, a null or text that is no JSON object gives defaults."""
    kept = [name for name in responses.columns if name != "response"]
    rows = evaluated_once(responses, *kept, _json=response_json(F.col("response")))
    # Wrapped in brackets, an object followed by anything else is not a list of one.
    single = F.json_array_length(F.concat(F.lit("["), F.col("_json"), F.lit("]"))) == 1
    parsed = F.from_json(F.when(single, F.col("_json")), LABELS, {"allowSingleQuotes": "false"})
    rows = evaluated_once(rows, *kept, _labels=parsed)
    defaults = [
        F.coalesce(f"_labels.{name}", F.lit(value)).alias(name) for name, value in DEFAULT_LABELS.items()
    ]
    topics = F.coalesce("_labels.topics", F.array().cast("array<string>")).alias("topics")
    return rows.select(*kept, *defaults, topics)


def run_embedding_job(
    spark: SparkSession,
    messages_path: str,
    vectors_path: str,
    load_embedder: Callable[[], Embedder],
    limit: int | None = None,
    as_of: Clock = None,
) -> int:
    """Embed the queue, add the vectors, then mark the messages. Returns the marked rows.

    What is written grows with the queue, not with the tables. The vectors are a complete version before any message
    is marked; a run lost in between is made up by the next, which marks what has a vector without embedding it again.
    """
    chosen = materialised(queued_ids(spark, messages_path, tables.embedding_queue, limit))
    known = read_snapshot(spark, vectors_path, VECTORS).select("id")
    queue = messages_with(spark, messages_path, chosen.join(known, "id", "left_anti"))
    write_snapshot(vector_records(queue, load_embedder), vectors_path, partition_by="source", sort_by="id", added=True)
    written = read_snapshot(spark, vectors_path, VECTORS).select("id")
    marks = chosen.join(written, "id", "left_semi").withColumn("embedding_id", F.col("id"))
    version = append_analysis(marks, messages_path, as_of)
    return read_snapshot(spark, analysis_path(messages_path), ANALYSIS, version, since=version).count()


class SentimentRun(NamedTuple):
    """Messages that were labelled, and those that were not by kind of error."""

    processed: int
    failed: dict[str, int]


def run_sentiment_job(
    spark: SparkSession,
    messages_path: str,
    labels_path: str,
    metrics_path: str,
    load_classifier: Callable[[], Classifier],
    product: str,
    limit: int | None = None,
    as_of: Clock = None,
) -> SentimentRun:
    """Label the queue, add the labels and refresh the days they touch.

    The answers are written once, with their errors, below ``labels_path``, before they are used, so a lost executor never
    asks the model twice for labels that then differ. A message whose answer failed stays in the queue. If every answer
    failed, the model is at fault rather than a message: the run raises.
    """
    chosen = materialised(queued_ids(spark, messages_path, tables.sentiment_queue, limit))
    if chosen.isEmpty():
        return SentimentRun(0, {})
    prompts = sentiment_prompts(messages_with(spark, messages_path, chosen), taxonomy_text(product))
    answers = parse_responses(classify(prompts, load_classifier, errors=True))
    version = write_snapshot(answers, labels_path, added=True)
    answers = read_snapshot(spark, labels_path, answers.schema, version, since=version)
    failed = {row["error"]: row["count"] for row in error_counts(answers).collect()}  # a row for each kind of error
    labels = answers.where(F.col("error").isNull()).drop("error")
    processed = labels.count()
    if not processed:
        raise RuntimeError(f"the model failed for every message: {failed}")
    append_analysis(labels, messages_path, as_of)
    current = read_messages(spark, messages_path, texts=False)
    refresh_days(spark, current, current.join(labels.select("id"), "id", "left_semi"), metrics_path)
    return SentimentRun(processed, failed)
