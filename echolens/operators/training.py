"""Instruction examples from documents and threads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.functions.text import (
    SPACE,
    THREAD_QUESTION_WORDS,
    clean_content,
    computed_once,
    contains_any,
    strip,
    title_to_question,
    truncate,
)
from echolens.operators.filters import is_knowledge

# Lengths that decide what becomes an example.
CANDIDATE_CHARS = 100
SHORTEST_DOC = 200
SHORTEST_PART = 100
MOST_QUESTION_MARKS = 2


@dataclass(frozen=True)
class Cuts:
    """Characters kept of each text, None for all; documents longer than ``longest_doc`` are left out if it is given.

    ``question_head`` is how far into a message a question word is looked for.
    """

    longest_doc: int | None = None
    whole_doc: int | None = None
    section: int | None = None
    question: int | None = None
    answer: int | None = None
    question_head: int | None = None


UNCUT = Cuts()


def instruction(product: str) -> str:
    return (
        f"You are a support assistant for {product}. Answer correctly and briefly, show code where it "
        "helps, and say so when you do not know."
    )


def training_candidates(messages: DataFrame) -> DataFrame:
    """Messages long enough to learn from. This runs before threads are built."""
    return messages.where(F.length("content") > CANDIDATE_CHARS)


def _documents(messages: DataFrame, cuts: Cuts) -> DataFrame:
    rows = messages.where(is_knowledge() & (F.length("content") >= SHORTEST_DOC))
    return rows if cuts.longest_doc is None else rows.where(F.length("content") <= cuts.longest_doc)


def _parts(messages: DataFrame, cuts: Cuts) -> DataFrame:
    """Sections of each document from position 1, or at position 0 the whole of one without headers."""
    content = F.col("content")
    parts = F.split(content, rf"\n#{{1,3}}{SPACE}+", -1)
    headers = F.regexp_extract_all(content, F.lit(rf"\n(#{{1,3}}{SPACE}+[^\n]+)"), 1)

    def part(position: Column, header: Column, text: Column) -> Column:
        return F.struct(position.alias("position"), header.alias("header"), text.alias("text"))

    # Header i goes with part i + 1; where the two lists differ in length the longer tail is dropped.
    def sections(cut: Column) -> Column:
        return F.transform(
            cut["headers"],
            lambda header, i: part(
                i + 1, strip(F.ltrim(strip(header), F.lit("#"))), strip(F.get(cut["parts"], i + 1))
            ),
        )

    whole = F.array(part(F.lit(0), F.col("title"), content))

    def found(cut: Column) -> Column:
        return F.when(F.size(cut["headers"]) > 0, sections(cut)).otherwise(whole)

    cut = F.struct(headers.alias("headers"), parts.alias("parts"))
    return _documents(messages, cuts).select("id", F.inline(computed_once(cut, found)))


def doc_sections(messages: DataFrame, cuts: Cuts = UNCUT) -> DataFrame:
    """Sections of knowledge documents that are long enough: ``id``, ``position``, ``header``, ``text``.

    A header needs a line break before it, so one on the first line is not seen. The text up to the
    first header belongs to no section.
    """
    return _parts(messages, cuts).where((F.col("position") > 0) & (F.length("text") >= SHORTEST_PART))


def doc_examples(messages: DataFrame, product: str, cuts: Cuts = UNCUT) -> DataFrame:
    """One example per section, or per titled document without headers."""
    position = F.col("position")
    rows = _parts(messages, cuts).where((position == 0) | (F.length("text") >= SHORTEST_PART))
    text = F.when(position == 0, truncate(F.col("text"), cuts.whole_doc)).otherwise(
        truncate(F.col("text"), cuts.section)
    )
    return rows.select(
        F.concat_ws("#", "id", position.cast("string")).alias("example_id"),
        F.lit("docs").alias("source"),
        title_to_question(F.col("header"), product).alias("input"),
        clean_content(text).alias("output"),
    ).where(F.col("input").isNotNull())


def qa_pairs(messages: DataFrame, cuts: Cuts = UNCUT) -> DataFrame:
    """The opening question of each thread with its first substantial answer.

    A thread may hold most messages, so none is gathered: one aggregate keeps the opening message and
    a window keeps the two earliest answer candidates of each thread, both reduced per task before the
    shuffle. Two are enough, since at most one candidate is the opening message itself. These rows are narrow; texts are read
    once more for the two messages of each pair.
    """
    content = F.coalesce("content", F.lit(""))
    # Cut before lower-casing, so that only the head is lower-cased; some letters grow by it.
    head = truncate(F.lower(truncate(content, cuts.question_head)), cuts.question_head)
    asks = (
        F.coalesce(F.col("content_type") == "question", F.lit(False))
        | content.contains("?")
        | contains_any(head, THREAD_QUESTION_WORDS)
    )
    marks = F.length(content) - F.length(F.replace(content, F.lit("?"), F.lit("")))
    answers = (F.length(content) >= SHORTEST_PART) & (marks <= MOST_QUESTION_MARKS)
    rows = messages.select(F.coalesce("thread_id", "id").alias("thread"), "created_at", "id",
                           asks.alias("asks"), answers.alias("answers"))
    opening = rows.groupBy("thread").agg(
        F.min(F.struct("created_at", "id", "asks")).alias("first"), F.count("*").alias("size"),
    ).where((F.col("size") >= 2) & F.col("first.asks"))
    earliest = Window.partitionBy("thread").orderBy("created_at", "id")
    candidates = (
        rows.where(F.col("answers"))
        .select("thread", "created_at", "id", F.row_number().over(earliest).alias("rank"))
        .where(F.col("rank") <= 2)
    )
    pairs = (
        opening.join(candidates, "thread")
        .where(F.col("id") != F.col("first.id"))
        .groupBy("thread")
        .agg(F.min(F.struct("created_at", "id")).alias("reply"), F.first("first.id").alias("question_id"))
    )
    wanted = F.array(F.struct(F.col("question_id").alias("id"), F.lit(True).alias("opens")),
                     F.struct(F.col("reply.id").alias("id"), F.lit(False).alias("opens")))
    parts = pairs.select("thread", F.inline(wanted)).join(messages.select("id", "source", content.alias("content")), "id")
    opens = F.col("opens")
    found = parts.groupBy("thread").agg(
        F.max(F.when(opens, F.col("source"))).alias("source"), F.max(F.when(opens, F.col("content"))).alias("question"),
        F.max(F.when(~opens, F.col("content"))).alias("answer"),
    )
    return found.select(
        F.concat(F.lit("thread:"), F.col("thread")).alias("example_id"),
        "source",
        clean_content(truncate(F.col("question"), cuts.question)).alias("input"),
        clean_content(truncate(F.col("answer"), cuts.answer)).alias("output"),
    )


def training_examples(messages: DataFrame, product: str, cuts: Cuts = UNCUT) -> DataFrame:
    rows = training_candidates(messages)
    return doc_examples(rows, product, cuts).unionByName(qa_pairs(rows, cuts))


def chat_examples(examples: DataFrame, system: str) -> DataFrame:
    """Examples as chat messages; an empty input leaves the user turn out."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    turns = F.array(
        turn("system", F.lit(system)), turn("user", F.col("input")), turn("assistant", F.col("output"))
    )
    kept = F.filter(turns, lambda t: (t["role"] != "user") | F.coalesce(t["content"] != "", F.lit(False)))
    return examples.select("example_id", kept.alias("messages"))


def train_val_split(examples: DataFrame, share: float = 0.9, seed: int = 42) -> DataFrame:
    """Add ``split``: a seeded shuffle puts exactly ``int(share * rows)`` examples into train.

    The shuffle order is a hash of the unique ``example_id``. Counting rows per hash prefix finds the
    one prefix the boundary falls into; only rows with that prefix are ranked.
    """
    ordered = examples.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col("example_id"))))
    ordered = ordered.withColumn("_bucket", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))
    counts = ordered.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    # One row per prefix, at most 65,536: small for one task and for a broadcast.
    running = Window.orderBy("_bucket")
    whole = Window.partitionBy()
    limits = counts.select(
        "_bucket",
        (F.sum("_rows").over(running) - F.col("_rows")).alias("_before"),
        "_rows",
        F.floor(F.sum("_rows").over(whole) * F.lit(share)).alias("_train"),
    )
    rows = ordered.join(F.broadcast(limits), "_bucket")
    whole_bucket = F.col("_before") + F.col("_rows") <= F.col("_train")
    outside = F.col("_before") >= F.col("_train")
    names = examples.columns
    clear = rows.where(whole_bucket | outside).select(
        *names, F.when(whole_bucket, "train").otherwise("val").alias("split")
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", "example_id"))
    boundary = rows.where(~whole_bucket & ~outside).withColumn("_rank", rank)
    inside = F.col("_before") + F.col("_rank") <= F.col("_train")
    return clear.unionByName(boundary.select(*names, F.when(inside, "train").otherwise("val").alias("split")))


def save_dataset(chat: DataFrame, path: str, share: float = 0.9, seed: int = 42) -> tuple[str, str]:
    """Write ``{"messages": [...]}`` lines for training and validation; returns the two folders.

    ``chat`` is read twice, once to find the boundary of the split: give it a stored table.
    """
    split = train_val_split(chat, share, seed).select("messages", "split")
    split.write.mode("overwrite").partitionBy("split").json(path)
    return f"{path}/split=train", f"{path}/split=val"


def prepare_training_data(messages: DataFrame, path: str, product: str) -> tuple[str, str]:
    """Examples from messages, stored as chat lines below ``path``; returns the two folders."""
    chat = chat_examples(training_examples(messages, product), instruction(product))
    stored = f"{path}/examples"
    chat.write.mode("overwrite").parquet(stored)
    return save_dataset(messages.sparkSession.read.schema(chat.schema).parquet(stored), f"{path}/chat")
