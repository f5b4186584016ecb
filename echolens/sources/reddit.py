"""Posts and comments from the API, and posts from Atom feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions.clock import Clock, epoch, iso_or_now
from echolens.functions.text import (
    FEED_QUESTION_WORDS,
    TITLE_QUESTION_WORDS,
    RelevanceRules,
    contains_any,
    is_filled,
    is_relevant,
    strip_html,
)
from echolens.operators.plan import brought_to_lots, evaluated_once
from echolens.operators.tables import first_per_key, row_hash
from echolens.sources.landing import message_id, to_messages, with_blank_line

SOURCE = "reddit"
SITE = "https://reddit.com"


def _question_or_discussion(title: Column, words: tuple[str, ...]) -> Column:
    asks = title.contains("?") | contains_any(F.lower(title), words)
    return F.when(asks, "question").otherwise("discussion")


def _site_url(permalink: Column) -> Column:
    return F.concat(F.lit(SITE), F.coalesce(permalink, F.lit("")))


def posts(raw: DataFrame, as_of: Clock = None) -> DataFrame:
    return to_messages(
        raw,
        SOURCE,
        F.concat(F.lit("post_"), F.col("id")),
        as_of=as_of,
        content=with_blank_line(F.col("title"), F.col("selftext")),
        title=F.col("title"),
        author=F.col("author"),
        url=_site_url(F.col("permalink")),
        created_at=epoch(F.col("created_utc")),
        content_type=_question_or_discussion(F.coalesce("title", F.lit("")), TITLE_QUESTION_WORDS),
        metadata=F.struct(
            "subreddit",
            F.coalesce("score", F.lit(0)).alias("score"),
            F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
            F.coalesce("upvote_ratio", F.lit(0.0)).alias("upvote_ratio"),
            F.col("link_flair_text").alias("flair"),
        ),
    )


def comments(raw: DataFrame, as_of: Clock = None) -> DataFrame:
    """Top-level comments with a body; deleted ones have none."""
    rows = raw.select("post_id", F.explode("children.data").alias("c")).where(is_filled(F.col("c.body")))
    parent = message_id(SOURCE, F.concat(F.lit("post_"), F.col("post_id")))
    return to_messages(
        rows,
        SOURCE,
        F.concat(F.lit("comment_"), F.col("c.id")),
        as_of=as_of,
        content=F.col("c.body"),
        author=F.col("c.author"),
        url=_site_url(F.col("c.permalink")),
        parent_id=parent,
        thread_id=parent,
        created_at=epoch(F.col("c.created_utc")),
        metadata=F.struct(
            F.col("c.subreddit"), F.coalesce("c.score", F.lit(0)).alias("score"), "post_id"
        ),
    )


def atom_entries(entries: DataFrame) -> DataFrame:
    """Flat feed entries; those without title or id are dropped."""
    return entries.where(F.col("title").isNotNull() & F.col("id").isNotNull()).select(
        "subreddit",
        F.col("id").alias("entry_id"),
        "title",
        F.coalesce("link._href", F.lit("")).alias("link"),
        F.coalesce("content", F.lit("")).alias("content"),
        "updated",
        F.col("author.name").alias("author"),
    )


def atom_posts(
    entries: DataFrame, rules: RelevanceRules, as_of: Clock = None, store: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Relevant feed entries as messages, one per post however many feeds carry it.

    With ``store``, which is ``plan.stored_in_lots``, relevant entries are stored once, posts are chosen by narrow columns, and no
    text is shuffled.
    """
    kept = ("subreddit", "entry_id", "title", "link", "updated", "author")
    rows = evaluated_once(atom_entries(entries), *kept, content=strip_html(F.col("content")))
    rows = rows.where(is_relevant(F.col("title"), F.col("content"), rules))
    word = "([A-Za-z0-9_]+)"
    by_id = F.nullif(F.regexp_extract("entry_id", "t3_" + word, 1), F.lit(""))
    by_link = F.nullif(F.regexp_extract("link", f"/comments/{word}/", 1), F.lit(""))
    hashed = F.xxhash64("entry_id").cast("string")
    rows = rows.withColumn("source_id", F.concat(F.lit("post_"), F.coalesce(by_id, by_link, hashed)))
    order = ("subreddit", "updated", "entry_id")
    if store:
        lots = store(rows.withColumn("_hash", row_hash(rows)))
        chosen = first_per_key(lots.select("source_id", *order, "_hash", "_lot", "_place"), "source_id", *order, "_hash")
        rows = brought_to_lots(chosen.select("_lot", "_place"), lots.drop("_hash"))
    else:
        rows = first_per_key(rows, "source_id", *order)
    title, content = F.col("title"), F.col("content")
    return to_messages(
        rows,
        SOURCE,
        F.col("source_id"),
        as_of=as_of,
        content=F.when(content == title, title).otherwise(with_blank_line(title, content)),
        title=title,
        author=F.col("author"),
        url=F.col("link"),
        created_at=iso_or_now(F.col("updated"), as_of),
        content_type=_question_or_discussion(title, FEED_QUESTION_WORDS),
        metadata=F.struct("subreddit", F.lit("rss").alias("via")),
    )
