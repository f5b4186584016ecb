"""Stories and their comment trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions.clock import Clock, epoch
from echolens.functions.text import is_filled
from echolens.operators.plan import joined_in_lots, materialised
from echolens.operators.tables import first_of_shared_keys, first_per_key
from echolens.sources.landing import message_id, to_messages, with_blank_line

SOURCE = "hackernews"
ITEM_PAGE = "https://news.ycombinator.com/item?id="


def _page(item: Column) -> Column:
    return F.concat(F.lit(ITEM_PAGE), item.cast("string"))


def stories(hits: DataFrame, as_of: Clock = None) -> DataFrame:
    """Search hits as messages, one per story however many search terms found it."""
    found = hits.where(is_filled(F.col("objectID")))
    once = first_of_shared_keys(found, "objectID", "created_at_i", "title", "story_text")
    page = _page(F.col("objectID"))
    return to_messages(
        once,
        SOURCE,
        F.concat(F.lit("story_"), F.col("objectID")),
        as_of=as_of,
        content=with_blank_line(F.col("title"), F.col("story_text")),
        title=F.col("title"),
        author=F.col("author"),
        url=F.when(is_filled(F.col("url")), F.col("url")).otherwise(page),
        created_at=epoch(F.col("created_at_i")),
        content_type=F.lit("discussion"),
        metadata=F.struct(
            F.coalesce("points", F.lit(0)).alias("points"),
            F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
            page.alias("hn_url"),
        ),
    )


def comment_tree(
    story_ids: DataFrame,
    items: DataFrame,
    max_depth: int | None = None,
    kids_per_story: int | None = None,
    kids_per_comment: int | None = None,
) -> DataFrame:
    """Comments below each story: all levels and all kids, or those down to ``max_depth`` and the first so many kids.

    Kids of a story have depth 0. A deleted, dead or missing comment cuts its whole subtree. Every live comment starts with a
    pointer to the item that lists it and the pointers are doubled: a round replaces a pointer by that of the item it
    leads to, so rounds grow with the logarithm of the depth, and each moves ids only. A pointer ends at a story; one that
    leads to an item without a pointer of its own has met the nearest cut and is dropped with its comment. What still
    moves once 2^rounds exceeds the number of comments runs in a circle and belongs to no story. An item that several
    others list counts below the one it names as its parent, else below the smallest id. Texts are joined at the end, where
    they are if ``items`` were stored in lots.
    """
    gone = F.coalesce("deleted", F.lit(False)) | F.coalesce("dead", F.lit(False))
    roots = story_ids.select(F.col("story_id").alias("id")).distinct().withColumn("root", F.lit(True))
    holders = items.select("id", "kids").join(roots, "id", "left")
    listed = holders.select(
        F.col("id").alias("at"), F.coalesce("root", F.lit(False)).alias("root"), F.posexplode("kids").alias("position", "id")
    )
    for width, kind in ((kids_per_story, F.col("root")), (kids_per_comment, ~F.col("root"))):
        if width is not None:
            listed = listed.where(~kind | (F.col("position") < width))
    links = listed.join(items.where(~gone).select("id", "parent"), "id")
    named = F.coalesce(F.col("parent") == F.col("at"), F.lit(False))
    links = first_per_key(links, "id", named.desc(), "at", "position")
    moving = materialised(links.select("id", "at", "root", F.lit(0).alias("depth")))
    settled, moving = moving.where("root"), moving.where(~F.col("root"))
    longest = moving.count() if max_depth is None else min(moving.count(), max_depth)
    for _ in range(longest.bit_length()):
        further = settled.unionByName(moving).select(
            F.col("id").alias("at"), F.col("at").alias("next"), F.col("root").alias("ended"), F.col("depth").alias("above")
        )
        moved = materialised(moving.join(further, "at").select(
            "id", F.col("next").alias("at"), F.col("ended").alias("root"), (F.col("depth") + F.col("above") + 1).alias("depth")
        ))
        settled, moving = settled.unionByName(moved.where("root")), moved.where(~F.col("root"))
        if moving.isEmpty():
            break
    reached = settled.select(F.col("at").alias("story_id"), "depth", "id")
    if max_depth is not None:
        reached = reached.where(F.col("depth") <= max_depth)
    return joined_in_lots(items, reached, "id", "text", "by", "parent", "time")


def comments(tree: DataFrame, as_of: Clock = None) -> DataFrame:
    thread = F.concat(F.lit("story_"), F.col("story_id").cast("string"))
    parent = F.col("parent")
    nested = parent.isNotNull() & (parent != 0) & (parent != F.col("story_id"))
    replied = F.when(nested, F.concat(F.lit("comment_"), parent.cast("string"))).otherwise(thread)
    return to_messages(
        tree,
        SOURCE,
        F.concat(F.lit("comment_"), F.col("id").cast("string")),
        as_of=as_of,
        content=F.coalesce("text", F.lit("")),
        author=F.col("by"),
        url=_page(F.col("id")),
        parent_id=message_id(SOURCE, replied),
        thread_id=message_id(SOURCE, thread),
        created_at=epoch(F.col("time")),
        metadata=F.struct("story_id"),
    )
