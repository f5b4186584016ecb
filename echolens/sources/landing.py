"""Landed raw records: their schemas and readers.

A landing folder holds JSON lines, one API object per line, as fetched; the fetcher only adds the
context an object does not carry itself (``owner``/``repo``, ``issue_number``, ``post_id``).
Atom feeds are landed as XML files under ``subreddit=<name>/`` folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.functions.clock import Clock, now
from echolens.schemas import as_messages

LANDED = {
    "github_issues": """
        owner STRING, repo STRING, number BIGINT, title STRING, body STRING, user STRUCT<login STRING>,
        html_url STRING, created_at STRING, updated_at STRING, state STRING,
        labels ARRAY<STRUCT<name STRING>>, reactions VARIANT, comments BIGINT, pull_request STRING""",
    "github_issue_comments": """
        owner STRING, repo STRING, issue_number BIGINT, id BIGINT, body STRING,
        user STRUCT<login STRING>, html_url STRING, created_at STRING""",
    "github_discussions": """
        owner STRING, repo STRING, number BIGINT, title STRING, body STRING,
        author STRUCT<login STRING>, url STRING, createdAt STRING, updatedAt STRING,
        category STRUCT<name STRING>,
        comments STRUCT<nodes ARRAY<STRUCT<id STRING, body STRING, author STRUCT<login STRING>,
            createdAt STRING, url STRING>>>""",
    "hn_stories": """
        objectID STRING, title STRING, story_text STRING, author STRING, url STRING,
        created_at_i BIGINT, points BIGINT, num_comments BIGINT""",
    "hn_items": """
        id BIGINT, text STRING, by STRING, parent BIGINT, time BIGINT, kids ARRAY<BIGINT>,
        deleted BOOLEAN, dead BOOLEAN""",
    "reddit_posts": """
        id STRING, title STRING, selftext STRING, author STRING, permalink STRING,
        created_utc DOUBLE, subreddit STRING, score BIGINT, num_comments BIGINT,
        upvote_ratio DOUBLE, link_flair_text STRING""",
    "reddit_comments": """
        post_id STRING, children ARRAY<STRUCT<data STRUCT<id STRING, body STRING, author STRING,
            permalink STRING, created_utc DOUBLE, subreddit STRING, score BIGINT>>>""",
    "repo_files": "owner STRING, repo STRING, position BIGINT, path STRING, content STRING",
    "pages": "url STRING, html STRING",
}

ATOM_ENTRY = (
    "title STRING, link STRUCT<_href STRING>, content STRING, updated STRING, "
    "author STRUCT<name STRING>, id STRING"
)


def read_landed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of one kind from JSON-lines files."""
    return spark.read.schema(LANDED[kind]).json(path)


def parse_landed(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Records of one kind from a column of JSON text.

    A generator makes the columns: filters on them stay above it, so each line is parsed once. A line that is no
    record gives a row of NULLs, which has no id and so becomes no message; ``rejects`` has such lines.
    """
    return lines.select(F.inline(F.array(F.from_json(column, LANDED[kind]))))


def rejects(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """The lines that are no record of the kind, with all columns; count them to see how much of a landing was lost."""
    schema = LANDED[kind] + ", _damaged STRING"
    parsed = F.from_json(column, schema, {"columnNameOfCorruptRecord": "_damaged"})
    return lines.where(parsed.isNull() | parsed["_damaged"].isNotNull())


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed Atom files; ``subreddit`` comes from the folder name."""
    return (
        spark.read.format("xml")
        .option("rowTag", "entry")
        .schema(ATOM_ENTRY + ", subreddit STRING")
        .load(path)
    )


def parse_atom(entries: DataFrame, column: str = "value") -> DataFrame:
    """Entries from a column of ``<entry>`` text; other columns are kept."""
    others = [name for name in entries.columns if name != column]
    return entries.select(*others, F.inline(F.array(F.from_xml(column, ATOM_ENTRY))))


def to_messages(
    rows: DataFrame,
    source: str,
    source_id: Column,
    *,
    metadata: Column,
    as_of: Clock = None,
    id_prefix: str | None = None,
    **columns: Column,
) -> DataFrame:
    """Message rows; the id is ``source:source_id`` and the metadata struct becomes JSON text.

    A record without what its id is made of is no message.
    """
    made = as_messages(
        rows,
        id=message_id(id_prefix or source, source_id),
        source=F.lit(source),
        source_id=source_id,
        fetched_at=now(as_of),
        metadata=F.to_json(metadata, {"ignoreNullFields": "false"}),
        topics=F.lit("[]"),
        **columns,
    )
    return made.where(F.col("id").isNotNull())


def message_id(source: str, source_id: Column) -> Column:
    return F.concat(F.lit(source + ":"), source_id)


def with_blank_line(head: Column, tail: Column) -> Column:
    """``head``, then a blank line and ``tail`` where there is one."""
    head = F.coalesce(head, F.lit(""))
    return F.when(tail.isNotNull() & (tail != ""), F.concat(head, F.lit("\n\n"), tail)).otherwise(head)
