"""Issues, discussions and their comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions.clock import Clock, iso_utc
from echolens.operators.metrics import latest_fetch
from echolens.sources.landing import message_id, to_messages

SOURCE = "github"

# Issue labels and discussion categories that decide the content type, in order.
LABEL_TYPES = (
    ("bug_report", ("bug", "bug-report")),
    ("feature_request", ("enhancement", "feature", "feature-request")),
    ("question", ("question", "help-wanted")),
)
CATEGORY_TYPES = (
    ("question", ("q&a", "question")),
    ("feature_request", ("ideas", "feature")),
    ("announcement", ("announcement",)),
)


def since_filter(rows: DataFrame, state: DataFrame, updated_at: str = "updated_at") -> DataFrame:
    """Rows updated at or after their source's last fetch; all rows of a source never fetched."""
    last = latest_fetch(state)
    fresh = F.col("last_fetched_at").isNull() | (F.col(updated_at) >= F.col("last_fetched_at"))
    return rows.join(last, "source", "left").where(fresh).drop("last_fetched_at")


def issues(raw: DataFrame, as_of: Clock = None) -> DataFrame:
    """Issues as messages; pull requests, which share the endpoint, are dropped."""
    labels = F.transform(F.coalesce("labels.name", F.array().cast("array<string>")), F.lower)
    content_type: Column | None = None
    for name, values in LABEL_TYPES:
        hit = F.arrays_overlap(labels, F.array(*map(F.lit, values)))
        content_type = F.when(hit, name) if content_type is None else content_type.when(hit, name)
    return to_messages(
        raw.where(F.col("pull_request").isNull()),
        SOURCE,
        _number_id("issue", F.col("number")),
        as_of=as_of,
        content=F.concat(F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit(""))),
        title=F.col("title"),
        author=F.col("user.login"),
        url=F.col("html_url"),
        created_at=iso_utc(F.col("created_at")),
        content_type=content_type.otherwise("discussion"),
        metadata=F.struct(
            _repo(),
            F.lit("issue").alias("type"),
            "number",
            "state",
            labels.alias("labels"),
            F.coalesce("reactions", F.parse_json(F.lit("{}"))).alias("reactions"),
        ),
    )


def issue_comments(raw: DataFrame, as_of: Clock = None) -> DataFrame:
    parent = _number_id("issue", F.col("issue_number"))
    return to_messages(
        raw,
        SOURCE,
        _comment_id(parent, F.col("id").cast("string")),
        as_of=as_of,
        content=F.coalesce("body", F.lit("")),
        author=F.col("user.login"),
        url=F.col("html_url"),
        parent_id=message_id(SOURCE, parent),
        thread_id=message_id(SOURCE, parent),
        created_at=iso_utc(F.col("created_at")),
        metadata=F.struct(_repo(), F.lit("issue_comment").alias("type"), "issue_number"),
    )


def discussions(raw: DataFrame, as_of: Clock = None) -> DataFrame:
    category = F.lower(F.coalesce("category.name", F.lit("")))
    content_type: Column | None = None
    for name, parts in CATEGORY_TYPES:
        hit = F.lit(False)
        for part in parts:
            hit = hit | category.contains(part)
        content_type = F.when(hit, name) if content_type is None else content_type.when(hit, name)
    return to_messages(
        raw,
        SOURCE,
        _number_id("discussion", F.col("number")),
        as_of=as_of,
        content=F.concat(F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit(""))),
        title=F.col("title"),
        author=F.col("author.login"),
        url=F.col("url"),
        created_at=iso_utc(F.col("createdAt")),
        content_type=content_type.otherwise("discussion"),
        metadata=F.struct(
            _repo(), F.lit("discussion").alias("type"), "number", category.alias("category")
        ),
    )


def discussion_comments(raw: DataFrame, as_of: Clock = None) -> DataFrame:
    nodes = raw.select("owner", "repo", "number", F.explode("comments.nodes").alias("c"))
    parent = _number_id("discussion", F.col("number"))
    return to_messages(
        nodes,
        SOURCE,
        _comment_id(parent, F.col("c.id")),
        as_of=as_of,
        content=F.coalesce("c.body", F.lit("")),
        author=F.col("c.author.login"),
        url=F.col("c.url"),
        parent_id=message_id(SOURCE, parent),
        thread_id=message_id(SOURCE, parent),
        created_at=iso_utc(F.col("c.createdAt")),
        metadata=F.struct(
            _repo(),
            F.lit("discussion_comment").alias("type"),
            F.col("number").alias("discussion_number"),
        ),
    )


def _repo() -> Column:
    return F.concat_ws("/", "owner", "repo").alias("repo")


def _number_id(kind: str, number: Column) -> Column:
    return _joined(F.col("owner"), F.col("repo"), F.lit(kind), number.cast("string"))


def _comment_id(parent: Column, comment: Column) -> Column:
    return _joined(parent, F.lit("comment"), comment)


def _joined(*parts: Column) -> Column:
    """The parts with underscores between them; NULL if one is missing."""
    between = [x for part in parts for x in (F.lit("_"), part)]
    return F.concat(*between[1:])
