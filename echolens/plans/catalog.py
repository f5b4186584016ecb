"""Every registered query: a name and a function of session and data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.functions import scoring, text
from echolens.operators import (
    adhoc, analysed, enrich, filters, ingestion, metrics, replies, retrieval, rollup, stored_replies, tables, training, triage,
    vector_index,
)
from echolens.operators import vectors as V
from echolens.operators.plan import materialised, shared_folder, stored_in_lots
from echolens.plans import inputs as I
from echolens.plans.inputs import AS_OF, BRAND
from echolens.schemas import MESSAGES, VECTORS
from echolens.sources import docs, github, hackernews, landing, reddit, shredding, snapshots

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

PRODUCT = "Acme"
BUSY_DAYS = (
    "WITH daily AS (SELECT to_date(created_at) AS day, count(*) AS n FROM messages GROUP BY 1) "
    "SELECT day, n FROM daily WHERE n > 10;"
)


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def _over_messages(name: str, operator: Callable[[DataFrame], DataFrame], text: bool = False) -> None:
    """Register an operator that needs the messages table only."""
    _QUERIES[name] = lambda spark, folder: operator(I.messages(spark, folder, text))


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _joined(items: str, *fields: str, name: str) -> Column:
    """A short list as text, so that any engine can compare it."""
    shown = F.transform(items, lambda s: F.concat_ws("|", *[F.coalesce(s[f], F.lit("")) for f in fields]))
    return F.array_join(shown, "\n").alias(name)


# Metrics

_over_messages("voice_stats", metrics.voice_stats)
_over_messages(
    "positive_pct",
    lambda m: metrics.positive_pct(m).select(F.round("positive_pct", 6).alias("positive_pct")),
)
_over_messages("new_bug_reports", lambda m: metrics.new_bug_reports(m, 7, AS_OF))
_over_messages("summary_stats", lambda m: metrics.summary_stats(m, 7, AS_OF))
_over_messages("sentiment_over_time", lambda m: metrics.sentiment_over_time(m, None, 30, AS_OF))
_over_messages("sentiment_over_time_source", lambda m: metrics.sentiment_over_time(m, "github", 7, AS_OF))
_over_messages("sentiment_daily", lambda m: metrics.sentiment_daily(m, 30, as_of=AS_OF))
_over_messages(
    "sentiment_moving_avg",
    lambda m: metrics.sentiment_moving_avg(m, 30, AS_OF).select(
        "date", *[F.round(name, 6).alias(name) for name in ("positive", "negative", "neutral")]
    ),
)
_over_messages("topic_distribution", lambda m: metrics.topic_distribution(m, None, 7, 20, AS_OF))
_over_messages("topic_distribution_source", lambda m: metrics.topic_distribution(m, "reddit", 30, 20, AS_OF))
_over_messages("top_topics", metrics.top_topics)
_over_messages("topic_counts", metrics.topic_counts)
_over_messages("negative_by_topic", metrics.negative_by_topic)
_over_messages("pain_points", lambda m: metrics.pain_points(m, 30, 8, AS_OF))
_over_messages("source_counts", lambda m: metrics.by_source(m, voice_only=True))
_over_messages("by_source", metrics.by_source)
_over_messages("total_messages", metrics.total_messages)
_over_messages("by_sentiment", metrics.by_sentiment)
_over_messages("sentiment_coverage", metrics.sentiment_coverage)
_over_messages("corpus_split", metrics.corpus_split)
_over_messages("processing_snapshot", metrics.processing_snapshot)
_over_messages("daily_metrics", metrics.daily_metrics)


@_query
def source_freshness(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.source_freshness(I.messages(spark, folder, text=False), I.ingestion_state(spark, folder))


# Filters, facets and lists

_over_messages(
    "get_messages",
    lambda m: filters.get_messages(
        m, "github", AS_OF.replace(day=10), AS_OF.replace(day=25), "negative", limit=50, offset=20
    ),
    text=True,
)
_over_messages("limit_per_run", lambda m: filters.limit_per_run(m, 200), text=True)
_over_messages("sample_rows", filters.sample_rows)
_over_messages("facets", filters.facet_values)
_over_messages("facet_topics", filters.facet_topics)
_over_messages("recent_voice", filters.recent_voice)
_over_messages("recent_negative", lambda m: filters.recent_negative(m, as_of=AS_OF))
_over_messages("recent_questions", lambda m: filters.recent_questions(m, as_of=AS_OF))
_over_messages("uncategorized", lambda m: filters.uncategorized(m, 7, 20, AS_OF), text=True)
_over_messages(
    "uncategorized_cards",
    lambda m: filters.as_cards(filters.uncategorized(m, 30, 20, AS_OF), 100, 120),
    text=True,
)
_over_messages(
    "preview",
    lambda m: m.select(
        "id",
        text.preview_text(F.col("content")).alias("preview"),
        text.source_label(F.col("source")).alias("source_label"),
        text.safe_url(F.col("url")).alias("safe_url"),
    ),
    text=True,
)
_over_messages("high_impact", lambda m: triage.high_impact(m, as_of=AS_OF), text=True)
_over_messages("high_impact_cards", lambda m: triage.high_impact_cards(m, as_of=AS_OF), text=True)
_over_messages("impact_score", lambda m: m.select("id", scoring.impact_score(AS_OF).alias("impact_score")))
_over_messages(
    "impact_score_explorer", lambda m: m.select("id", scoring.explorer_impact_score().alias("impact_score"))
)

# Explorer

SEARCHES = {
    "explore": triage.Search(text="Re", days=7),
    "explore_filtered": triage.Search(
        sources=("docs", "github"), sentiments=("negative", "neutral"), content_types=("question", "bug_report")
    ),
    "explore_topic": triage.Search(topics=("pricing", "images"), days=30),
    "explore_triage": triage.Search(
        triage=(triage.BUG_REPORTS, triage.FEATURE_REQUESTS, triage.UNANSWERED, triage.HIGH_IMPACT)
    ),
    "explore_unanswered": triage.Search(triage=(triage.UNANSWERED,), days=30),
    "explore_sorted": triage.Search(sort=triage.MOST_NEGATIVE, days=7),
    "explore_impact": triage.Search(sort=triage.HIGHEST_IMPACT, triage=(triage.HIGH_IMPACT,)),
}
for _name, _search in SEARCHES.items():
    _over_messages(
        _name, lambda m, search=_search: triage.explore(m, search, AS_OF), text=True
    )

# Replies

_over_messages("unanswered_questions", lambda m: replies.unanswered_questions(m, as_of=AS_OF))
_over_messages(
    "unanswered_voice", lambda m: replies.unanswered_questions(m, 30, None, voice_only=True, as_of=AS_OF)
)
_over_messages("unanswered_count", lambda m: replies.unanswered_count(m, 7, AS_OF))
_over_messages("has_reply", lambda m: replies.with_has_reply(m.select("id"), m))



def _with_replies(spark: SparkSession, folder: str) -> str:
    """Stored messages and, refreshed after each of two inserts, the table of their replies."""
    everything, path = I.messages(spark, folder, text=False), _fresh(spark, "messages")
    early = F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz")
    for rows, added in ((everything.where(early), False), (everything.where(~early), True)):
        snapshots.write_messages(rows, path, added)
        stored_replies.refresh(spark, path)
    return path


@_query
def stored_unanswered(spark: SparkSession, folder: str) -> DataFrame:
    path = _with_replies(spark, folder)
    messages = snapshots.read_snapshot(spark, path, MESSAGES)
    return stored_replies.unanswered_questions(spark, path, messages, as_of=AS_OF)


@_query
def stored_has_reply(spark: SparkSession, folder: str) -> DataFrame:
    path = _with_replies(spark, folder)
    return stored_replies.with_has_reply(spark, path, snapshots.read_snapshot(spark, path, MESSAGES).select("id"))


# Table maintenance


@_query
def since_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.messages(spark, folder, text=False).select("id", "source", "created_at")
    return github.since_filter(rows, I.ingestion_state(spark, folder), "created_at")


@_query
def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    everything = I.messages(spark, folder)
    stored = everything.where(F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return tables.insert_if_absent(stored, I.refetched(everything))


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _kept_messages(spark: SparkSession, folder: str) -> DataFrame:
    """All messages, stored where they lie, for queries that take them up in several steps."""
    return stored_in_lots(I.messages(spark, folder)).select(*MESSAGES.names)


@_query
def stored_insert(spark: SparkSession, folder: str) -> DataFrame:
    """The same insert into a stored table, which opens only versions that may hold an id of the batch."""
    everything, path = _kept_messages(spark, folder), _fresh(spark, "messages")
    early = F.col("created_at") < F.lit("2024-01-05").cast("timestamp_ntz")
    stored = everything.where(F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz"))
    snapshots.write_messages(stored.where(early), path, apart=True)
    snapshots.write_messages(stored.where(~early), path, added=True)
    ingestion.insert(I.refetched(everything), path)
    return snapshots.read_snapshot(spark, path, MESSAGES)


def _stored_with_analysis(spark: SparkSession, everything: DataFrame) -> str:
    """A stored table of all messages and, beside it, labels and pointers that runs have added."""
    path = _fresh(spark, "messages")
    snapshots.write_messages(everything, path, apart=True)
    analysed.append_analysis(I.analysis_delta(everything), path, AS_OF)
    return path


@_query
def stored_merge(spark: SparkSession, folder: str) -> DataFrame:
    return analysed.read_messages(spark, _stored_with_analysis(spark, I.messages(spark, folder)))


@_query
def stored_queues(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that the two jobs would take up next."""
    path = _stored_with_analysis(spark, I.messages(spark, folder))
    queues = {"embedding": tables.embedding_queue, "sentiment": tables.sentiment_queue}
    found = [analysed.queued_ids(spark, path, queue).select(F.lit(name).alias("queue"), "id") for name, queue in queues.items()]
    return found[0].unionByName(found[1])


@_query
def stored_reset(spark: SparkSession, folder: str) -> DataFrame:
    """Messages read again after all embeddings were forgotten."""
    path, vectors = _stored_with_analysis(spark, I.messages(spark, folder)), _fresh(spark, "vectors")
    snapshots.write_snapshot(I.vectors(spark, folder), vectors)
    analysed.reset_embeddings(spark, path, vectors)
    return analysed.read_messages(spark, path)


@_query
def stored_clear_source(spark: SparkSession, folder: str) -> DataFrame:
    """Messages after a source was cleared and fetched again."""
    everything = _kept_messages(spark, folder)
    path, vectors, state = _stored_with_analysis(spark, everything), _fresh(spark, "vectors"), _fresh(spark, "state")
    snapshots.write_snapshot(I.vectors(spark, folder), vectors)
    snapshots.write_snapshot(I.ingestion_state(spark, folder), state)
    analysed.clear_source(spark, "github", path, vectors, state)
    ingestion.insert(everything.where(F.col("source") == "github"), path, "github")
    return analysed.read_messages(spark, path)


@_query
def rollup_after_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The rollup kept by signed changes: after inserts, new labels and a cleared source."""
    everything, path, kept = _kept_messages(spark, folder), _fresh(spark, "messages"), _fresh(spark, "rollup")
    vectors, state = _fresh(spark, "vectors"), _fresh(spark, "state")
    early = F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz")
    snapshots.write_messages(everything.where(early), path, apart=True)
    rollup.refresh(spark, path, kept)
    ingestion.insert(everything, path)
    analysed.append_analysis(I.analysis_delta(everything), path, AS_OF)
    rollup.refresh(spark, path, kept)
    analysed.clear_source(spark, "github", path, vectors, state)
    rollup.refresh(spark, path, kept)
    return rollup.read_rollup(spark, kept)


def _shredded(spark: SparkSession, folder: str) -> DataFrame:
    path = _fresh(spark, "shredded")
    shredding.write_shredded(I.messages(spark, folder, text=False), path)
    return shredding.read_shredded(spark, path)


@_query
def impact_score_shredded(spark: SparkSession, folder: str) -> DataFrame:
    """The same scores from counts that were taken out of the metadata when the table was written."""
    return _shredded(spark, folder).select("id", scoring.impact_score(AS_OF, shredded=True).alias("impact_score"))


@_query
def impact_score_explorer_shredded(spark: SparkSession, folder: str) -> DataFrame:
    return _shredded(spark, folder).select("id", scoring.explorer_impact_score(shredded=True).alias("impact_score"))


@_query
def new_message_count(spark: SparkSession, folder: str) -> DataFrame:
    everything = I.messages(spark, folder, text=False)
    stored = everything.where(F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return tables.new_messages(stored, I.refetched(everything)).agg(F.count("*").alias("new_messages"))


@_query
def ingest_state_after(spark: SparkSession, folder: str) -> DataFrame:
    """The state once the landed issues have been ingested."""
    state, stored = I.ingestion_state(spark, folder), I.messages(spark, folder, text=False)
    landed = landing.parse_landed(I.github_issues(spark, folder), "github_issues")
    normalise = lambda raw: github.issues(raw, AS_OF)
    fresh = ingestion.fresh_messages(stored, state, landed, "github", normalise)
    return ingestion.state_after(state, fresh, "github", AS_OF)


@_query
def saved_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Chat examples written as JSON lines, read back and counted."""
    chat = training.chat_examples(_examples(spark, folder), training.instruction(PRODUCT))
    path = f"{shared_folder(spark)}/chat-{uuid.uuid4().hex}"
    snapshots.write_jsonl(chat.select("messages"), path)
    return snapshots.jsonl_lines(spark, path).agg(F.count("*").alias("lines"))


@_query
def landed_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return landing.rejects(I.damaged_lines(spark, folder), "github_issues")


@_query
def replace_by_key(spark: SparkSession, folder: str) -> DataFrame:
    state = I.ingestion_state(spark, folder)
    newest = I.messages(spark, folder, text=False).where(F.col("source").isin("github", "twitter"))
    delta = newest.groupBy("source").agg(
        F.max("created_at").alias("last_fetched_at"),
        F.lit(None).cast("string").alias("last_item_id"),
        F.lit("next").alias("cursor"),
        F.lit(None).cast("string").alias("metadata"),
    )
    return tables.update_ingestion_state(state, delta)


@_query
def ingestion_state(spark: SparkSession, folder: str) -> DataFrame:
    row = tables.ingestion_state_of(I.ingestion_state(spark, folder), "reddit")
    return row.withColumn("metadata", F.col("metadata")["pages"])


@_query
def update_analysis(spark: SparkSession, folder: str) -> DataFrame:
    # The delta has no texts, so it is made without reading them.
    delta = I.analysis_delta(I.messages(spark, folder, text=False))
    return tables.update_analysis(stored_in_lots(I.messages(spark, folder)), delta, as_of=AS_OF, in_lots=True)


_over_messages("embedding_queue", tables.embedding_queue, text=True)
_over_messages("sentiment_queue", tables.sentiment_queue, text=True)
_over_messages("reset_embeddings", tables.reset_embeddings, text=True)
_over_messages("clear_source", lambda m: tables.clear_source(m, "github"), text=True)


@_query
def cleared_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tables.cleared_counts(
        "github",
        messages=I.messages(spark, folder, text=False),
        ingestion_state=I.ingestion_state(spark, folder),
        vectors=I.vectors(spark, folder),
    )


# Normalisers


def _over_landed(name: str, kind: str, make: Callable, normalise: Callable) -> None:
    _QUERIES[name] = lambda spark, folder: normalise(
        landing.parse_landed(make(spark, folder), kind), as_of=AS_OF
    )


_over_landed("norm_github_issues", "github_issues", I.github_issues, github.issues)
_over_landed("norm_github_comments", "github_issue_comments", I.github_issue_comments, github.issue_comments)
_over_landed("norm_github_discussions", "github_discussions", I.github_discussions, github.discussions)
_over_landed(
    "norm_github_discussion_comments", "github_discussions", I.github_discussions, github.discussion_comments
)
_over_landed("norm_hn_stories", "hn_stories", I.hn_stories, hackernews.stories)
_over_landed("norm_reddit_posts", "reddit_posts", I.reddit_posts, reddit.posts)
_over_landed("norm_reddit_comments", "reddit_comments", I.reddit_comments, reddit.comments)


def _comment_tree(spark: SparkSession, folder: str, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    # The tree reads the items several times, so they are parsed and stored first.
    items = store(landing.parse_landed(I.hn_items(spark, folder), "hn_items"))
    return hackernews.comment_tree(I.hn_story_ids(items), items)


@_query
def hn_comment_tree(spark: SparkSession, folder: str) -> DataFrame:
    return _comment_tree(spark, folder, materialised).select("story_id", "id", "parent", "depth")


@_query
def norm_hn_comments(spark: SparkSession, folder: str) -> DataFrame:
    return hackernews.comments(_comment_tree(spark, folder, stored_in_lots), as_of=AS_OF)


@_query
def norm_atom_entries(spark: SparkSession, folder: str) -> DataFrame:
    return reddit.atom_entries(landing.parse_atom(I.atom_feed(spark, folder)))


@_query
def norm_atom(spark: SparkSession, folder: str) -> DataFrame:
    entries = landing.parse_atom(I.atom_feed(spark, folder))
    return reddit.atom_posts(entries, text.RelevanceRules.for_brand(BRAND), as_of=AS_OF, store=stored_in_lots)


@_query
def relevance_filter(spark: SparkSession, folder: str) -> DataFrame:
    entries = reddit.atom_entries(landing.parse_atom(I.atom_feed(spark, folder)))
    relevant = text.is_relevant(F.col("title"), F.col("content"), text.RelevanceRules.for_brand(BRAND))
    return entries.select("entry_id", relevant.alias("relevant"))


@_query
def strip_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = I.text_table(spark, folder, "pages")
    return pages.select("page_id", text.strip_html(F.col("html")).alias("stripped"))


@_query
def doc_file_filter(spark: SparkSession, folder: str) -> DataFrame:
    return docs.doc_files(I.repo_files(spark, folder)).select("repo", "position", "path")


@_query
def python_doc_extract(spark: SparkSession, folder: str) -> DataFrame:
    files = I.repo_files(spark, folder).where(F.col("path").endswith(".py"))
    extracted = docs.python_doc(F.col("content"), F.col("path"), BRAND)
    return files.select("position", extracted.alias("content"))


@_query
def doc_file_to_message(spark: SparkSession, folder: str) -> DataFrame:
    return docs.file_messages(I.repo_files(spark, folder), BRAND, as_of=AS_OF)


@_query
def page_extract(spark: SparkSession, folder: str) -> DataFrame:
    return docs.page_texts(I.text_table(spark, folder, "pages")).select("page_id", "title", "content")


@_query
def page_to_message(spark: SparkSession, folder: str) -> DataFrame:
    return docs.page_messages(I.text_table(spark, folder, "pages"), as_of=AS_OF)


@_query
def extract_links(spark: SparkSession, folder: str) -> DataFrame:
    return docs.page_links(I.text_table(spark, folder, "pages"), marker="/")


@_query
def crawlable_url(spark: SparkSession, folder: str) -> DataFrame:
    allowed = docs.crawlable(F.col("url"), "blog.tionsh.example.com", "/en")
    return I.text_table(spark, folder, "pages").select("page_id", allowed.alias("crawlable"))


# Vectors and retrieval


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@_query
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(V.search(I.vector_queries(spark, folder), I.vectors(spark, folder)))


@_query
def vector_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    stored = I.vectors(spark, folder)
    queries = I.vector_queries(spark, folder)
    return _rounded(V.search(queries, stored, 5, source="github", after=AS_OF.replace(day=10)))


@_query
def vector_topk_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """The plan for query tables too large to broadcast."""
    queries, stored = I.vector_queries(spark, folder), I.vectors(spark, folder)
    return _rounded(V.search(queries, stored, broadcast_bytes=0))


@_query
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(V.search(I.vector_queries(spark, folder), I.vectors(spark, folder), 10, V.COSINE))


@_query
def ann_topk(spark: SparkSession, folder: str) -> DataFrame:
    stored, centres = V.assign_cells(I.vectors(spark, folder), cells=16)
    return _rounded(V.search_cells(I.vector_queries(spark, folder), stored, centres, probes=4))


@_query
def cell_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Search in the four nearest cells of given centres, the mean vectors of the labels."""
    labelled = I.table(spark, folder, "embeddings").select("label", F.col("embedding").alias("vector"))
    centres = V.mean_centres(labelled, "label")
    stored = V.to_cells(I.vectors(spark, folder), centres)
    return _rounded(V.search_cells(I.vector_queries(spark, folder), stored, centres, probes=4))


@_query
def ivf_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The same search in a stored index: written around given centres, appended to, read by probed cell."""
    labelled = I.table(spark, folder, "embeddings").select("label", F.col("embedding").alias("vector"))
    stored, path = I.vectors(spark, folder), _fresh(spark, "index")
    even = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    vector_index.build(stored.where(even), path, V.mean_centres(labelled, "label"))
    vector_index.append(stored.where(~even), path)
    return _rounded(vector_index.search(spark, I.vector_queries(spark, folder), path, probes=4))


@_query
def stored_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The same upsert into a stored table: the batch is added, what it replaces is marked."""
    stored, path = I.vectors(spark, folder), _fresh(spark, "vectors")
    snapshots.write_snapshot(stored, path, partition_by="source", sort_by="id")
    V.upsert_stored(_moved_vectors(stored), path)
    return _vector_heads(snapshots.read_snapshot(spark, path, VECTORS))


@_query
def upsert_vectors(spark: SparkSession, folder: str) -> DataFrame:
    stored = I.vectors(spark, folder)
    return _vector_heads(V.upsert_vectors(stored, _moved_vectors(stored)))


def _moved_vectors(stored: DataFrame) -> DataFrame:
    """A batch in which each id stands twice, the second time a day later."""
    moved = stored.where(F.col("source").isin("docs", "blog")).withColumns(
        {"source": F.lit("slack"), "vector": F.reverse("vector")}
    )
    later = moved.withColumn("created_at", F.timestamp_add("DAY", F.lit(1), F.col("created_at")))
    return moved.withColumn("text", F.lit("old")).unionByName(later)


def _vector_heads(rows: DataFrame) -> DataFrame:
    return rows.select("id", "text", "source", "created_at", F.get("vector", F.lit(0)).alias("first"))


@_query
def vector_counts(spark: SparkSession, folder: str) -> DataFrame:
    return V.vector_counts(I.vectors(spark, folder))


@_query
def vector_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return V.vector_by_id(I.vectors(spark, folder), "vec:7").select("id", "text", "source", "created_at", "url")


def _retrieved(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    asked = I.questions(spark, folder)
    return asked, retrieval.retrieve(asked, I.vectors(spark, folder))


@_query
def rag_retrieve(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_retrieved(spark, folder)[1])


@_query
def rag_context(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.format_context(*_retrieved(spark, folder))


@_query
def rag_sources(spark: SparkSession, folder: str) -> DataFrame:
    cited = retrieval.context_sources(*_retrieved(spark, folder))
    return cited.select(
        "question_id", "used_rag", _joined("sources", "source", "url", "text", name="sources")
    )


@_query
def rag_prompts(spark: SparkSession, folder: str) -> DataFrame:
    prompts = retrieval.build_prompts(*_retrieved(spark, folder), PRODUCT)
    return prompts.select("question_id", _joined("messages", "role", "content", name="messages"))


# Models


def _vector_columns(rows: DataFrame) -> DataFrame:
    letters = [
        F.get("vector", F.lit(i)).alias(f"n_{letter}") for i, letter in enumerate(I.EMBEDDED_LETTERS)
    ]
    return rows.select("id", "text", "source", "created_at", "url", F.col("metadata.title").alias("title"), *letters)


_over_messages(
    "embed_batch", lambda m: _vector_columns(enrich.vector_records(m, I.load_letter_embedder)), text=True
)
_over_messages(
    "sentiment_prompts",
    lambda m: enrich.sentiment_prompts(m, "Classify.").select(
        "id", _joined("prompt", "role", "content", name="prompt")
    ),
    text=True,
)


def _classified(messages: DataFrame, on_error: str) -> DataFrame:
    prompts = enrich.sentiment_prompts(messages, "Classify.")
    return enrich.classify(prompts, I.load_length_classifier, on_error)


def _topics_as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("topics", F.array_join("topics", ","))


_over_messages(
    "classify",
    lambda m: _topics_as_text(enrich.parse_responses(_classified(m, enrich.ON_ERROR_DEFAULTS))),
    text=True,
)
_over_messages(
    "classify_skip",
    lambda m: _topics_as_text(enrich.parse_responses(_classified(m, enrich.ON_ERROR_SKIP))),
    text=True,
)


@_query
def parse_responses(spark: SparkSession, folder: str) -> DataFrame:
    return _topics_as_text(enrich.parse_responses(I.responses(spark, folder)))


@_query
def search_text(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts against all messages, both embedded by the stand-in model."""
    asked = I.questions(spark, folder).select(F.col("question_id").alias("query_id"), "question")
    stored = enrich.vector_records(I.messages(spark, folder), I.load_letter_embedder)
    return _rounded(enrich.search_text(asked, stored, I.load_letter_embedder, 5))


@_query
def embedding_job(spark: SparkSession, folder: str) -> DataFrame:
    """Messages after their queue has been embedded and marked."""
    stored = I.messages(spark, folder)
    queue = tables.embedding_queue(stored)
    embedded = enrich.vector_records(queue, I.load_letter_embedder)
    marks = embedded.select("id", F.col("id").alias("embedding_id"))
    # Only messages of the queue are marked, so only they move.
    return tables.update_analysis(stored, marks, as_of=AS_OF, among=F.col("embedding_id").isNull())


@_query
def sentiment_job(spark: SparkSession, folder: str) -> DataFrame:
    """The daily rollup after the queue has been labelled."""
    stored = I.messages(spark, folder)
    queue = tables.sentiment_queue(stored)
    labels = enrich.parse_responses(_classified(queue, enrich.ON_ERROR_SKIP))
    return metrics.daily_metrics(tables.update_analysis(stored, labels, as_of=AS_OF))


# Training examples


@_query
def doc_sections(spark: SparkSession, folder: str) -> DataFrame:
    return training.doc_sections(training.training_candidates(I.documents(spark, folder)))


@_query
def doc_examples(spark: SparkSession, folder: str) -> DataFrame:
    return training.doc_examples(training.training_candidates(I.documents(spark, folder)), PRODUCT)


@_query
def title_to_question(spark: SparkSession, folder: str) -> DataFrame:
    first_line = F.split_part("text", F.lit("\n"), F.lit(1))
    number = F.col("doc_id") % 7
    leads = ("", "How to ", "Using ", "Deploy ", "The ", "Getting started with ", "working with ")
    lead = F.lit(leads[0])
    for i, words in enumerate(leads):
        lead = F.when(number == i, words).otherwise(lead)
    title = F.concat(lead, first_line, F.when(F.col("doc_id") % 11 == 0, "?").otherwise(""))
    return I.text_table(spark, folder, "documents").select(
        "doc_id", text.title_to_question(title, PRODUCT).alias("question")
    )


@_query
def clean_content(spark: SparkSession, folder: str) -> DataFrame:
    spaced = F.replace(F.replace("text", F.lit(". "), F.lit(".   <b>")), F.lit("\n"), F.lit("\n\n\n\n"))
    return I.text_table(spark, folder, "documents").select("doc_id", text.clean_content(spaced).alias("content"))


@_query
def qa_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return training.qa_pairs(training.training_candidates(I.threads(spark, folder)))


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.documents(spark, folder).unionByName(I.threads(spark, folder))
    return training.training_examples(rows, PRODUCT)


@_query
def chat_examples(spark: SparkSession, folder: str) -> DataFrame:
    chat = training.chat_examples(_examples(spark, folder), training.instruction(PRODUCT))
    return chat.select("example_id", _joined("messages", "role", "content", name="messages"))


@_query
def train_val_split(spark: SparkSession, folder: str) -> DataFrame:
    # The split reads the examples twice.
    return training.train_val_split(materialised(_examples(spark, folder))).select("example_id", "split")


# Ad-hoc SQL


@_query
def safe_query(spark: SparkSession, folder: str) -> DataFrame:
    return adhoc.safe_query(spark, BUSY_DAYS, {"messages": I.messages(spark, folder, text=False)}, 500)


@_query
def describe_tables(spark: SparkSession, folder: str) -> DataFrame:
    described = adhoc.check_tables(
        spark,
        {
            "messages": I.messages(spark, folder, text=False),
            "ingestion_state": I.ingestion_state(spark, folder),
            "embeddings": I.vectors(spark, folder),
        },
    )
    return described.drop("nullable")
