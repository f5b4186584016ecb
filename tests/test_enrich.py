"""Model hooks, response parsing and the two jobs."""

import sys
from datetime import timedelta

from pyspark import cloudpickle

from echolens.operators import enrich, metrics, retrieval, vectors
from echolens.plans.inputs import load_letter_embedder
from echolens.schemas import MESSAGES, VECTORS
from echolens.operators.analysed import ANALYSIS, analysis_path, fold, read_messages
from echolens.sources.snapshots import latest_version, read_snapshot, write_messages, write_snapshot

import pytest

from conftest import START

# The models below travel to the workers by value; workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEFAULTS = ("neutral", "neutral", "discussion", [])


def test_parse_responses(spark):
    cases = {
        '```json\n{"sentiment_simple": "positive", "topics": ["a", "b"]}\n``` and ```x```': ("positive", "neutral", "discussion", ["a", "b"]),
        'Sure\n```\n{"content_type": "praise"}': ("neutral", "neutral", "praise", []),
        '{"sentiment_rich": "delight", "topics": null, "sentiment_simple": null}': ("neutral", "delight", "discussion", []),
        ' {"sentiment_simple": "odd"} ': ("odd", "neutral", "discussion", []),
        '{"sentiment_simple": "positive"} trailing': DEFAULTS,
        '{"sentiment_simple": "positive"}, {"a": 1}': DEFAULTS,
        '{"sentiment_simple": "positive", "topics": [': DEFAULTS,
        "{'sentiment_simple': 'positive'}": DEFAULTS,
        '["positive"]': DEFAULTS,
        "": DEFAULTS,
        "```json": DEFAULTS,
        None: DEFAULTS,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, response string")
    got = {r.id: tuple(r)[1:] for r in enrich.parse_responses(rows).collect()}
    for i, (response, expected) in enumerate(cases.items()):
        assert got[i] == expected, response


def _load_failing():
    def answer(prompts):
        if any("bad" in p[1]["content"] for p in prompts):
            raise RuntimeError("model error")
        return ['{"sentiment_simple": "negative", "topics": ["pricing"]}' for _ in prompts]

    return answer


def test_one_failure_costs_one_message(make_messages):
    rows = make_messages(*[{"id": f"m{i}", "content": "bad" if i == 3 else "good"} for i in range(10)])
    prompts = enrich.sentiment_prompts(rows, enrich.taxonomy_text("Acme"))
    kept = enrich.classify(prompts, _load_failing, enrich.ON_ERROR_SKIP)
    assert {r.id for r in kept.collect()} == {f"m{i}" for i in range(10)} - {"m3"}
    labelled = enrich.parse_responses(enrich.classify(prompts, _load_failing))
    assert {r.id: r.sentiment_simple for r in labelled.collect()}["m3"] == "neutral"
    assert labelled.count() == 10


def test_embedding_job(spark, make_messages, tmp_path):
    messages, stored = str(tmp_path / "messages"), str(tmp_path / "vectors")
    rows = make_messages(*[{"id": f"m{i}", "content": "ae" * i} for i in range(5)], {"id": "done", "embedding_id": "done"})
    write_messages(rows, messages)
    assert enrich.run_embedding_job(spark, messages, stored, load_letter_embedder, 3, START) == 3
    assert enrich.run_embedding_job(spark, messages, stored, load_letter_embedder, 3, START) == 2
    assert enrich.run_embedding_job(spark, messages, stored, load_letter_embedder, 3, START) == 0
    table = read_snapshot(spark, stored, VECTORS)
    assert {r.id: r.vector[0] for r in table.collect()} == {f"m{i}": float(i) for i in range(5)}
    marked = read_messages(spark, messages)
    assert marked.where("embedding_id = id").count() == 6
    assert marked.where("processed_at is not null").count() == 0
    assert latest_version(spark, messages) == 1  # the table itself was not written again
    assert read_snapshot(spark, analysis_path(messages), ANALYSIS).count() == 5
    before = marked.collect()
    fold(spark, messages)
    assert sorted(read_snapshot(spark, messages, MESSAGES).collect()) == sorted(read_messages(spark, messages).collect()) == sorted(before)


def test_a_lost_embedding_run_is_made_up(spark, make_messages, tmp_path):
    messages, stored = str(tmp_path / "messages"), str(tmp_path / "vectors")
    rows = make_messages({"id": "a", "content": "ae"}, {"id": "b", "content": "e"})
    write_messages(rows, messages)
    write_snapshot(enrich.vector_records(rows.where("id = 'a'"), load_letter_embedder), stored, partition_by="source", added=True)
    assert enrich.run_embedding_job(spark, messages, stored, load_letter_embedder, as_of=START) == 2
    assert sorted(r.id for r in read_snapshot(spark, stored, VECTORS).collect()) == ["a", "b"]


def test_sentiment_job(spark, make_messages, tmp_path):
    paths = [str(tmp_path / name) for name in ("messages", "labels", "metrics")]
    rows = make_messages(
        {"id": "a"}, {"id": "b", "content": "bad"}, {"id": "c", "source": "docs"}, {"id": "d", "sentiment_simple": "positive"}
    )
    write_messages(rows, paths[0])
    assert enrich.run_sentiment_job(spark, *paths, _load_failing, "Acme", as_of=START) == (1, {"RuntimeError": 1})
    found = {r.id: r for r in read_messages(spark, paths[0]).collect()}
    assert (found["a"].sentiment_simple, found["a"].topics, found["a"].processed_at) == ("negative", '["pricing"]', START)
    assert found["b"].sentiment_simple is None and found["c"].sentiment_simple is None
    rollup = read_snapshot(spark, paths[2], metrics.daily_metrics(rows).schema).collect()
    assert [(r.source, r.total_messages, r.negative_count) for r in rollup] == [("github", 1, 1)]
    later = make_messages({"id": "e", "created_at": START + timedelta(days=1)})
    write_messages(later, paths[0], added=True)
    assert enrich.run_sentiment_job(spark, *paths, _load_failing, "Acme", as_of=START) == (1, {"RuntimeError": 1})  # the new one and the failed one
    rollup = read_snapshot(spark, paths[2], metrics.daily_metrics(rows).schema)
    assert sorted(rollup.collect()) == sorted(metrics.daily_metrics(read_messages(spark, paths[0])).collect())
    assert latest_version(spark, paths[0]) == 2


def test_errors_are_named_and_counted(spark, make_messages, tmp_path):
    def load():
        def answer(prompts):
            texts = [p[1]["content"] for p in prompts]
            if any("key" in t for t in texts):
                raise KeyError("k")
            return [None if "none" in t else "{}" for t in texts][: 1 if any("short" in t for t in texts) else None]

        return answer

    rows = make_messages(*[{"id": t + str(i), "content": t} for i, t in enumerate(["good", "key", "none", "key", "good", "short"])])
    prompts = enrich.sentiment_prompts(rows, "x")
    got = enrich.classify(prompts, load, batch_size=3, errors=True)
    assert {r["id"]: r["error"] for r in got.collect() if r["error"]} == {
        "key1": "KeyError: 'k'", "key3": "KeyError: 'k'", "none2": enrich.NO_ANSWER
    }
    assert {tuple(r) for r in enrich.error_counts(got).collect()} == {("KeyError", 2), ("NoAnswer", 1)}
    paths = [str(tmp_path / name) for name in ("messages", "labels", "metrics")]
    write_messages(rows.where("content = 'key'"), paths[0])
    with pytest.raises(RuntimeError, match="KeyError"):
        enrich.run_sentiment_job(spark, *paths, load, "Acme")
    assert read_messages(spark, paths[0]).where("sentiment_simple is not null").isEmpty()


def test_search_text_and_context(spark, make_messages):
    rows = make_messages(
        {"id": "a", "content": "aaaa", "url": "https://u"}, {"id": "e", "content": "eeee" + "x" * 600}, {"id": "i", "content": "iiii"}
    )
    stored = enrich.vector_records(rows, load_letter_embedder)
    asked = spark.createDataFrame([("q", "aaa"), ("r", "eee")], "query_id string, question string")
    hits = enrich.search_text(asked, stored, load_letter_embedder, 1)
    assert {r.query_id: r.id for r in hits.collect()} == {"q": "a", "r": "e"}
    questions = enrich.embed(asked.withColumnRenamed("query_id", "question_id"), load_letter_embedder, "question")
    found = retrieval.retrieve(questions, stored, 2)
    contexts = {r.question_id: r.context for r in retrieval.format_context(questions, found).collect()}
    assert contexts["q"].startswith("[1] Source: github\nURL: https://u\naaaa\n\n---\n\n[2] Source: github\n")
    assert len(contexts["r"].split("\n\n---\n\n")[0].split("\n")[1]) == 604
    cut = {r.question_id: r.context for r in retrieval.format_context(questions, found, 500).collect()}
    assert len(cut["r"].split("\n\n---\n\n")[0].split("\n")[1]) == 500
    none = found.limit(0)
    assert {r.context for r in retrieval.format_context(questions, none).collect()} == {retrieval.NOTHING_FOUND}
    cited = retrieval.context_sources(questions, found).collect()
    assert all(r.used_rag and len(r.sources) == 2 for r in cited)
    assert max(len(s.text) for r in cited for s in r.sources) == 604
    cut = retrieval.context_sources(questions, found, longest=200).collect()
    assert max(len(s.text) for r in cut for s in r.sources) == 200
    assert not any(r.used_rag for r in retrieval.context_sources(questions, found, use_rag=False).collect())
    prompt = retrieval.build_prompts(questions, none, "Acme").first().messages
    assert [m.role for m in prompt] == ["system", "user"] and retrieval.NOTHING_AVAILABLE in prompt[0].content
    late = vectors.restrict(stored, after=START.replace(year=2025)).count()
    assert late == 0


def test_answers_leave_the_worker_by_arrow_batches(spark):
    asked = spark.createDataFrame([(str(i), "x" * i) for i in range(50)], "id string, content string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def load():
        def answer(prompts):
            calls.add(1)
            sizes = [len(prompt[-1]["content"]) for prompt in prompts]
            if any(size % 10 == 0 for size in sizes):
                raise ValueError("ten")
            return [str(size) if size % 7 else None for size in sizes]

        return answer

    rows = enrich.classify(enrich.sentiment_prompts(asked, "s"), load, batch_size=4, errors=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan  # a batch of prompts is no data frame of its own
    found = {row.id: (row.response, row.error) for row in rows.collect()}
    lead = len("Analyze this message:\n\n")
    for i in range(50):
        size = lead + i
        failed = "ValueError: ten" if size % 10 == 0 else None if size % 7 else enrich.NO_ANSWER
        assert found[str(i)] == (None if failed else str(size), failed)
    assert calls.value >= 13  # four prompts at a time, as asked for
