"""Stored tables: buckets, key filters, lasting deletes, clean-up."""

import re
from datetime import timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from echolens.functions import scoring
from echolens.functions.text import RelevanceRules
from echolens.operators import analysed, ingestion, metrics, replies, rollup, stored_replies, tables, triage
from echolens.operators.analysed import ANALYSIS, append_analysis, read_messages
from echolens.operators.plan import stored_in_lots
from echolens.schemas import INGESTION_STATE, MESSAGES, VECTORS
from echolens.sources import reddit, shredding, snapshots
from echolens.sources.snapshots import read_snapshot, write_messages, write_snapshot

from conftest import START, plan_of


def _ids(rows):
    return sorted(r.id for r in rows.select("id").collect())


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "messages"), str(tmp_path / "vectors"), str(tmp_path / "state")


def _vectors(spark, *ids):
    return spark.createDataFrame([(i, "t", [1.0], "github", START, None, None) for i in ids], VECTORS)


def test_queues_shuffle_no_messages(spark, make_messages, paths):
    rows = make_messages(*[{"id": f"github:{i}", "content": "long text " * 20} for i in range(60)])
    write_messages(rows, paths[0])
    write_messages(make_messages(*[{"id": f"reddit:{i}", "source": "reddit"} for i in range(9)]), paths[0], added=True)
    append_analysis(rows.where("id like '%1'").selectExpr("id", "'positive' AS sentiment_simple", "id AS embedding_id"), paths[0], START)
    append_analysis(rows.where("id like '%2'").selectExpr("id", "'neutral' AS sentiment_simple"), paths[0], START)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for queue, number in ((tables.embedding_queue, 63), (tables.sentiment_queue, 57)):
            ids = analysed.queued_ids(spark, paths[0], queue)
            plan = plan_of(ids)
            assert "Exchange" not in plan and "Bucketed: true" in plan and "content:string" not in plan
            assert ids.count() == number
            whole = analysed.messages_with(spark, paths[0], ids)
            assert "Exchange" not in plan_of(whole) and whole.count() == number
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_insert_opens_only_versions_that_may_hold_an_id(spark, make_messages, paths, monkeypatch):
    for i in range(4):
        write_messages(make_messages(*[{"id": f"github:{i}{n:03d}"} for n in range(100)]), paths[0], added=bool(i))
    opened = []

    def counted(spark, path, keys, found=ingestion.holding):
        opened.append(found(spark, path, keys))
        return opened[-1]

    monkeypatch.setattr(ingestion, "holding", counted)
    batch = make_messages({"id": "github:2007"}, {"id": "github:2x"}, {"id": "zz:1"}, {"id": "github:2007"}, {"id": None, "source_id": "n"})
    before = read_snapshot(spark, paths[0], MESSAGES)
    want = sorted(tables.insert_if_absent(before, batch).collect())
    version = ingestion.insert(batch, paths[0])
    assert [len(names) for names in opened] == [1] and opened[0][0].startswith("0000000003")
    assert sorted(read_snapshot(spark, paths[0], MESSAGES).collect()) == want
    assert _ids(read_snapshot(spark, paths[0], MESSAGES, since=version)) == ["github:2x", "zz:1"]
    ingestion.insert(make_messages({"id": "aa:1"}, {"id": "zzz:1"}), paths[0])
    assert opened[1] == []


def test_an_insert_keeps_ids_only_in_between(spark, make_messages, paths, monkeypatch):
    write_messages(make_messages({"id": "a", "content": "old"}), paths[0])
    kept = []

    def counted(rows, store=ingestion.materialised):
        kept.append(rows.columns)
        return store(rows)

    monkeypatch.setattr(ingestion, "materialised", counted)
    ingestion.insert(make_messages({"id": "a"}, {"id": "b", "content": "new"}, {"id": None, "source_id": "n"}), paths[0])
    assert kept == [["id"]]
    assert sorted((r.id, r.content) for r in read_snapshot(spark, paths[0], MESSAGES).collect()) == [("a", "old"), ("b", "new")]


def test_stored_texts_are_compressed_well(spark, make_messages, paths, tmp_path):
    write_messages(make_messages({"id": "a"}), paths[0])
    write_snapshot(make_messages({"id": "a"}), paths[1], partition_by="source", sort_by="created_at")
    for name in ("messages", "vectors"):
        files = list((tmp_path / name).rglob("*.parquet"))
        assert files and all(pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD" for f in files)


def test_filters_miss_no_key(spark, make_messages, paths):
    rows = spark.range(30_000).selectExpr("concat('k', id) AS id", "id AS v")
    buckets = snapshots.Buckets("id", 3)
    write_snapshot(rows.where("v % 3 = 0"), paths[0], buckets=buckets)
    write_snapshot(rows.where("v % 3 = 1"), paths[0], added=True)
    write_snapshot(rows.limit(0), paths[0], added=True)
    for remainder, names in ((0, 1), (1, 1), (2, 0)):
        for part in range(3):
            asked = rows.where(f"v % 3 = {remainder} and v % 1000 = {part * 300 + remainder}").select("id")
            found = snapshots.holding(spark, paths[0], asked)
            if remainder < 2:
                assert f"000000000{remainder + 1}" in "".join(found)
    false = sum(len(snapshots.holding(spark, paths[0], rows.where(f"v = {3 * i + 2}").select("id"))) for i in range(12))
    assert false <= 1


def test_a_reset_lasts(spark, make_messages, paths):
    messages, vectors, _ = paths
    write_messages(make_messages({"id": "a", "embedding_id": "a"}, {"id": "b"}, {"id": "c"}), messages)
    append_analysis(spark.createDataFrame([("b", "b", "positive")], "id string, embedding_id string, sentiment_simple string"), messages, START)
    write_snapshot(_vectors(spark, "a", "b"), vectors)
    assert analysed.reset_embeddings(spark, messages, vectors) == 2
    for _ in range(2):
        again = read_messages(spark, messages)
        assert again.where("embedding_id is not null").isEmpty() and again.where("sentiment_simple is not null").count() == 1
        assert read_snapshot(spark, vectors, VECTORS).isEmpty()
        analysed.fold(spark, messages)
    append_analysis(spark.createDataFrame([("c", "c")], "id string, embedding_id string"), messages, START)
    assert _ids(read_messages(spark, messages).where("embedding_id is not null")) == ["c"]


def test_a_cleared_source_starts_without_labels(spark, make_messages, paths):
    messages, vectors, state = paths
    rows = make_messages({"id": "docs:a", "source": "blog"}, {"id": "docs:b", "source": "docs"}, {"id": "x", "source": None}, {"id": "y"})
    write_messages(rows, messages)
    labels = rows.selectExpr("id", "'negative' AS sentiment_simple")
    append_analysis(labels, messages, START)
    write_snapshot(_vectors(spark, "y"), vectors, partition_by="source")
    write_snapshot(spark.createDataFrame([("docs", START, None, None, "{}"), ("github", START, None, None, "{}")], INGESTION_STATE), state)
    counts = analysed.clear_source(spark, "docs", messages, vectors, state)
    assert counts == {"messages": 1, "vectors": 0, "ingestion_state": 1}
    assert _ids(read_messages(spark, messages)) == ["docs:a", "x", "y"]
    assert [r.source for r in read_snapshot(spark, state, INGESTION_STATE).collect()] == ["github"]
    write_messages(rows.where("source = 'docs'"), messages, added=True)
    found = {r.id: r.sentiment_simple for r in read_messages(spark, messages).collect()}
    assert found == {"docs:a": "negative", "docs:b": None, "x": "negative", "y": "negative"}
    append_analysis(labels.where("id = 'docs:b'"), messages, START + timedelta(1))
    assert read_messages(spark, messages).where("sentiment_simple is null").isEmpty()
    analysed.clear_source(spark, "github", messages, vectors, state)
    assert read_snapshot(spark, vectors, VECTORS).isEmpty() and _ids(read_messages(spark, messages)) == ["docs:a", "docs:b", "x"]


def test_equal_times_have_a_fixed_winner(spark, make_messages, paths):
    write_messages(make_messages({"id": "a"}), paths[0])
    for label in ("positive", "negative", "neutral"):
        append_analysis(spark.createDataFrame([("a", label)], "id string, sentiment_simple string"), paths[0], START)
    assert read_messages(spark, paths[0]).first().sentiment_simple == "neutral"
    same = [("a", label, START) for label in ("positive", "negative", "neutral")]
    frame = make_messages({"id": "a"})
    kept = set()
    for rows in (same, same[::-1], same[1:] + same[:1]):
        delta = spark.createDataFrame(rows, "id string, sentiment_simple string, made_at timestamp_ntz").repartition(3)
        kept.add(tables.update_analysis(frame, delta, "made_at", stamp="made_at").first().sentiment_simple)
    assert len(kept) == 1


def test_vacuum(spark, make_messages, paths, tmp_path):
    write_messages(make_messages({"id": "a"}), paths[0])
    write_messages(make_messages({"id": "b"}), paths[0], added=True)
    snapshots.remove(spark.createDataFrame([("a",)], "id string"), paths[0])
    assert snapshots.vacuum(spark, paths[0]) == [] and _ids(read_snapshot(spark, paths[0], MESSAGES)) == ["b"]
    snapshots.compact(spark, paths[0], MESSAGES)
    assert len(snapshots.vacuum(spark, paths[0], keep=2)) == 0
    assert snapshots.vacuum(spark, paths[0]) == ["0000000001-whole", "0000000002-added", "0000000003-removed_id"]
    assert _ids(read_snapshot(spark, paths[0], MESSAGES)) == ["b"]
    assert len([p for p in (tmp_path / "messages").iterdir() if p.name.startswith("version")]) == 1


def test_a_lost_write_leaves_the_table(spark, make_messages, paths, tmp_path):
    write_messages(make_messages({"id": "a"}), paths[0])
    lost = tmp_path / "messages" / "version=0000000002-added"
    lost.mkdir()
    (lost / "part-00000.parquet").write_text("rubbish")
    assert _ids(read_snapshot(spark, paths[0], MESSAGES)) == ["a"]
    assert write_messages(make_messages({"id": "b"}), paths[0], added=True) == 2
    assert _ids(read_snapshot(spark, paths[0], MESSAGES)) == ["a", "b"]
    assert read_snapshot(spark, analysed.analysis_path(paths[0]), ANALYSIS).isEmpty()


def test_rollup_follows_changes(spark, make_messages, paths, tmp_path):
    messages, vectors, state = paths
    kept = str(tmp_path / "rollup")

    def check(written=None):
        rollup.refresh(spark, messages, kept)
        want = sorted(metrics.daily_metrics(read_messages(spark, messages)).collect(), key=str)
        names = metrics.daily_metrics(read_messages(spark, messages)).columns
        assert sorted(rollup.read_rollup(spark, kept).select(*names).collect(), key=str) == want
        if written is not None:
            last = snapshots.latest_version(spark, kept)
            assert read_snapshot(spark, kept, rollup._schema(spark), since=last).where("date is not null").count() == written

    rows = make_messages(*[
        {"id": f"m{i}", "source": ("github", "docs", "reddit")[i % 3], "created_at": START + timedelta(days=i % 10), "processed_at": START,
         "sentiment_simple": ("positive", "negative", None)[i % 3]} for i in range(60)
    ])
    write_messages(rows, messages)
    check()
    check(0)
    ingestion.insert(make_messages({"id": "new", "processed_at": START, "content_type": "question"}, {"id": "m1"}), messages)
    check(1)
    append_analysis(spark.createDataFrame([("m0", "negative"), ("m5", "neutral"), ("zz", "neutral")], "id string, sentiment_simple string"), messages, START)
    check(2)
    analysed.clear_source(spark, "docs", messages, vectors, state)
    check(10)
    ingestion.insert(rows.where("id in ('m1', 'm4')"), messages)
    check(2)
    analysed.reset_embeddings(spark, messages, vectors)
    check(0)
    analysed.fold(spark, messages)
    check()
    assert rollup.read_rollup(spark, kept).agg({"total_messages": "sum"}).first()[0] == read_messages(spark, messages).where("processed_at is not null").count()


def test_shredded_scores_parse_no_json(spark, make_messages, paths):
    texts = ['{"points": 40, "num_comments": 3}', '{"score": "7", "comments": 2, "points": 0}', "no json", None, "[1]", '{"points": 3.7}']
    rows = make_messages(*[{"id": f"m{i}", "metadata": text, "sentiment_simple": "negative"} for i, text in enumerate(texts)])
    shredding.write_shredded(rows, paths[0])
    stored = shredding.read_shredded(spark, paths[0])
    for score in (scoring.impact_score, scoring.explorer_impact_score):
        given = {"as_of": START} if score is scoring.impact_score else {}
        frame = stored.select("id", score(**given, shredded=True).alias("score"))
        assert sorted(frame.collect()) == sorted(rows.select("id", score(**given).alias("score")).collect())
        assert "json" not in plan_of(frame).lower() and "variant" not in plan_of(frame).lower()
    assert stored.where("variant_get(metadata_variant, '$.points', 'int') = 40").count() == 1
    assert _ids(read_snapshot(spark, paths[0], MESSAGES)) == [f"m{i}" for i in range(6)]


def test_replies_are_kept_beside_the_messages(spark, make_messages, paths, monkeypatch):
    def rows(numbers):
        return make_messages(*[
            {"id": f"m{i}", "content_type": "question", "created_at": START + timedelta(hours=i), "source": "docs" if i % 7 == 3 else "github",
             "parent_id": f"m{i // 3}" if i % 2 else None, "thread_id": "m1" if i % 5 == 0 else None} for i in numbers
        ])

    def check():
        stored_replies.refresh(spark, paths[0])
        stored = read_snapshot(spark, paths[0], MESSAGES)
        flags = {r.id: r.has_reply for r in stored_replies.with_has_reply(spark, paths[0], stored.select("id")).collect()}
        assert flags == {r.id: r.has_reply for r in replies.with_has_reply(stored.select("id"), stored).collect()}
        late = START + timedelta(days=3)
        found = stored_replies.unanswered_questions(spark, paths[0], stored, limit=None, as_of=late)
        assert _ids(found) == _ids(replies.unanswered_questions(stored, limit=None, as_of=late))
        return found

    write_messages(rows(range(20)), paths[0])
    check()
    write_messages(rows(range(20, 40)), paths[0], added=True)
    check()
    edges = read_snapshot(spark, stored_replies.replies_path(paths[0]), stored_replies.REPLIES, since=2)
    assert 0 < edges.where("replied_id is not null").count() < 20
    first = {r.replied_id: r.first_reply for r in stored_replies.first_replies(spark, paths[0]).collect()}
    assert first["m1"] == "m0" and first["m5"] == "m15"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(check())
        assert "Exchange" not in plan and "HashAggregate" not in plan
        flagged = stored_replies.with_has_reply(spark, paths[0], read_snapshot(spark, paths[0], MESSAGES).select("id"))
        assert "Exchange" not in plan_of(flagged)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    analysed.clear_source(spark, "docs", *paths)
    check()


def _wide_exchanges(frame):
    """Shuffles of the plan that move texts."""
    found = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    return [part for part in re.findall(r"\n\(\d+\) Exchange\n(.*)", found) if "content#" in part]


def test_texts_kept_apart_stay_where_they_lay(spark, make_messages, paths, tmp_path):
    rows = make_messages(*[{"id": f"m{i}", "content": f"text {i}", "source": ("github", None)[i % 2]} for i in range(40)]).repartition(3)
    batch = make_messages(
        {"id": "m1", "content": "other"}, {"id": "n1", "content": None}, {"id": "n2", "content": "first"},
        {"id": "n2", "content": "second", "fetched_at": START + timedelta(1)}, {"id": None, "content": "no id"},
    )
    write_messages(rows, paths[0], apart=True)
    lots = spark.read.parquet(str(tmp_path / "messages-lots" / "version=0000000001-whole"))
    assert lots.count() == 40 and lots.select("_lot").distinct().count() == 3  # a lot of each task
    ingestion.insert(batch, paths[0])
    stored = read_snapshot(spark, paths[0], MESSAGES)
    assert stored.columns == MESSAGES.names and not _wide_exchanges(stored) and stored.count() == 42
    append_analysis(rows.selectExpr("id", "'positive' AS sentiment_simple"), paths[0], START)
    merged = read_messages(spark, paths[0])
    assert not _wide_exchanges(merged)
    want = {f"m{i}": f"text {i}" for i in range(40)} | {"n1": None, "n2": "first"}
    assert {r.id: r.content for r in merged.collect()} == {r.id: r.content for r in stored.collect()} == want
    some = analysed.messages_with(spark, paths[0], spark.createDataFrame([("m7",), ("n2",), ("zz",)], "id string"))
    assert sorted((r.id, r.content, r.sentiment_simple) for r in some.collect()) == [("m7", "text 7", "positive"), ("n2", "first", None)]
    narrow = read_messages(spark, paths[0], texts=False)
    assert _wide_exchanges(rows) and "content#" not in plan_of(narrow.drop("content")) and narrow.where("content is not null").isEmpty()


def test_tables_with_texts_apart_do_all_that_others_do(spark, make_messages, tmp_path):
    rows = make_messages(*[
        {"id": f"m{i}", "content": f"text {i}", "source": ("github", "docs", "reddit", None)[i % 4], "processed_at": START,
         "created_at": START + timedelta(days=i % 5), "embedding_id": f"m{i}" if i % 3 else None} for i in range(60)
    ])
    seen = []
    for apart in (False, True):
        messages, vectors, state, kept = (str(tmp_path / f"{name}-{apart}") for name in ("messages", "vectors", "state", "rollup"))
        states = []

        def look(messages=messages, kept=kept, states=states):
            rollup.refresh(spark, messages, kept)
            found = read_messages(spark, messages)
            states.append(sorted(found.collect(), key=str) + sorted(rollup.read_rollup(spark, kept).collect(), key=str))
            states.append([_ids(analysed.queued_ids(spark, messages, queue)) for queue in (tables.embedding_queue, tables.sentiment_queue)])

        write_messages(rows.where("id < 'm4'"), messages, apart=apart)
        assert snapshots.exists(spark, messages + "-lots") is apart
        look()
        ingestion.insert(rows, messages)
        append_analysis(rows.selectExpr("id", "'negative' AS sentiment_simple").where("id like '%1'"), messages, START)
        look()
        analysed.clear_source(spark, "docs", messages, vectors, state)
        look()
        ingestion.insert(rows.where("source = 'docs'").withColumn("content", F.lit("again")), messages, "docs")
        look()
        analysed.reset_embeddings(spark, messages, vectors)
        snapshots.void_column(spark, messages, "content")
        ingestion.insert(make_messages({"id": "new", "content": "new text"}), messages)
        look()
        analysed.fold(spark, messages)
        assert len(snapshots.vacuum(spark, messages)) >= 5
        assert not apart or len([p for p in (tmp_path / f"messages-{apart}-lots").iterdir() if p.name.startswith("version")]) == 1
        look()
        write_messages(rows.limit(0), messages)
        states.append(read_messages(spark, messages).collect())
        seen.append(states)
    assert seen[0] == seen[1]


def test_messages_in_lots_stay_while_their_analysis_changes(spark, make_messages):
    rows = make_messages(*[
        {"id": f"m{i}", "content": f"text {i}", "topics": None if i % 4 else '["a"]', "sentiment_simple": "neutral"} for i in range(30)
    ]).repartition(4)
    delta = spark.createDataFrame(
        [("m1", "positive", ["b"], None), ("m2", None, None, "e2"), ("m2", "negative", None, None), ("zz", "positive", None, None), ("m3", None, None, None)],
        "id string, sentiment_simple string, topics array<string>, embedding_id string",
    )
    kept = stored_in_lots(rows)
    for names in (MESSAGES.names, ["content", "id", "topics"]):
        got = tables.update_analysis(kept.select(*names, "_lot", "_place"), delta, as_of=START, in_lots=True)
        assert got.columns == list(names) and not _wide_exchanges(got)
        assert sorted(got.collect(), key=str) == sorted(tables.update_analysis(rows, delta, as_of=START).select(*names).collect(), key=str)


def test_entries_in_lots_stay_while_posts_are_chosen(spark):
    entry = "struct<title:string,link:struct<_href:string>,content:string,updated:string,author:struct<name:string>,id:string>"
    names = ("title", "content", "updated", "id")
    values = [(f"acme.com {i}", f"<p>acme.com &amp; {i}</p>", f"2024-01-0{i % 3 + 1}T00:00:00Z", f"t3_p{i % 7}") for i in range(20)]
    rows = spark.createDataFrame([(f"sub{i % 2}", *value) for i, value in enumerate(values)], ["subreddit", *names]).repartition(3)
    entries = rows.selectExpr("subreddit", f"inline(array(from_json(to_json(struct({', '.join(names)})), '{entry}')))")
    rules = RelevanceRules.for_brand("acme")
    got = reddit.atom_posts(entries, rules, START, store=stored_in_lots)
    want = reddit.atom_posts(entries, rules, START)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() == 7
    assert _wide_exchanges(want) and not _wide_exchanges(got)


@pytest.mark.parametrize("sort", [triage.NEWEST, triage.MOST_NEGATIVE, triage.HIGHEST_IMPACT])
def test_the_explorer_moves_texts_once(make_messages, sort):
    rows = make_messages(*[
        {"id": f"m{i:02d}", "content": f"text {i}", "created_at": START + timedelta(hours=i % 9) if i % 13 else None,
         "content_type": ("question", "bug_report", None)[i % 3], "parent_id": f"m{i // 2:02d}" if i % 4 else None,
         "sentiment_simple": ("negative", "positive", "neutral", "odd", None)[i % 5], "metadata": f'{{"points": {i * 7 % 40}}}'}
        for i in range(60)
    ], {"id": None, "source_id": "x"})
    for chosen in ((), (triage.UNANSWERED,), (triage.BUG_REPORTS, triage.UNANSWERED, triage.HIGH_IMPACT)):
        whole = triage.explore(rows, triage.Search(triage=chosen, sort=sort), START)
        assert len(_wide_exchanges(whole)) == 1
        page = triage.explore(rows, triage.Search(triage=chosen, sort=sort, limit=100), START)
        assert whole.collect() == page.collect() and whole.columns == page.columns and 5 < whole.count() <= 60
        assert {r.has_reply for r in whole.collect()} == ({False} if chosen == (triage.UNANSWERED,) else {False, True})
