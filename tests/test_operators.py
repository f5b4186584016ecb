"""Filters, metrics, replies and triage on small tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from echolens.operators import adhoc, filters, metrics, replies, tables, triage
from echolens.operators.plan import perhaps_among
from echolens.plans import pages
from echolens.schemas import INGESTION_STATE, MESSAGES, VECTORS
from echolens.sources import github
from echolens.sources.snapshots import read_snapshot, write_messages

from conftest import START, plan_of

AS_OF = datetime(2024, 1, 31)


def _ids(frame):
    return sorted(row.id for row in frame.select("id").collect())


def test_replies_count_from_any_source_and_oneself(make_messages):
    rows = make_messages(
        {"id": "q1", "content_type": "question"},
        {"id": "q2", "content_type": "question"},
        {"id": "q3", "content_type": "question", "parent_id": "q3"},
        {"id": "q4", "content_type": "question", "source": "docs"},
        {"id": "r1", "parent_id": "q1", "source": "docs"},
        {"id": "r2", "thread_id": "gone"},
    )
    assert _ids(replies.unanswered_questions(rows, as_of=AS_OF)) == ["q2", "q4"]
    assert replies.unanswered_count(rows, as_of=AS_OF).first()[0] == 1
    answered = {r.id for r in replies.with_has_reply(rows, rows).collect() if r.has_reply}
    assert answered == {"q1", "q3"}
    page = filters.newest(rows, 10)
    assert {r.id for r in replies.some_with_has_reply(page, rows).collect() if r.has_reply} == answered


def test_a_page_reads_texts_last(make_messages, tmp_path):
    rows = make_messages(*[
        {"id": f"m{i:02d}", "content": f"text {i}", "created_at": START + timedelta(hours=i), "content_type": "question",
         "parent_id": "m09" if i == 3 else None} for i in range(20)
    ])
    search = triage.Search(limit=5, offset=2, triage=(triage.UNANSWERED,))
    page = triage.explore(rows, search, AS_OF)
    assert [(r.id, r.content, r.has_reply) for r in page.collect()] == [(f"m{i}", f"text {i}", False) for i in range(17, 12, -1)]
    whole = [r.id for r in triage.explore(rows, triage.Search(triage=(triage.UNANSWERED,)), AS_OF).collect()]
    assert whole == [f"m{i:02d}" for i in range(19, -1, -1) if i != 9]
    write_messages(rows, str(tmp_path / "messages"))
    stored = read_snapshot(rows.sparkSession, str(tmp_path / "messages"), MESSAGES)
    plan = plan_of(triage.explore(stored, search, AS_OF))
    assert sum("content:string" in line for line in plan.splitlines() if "FileScan" in line) == 1



def test_explorer_moves_texts_of_matching_rows_only(spark, make_messages, tmp_path):
    rows = make_messages(
        {"id": "a", "content_type": "bug_report"}, {"id": "b", "content_type": "question"}, {"id": "c", "content_type": "question"},
        {"id": "d", "content_type": "praise", "parent_id": "c"}, {"id": "e", "source": "reddit", "content_type": "question"},
    )
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    search = triage.Search(sources=("github",), triage=(triage.BUG_REPORTS, triage.UNANSWERED))
    found = triage.explore(stored, search, AS_OF)
    assert _ids(found) == ["a", "b"]
    scans = [line for line in plan_of(found).splitlines() if "FileScan" in line and "content:string" in line]
    assert scans and all("EqualTo(source,github)" in line and "bug_report" in line for line in scans)


def test_no_nested_loop_joins(make_messages):
    rows = make_messages({"id": "a", "content_type": "question"})
    for frame in (
        replies.unanswered_questions(rows, as_of=AS_OF),
        replies.with_has_reply(rows, rows),
        triage.explore(rows, as_of=AS_OF),
    ):
        assert "NestedLoop" not in plan_of(frame) and "Cartesian" not in plan_of(frame)
    assert "TakeOrderedAndProject" in plan_of(filters.recent_negative(rows, as_of=AS_OF))


def test_filters_reach_the_stored_table(spark, make_messages, tmp_path):
    rows = make_messages(
        {"id": "a"}, {"id": "b", "source": "docs"}, {"id": "c", "created_at": datetime(2020, 1, 1)}
    )
    write_messages(rows, str(tmp_path / "messages"))
    stored = read_snapshot(spark, str(tmp_path / "messages"), MESSAGES)
    frame = metrics.new_bug_reports(stored, as_of=AS_OF)
    plan = plan_of(frame)
    scan = plan[plan.index("FileScan") :]
    assert "PartitionFilters: [NOT source" in scan
    assert "GreaterThanOrEqual(created_at" in scan and "EqualTo(content_type,bug_report)" in scan
    assert "ReadSchema: struct<created_at:timestamp_ntz,content_type:string>" in scan
    assert _ids(stored.where(filters.is_voice())) == ["a", "c"]


def test_filters_act_before_the_page_is_cut(make_messages):
    rows = make_messages(
        *[{"id": f"n{i}", "created_at": START + timedelta(hours=i), "topics": "[]"} for i in range(3)],
        {"id": "old", "topics": '["pricing"]'},
    )
    search = triage.Search(topics=("pricing",), limit=3)
    assert _ids(triage.explore(rows, search, AS_OF)) == ["old"]
    pages = [triage.explore(rows, triage.Search(limit=3, offset=at), AS_OF) for at in (0, 3)]
    assert [[r.id for r in page.collect()] for page in pages] == [["n2", "n1", "n0"], ["old"]]


def test_search_text_wildcards_and_backslash(make_messages):
    rows = make_messages({"id": "a", "content": r"50% C:\x"}, {"id": "b", "content": "50 off", "title": "Axb"})
    for text, found in (("0%c", ["a"]), ("A_B", ["b"]), ("c:\\x", ["a"]), (" ", ["a", "b"])):
        assert _ids(triage.explore(rows, triage.Search(text=text), AS_OF)) == found, text


def test_knowledge_source_lifts_the_voice_filter(make_messages):
    rows = make_messages({"id": "a"}, {"id": "b", "source": "docs"}, {"id": "c", "source": "blog"})
    assert _ids(triage.explore(rows, triage.Search(), AS_OF)) == ["a"]
    assert _ids(triage.explore(rows, triage.Search(sources=("docs", "github")), AS_OF)) == ["a", "b"]


def test_most_negative_sort(make_messages):
    rows = make_messages(
        {"id": "p", "sentiment_simple": "positive"}, {"id": "o", "sentiment_simple": "odd"},
        {"id": "u"}, {"id": "n", "sentiment_simple": "negative"},
    )
    frame = triage.explore(rows, triage.Search(sort=triage.MOST_NEGATIVE), AS_OF)
    assert [r.id for r in frame.collect()] == ["n", "u", "p", "o"]


def test_moving_average_skips_missing_days(make_messages):
    days = [1, 2, 9]
    rows = make_messages(
        *[{"id": f"{d}-{i}", "created_at": datetime(2024, 1, d), "sentiment_simple": "positive"}
          for d in days for i in range(d)]
    )
    values = [r.positive for r in metrics.sentiment_moving_avg(rows, as_of=AS_OF).collect()]
    assert values == [1.0, 1.5, 4.0]


def test_empty_table(spark):
    empty = spark.createDataFrame([], MESSAGES)
    assert metrics.positive_pct(empty).first()[0] == 0.0
    assert metrics.summary_stats(empty, as_of=AS_OF).first().total_messages == 0
    assert metrics.voice_stats(empty).first().questions == 0


def test_daily_totals_cover_processed_rows(make_messages):
    rows = make_messages(
        {"id": "a", "processed_at": START}, {"id": "b"}, {"id": "c", "processed_at": START, "source": "docs"}
    )
    assert sum(r.total_messages for r in metrics.daily_metrics(rows).collect()) == 2


def test_since_filter(spark, make_messages):
    state = spark.createDataFrame([("github", START, None, None, "{}")], INGESTION_STATE)
    rows = make_messages(
        {"id": "a"}, {"id": "b", "created_at": START - timedelta(1)},
        {"id": "c", "source": "reddit", "created_at": START - timedelta(9)},
    )
    assert _ids(github.since_filter(rows, state, "created_at")) == ["a", "c"]


def test_insert_if_absent(make_messages):
    stored = make_messages({"id": "a", "title": "old"})
    batch = make_messages(
        {"id": "a", "title": "new"},
        {"id": "b", "title": "second", "fetched_at": START + timedelta(1)},
        {"id": "b", "title": "first"},
    )
    once = tables.insert_if_absent(stored, batch)
    assert {r.id: r.title for r in once.collect()} == {"a": "old", "b": "first"}
    row = once.where("id = 'b'").first()
    assert (row.metadata, row.topics) == ("{}", "[]")
    assert sorted(tables.insert_if_absent(once, batch).collect()) == sorted(once.collect())
    assert tables.new_messages(once, batch).count() == 0


def test_update_analysis(spark, make_messages):
    stored = make_messages(
        {"id": "a", "sentiment_simple": "neutral", "topics": '["x"]', "metadata": '{"k":1}'},
        {"id": "b", "topics": '["x"]'}, {"id": "c", "topics": '["x"]'}, {"id": "d"},
    )
    delta = spark.createDataFrame(
        [("a", "positive", None, None, 1), ("a", None, None, "e1", 2), ("a", "negative", None, None, 3),
         ("b", None, [], None, 1), ("c", None, None, "e3", 1), ("zz", "positive", ["y"], None, 1)],
        "id string, sentiment_simple string, topics array<string>, embedding_id string, seq int",
    )
    rows = {r.id: r for r in tables.update_analysis(stored, delta, "seq", AS_OF).collect()}
    assert set(rows) == {"a", "b", "c", "d"}
    assert (rows["a"].sentiment_simple, rows["a"].embedding_id, rows["a"].topics) == ("negative", "e1", '["x"]')
    assert rows["a"].processed_at == AS_OF and rows["a"].metadata == '{"k":1}'
    assert (rows["b"].topics, rows["b"].processed_at) == ("[]", None)
    assert (rows["c"].topics, rows["c"].processed_at, rows["c"].embedding_id) == ('["x"]', None, "e3")
    assert (rows["d"].topics, rows["d"].metadata) == (None, None)


def test_large_delta_is_not_broadcast(make_messages, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = make_messages({"id": "a"}, {"id": "b"})
        batch = make_messages({"id": "b"}, {"id": "c"}, {"id": "d"})
        frame = tables.insert_if_absent(stored, batch)
        assert "BroadcastHashJoin" not in plan_of(frame)
        assert _ids(frame) == ["a", "b", "c", "d"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_building_a_plan_starts_no_job(make_messages, spark):
    stored, batch = make_messages({"id": "a"}, {"id": "b"}), make_messages({"id": "b"}, {"id": "c"})
    spark.sparkContext.setJobGroup("plans", "plans only")
    tables.insert_if_absent(stored, batch)
    tables.update_analysis(stored, batch.select("id", "sentiment_simple"))
    tables.replace_by_key(stored, batch, "id")
    triage.explore(stored)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")


def test_null_ids_ties_and_repeated_delta_ids(make_messages):
    stored = make_messages({"id": "a"}, {"id": "b"})
    batch = make_messages({"id": None, "source_id": "x"}, {"id": "c", "content": "1"}, {"id": "c", "content": "2"})
    once = tables.insert_if_absent(stored, batch)
    assert _ids(once) == ["a", "b", "c"] and _ids(tables.insert_if_absent(once, batch)) == ["a", "b", "c"]
    turned = batch.orderBy("content", ascending=False).repartition(3)
    assert sorted(once.collect(), key=str) == sorted(tables.insert_if_absent(stored, turned).collect(), key=str)
    delta = batch.where("id = 'c'").select("id", "sentiment_simple")
    assert tables.update_analysis(once, delta).count() == 3
    assert tables.replace_by_key(once, batch.where("id = 'c'"), "id").count() == 3


def test_an_insert_sorts_no_texts_and_moves_those_it_adds(make_messages, spark):
    stored = make_messages(*[{"id": f"m{i}", "content": f"old {i}"} for i in range(0, 300, 2)])
    fetched = [
        {"id": f"m{i}", "content": f"text {i} {again}", "fetched_at": START + timedelta((i + again) % 3)}
        for i in range(300) for again in (0, 1, 2, 2)
    ]
    batch = make_messages(*fetched, {"id": None, "content": "none"}).repartition(4)
    first = {f["id"]: f["content"] for f in sorted(fetched, key=lambda f: f["fetched_at"], reverse=True)}
    want = {f"m{i}": first[f"m{i}"] if i % 2 else f"old {i}" for i in range(300)}
    steps = tables.new_messages(stored, batch)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    ).split("\n\n")
    ranked = [step for step in steps if ") WindowGroupLimit" in step or ") Window" in step]
    assert ranked and not any("content#" in step for step in ranked)
    for threshold in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            rows = tables.insert_if_absent(stored, batch).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {r.id: r.content for r in rows} == want and len(rows) == 300
    ids = batch.select("id").where("id is not null").distinct()
    keys = ids.where("id like '%7'")
    passed = {r.id for r in perhaps_among(ids, keys, "id").collect()}
    assert {r.id for r in keys.collect()} <= passed and len(passed) < 40


def test_rows_alone_with_their_key_stay_where_they_are(spark):
    rows = spark.createDataFrame(
        [(f"k{i}", again, f"text {i} {again}") for i in range(200) for again in range(3 if i % 10 == 0 else 1)] + [("k0", 0, "text 0 0")],
        "key string, made int, text string",
    ).repartition(4).withColumn("at", F.spark_partition_id())
    rows = rows.localCheckpoint()
    got = tables.first_of_shared_keys(rows, "key", F.desc("made")).withColumn("now", F.spark_partition_id()).collect()
    assert sorted((r.key, r.text) for r in got) == sorted((f"k{i}", f"text {i} {2 if i % 10 == 0 else 0}") for i in range(200))
    moved = {r.key for r in got if r.now != r.at}
    assert len(moved) < 30
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        without = tables.first_of_shared_keys(rows, "key", F.desc("made"))
        assert "BroadcastHashJoin" not in plan_of(without)
        assert sorted(r.text for r in without.collect()) == sorted(r.text for r in got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_state_of_any_source_counts(spark):
    from echolens.sources.github import since_filter

    state = spark.createDataFrame([("discord", START, "1", None, "{}")], INGESTION_STATE)
    rows = spark.createDataFrame([("discord", START - timedelta(days=1)), ("discord", START)], "source string, at timestamp_ntz")
    assert since_filter(rows, state, "at").count() == 1


def test_ingestion_state(spark):
    state = spark.createDataFrame([("github", START, "1", None, '{"a": "b"}')], INGESTION_STATE)
    later = spark.createDataFrame(
        [("github", AS_OF, "2", None, None), ("github", START, "0", None, None), ("reddit", START, None, None, None)],
        INGESTION_STATE,
    )
    new = tables.update_ingestion_state(state, later)
    assert {r.source: r.last_item_id for r in new.collect()} == {"github": "2", "reddit": None}
    assert tables.ingestion_state_of(state, "github").first().metadata == {"a": "b"}
    assert tables.ingestion_state_of(state, "slack").count() == 0


def test_snapshots_ignore_unfinished_versions(spark, make_messages, tmp_path):
    path = str(tmp_path / "table")
    assert read_snapshot(spark, path, VECTORS).count() == 0
    assert write_messages(make_messages({"id": "a"}), path) == 1
    assert write_messages(make_messages({"id": "a"}, {"id": "b"}), path) == 2
    (tmp_path / "table" / "version=0000000003-whole").mkdir()
    assert _ids(read_snapshot(spark, path, MESSAGES)) == ["a", "b"]
    assert _ids(read_snapshot(spark, path, MESSAGES, 1)) == ["a"]
    assert write_messages(make_messages({"id": "c", "source": "docs"}), path, added=True) == 3
    assert write_messages(make_messages({"id": "d"}), path, added=True) == 4
    assert _ids(read_snapshot(spark, path, MESSAGES)) == ["a", "b", "c", "d"]
    assert _ids(read_snapshot(spark, path, MESSAGES, 3)) == ["a", "b", "c"]
    assert {r.id: r.source for r in read_snapshot(spark, path, MESSAGES).collect()}["c"] == "docs"
    assert write_messages(make_messages({"id": "e"}), path) == 5
    assert _ids(read_snapshot(spark, path, MESSAGES)) == ["e"]
    assert read_snapshot(spark, path, MESSAGES).columns == MESSAGES.names


def test_pages_have_every_panel(spark, make_messages):
    rows = make_messages({"id": "a", "content_type": "question", "topics": '["pricing","other"]', "title": "t"})
    state = spark.createDataFrame([], INGESTION_STATE)
    for page in (pages.dashboard(rows, AS_OF), pages.explorer(rows, as_of=AS_OF), pages.admin(rows, state)):
        assert all(frame.count() >= 1 for name, frame in page.items()), page
    groups = adhoc.SAMPLE_QUERIES.values()
    assert sum(len(query(rows).columns) > 0 for group in groups for query in group.values()) == 9


def test_clear_source(spark, make_messages):
    rows = make_messages({"id": "docs:a", "source": "blog"}, {"id": "docs:b", "source": "docs"})
    assert _ids(tables.clear_source(rows, "docs")) == ["docs:a"]
    assert tables.cleared_counts("docs", messages=rows).first().deleted == 1
    assert tables.reset_embeddings(rows).where("embedding_id is null").count() == 2


def test_update_among_leaves_other_rows_in_place(spark, make_messages):
    stored = make_messages({"id": "a"}, {"id": "b", "embedding_id": "b"}, {"id": "c", "topics": '["x"]'}, {"id": None})
    marks = spark.createDataFrame([("a", "a"), ("zz", "zz")], "id string, embedding_id string")
    frame = tables.update_analysis(stored, marks, as_of=AS_OF, among=F.col("embedding_id").isNull())
    assert sorted(frame.collect(), key=str) == sorted(tables.update_analysis(stored, marks, as_of=AS_OF).collect(), key=str)
    assert frame.columns == stored.columns and "Union" in plan_of(frame)


def test_a_sparing_update_moves_changed_messages_only(spark, make_messages):
    stored = make_messages(
        *[{"id": f"m{i}", "topics": '["x"]', "metadata": "{}", "content": f"text {i}"} for i in range(200)],
        {"id": "bare"}, {"id": "bare, not in the delta"}, {"id": None, "topics": "[]", "metadata": "{}"},
    ).repartition(4).withColumn("at", F.spark_partition_id()).localCheckpoint()
    given = [(f"m{i}", "positive" if i % 10 == 0 else None, [] if i == 5 else None, i) for i in range(200)]
    delta = spark.createDataFrame(
        [*given, ("m0", None, None, 200), ("bare", None, None, 0), ("zz", "positive", None, 0)],
        "id string, sentiment_simple string, topics array<string>, seq int",
    )
    for order in (None, "seq"):
        whole = tables.update_analysis(stored, delta, order, AS_OF)
        frame = tables.update_analysis(stored, delta, order, AS_OF, sparing=True)
        assert sorted(frame.collect(), key=str) == sorted(whole.collect(), key=str) and frame.columns == stored.columns
    rows = {r.id: r for r in frame.withColumn("now", F.spark_partition_id()).collect()}
    assert rows["m10"].sentiment_simple == "positive" and rows["m5"].topics == "[]"
    assert (rows["bare"].topics, rows["bare, not in the delta"].topics) == ("[]", None)
    assert sum(r.now != r.at for r in rows.values()) < 30


def test_an_insert_reads_texts_for_the_rows_it_adds_only(spark, make_messages):
    stored = make_messages({"id": "a"}, {"id": "b"})
    batch = make_messages(
        {"id": "b", "content": "x"}, {"id": "c", "content": "z", "fetched_at": START}, {"id": "c", "content": "y", "fetched_at": START},
        {"id": "c", "content": "a", "fetched_at": START + timedelta(1)}, {"id": "d", "fetched_at": None}, {"id": "d", "content": "late"},
    )
    candidates, exactly = tables.among_new_messages(stored, batch)
    assert sorted(r.id for r in candidates.collect()) == ["c", "c", "d"]
    # Copies of the candidates without texts are told apart all the same.
    found = exactly(candidates.drop("content").unionByName(candidates.drop("content"))).collect()
    assert sorted((r.id, r.fetched_at) for r in found if r.id == "c") == [("c", START)] and len(found) == 2
    asked = []
    for frame in (batch, batch.repartition(5), batch.orderBy("content")):
        asked.append(sorted((r.id, r.content) for r in tables.new_messages(stored, frame).collect()))
    assert asked[0] == asked[1] == asked[2] and asked[0][1] == ("d", "text")
