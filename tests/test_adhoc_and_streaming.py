"""The SQL surface and incremental ingestion."""

import json

import pytest

from echolens.operators import adhoc
from echolens.operators.ingestion import run_ingestion
from echolens.schemas import INGESTION_STATE, MESSAGES
from echolens.sources import github, landing
from echolens.sources.snapshots import compact, latest_version, read_snapshot
from echolens.streaming.ingest import ingest

from conftest import START


@pytest.mark.parametrize("sql", ["", " ; ", "DROP TABLE messages", "SELECT 1; SELECT 2", "INSERT INTO messages SELECT 1"])
def test_refused_queries(sql):
    with pytest.raises(ValueError):
        adhoc.checked_sql(sql)


def test_limit_is_clamped():
    assert [adhoc.checked_sql("select 1", n)[1] for n in (0, -5, 10, "20", 99_999)] == [1, 1, 10, 20, 1000]
    with pytest.raises(ValueError):
        adhoc.checked_sql("select 1", "many")


def test_limit_cannot_be_undone(spark):
    numbers = {"nums": spark.range(5000)}
    with pytest.raises(Exception):
        adhoc.safe_query(spark, "SELECT * FROM nums) AS q --", numbers, 10)
    assert adhoc.safe_query(spark, "SELECT * FROM nums -- all", numbers, 10).count() == 10
    result = adhoc.run_query(spark, "SELECT id FROM nums", numbers, 10)
    assert (result["row_count"], result["truncated"]) == (10, True)
    assert adhoc.run_query(spark, "SELECT id FROM nums WHERE id < 10", numbers, 10)["truncated"] is False


@pytest.mark.parametrize("sql", [
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT id, (SELECT reflect('java.lang.Math', 'random')) FROM nums",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
    "SELECT * FROM nums WHERE id IN (SELECT id FROM other)",
    "WITH x AS (SELECT 1 AS id) INSERT INTO nums SELECT * FROM x",
])
def test_only_named_tables_and_harmless_functions(spark, sql):
    spark.range(3).createOrReplaceTempView("other")
    with pytest.raises(ValueError):
        adhoc.safe_query(spark, sql, {"nums": spark.range(5)})


@pytest.mark.parametrize("sql", [
    "SELECT " + ", ".join(f"{i} AS c{i}" for i in range(60)) + ", java_method('java.lang.System', 'getProperty', 'user.home') FROM nums",
    "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT * FROM IDENTIFIER('secret')",
    "SELECT * FROM secret /* WITH secret AS ( */",
    "SELECT 'WITH secret AS (' FROM secret",
    "SELECT (SELECT max(id) FROM secret) FROM nums",
    "SELECT id FROM nums WHERE EXISTS (SELECT 1 FROM secret)",
    "SELECT id FROM nums GROUP BY id HAVING count(*) > (SELECT count(*) FROM secret)",
    "SELECT id FROM nums ORDER BY (SELECT max(id) FROM secret)",
    "SELECT id FROM nums JOIN (SELECT id AS j FROM secret) ON id = j",
    "SELECT id FROM nums JOIN nums AS n ON n.id = (SELECT max(id) FROM secret)",
    "SELECT id FROM nums, LATERAL (SELECT id FROM secret)",
    "SELECT id FROM nums LIMIT (SELECT max(id) FROM secret)",
    "SELECT max(id) OVER (ORDER BY (SELECT max(id) FROM secret)) FROM nums",
    "SELECT CASE WHEN id > 1 THEN (SELECT max(id) FROM secret) END FROM nums",
    "SELECT transform(array(1), x -> reflect('java.lang.Math', 'random')) FROM nums",
    "WITH a AS (SELECT * FROM secret) SELECT * FROM a",
    "SELECT * FROM (WITH secret AS (SELECT 1 AS id) SELECT id FROM secret), secret",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
    "SELECT id FROM nums UNION SELECT id FROM secret",
    "SELECT * FROM default.nums",
    "SELECT try_reflect('java.lang.Math', 'random')",
    "SELECT current_user()",
    "SELECT TRANSFORM(id) USING 'cat' AS x FROM nums",
    "SELECT my_own(id) FROM nums",
    "SELECT * FROM secret TABLESAMPLE (10 ROWS)",
    "SELECT * FROM global_temp.secret",
])
def test_bypasses_are_refused(spark, sql):
    spark.range(3).createOrReplaceTempView("secret")
    spark.range(3).createOrReplaceGlobalTempView("secret")
    spark.udf.register("my_own", lambda x: x)
    with pytest.raises(ValueError):
        adhoc.safe_query(spark, sql, {"nums": spark.range(5)})


@pytest.mark.parametrize("sql, rows", [
    ("SELECT ';' AS x, id FROM nums -- one; two", 5),
    ("SELECT 'UnresolvedRelation [x]' AS a, \"java_method(\" AS b FROM nums", 5),
    ("SELECT 'it''s; \\'; fine' AS a /* ; */;", 1),
    ("WITH secret AS (SELECT id FROM nums), more AS (SELECT * FROM secret) SELECT * FROM more JOIN secret USING (id)", 5),
    ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT * FROM r", 4),
    ("SELECT id, count(*) AS n FROM nums GROUP BY id HAVING count(*) > 0 ORDER BY id LIMIT 3", 3),
    ("SELECT x FROM nums LATERAL VIEW explode(array(1, 2)) t AS x", 10),
    ("SELECT * FROM range(3) CROSS JOIN VALUES (1), (2) AS v(k)", 6),
    ("SELECT date_trunc('day', now()) AS d, upper('a') AS u, try_to_number('1', '9') AS t, get_json_object('{}', '$.a') AS j", 1),
    ("SELECT * FROM (SELECT id, id % 2 AS odd FROM nums) PIVOT (count(*) FOR odd IN (0 AS even, 1 AS odd))", 5),
])
def test_legal_queries(spark, sql, rows):
    assert adhoc.safe_query(spark, sql, {"nums": spark.range(5)}).count() == rows


def test_result_belongs_to_the_callers_session(spark):
    rows = spark.range(5)
    result = adhoc.safe_query(spark, "SELECT id FROM nums WHERE id > 2", {"nums": rows})
    assert result.sparkSession is spark and result.join(rows, "id").count() == 2
    assert not spark.catalog.tableExists("nums")


def test_views_of_the_session_come_back(spark):
    spark.range(3).createOrReplaceTempView("nums")
    assert adhoc.safe_query(spark, "SELECT * FROM nums", {"nums": spark.range(7)}).count() == 7
    assert spark.table("nums").count() == 3
    spark.catalog.dropTempView("nums")


def test_run_query(spark, make_messages):
    rows = make_messages({"id": "a"}, {"id": "b"}, {"id": "c", "source": "docs"})
    sql = "with x as (select source, count(*) as n from messages group by source) select * from x order by n desc;"
    result = adhoc.run_query(spark, sql, {"messages": rows})
    assert result["rows"] == [{"source": "github", "n": 2}, {"source": "docs", "n": 1}]
    assert (result["columns"], result["row_count"], result["limit_applied"]) == (["source", "n"], 2, 1000)
    table = adhoc.run_query(spark, "select id from messages order by id", {"messages": rows}, 2, "table")
    assert table["rows"] == [("a",), ("b",)]
    with pytest.raises(ValueError):
        adhoc.run_query(spark, "select id, id from messages", {"messages": rows})
    with pytest.raises(ValueError):
        adhoc.run_query(spark, "select 1", {}, format="csv")
    with pytest.raises(Exception):
        adhoc.run_query(spark, "with x as (select 1) delete from messages", {"messages": rows})


def test_describe_tables(spark, make_messages):
    found = adhoc.describe_tables(spark, {"messages": make_messages({"id": "a"})}).collect()
    assert [r.column_name for r in sorted(found, key=lambda r: r.position)] == MESSAGES.names


def test_ingestion_run_moves_the_state_and_adds_nothing_twice(spark, tmp_path):
    messages, state = str(tmp_path / "messages"), str(tmp_path / "state")
    lines = [json.dumps({"owner": "o", "repo": "r", "number": n, "title": "t", "created_at": f"2024-01-0{n}T00:00:00Z"}) for n in (1, 2)]
    raw = landing.parse_landed(spark.createDataFrame([(line,) for line in [*lines, "broken"]], "value string"), "github_issues")
    run = lambda: run_ingestion(spark, "github", raw, github.issues, messages, state, START)
    assert run() == 2 and run() == 0
    row = read_snapshot(spark, state, INGESTION_STATE).first()
    assert (row.source, row.last_fetched_at, row.metadata) == ("github", START, '{"inserted":0}')
    assert read_snapshot(spark, messages, MESSAGES).count() == 2
    compact(spark, messages, MESSAGES, "source")
    assert read_snapshot(spark, messages, MESSAGES).count() == 2


def test_stream_inserts_only_new_files(spark, tmp_path):
    landing, table, checkpoint = (tmp_path / name for name in ("landing", "messages", "checkpoint"))
    landing.mkdir()

    def land(name, *numbers):
        lines = [
            json.dumps({"owner": "o", "repo": "r", "issue_number": 1, "id": n, "body": name, "created_at": "2024-01-01T00:00:00Z"})
            for n in numbers
        ]
        (landing / f"{name}.json").write_text("\n".join(lines))

    def run():
        normalise = lambda raw: github.issue_comments(raw, START)
        query = ingest(spark, str(landing), "github_issue_comments", normalise, str(table), str(checkpoint))
        query.awaitTermination()

    land("one", 1, 2)
    run()
    land("two", 2, 3)
    run()
    run()
    rows = {r.source_id[-1]: r.content for r in read_snapshot(spark, str(table), MESSAGES).collect()}
    assert rows == {"1": "one", "2": "one", "3": "two"}
    assert latest_version(spark, str(table)) == 2
