"""The pipeline's stages on a small corpus, their odd rows, and the queries' parity with SQL."""

import duckdb
import pytest

import corpus_pipeline
from echolens.llm import packing, queries, sql
from tests.llm.conftest import SMALL

TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.mark.parametrize("name", sorted(sql.llm_sql()))
def test_parity(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    cursor = duck.execute(sql.llm_sql()[name])
    frame = queries.llm_queries()[name](spark, SMALL)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(map(repr, (tuple(row[columns.index(c)] for c in frame.columns) for row in cursor.fetchall())))
    assert sorted(repr(tuple(row)) for row in frame.collect()) == want


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "mixing", "packing"]
    assert sorted(int(name[2:].split("_")[0]) for name in queries.llm_queries()) == list(range(1, 14))


def test_stages_keep_columns_and_take_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, odd.limit(0)):
            got = stage(spark, docs, SMALL)
            assert got.columns == list(corpus_pipeline.COLUMNS), name
            rows = got.collect()
            if name == "near_copies" and docs is odd:
                assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 2, 3, 4, None, 8, 9, 10], key=str)
    assert corpus_pipeline.pack_tokens(spark, odd.limit(0), SMALL).count() == 0


def test_near_copies_of_repeated_ids(spark, documents):
    one, other = "one two three four five", "six seven eight nine ten"
    docs = documents((1, one), (1, one), (2, one), (3, other), (5, other), (5, "an own text of six words"), (6, ""), (6, ""))
    rows = corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, one), (3, other), (5, "an own text of six words"), (6, ""), (6, "")]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    lengths = {}
    for row in rows:
        lengths[row.sequence_id] = lengths.get(row.sequence_id, 0) + row.length
    assert all(n == packing.LENGTH or n & (n - 1) == 0 for n in lengths.values())
    docs = {row.doc_id for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {row.doc_id for row in rows} <= docs and len(rows) > 50
