"""Every query with SQL gives the same rows in both engines."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from echolens.plans.catalog import all_queries
from echolens.plans.oracle import all_sql

FOLDER = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings", "pages", "benchmark", "conversations")
SQL = all_sql()
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(SQL[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(columns, cursor.fetchall())


def test_queries_without_sql():
    assert set(QUERIES) - set(SQL) == {"ann_topk"}


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["topic", "mentions", "negative_mentions", "friction_mentions"]
