from datetime import datetime

import pytest
from pyspark.sql import functions as F

from echolens.functions import scoring

AS_OF = datetime(2024, 1, 8)


@pytest.mark.parametrize(
    "metadata, expected",
    [
        ('{"num_comments": 7, "comments": 3}', 7),
        ('{"num_comments": 0, "comments": 3}', 3),
        ('{"comments": 3}', 3),
        ('{"num_comments": null, "comments": "12"}', 12),
        ('{"num_comments": 3.7}', 3),
        ('{"num_comments": "3.7", "comments": 5}', 0),
        ('{"num_comments": "", "comments": 5}', 5),
        ('{"num_comments": "many"}', 0),
        ("[1]", 0),
        ("no json", 0),
        (None, 0),
    ],
)
def test_metadata_int(spark, metadata, expected):
    row = spark.createDataFrame([(metadata,)], "m string")
    assert row.select(scoring.metadata_int(F.col("m"), "num_comments", "comments")).first()[0] == expected


def test_impact_scores(make_messages):
    rows = make_messages(
        {"id": "a", "sentiment_simple": "negative", "sentiment_rich": "complaint", "content_type": "bug_report",
         "metadata": '{"num_comments": 100, "points": 1000}', "created_at": datetime(2024, 1, 8)},
        {"id": "b", "metadata": '{"score": -40}', "created_at": datetime(2024, 1, 1)},
        {"id": "c", "sentiment_simple": "neutral", "content_type": "question", "created_at": datetime(2023, 1, 1)},
        {"id": "d", "sentiment_simple": "positive", "created_at": datetime(2024, 2, 1)},
    )
    scored = rows.select("id", scoring.impact_score(AS_OF).alias("s"), scoring.explorer_impact_score().alias("e"))
    assert {r.id: (r.s, r.e) for r in scored.collect()} == {
        "a": (4 + 2 + 3 + 3 + 3 + 2, 15.0),
        "b": (-2.0 + 1.0, -2.0 + 1.0),  # recency lifts the first, the default sentiment the second
        "c": (2.0, 2.0),
        "d": (2.0, 0.0),
    }


def test_malformed_topics_are_null(spark):
    rows = spark.createDataFrame([('["a","b"]',), ('{"a":1}',), ("[",), (None,)], "t string")
    assert [r[0] for r in rows.select(scoring.topics_array(F.col("t"))).collect()] == [["a", "b"], None, None, None]
