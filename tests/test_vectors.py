"""Search against brute force, with copies, ties and hot cells."""

import numpy as np
import pytest

from echolens.operators import vectors as V
from echolens.schemas import VECTORS

from conftest import START, plan_of

RNG = np.random.default_rng(5)
# A third of the corpus are copies of one vector.
POINTS = np.round(np.concatenate([RNG.normal(size=(200, 8)), np.repeat(RNG.normal(size=(1, 8)), 100, axis=0)]), 3)
QUERIES = np.concatenate([POINTS[195:205], RNG.normal(size=(5, 8))])


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (f"v{i}", "t", [float(x) for x in p], "docs" if i % 2 else "blog", START, None, None) for i, p in enumerate(POINTS)
    ]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(f"q{i}", [float(x) for x in p]) for i, p in enumerate(QUERIES)]
    return spark.createDataFrame(rows, "query_id string, vector array<float>")


def _brute(metric, k, keep=lambda i: True):
    points, asked = POINTS.astype("float32").astype(float), QUERIES.astype("float32").astype(float)
    best = {}
    for q, x in enumerate(asked):
        pairs = []
        for i, p in enumerate(points):
            if keep(i):
                d = ((x - p) ** 2).sum() if metric == V.L2 else 1 - x @ p / np.sqrt((x @ x) * (p @ p))
                pairs.append((round(float(d), 9), f"v{i}"))
        best[f"q{q}"] = sorted(pairs)[:k]
    return best


def _found(hits):
    rows = sorted(hits.collect(), key=lambda r: (r.query_id, r.rank))
    best = {}
    for r in rows:
        best.setdefault(r.query_id, []).append((round(r.distance, 9), r.id))
        assert r.rank == len(best[r.query_id])
    return best


@pytest.mark.parametrize("metric", [V.L2, V.COSINE])
@pytest.mark.parametrize("limit", [V.BROADCAST_BYTES, 0])
def test_search_is_exact(corpus, queries, metric, limit, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 40)
    hits = V.search(queries, corpus, 7, metric, broadcast_bytes=limit)
    assert _found(hits) == _brute(metric, 7)
    assert "CartesianProduct" not in plan_of(hits) and "NestedLoop" not in plan_of(hits)


def test_filter_acts_before_ranking(corpus, queries):
    hits = V.search(queries, corpus, 5, source="docs", payload=True)
    assert _found(hits) == _brute(V.L2, 5, lambda i: i % 2)
    assert set(hits.columns) >= {"text", "source", "url"}
    assert V.search(queries.limit(0), corpus).count() == 0


def test_cells(corpus, queries):
    stored, centres = V.assign_cells(corpus, cells=6)
    assert stored.count() == len(POINTS) and len(centres) == 6
    everything = V.search_cells(queries, stored, centres, 5, probes=6)
    assert _found(everything) == _brute(V.COSINE, 5)
    exact = {q: {d for d, _ in hits} for q, hits in _brute(V.COSINE, 5).items()}
    for limit in (V.BROADCAST_BYTES, 0):
        some = _found(V.search_cells(queries, stored, centres, 5, probes=3, broadcast_bytes=limit))
        recall = np.mean([len(exact[q] & {d for d, _ in hits}) / len(exact[q]) for q, hits in some.items()])
        assert recall > 0.7


def test_upsert_keeps_one_row_per_id(spark, corpus):
    batch = spark.createDataFrame(
        [("v1", "old", [1.0], "docs", START, None, None), ("v1", "new", [2.0], "docs", START.replace(day=2), None, None)],
        VECTORS,
    )
    rows = V.upsert_vectors(corpus, batch)
    assert rows.count() == len(POINTS) and V.vector_by_id(rows, "v1").first().text == "new"
    assert {r.source: r["count"] for r in V.vector_counts(corpus).collect()} == {"docs": 150, "blog": 150}
