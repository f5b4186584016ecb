"""The stored index: appends, replaced vectors, splits, and which folders a search opens."""

import numpy as np
import pytest

from echolens.operators import vector_index as index
from echolens.operators import vectors as V
from echolens.schemas import VECTORS
from echolens.sources.snapshots import read_snapshot

from conftest import START, plan_of

RNG = np.random.default_rng(3)
HEADS = RNG.normal(size=(4, 8))
POINTS = np.round(HEADS[np.arange(240) % 4] + 0.3 * RNG.normal(size=(240, 8)), 3)


def _rows(spark, numbers, shift=0.0):
    rows = [(f"v{i:03d}", "t", [float(x) + shift for x in POINTS[i]], "docs", START, None, None) for i in numbers]
    return spark.createDataFrame(rows, VECTORS)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(f"q{i}", [float(x) for x in POINTS[i] + 0.05]) for i in range(12)]
    return spark.createDataFrame(rows, "query_id string, vector array<float>")


def _sorted(hits):
    return sorted((r.query_id, r.rank, r.id, round(r.distance, 9)) for r in hits.collect())


def test_build_append_search(spark, queries, tmp_path):
    path = str(tmp_path / "index")
    index.build(_rows(spark, range(0, 240, 2)), path, HEADS)
    index.append(_rows(spark, range(1, 240, 2)), path)
    whole = _rows(spark, range(240))
    assert _sorted(index.search(spark, queries, path, 5, probes=4)) == _sorted(V.search(queries, whole, 5, V.COSINE))
    cells = V.to_cells(whole, HEADS)
    for probes in (1, 2):
        want = _sorted(V.search_cells(queries, cells, HEADS, 5, probes))
        assert _sorted(index.search(spark, queries, path, 5, probes)) == want
        assert _sorted(index.search(spark, queries, path, 5, probes, broadcast_bytes=0)) == want
    plan = plan_of(index.search(spark, queries, path, 5, 1))
    assert "dynamicpruningexpression(cell" in plan and "CartesianProduct" not in plan


def test_the_last_vector_of_an_id_counts(spark, queries, tmp_path):
    path = str(tmp_path / "index")
    index.build(_rows(spark, range(60)), path, HEADS)
    index.append(_rows(spark, range(10), shift=5.0), path)
    stored = {r.id: r.vector[0] for r in read_snapshot(spark, path + "/vectors", index.INDEXED).collect()}
    assert len(stored) == 60 and stored["v003"] == pytest.approx(POINTS[3][0] + 5) and stored["v033"] == pytest.approx(POINTS[33][0])
    written = read_snapshot(spark, path + "/vectors", index.INDEXED, since=3).count()
    assert written == 10


def test_overgrown_cells_are_split(spark, queries, tmp_path):
    path = str(tmp_path / "index")
    copies = spark.createDataFrame([(f"c{i}", "t", [1.0] + [0.0] * 7, "docs", START, None, None) for i in range(50)], VECTORS)
    index.build(_rows(spark, range(240)).unionByName(copies), path, np.vstack([HEADS[:2], np.eye(8)[:1] * 50]))
    before = {r["cell"]: r["rows"] for r in index.cell_sizes(spark, path).collect()}
    while index.split(spark, path, 40):
        pass
    sizes = {r["cell"]: r["rows"] for r in index.cell_sizes(spark, path).collect()}
    assert sum(sizes.values()) == 290 and len(sizes) > len(before)
    large = [cell for cell, rows in sizes.items() if rows > 40]
    kept = read_snapshot(spark, path + "/vectors", index.INDEXED).where(f"cell in ({', '.join(map(str, large)) or -1})")
    assert kept.select("vector").distinct().count() <= len(large)  # only copies stay together
    centres = index.read_centres(spark, path)
    assert sorted(centres.cells) == sorted(set(centres.cells)) and set(sizes) <= set(centres.cells.tolist())
    hits = index.search(spark, queries, path, 5, probes=len(centres.cells))
    assert _sorted(hits) == _sorted(V.search(queries, _rows(spark, range(240)).unionByName(copies), 5, V.COSINE))
    index.append(_rows(spark, range(5), shift=0.01), path)
    assert read_snapshot(spark, path + "/vectors", index.INDEXED).count() == 290


def test_upsert_adds_only_the_batch(spark, tmp_path):
    path = str(tmp_path / "vectors")
    V.upsert_stored(_rows(spark, range(30)), path)
    V.upsert_stored(_rows(spark, range(25, 35), shift=1.0), path)
    stored = {r.id: r.vector[0] for r in read_snapshot(spark, path, VECTORS).collect()}
    assert len(stored) == 35 and stored["v027"] == pytest.approx(POINTS[27][0] + 1)
    assert read_snapshot(spark, path, VECTORS, since=4).count() == 10
