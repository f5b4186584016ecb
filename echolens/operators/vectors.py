"""Vector tables and nearest-neighbour search.

Search is exact and scans the corpus once: each task multiplies its Arrow batches with the query
matrix in NumPy and keeps only its best k hits per query, so what is shuffled is
``tasks x queries x k`` small rows, however the corpus is distributed. The query side is broadcast only
after its size has been measured; a larger one is joined with the corpus block by block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.functions.clock import Clock, timestamp
from echolens.operators.plan import materialised
from echolens.operators.tables import first_per_key, replace_by_key
from echolens.schemas import VECTORS
from echolens.sources.snapshots import remove, write_snapshot

L2, COSINE = "l2", "cosine"
# Query matrices up to this many bytes go to every executor.
BROADCAST_BYTES = 64 << 20
# Rows of either side that meet in one task of the block-by-block join.
BLOCK_ROWS = 20_000
# Query-corpus pairs compared in one NumPy call.
_PAIRS = 1 << 18
_HIT_BYTES = 256
_HIT = "query_id string, cell int, id string, distance double"


def upsert_vectors(vectors: DataFrame, batch: DataFrame, *last_by: str) -> DataFrame:
    """Batch rows replace stored rows of the same id; the last by ``last_by`` wins in the batch."""
    return replace_by_key(vectors, batch, "id", *(last_by or ("created_at",)))


def last_per_id(batch: DataFrame, *last_by: str) -> DataFrame:
    """One row for each id, the last by ``last_by``, the date without it."""
    return first_per_key(batch, "id", *[F.desc(name) for name in last_by or ("created_at",)])


def upsert_stored(batch: DataFrame, path: str) -> int:
    """Batch rows replace rows of the stored table; what is written grows with the batch. Returns the version.

    The ids are marked as gone from the versions before, then the rows are added; a run lost in between is made up by repeating it.
    """
    rows = materialised(last_per_id(batch).select(*VECTORS.names))
    remove(rows.select("id"), path)
    return write_snapshot(rows, path, partition_by="source", sort_by="id", added=True)


def vector_by_id(vectors: DataFrame, id: str) -> DataFrame:
    return vectors.where(F.col("id") == id).limit(1)


def vector_counts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("source").agg(F.count("*").alias("count")).orderBy("source")


def restrict(vectors: DataFrame, source: str | None = None, after: Clock = None) -> DataFrame:
    """The source and date filters of a search. They act before the ranking."""
    if source:
        vectors = vectors.where(F.col("source") == source)
    if after:
        vectors = vectors.where(F.col("created_at") >= timestamp(after))
    return vectors


def search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    metric: str = L2,
    source: str | None = None,
    after: Clock = None,
    payload: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` nearest vectors of each query (``query_id``, ``vector``), ties by id.

    Gives ``query_id``, ``rank`` from 1, ``id`` and ``distance``: squared L2, or 1 minus cosine. With
    ``payload`` the other stored columns are added to the final hits, not carried through the search.
    """
    chosen = restrict(vectors, source, after)
    corpus = chosen.select("id", "vector", F.lit(0).alias("cell"))
    asked = queries.select("query_id", "vector", F.lit(0).alias("cell"))
    hits, asked_rows = _hits(asked, corpus, k, metric, broadcast_bytes)
    best = _best(hits, k)
    if not payload:
        return best
    if asked_rows * k * _HIT_BYTES <= broadcast_bytes:
        best = F.broadcast(best)
    return best.join(chosen.drop("vector"), "id")


def assign_cells(vectors: DataFrame, cells: int = 256, seed: int = 42, max_iter: int = 10):
    """Cluster unit-length vectors with k-means.

    Gives the vectors with their ``cell`` and the cell centres, fitted on all vectors. Store the vectors
    partitioned by cell to let a search read the probed cells only.
    """
    rows = vectors.where(F.col("vector").isNotNull())
    unit = rows.withColumn("_unit", array_to_vector(_unit(F.col("vector"))))
    model = KMeans(
        k=cells, seed=seed, maxIter=max_iter, featuresCol="_unit", predictionCol="cell"
    ).fit(unit.select("_unit"))
    return model.transform(unit).drop("_unit"), np.array(model.clusterCenters())


def mean_centres(vectors: DataFrame, group: str) -> np.ndarray:
    """The mean unit vector of every group, in the groups' order: one row per group reaches the driver."""
    parts = vectors.where(F.col("vector").isNotNull()).select(group, F.posexplode(_unit(F.col("vector"))))
    rows = parts.groupBy(group, "pos").agg(F.avg("col").alias("mean")).orderBy(group, "pos").collect()
    names = list(dict.fromkeys(row[group] for row in rows))
    return np.array([[row["mean"] for row in rows if row[group] == name] for name in names])


def to_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Vectors with the ``cell`` of the nearest of given centres; what is stored by cell can be searched by cell."""

    @F.pandas_udf("int")
    def nearest(batch: pd.Series) -> pd.Series:
        unit = _normalised(np.stack(batch.to_numpy()).astype(float)) if len(batch) else np.zeros((0, centres.shape[1]))
        return pd.Series(_gaps(unit, centres).argmin(axis=1).astype("int32"))

    return vectors.where(F.col("vector").isNotNull()).withColumn("cell", nearest(F.col("vector")))


def _gaps(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (unit**2).sum(1)[:, None] - 2 * unit @ centres.T + (centres**2).sum(1)


def search_cells(
    queries: DataFrame,
    vectors: DataFrame,
    centres: np.ndarray,
    k: int = 10,
    probes: int = 8,
    metric: str = COSINE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Search the ``probes`` cells nearest to each query; exact within them.

    ``centres`` has one row per cell, so it is as small as the number of cells.
    """
    asked = _probed_cells(queries, centres, probes)
    # The probed cells, at most one row per centre, filter the scan: a table stored by cell reads their folders only.
    probed = F.broadcast(asked.select("cell").distinct())
    corpus = vectors.select("id", "vector", "cell").join(probed, "cell", "left_semi")
    return best_in_cells(asked, corpus, k, metric, broadcast_bytes)


def best_in_cells(asked: DataFrame, corpus: DataFrame, k: int, metric: str, broadcast_bytes: int) -> DataFrame:
    """The ``k`` nearest vectors of each query in the cells its rows name."""
    return _best(_hits(asked, corpus, k, metric, broadcast_bytes)[0], k)


def _unit(vector: Column) -> Column:
    as_double = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda total, x: total + x * x))
    return F.when(norm > 0, F.transform(as_double, lambda x: x / norm)).otherwise(as_double)


def _probed_cells(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    def nearest_cells(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = _normalised(np.stack(batch["vector"].to_numpy()).astype(float))
                cells = np.argsort(_gaps(unit, centres), axis=1, kind="stable")[:, :probes]
                yield batch.assign(cell=list(cells.astype("int32"))).explode("cell").astype({"cell": "int32"})

    rows = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    schema = f"query_id {rows.schema['query_id'].dataType.simpleString()}, vector array<float>, cell int"
    return rows.mapInPandas(nearest_cells, schema)


def _best(hits: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance")


def _hits(
    asked: DataFrame, corpus: DataFrame, k: int, metric: str, broadcast_bytes: int
) -> tuple[DataFrame, int]:
    """Candidates that include the k best of every query, and the number of query rows."""
    asked = asked.where(F.col("vector").isNotNull())
    corpus = corpus.where(F.col("vector").isNotNull())
    size = asked.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("dim")).first()
    if not size["rows"]:
        return asked.sparkSession.createDataFrame([], _HIT), 0
    if size["rows"] * (8 * size["dim"] + 64) <= broadcast_bytes:
        return _broadcast_hits(asked, corpus, k, metric), size["rows"]
    return _blocked_hits(asked, corpus, k, metric, size["rows"]), size["rows"]


def _broadcast_hits(asked: DataFrame, corpus: DataFrame, k: int, metric: str) -> DataFrame:
    rows = asked.select("query_id", "cell", "vector").toArrow()
    shared = asked.sparkSession.sparkContext.broadcast(_columns(rows, "query_id"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(_Queries(*shared.value, metric), k)
        for batch in batches:
            if batch.num_rows:
                best.add(*_columns(batch, "id"))
        yield from best.batches()

    return corpus.select("id", "cell", "vector").mapInArrow(scan, _HIT)


def _blocked_hits(asked: DataFrame, corpus: DataFrame, k: int, metric: str, queries: int) -> DataFrame:
    """Each query block meets each corpus block of its cell once; blocks have a bounded size.

    A cell that holds most of the corpus is cut into as many blocks as its row count asks for. The
    driver gets one count per cell, a number set by the caller.
    """
    query_blocks = -(-queries // BLOCK_ROWS)
    counts = {row["cell"]: row["count"] for row in corpus.groupBy("cell").count().collect()}
    per_cell = [-(-counts.get(cell, 0) // BLOCK_ROWS) for cell in range(max(counts, default=0) + 1)]
    corpus_blocks = F.get(F.array(*map(F.lit, per_cell)), F.col("cell"))
    keys = ["cell", "query_block", "corpus_block"]
    left = (
        asked.where(corpus_blocks > 0)
        .withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
        .withColumn("corpus_block", F.explode(F.sequence(F.lit(0), corpus_blocks - 1)))
        .select(*keys, "query_id", "vector")
    )
    # One row per cell that holds vectors: joined by hash here, broadcast at run time when small.
    right = (
        corpus.withColumn("corpus_block", F.pmod(F.xxhash64("id"), corpus_blocks).cast("int"))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        .select(*keys, "id", "vector")
    )

    def meet(asked_rows: pa.Table, stored: pa.Table) -> pa.Table:
        if not asked_rows.num_rows or not stored.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in _HIT_ARROW})
        best = _Best(_Queries(*_columns(asked_rows, "query_id"), metric), k)
        best.add(*_columns(stored, "id"))
        return pa.Table.from_batches(list(best.batches()))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, _HIT)


_HIT_ARROW = (
    ("query_id", pa.string()),
    ("cell", pa.int32()),
    ("id", pa.string()),
    ("distance", pa.float64()),
)


def _columns(rows: pa.Table | pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys as strings, cells and the vectors as one matrix of doubles."""
    if isinstance(rows, pa.Table):
        rows = rows.combine_chunks().to_batches()[0]
    keys = rows.column(key).cast(pa.string()).to_numpy(zero_copy_only=False)
    cells = rows.column("cell").to_numpy(zero_copy_only=False)
    flat = rows.column("vector").flatten().to_numpy(zero_copy_only=False)
    return keys, cells, flat.astype(float).reshape(len(keys), -1)


def _normalised(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


class _Queries:
    """Query ids, the matrix of each cell's queries and the metric."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, matrix: np.ndarray, metric: str) -> None:
        self.ids, self.cells, self.metric = ids, cells, metric
        self.matrix = self.prepare(matrix)
        self.by_cell = {cell: np.flatnonzero(cells == cell) for cell in np.unique(cells)}

    def prepare(self, matrix: np.ndarray) -> np.ndarray:
        return _normalised(matrix) if self.metric == COSINE else matrix

    def distance(self, rows: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """Distance of paired rows, summed in one order so that equal vectors tie exactly."""
        if self.metric == COSINE:
            return 1.0 - (self.matrix[rows] * stored).sum(1)
        gaps = self.matrix[rows] - stored
        return (gaps * gaps).sum(1)


class _Best:
    """Running k best hits per query over batches of stored vectors."""

    def __init__(self, queries: _Queries, k: int) -> None:
        self.queries, self.k = queries, k
        self.bound = np.full(len(queries.ids), np.inf)
        self.distance = np.full((len(queries.ids), k), np.inf)
        self.hit_ids = np.full((len(queries.ids), k), None, object)

    def add(self, ids: np.ndarray, cells: np.ndarray, matrix: np.ndarray) -> None:
        stored = self.queries.prepare(matrix)
        for cell in np.unique(cells):
            asked = self.queries.by_cell.get(cell)
            if asked is None:
                continue
            inside = np.flatnonzero(cells == cell)
            for start in range(0, len(inside), _PAIRS):
                part = inside[start : start + _PAIRS]
                step = max(1, _PAIRS // len(part))
                for first in range(0, len(asked), step):
                    self._compare(asked[first : first + step], ids[part], stored[part])

    def _compare(self, asked: np.ndarray, ids: np.ndarray, stored: np.ndarray) -> None:
        # Matrix products are fast but round by position, so they only select candidates.
        left = self.queries.matrix[asked]
        sizes = (left * left).sum(1)[:, None] + (stored * stored).sum(1)
        rough = sizes - 2.0 * (left @ stored.T)
        if self.queries.metric == COSINE:
            rough = 1.0 - left @ stored.T
        slack = 1e-9 * (1.0 + sizes.max())
        bound = self.bound[asked]
        if rough.shape[1] > self.k:
            bound = np.minimum(bound, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
        rows, cols = np.nonzero(rough <= bound[:, None] + slack)
        if not len(rows):
            return
        distance, names = self.queries.distance(asked[rows], stored[cols]), ids[cols]
        begin = np.searchsorted(rows, np.unique(rows))
        for low, high in zip(begin, np.r_[begin[1:], len(rows)]):
            self._merge(asked[rows[low]], distance[low:high], names[low:high])

    def _merge(self, query: int, distance: np.ndarray, names: np.ndarray) -> None:
        """The k best of a query's hits so far and new ones, by distance, then id."""
        held = np.isfinite(self.distance[query])
        distance, names = np.r_[self.distance[query][held], distance], np.r_[self.hit_ids[query][held], names]
        if len(distance) > self.k:  # of far more than k only those that can stay are sorted with their ids
            kept = distance <= np.partition(distance, self.k - 1)[self.k - 1]
            distance, names = distance[kept], names[kept]
        order = np.lexsort((names.astype(str), distance))[: self.k]
        self.distance[query, : len(order)], self.hit_ids[query, : len(order)] = distance[order], names[order]
        if len(order) == self.k:
            self.bound[query] = distance[order[-1]]

    def batches(self) -> Iterator[pa.RecordBatch]:
        rows, places = np.nonzero(np.isfinite(self.distance))
        columns = [
            pa.array(self.queries.ids[rows], pa.string()),
            pa.array(self.queries.cells[rows], pa.int32()),
            pa.array(self.hit_ids[rows, places], pa.string()),
            pa.array(self.distance[rows, places], pa.float64()),
        ]
        if len(rows):
            yield pa.RecordBatch.from_arrays(columns, [name for name, _ in _HIT_ARROW])
