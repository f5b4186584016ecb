"""Exact search of the largest inner products with an M-tree in two storeys.

*Upper storey*: a bounded number of routing objects, rows of the table drawn by hash. Every vector goes to the subtree of the
nearest one; a subtree's covering radius, longest vector and number of rows come from aggregates over all its vectors. *Lower
storey*: each subtree is an M-tree in a task of its own, or several where it has many rows. Pages hold either routing objects
with covering radius, distance to the parent and subtree, or vectors with their distance to the parent.

From the distance d of a query to a routing object of radius r, no vector below has an inner product above
(|q|^2 + m^2 - max(0, d - r)^2) / 2, where m is the largest length below, nor above q*c + |q| r; and before d is computed, the
stored distance to the parent bounds it by the triangle inequality, which spares computing it. A query first walks the subtree of its
nearest routing object. Its k-th best score there is a floor, and it goes on only to subtrees whose bound reaches it.
Within a tree all queries of the task are walked together, best first by the page that promises most to any of them: a page meets
the queries that still need it in one matrix product.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without vec_id. Vectors of different
lengths are not compared; those of a length without routing object form a subtree that every query of that length walks.
Components are scaled and rounded down first; inner products are exact while below 2**53. Ties go to the smaller
vec_id; repeated rows of one vec_id are candidates each, and queries once with the first of them by its components.
Other columns take no part. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.llm.common import cut, stored

#: Rows of a subtree beyond which it is cut into several trees; rows of a subtree on average, while there are fewer than ROUTES.
MOST_ROWS, LEAST_ROWS = 65_536, 1_024
#: Routing objects of the upper storey at most.
ROUTES = 1_024
#: Rows of a block of queries.
QUERY_ROWS = 8_192
PAGE = 64
FANOUT = 16
_SCHEMA = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(vector) > 0)


def scaled(vector: Column, by: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * by).cast("long"))


@dataclass
class Node:
    """A page. ``centers`` are routing objects or vectors; ``to_parent`` their distances to the page's own center."""

    centers: np.ndarray
    to_parent: np.ndarray
    ids: np.ndarray | None = None
    children: list["Node"] | None = None
    radii: np.ndarray | None = None
    longest: np.ndarray | None = None


def _distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    difference = points - center
    return np.sqrt(np.einsum("ij,ij->i", difference, difference))


def build(points: np.ndarray, ids: np.ndarray, center: np.ndarray | None = None, page: int = PAGE,
          fanout: int = FANOUT) -> Node:
    """A tree loaded from above: routing objects far from one another, every vector below the nearest of them."""
    center = points[0] if center is None else center
    own = _distances(points, center)
    if len(points) <= page:
        return Node(points, own, ids)
    picks, nearest = [int(own.argmax())], np.full(len(points), np.inf)
    owner = np.zeros(len(points), np.int64)
    while True:
        away = _distances(points, points[picks[-1]])
        closer = away < nearest
        owner[closer], nearest[closer] = len(picks) - 1, away[closer]
        farthest = int(nearest.argmax())
        if len(picks) == fanout or nearest[farthest] == 0:
            break
        picks.append(farthest)
    groups = [np.flatnonzero(owner == i) for i in range(len(picks))]
    largest = max(len(group) for group in groups)
    if len(picks) == 1 or largest > 0.9 * len(points):  # copies, or one dense spot: cut evenly by distance
        order = np.argsort(nearest if len(picks) > 1 else own, kind="stable")
        groups = np.array_split(order, min(fanout, -(-len(points) // page)))
    groups = [group for group in groups if len(group)]
    centers = np.stack([points[group[0]] for group in groups])
    radii = np.array([_distances(points[g], c).max() for g, c in zip(groups, centers)])
    longest = np.array([np.sqrt(np.einsum("ij,ij->i", points[g], points[g]).max()) for g in groups])
    children = [build(points[g], ids[g], c, page, fanout) for g, c in zip(groups, centers)]
    return Node(centers, _distances(centers, center), None, children, radii, longest)


@dataclass
class Work:
    """Distances and products that a search computed, and those that stored bounds spared."""

    computed: int = 0
    spared: int = 0


class Walk:
    """Queries on their way through a tree, with the k best vectors of each so far; ``floors`` are scores known before."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, floors: np.ndarray, k: int, work: Work | None = None) -> None:
        self.queries, self.ids, self.k, self.work = queries, ids, k, work or Work()
        self.squared = np.einsum("ij,ij->i", queries, queries)
        self.floors = floors.astype(float)
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]  # (-score, vec_id)

    def slack(self, at: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """Distances come from rounded squares; scores of equal rank must not be lost."""
        return 1e-6 * (1 + self.squared[at][:, None] + longest[None, :] ** 2)

    def distances(self, at: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the queries to the centers, and their inner products."""
        products = self.queries[at] @ centers.T
        squares = self.squared[at][:, None] + np.einsum("ij,ij->i", centers, centers) - 2 * products
        return np.sqrt(np.maximum(squares, 0)), products

    def limits(self, at: np.ndarray, gaps: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """Above no inner product with a vector of at most that length and at least that distance."""
        return (self.squared[at][:, None] + longest[None, :] ** 2 - gaps**2) / 2 + self.slack(at, longest)

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        found = sorted([*self.best[query], *zip((-scores).tolist(), ids.tolist())])[:self.k]
        self.best[query] = found
        if len(found) == self.k:
            self.floors[query] = max(self.floors[query], -found[-1][0])


def go_through(root: Node, root_center: np.ndarray, walk: Walk) -> None:
    """Offers each query of ``walk`` all vectors of the tree that its floor and the bounds admit, but those of its own id."""
    work, tick = walk.work, 0
    everyone = np.arange(len(walk.ids))
    start, _ = walk.distances(everyone, root_center[None, :])
    work.computed += len(everyone)
    queue = [(-np.inf, 0, root, everyone, start[:, 0], np.full(len(everyone), np.inf))]
    while queue:
        _, _, node, at, to_center, bounds = heapq.heappop(queue)
        alive = bounds >= walk.floors[at]
        at, to_center = at[alive], to_center[alive]
        if not len(at):
            continue
        gaps = np.abs(to_center[:, None] - node.to_parent[None, :])
        if node.children is None:
            lengths = np.sqrt(np.einsum("ij,ij->i", node.centers, node.centers))
            near = (walk.limits(at, gaps, lengths) >= walk.floors[at][:, None]) & (walk.ids[at][:, None] != node.ids[None, :])
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            work.computed += len(rows) * len(columns)
            work.spared += near.size - len(rows) * len(columns)
            if len(rows):
                scores = walk.queries[at[rows]] @ node.centers[columns].T
                hits = near[np.ix_(rows, columns)] & (scores >= walk.floors[at[rows]][:, None])
                for i in np.flatnonzero(hits.any(axis=1)):
                    walk.offer(at[rows[i]], scores[i, hits[i]], node.ids[columns[hits[i]]])
            continue
        near = walk.limits(at, np.maximum(gaps - node.radii, 0), node.longest) >= walk.floors[at][:, None]
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        work.computed += len(rows) * len(columns)
        work.spared += near.size - len(rows) * len(columns)
        if not len(rows):
            continue
        at, near = at[rows], near[np.ix_(rows, columns)]
        away, products = walk.distances(at, node.centers[columns])
        limit = walk.limits(at, np.maximum(away - node.radii[columns], 0), node.longest[columns])
        reach = products + np.sqrt(walk.squared[at])[:, None] * node.radii[columns] + walk.slack(at, node.longest[columns])
        limit = np.where(near, np.minimum(limit, reach), -np.inf)
        for j, child in enumerate(columns):
            needed = limit[:, j] >= walk.floors[at]
            if needed.any():
                tick += 1
                heapq.heappush(queue, (
                    -float(limit[needed, j].max()), tick, node.children[child], at[needed], away[needed, j], limit[needed, j],
                ))


def search(root: Node, root_center: np.ndarray, query: np.ndarray, query_id: int, k: int,
           work: Work | None = None) -> list[tuple[int, int]]:
    """The k best (vec_id, score) for one query, by score and then the smaller id, without rows of the query's own id."""
    walk = Walk(query[None, :].astype(float), np.array([query_id]), np.array([-np.inf]), k, work)
    go_through(root, root_center, walk)
    return [(vec_id, -int(score)) for score, vec_id in walk.best[0]]


@dataclass(frozen=True)
class Upper:
    """Routing objects of the upper storey as rows, by length of vector."""

    centers: dict[int, np.ndarray]
    first: dict[int, int]  # number of the first subtree of a length

    @classmethod
    def of(cls, drawn: list[list[int]]) -> "Upper":
        centers: dict[int, list] = {}
        for vector in dict.fromkeys(map(tuple, drawn)):
            centers.setdefault(len(vector), []).append(vector)
        numbers = np.cumsum([0, *map(len, centers.values())])
        return cls({d: np.array(c, float) for d, c in centers.items()}, dict(zip(centers, map(int, numbers))))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the subtrees of vectors of one length, and the distances to their routing objects; -1 without any."""
        centers = self.centers.get(points.shape[1])
        if centers is None:
            return np.full(len(points), -1, np.int64), np.zeros(len(points))
        squares = np.einsum("ij,ij->i", centers, centers) - 2 * (points @ centers.T)
        number = squares.argmin(axis=1)
        away = points - centers[number]
        return number + self.first[points.shape[1]], np.sqrt(np.einsum("ij,ij->i", away, away))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield batch.take(pa.array(np.flatnonzero(dims == dim)))


_DEALT = "vec_id long, vector array<long>, dim int, subtree long, away double, length double"


def dealt(vectors: DataFrame, upper: Upper) -> DataFrame:
    """Vectors with their subtree, the distance to its routing object, and their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                points = _matrix(part.column("vector"))
                subtree, away = upper.nearest(points)
                length = np.sqrt(np.einsum("ij,ij->i", points, points))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(subtree), pa.array(away), pa.array(length)],
                    ["vec_id", "vector", "dim", "subtree", "away", "length"],
                )

    return vectors.mapInArrow(run, _DEALT)


def _meet(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        points, ids = _matrix(vectors.column("vector")), vectors.column("vec_id").to_numpy()
        asked = queries.column("vec_id").to_numpy()
        floors = queries.column("floor").fill_null(-np.inf).to_numpy()
        walk = Walk(_matrix(queries.column("vector")), asked, floors, k)
        go_through(build(points, ids), points[0], walk)
        found = [(query, vec_id, -int(score)) for query, best in zip(asked.tolist(), walk.best) for score, vec_id in best]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(column, pa.int64()) for column in columns], schema)

    return meet


def _routed(queries: DataFrame, upper: Upper, stats: dict[int, tuple[float, float]]) -> DataFrame:
    """Queries once for each subtree whose bound reaches their floor, but that of their nearest routing object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                points = _matrix(part.column("vector"))
                centers = upper.centers.get(points.shape[1])
                if centers is None:
                    continue
                numbers = np.arange(len(centers)) + upper.first[points.shape[1]]
                known = np.array([number in stats for number in numbers])
                centers, numbers = centers[known], numbers[known]
                radii, longest = np.array([stats[n] for n in numbers], float).reshape(-1, 2).T
                floors = part.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                walk, everyone = Walk(points, np.zeros(len(points)), floors, 1), np.arange(len(points))
                for some in np.array_split(everyone, -(-len(points) * len(centers) // 2_000_000) or 1):
                    away, products = walk.distances(some, centers)
                    limit = np.minimum(
                        walk.limits(some, np.maximum(away - radii * (1 + 1e-9), 0), longest),
                        products + np.sqrt(walk.squared[some])[:, None] * radii * (1 + 1e-9) + walk.slack(some, longest),
                    )
                    home = part.column("subtree").to_numpy(zero_copy_only=False)[some]
                    row, column = np.nonzero((limit >= floors[some][:, None]) & (numbers != home[:, None]))
                    chosen = part.take(pa.array(some[row]))
                    yield pa.RecordBatch.from_arrays(
                        [*(chosen.column(name) for name in ("vec_id", "vector", "dim", "floor")), pa.array(numbers[column])],
                        ["vec_id", "vector", "dim", "floor", "subtree"],
                    )

    return queries.mapInArrow(run, "vec_id long, vector array<long>, dim int, floor double, subtree long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, most_rows: int = MOST_ROWS, least_rows: int = LEAST_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each query the k rows of ``vectors`` with the largest inner products, other than its own.

    Both have ``vec_id`` and ``vector``, an array of long. Result: query_id, rank from 1, vec_id, score.
    """
    columns = (F.col("vec_id").cast("long"), "vector", F.size("vector").alias("dim"))
    vectors = vectors.where(F.col("vec_id").isNotNull()).select(*columns)
    queries = queries.where(F.col("vec_id").isNotNull()).select(*columns)
    queries = queries.groupBy("vec_id", "dim").agg(F.min("vector").alias("vector")).select("vec_id", "vector", "dim")
    routes = min(max(-(-vectors.count() // least_rows), 1), ROUTES)
    drawn = vectors.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(routes).select("vector").collect()
    upper = Upper.of([row["vector"] for row in drawn])
    rows = stored(dealt(vectors, upper), "mtree-dealt")
    sizes = cut(rows.groupBy("dim", "subtree").agg(
        F.ceil(F.count("*") / most_rows).cast("int").alias("blocks"), F.max("away").alias("radius"), F.max("length").alias("longest")
    ))
    known = sizes.where("subtree >= 0").collect()  # as many rows as routing objects
    stats = {row["subtree"]: (row["radius"], row["longest"]) for row in known}
    asked = cut(dealt(queries, upper).select("vec_id", "vector", "dim", "subtree"))
    parts = max(-(-asked.count() // query_rows), 1)
    keys = ["dim", "subtree", "block", "part"]
    draw = lambda seed, n: F.pmod(F.xxhash64("vec_id", "vector", F.lit(seed)), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    blocks = sizes.select("dim", "subtree", "blocks")
    left = rows.select("vec_id", "vector", "dim", "subtree").join(blocks, ["dim", "subtree"])
    left = left.withColumn("block", draw(1, F.col("blocks"))).withColumn("part", spread(F.lit(parts))).drop("blocks")

    def met(some: DataFrame) -> DataFrame:
        right = some.withColumn("part", draw(2, F.lit(parts))).join(blocks, ["dim", "subtree"])
        right = right.withColumn("block", spread(F.col("blocks"))).drop("blocks")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k), _SCHEMA)

    def best(hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    at_home = cut(best(met(asked.withColumn("floor", F.lit(None).cast("double")))))
    floors = at_home.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").cast("double").alias("floor"))
    onward = asked.join(floors, F.col("vec_id") == F.col("of"), "left").drop("of")
    ranked = best(at_home.drop("rank").unionByName(met(_routed(onward, upper, stats))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
