"""A stored inverted-file index of vectors: cells around centres, appended to, split when they grow, read by probed cell.

``<path>/centres`` holds one row for each cell and ``<path>/vectors`` the vectors, a folder for each cell, both versioned.
Vectors go to the cell of the nearest centre by unit length. An append writes the new rows only; a row whose id is
stored already is marked as gone in the versions before, so the last one wins. A cell that outgrows a bound is split in two around
two centres of its own; only its rows are written again. A search probes the nearest cells of each query and opens their
folders only, by dynamic partition pruning; within them it is exact.

Centres reach the driver and the tasks: their number is bounded by ``MOST_CELLS``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolens.operators import vectors as V
from echolens.operators.plan import materialised
from echolens.schemas import VECTORS
from echolens.sources.snapshots import read_snapshot, remove, write_snapshot

MOST_CELLS = 65_536
#: Rows of a cell beyond which it is split, and rounds of moving the two centres.
MOST_ROWS, ROUNDS = 200_000, 6
CENTRES = T.StructType().add("cell", T.IntegerType()).add("centre", T.ArrayType(T.DoubleType()))
INDEXED = T.StructType([*VECTORS.fields, T.StructField("cell", T.IntegerType())])


@dataclass(frozen=True)
class Centres:
    """Numbers of the cells, ascending, and their centres as rows."""

    cells: np.ndarray
    matrix: np.ndarray

    def nearest(self, unit: np.ndarray, most: int = 1) -> np.ndarray:
        """Numbers of the nearest cells of each row, the smaller first among equals."""
        gaps = (unit**2).sum(1)[:, None] - 2 * unit @ self.matrix.T + (self.matrix**2).sum(1)
        return self.cells[np.argsort(gaps, axis=1, kind="stable")[:, :most]]


def _paths(path: str) -> tuple[str, str]:
    return f"{path.rstrip('/')}/centres", f"{path.rstrip('/')}/vectors"


def read_centres(spark: SparkSession, path: str) -> Centres:
    rows = read_snapshot(spark, _paths(path)[0], CENTRES).orderBy("cell").collect()
    matrix = np.array([row["centre"] for row in rows], float)
    return Centres(np.array([row["cell"] for row in rows], np.int32), matrix.reshape(len(rows), -1))


def _write_centres(spark: SparkSession, path: str, centres: Centres) -> None:
    if len(centres.cells) > MOST_CELLS:
        raise ValueError(f"an index has at most {MOST_CELLS} cells")
    rows = [(int(cell), [float(x) for x in centre]) for cell, centre in zip(centres.cells, centres.matrix)]
    write_snapshot(spark.createDataFrame(rows, CENTRES).coalesce(1), _paths(path)[0])


def _celled(vectors: DataFrame, centres: Centres) -> DataFrame:
    """Vectors with the cell of the nearest centre; NULL vectors are left out."""

    @F.pandas_udf("int")
    def cell(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype="int32")
        return pd.Series(centres.nearest(V._normalised(np.stack(batch.to_numpy()).astype(float)))[:, 0])

    return vectors.where(F.col("vector").isNotNull()).withColumn("cell", cell(F.col("vector"))).select(*INDEXED.names)


def build(vectors: DataFrame, path: str, centres: np.ndarray | None = None, cells: int = 256) -> None:
    """A new index of ``vectors``, around given centres or such as k-means finds on all of them."""
    spark = vectors.sparkSession
    if centres is None:
        centres = V.assign_cells(vectors, cells)[1]
    made = Centres(np.arange(len(centres), dtype=np.int32), np.asarray(centres, float))
    write_snapshot(_celled(vectors, made), _paths(path)[1], partition_by="cell", sort_by="id")
    _write_centres(spark, path, made)


def append(vectors: DataFrame, path: str) -> None:
    """Add vectors to their cells; of an id that is stored the new vector counts, of equal ids the last by date.

    The ids are marked first, so a run lost in between is made up by repeating it.
    """
    spark = vectors.sparkSession
    batch = materialised(V.last_per_id(vectors))
    stored = read_snapshot(spark, _paths(path)[1], INDEXED).select("id")
    again = materialised(batch.select("id").join(stored, "id", "left_semi"))
    if not again.isEmpty():
        remove(again, _paths(path)[1])
    write_snapshot(_celled(batch, read_centres(spark, path)), _paths(path)[1], partition_by="cell", sort_by="id", added=True)


def search(
    spark: SparkSession, queries: DataFrame, path: str, k: int = 10, probes: int = 8, metric: str = V.COSINE,
    broadcast_bytes: int = V.BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` nearest stored vectors of each query among those of its ``probes`` nearest cells."""
    centres = read_centres(spark, path)

    def probed(batches):
        for batch in batches:
            if len(batch):
                unit = V._normalised(np.stack(batch["vector"].to_numpy()).astype(float))
                yield batch.assign(cell=list(centres.nearest(unit, probes))).explode("cell").astype({"cell": "int32"})

    rows = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    kind = rows.schema["query_id"].dataType.simpleString()
    asked = materialised(rows.mapInPandas(probed, f"query_id {kind}, vector array<float>, cell int"))
    # One row for each probed cell, at most MOST_CELLS; the comparison makes the scan wait for them and skip other folders.
    cells = F.broadcast(asked.select("cell").where(F.col("cell") >= 0).distinct())
    corpus = read_snapshot(spark, _paths(path)[1], INDEXED).select("id", "vector", "cell").join(cells, "cell", "left_semi")
    return V.best_in_cells(asked, corpus, k, metric, broadcast_bytes)


def cell_sizes(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshot(spark, _paths(path)[1], INDEXED).groupBy("cell").agg(F.count("*").alias("rows"))


def _unit_gap(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x)


def _children(rows: DataFrame, cells: list[int]) -> dict[int, np.ndarray]:
    """Two centres for each of the cells: first two members far from one another, then the means of those nearer to each.

    A cell that has no two different vectors has none. Two rows of each cell and its two means reach the driver.
    """
    units = materialised(rows.select("id", "cell", V._unit(F.col("vector")).alias("unit")))
    first = units.groupBy("cell").agg(F.min_by("unit", "id").alias("start"))
    for _ in range(2):  # the farthest from any, and the farthest from that
        away = units.join(F.broadcast(first), "cell").withColumn("gap", _unit_gap(F.col("unit"), F.col("start")))
        ends = away.groupBy("cell").agg(
            F.max_by("unit", F.struct("gap", "id")).alias("far"), F.max("gap").alias("gap"), F.first("start").alias("start")
        )
        first = materialised(ends.select("cell", F.col("far").alias("start"), F.col("start").alias("other"), "gap"))
        ends, first = first, first.select("cell", "start")
    pairs = {
        row["cell"]: np.array([row["other"], row["start"]]) for row in ends.collect() if row["gap"] and row["gap"] > 0
    }
    for _ in range(ROUNDS if pairs else 0):
        means = (
            units.where(F.col("cell").isin(list(pairs))).withColumn("child", _nearer(pairs)(F.col("cell"), F.col("unit")))
            .select("cell", "child", F.posexplode("unit").alias("i", "x"))
            .groupBy("cell", "child", "i").agg(F.avg("x").alias("mean")).orderBy("cell", "child", "i").collect()
        )
        moved = {cell: pair.copy() for cell, pair in pairs.items()}
        for row in means:
            moved[row["cell"]][row["child"], row["i"]] = row["mean"]
        pairs = moved
    return pairs


def _nearer(pairs: dict[int, np.ndarray]):
    @F.pandas_udf("int")
    def child(cell: pd.Series, unit: pd.Series) -> pd.Series:
        if not len(cell):
            return pd.Series([], dtype="int32")
        matrix = np.stack(unit.to_numpy())
        both = np.stack([pairs[c] for c in cell])
        gaps = ((matrix[:, None, :] - both) ** 2).sum(2)
        return pd.Series((gaps[:, 1] < gaps[:, 0]).astype("int32"))

    return child


def split(spark: SparkSession, path: str, most_rows: int = MOST_ROWS) -> list[int]:
    """Split every cell of more than ``most_rows`` vectors in two; returns the numbers of the new cells.

    The new cells are written first, then the centres that lead to them, then the old cells are marked as gone, so a search finds
    each vector once at any time. Cells of equal vectors stay as they are.
    """
    grown = [row["cell"] for row in cell_sizes(spark, path).where(F.col("rows") > most_rows).collect()]
    centres = read_centres(spark, path)
    if not grown or len(centres.cells) + len(grown) > MOST_CELLS:
        return []
    rows = read_snapshot(spark, _paths(path)[1], INDEXED).where(F.col("cell").isin(grown))
    pairs = _children(rows, grown)
    if not pairs:
        return []
    number = int(centres.cells.max()) + 1
    numbers = {cell: number + 2 * i for i, cell in enumerate(sorted(pairs))}
    first = F.create_map(*[F.lit(x) for cell, n in numbers.items() for x in (cell, n)])
    kept = rows.where(F.col("cell").isin(list(pairs)))
    child = _nearer(pairs)(F.col("cell"), V._unit(F.col("vector")))
    moved = kept.withColumn("cell", (F.element_at(first, F.col("cell")) + child).cast("int"))
    write_snapshot(moved, _paths(path)[1], partition_by="cell", sort_by="id", added=True)
    stay = ~np.isin(centres.cells, list(pairs))
    new = np.array([n + side for n in numbers.values() for side in (0, 1)], np.int32)
    matrix = np.vstack([centres.matrix[stay], *[pairs[cell] for cell in numbers]])
    _write_centres(spark, path, Centres(np.r_[centres.cells[stay], new], matrix))
    remove(spark.createDataFrame([(int(cell),) for cell in pairs], "cell int"), _paths(path)[1])
    return new.tolist()
