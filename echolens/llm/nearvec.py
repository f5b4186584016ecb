"""Near-duplicate vectors by sorted projection passes.

Every pass gives a vector one bit for each of its random directions, the side it lies on; the bits in a row order the
vectors by range over the tasks. Each is compared with its next neighbours in that order, and verified pairs are
united across the passes. Equal vectors are one class from the start. Links are then counted within each component,
in blocks of bounded size, so that groups of near copies larger than any window have all their links counted
without a pair being written.

Pairs are found if some pass brings them close. Unless given, the number of passes grows with that of the vectors, so
that an isolated pair just at the threshold is found with a chance of ``RECALL``. The first and last rows of every task
are compared once more across the tasks' bounds, so such pairs do not depend on where a pass is cut.

Dense groups crowd a window. So vectors whose keys agree in as many leading bits as pairs are met with form a run, and a run longer than
a window is gone through once more: what is one component of it already and larger than a window counts as a ball, a mean direction with
its radius; another vector of the run is compared with its members if the triangle inequality on the sphere lets it link
with one; and what is left of the run without the balls is compared in windows of its own. Runs are taken ``RUN`` vectors at a
time, so a border member of a still larger group meets, in each pass, the share of it that its part of the run holds.

Vectors that are null, empty or zero, or
hold null or non-finite components, link with nothing, nor do vectors of different lengths. Repeated rows are vectors of
their own. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import cut, stored
from echolens.llm.components import components

THRESHOLD = 0.9
#: Passes at least.
PASSES, BITS, WINDOW = 24, 40, 32
#: Chance that an isolated pair at the threshold is found.
RECALL = 0.999
#: Vectors of a block when links are counted, and of a run that are compared together.
BLOCK, RUN = 1024, 8192
#: Products nearer to the threshold than this are computed again, row by row, so that a pair has one cosine everywhere.
_ROUNDING = 1e-9


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))


def passes_for(count: int, threshold: float, window: int, bits: int = BITS, recall: float = RECALL) -> int:
    """Passes in which a pair at the threshold agrees once in as many leading bits as leave a window of vectors."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    met = agree ** min(max(math.log2(max(count, 1) / window), 0), bits)
    return PASSES if met >= 1 else max(math.ceil(math.log(1 - recall) / math.log(1 - met)), PASSES)


def sort_keys(vectors: np.ndarray, passes: int, bits: int, seed: int) -> np.ndarray:
    """For each vector and pass, the bits of its random hashes as one number."""
    dim = vectors.shape[1]
    directions = np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))
    sides = (vectors @ directions > 0).reshape(len(vectors), passes, bits)
    return sides @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))


class Forest:
    """Union-find over the rows of a window; tells links that join what was apart."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired unit rows."""
    return np.einsum("ij,ij->i", a, b)


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` link with which rows of ``b``, both of unit length."""
    products = a @ b.T
    x, y = np.nonzero(np.abs(products - threshold) < _ROUNDING)
    products[x, y] = _cosines(a[x], b[y])
    return products >= threshold


def leading_bits(count: int, window: int, bits: int = BITS) -> int:
    """Bits in which keys agree that leave a window of so many vectors, spread evenly."""
    return min(max(math.ceil(math.log2(max(count, 1) / window)), 0), bits) if count > window else 0


def slide(ids: np.ndarray, values: np.ndarray, window: int, threshold: float, forest: Forest, held: int = 0) -> list[tuple[int, int]]:
    """Links of rows with their next neighbours that join what was apart; the first ``held`` rows were compared already."""
    links = []
    for step in range(1, min(window, len(ids) - 1) + 1):
        first = max(held - step, 0)
        cosines = _cosines(values[first:len(ids) - step], values[first + step:])
        for i in np.flatnonzero(cosines >= threshold) + first:
            x, y = int(ids[i]), int(ids[i + step])
            if forest.join(x, y):
                links.append((x, y))
    return links


def crowded_links(ids: np.ndarray, values: np.ndarray, window: int, threshold: float, forest: Forest) -> list[tuple[int, int]]:
    """Links of a run beyond its windows: balls of what is one component against the rest, and windows of the rest."""
    links = []
    label = np.array([forest.find(int(x)) for x in ids])
    names, sizes = np.unique(label, return_counts=True)
    for name in names[sizes > window]:
        inside = np.flatnonzero(label == name)
        outside = np.flatnonzero(np.array([forest.find(int(x)) != forest.find(int(name)) for x in ids]))
        if not len(outside):
            break
        centre = values[inside].sum(axis=0)
        length = float(np.sqrt(centre @ centre))
        if length > _ROUNDING:
            centre = centre / length
            radius = math.acos(max(-1.0, min(1.0, float((values[inside] @ centre).min())))) + math.acos(threshold) + 1e-6
            outside = outside[values[outside] @ centre >= math.cos(min(radius, math.pi))]
        for start in range(0, len(outside), 512):
            part = outside[start:start + 512]
            row, column = np.nonzero(linked(values[part], values[inside], threshold))
            for i in np.flatnonzero(np.r_[True, np.diff(row) != 0]) if len(row) else ():  # one link joins a row with the ball
                x, y = int(ids[part[row[i]]]), int(ids[inside[column[i]]])
                if forest.join(x, y):
                    links.append((x, y))
    rest = np.isin(label, names[sizes <= window])
    return links + slide(ids[rest], values[rest], window, threshold, forest)


class Run:
    """The rows of a pass whose keys agree in their leading bits, as they come; a part of bounded size is gone through when it is full."""

    def __init__(self, window: int, threshold: float) -> None:
        self.window, self.threshold, self.key = window, threshold, None
        self.ids, self.values, self.size = [], [], 0

    def add(self, key: tuple, ids: np.ndarray, values: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
        """``forest`` is that of the pass before the rows are added."""
        links = self.end(forest) if key != self.key or self.size + len(ids) > RUN else []
        self.key = key
        self.ids.append(ids)
        self.values.append(values)
        self.size += len(ids)
        return links

    def end(self, forest: Forest) -> list[tuple[int, int]]:
        links = []
        if self.size > self.window:
            links = crowded_links(np.concatenate(self.ids), np.concatenate(self.values), self.window, self.threshold, forest)
        self.ids, self.values, self.size = [], [], 0
        return links


def _dealt(classes: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                for at in np.array_split(np.flatnonzero(dims == dim), -(-int((dims == dim).sum()) // 2000)):
                    values = np.array([vectors[i] for i in at], dtype=np.float64)
                    keys = sort_keys(_unit(values), passes, bits, seed)
                    raw = [v.tobytes() for v in values.astype(dtype)]
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(at), p, np.int32)), pa.array(np.full(len(at), dim, np.int32)),
                            pa.array(keys[:, p]), pa.array(ids[at]), pa.array(raw, pa.binary()),
                        ], ["pass", "dim", "key", "id", "vector"])

    dtype = "<f4" if classes.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"
    return classes.select("id", "vector").mapInArrow(dealt, "pass int, dim int, key long, id long, vector binary"), dtype


def window_links(classes: DataFrame, threshold: float, passes: int, bits: int, window: int, seed: int, agreed: int) -> DataFrame:
    """Verified links (``a``, ``b``) between neighbours of each pass; links that only repeat a connection are left out.

    Every task also gives its first and last rows, as many as a window, which are then compared across its bounds. ``agreed`` is the
    number of leading bits of a run.
    """
    rows, dtype = _dealt(classes, passes, bits, seed)
    ordered = ["pass", "dim", "key", "id"]
    rows = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, forest, last, run = None, Forest(), None, Run(window, threshold)
        task, seen, tail = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if seen < window:
                yield _ends(batch.slice(0, window - seen), task, seen)
            tail = pa.Table.from_batches([*(tail.to_batches() if tail else []), batch])
            tail, seen = tail.slice(max(len(tail) - window, 0)).combine_chunks(), seen + len(batch)
            passes_, dims, keys = (batch.column(i).to_numpy() for i in (0, 1, 2))
            prefix = keys >> (bits - agreed)
            starts = np.flatnonzero(np.r_[True, (np.diff(passes_) != 0) | (np.diff(dims) != 0)])
            links = []
            for a, b in zip(starts, np.r_[starts[1:], len(passes_)]):
                now = (int(passes_[a]), int(dims[a]))
                if now != last:
                    links += run.end(forest)
                    kept, last, forest = None, now, Forest()
                ids = batch.column(3)[a:b].to_numpy(zero_copy_only=False)
                raw = b"".join(batch.column(4)[a:b].to_pylist())
                values = _unit(np.frombuffer(raw, dtype).reshape(len(ids), -1).astype(np.float64))
                held = len(kept[0]) if kept else 0
                all_ids, all_values = (np.concatenate([x, y]) for x, y in zip(kept, (ids, values))) if held else (ids, values)
                links += slide(all_ids, all_values, window, threshold, forest, held)
                kept = (all_ids[-window:], all_values[-window:])
                parts = np.flatnonzero(np.r_[True, np.diff(prefix[a:b]) != 0])
                for c, d in zip(parts, np.r_[parts[1:], b - a]):
                    for e in range(c, d, RUN):
                        links += run.add((*now, int(prefix[a + c])), ids[e:min(e + RUN, d)], values[e:min(e + RUN, d)], forest)
            yield _found(links)
        yield _found(run.end(forest))
        rest = min(max(seen - window, 0), window)  # the first rows were given already
        for batch in tail.slice(len(tail) - rest).to_batches() if rest else ():
            yield _ends(batch, task, seen - rest)

    found = stored(rows.mapInArrow(met, "a long, b long, task int, pos long, pass int, dim int, id long, vector binary"), "met")
    links, ends = found.where("a is not null").select("a", "b"), found.where("task is not null").drop("a", "b")
    return links.union(bound_links(ends, threshold, window, dtype)).distinct()


def _found(links: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in list(zip(*links)) or [(), ()]]
    blank = [pa.nulls(len(links), kind) for kind in _END_TYPES]
    return pa.RecordBatch.from_arrays([*columns, *blank], ["a", "b", *_END_NAMES])


_END_NAMES = ("task", "pos", "pass", "dim", "id", "vector")
_END_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())


def _ends(batch: pa.RecordBatch, task: int, start: int) -> pa.RecordBatch:
    """Rows of a task with their places in it."""
    n = len(batch)
    columns = [pa.nulls(n, pa.int64())] * 2 + [pa.array(np.full(n, task, np.int32)), pa.array(np.arange(start, start + n))]
    columns += [batch.column(i) for i in (0, 1, 3, 4)]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, (pa.int64(),) * 2 + _END_TYPES)],
                                      ["a", "b", *_END_NAMES])


def bound_links(ends: DataFrame, threshold: float, window: int, dtype: str) -> DataFrame:
    """Verified links (``a``, ``b``) between the last rows before each bound of two tasks and the first ones behind it.

    Tasks of less than a window share a bound with those before or behind them. Only the tasks' sizes reach the driver.
    """
    sizes = sorted((r["task"], r["n"]) for r in ends.groupBy("task").agg((F.max("pos") + 1).alias("n")).collect())
    wanted = []
    for at in range(1, len(sizes)):
        for behind, tasks in ((False, sizes[at - 1::-1]), (True, sizes[at:])):
            need = window
            for task, n in tasks:
                taken = min(n, need)
                wanted.append((at, behind, task, *((0, taken) if behind else (n - taken, n))))
                need -= taken
                if not need:
                    break
    spark = ends.sparkSession
    wanted = spark.createDataFrame(wanted, "bound int, behind boolean, of int, low long, high long")
    rows = ends.join(F.broadcast(wanted), (F.col("task") == F.col("of")) & (F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("high")))

    def met(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["task", "pos"])
        group["place"] = np.arange(len(group))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for _, run in group.groupby(["pass", "dim"]):
            values = _unit(np.frombuffer(b"".join(run["vector"]), dtype).reshape(len(run), -1).astype(np.float64))
            place, behind, ids = (run[name].to_numpy() for name in ("place", "behind", "id"))
            apart = place[None, :] - place[:, None]
            a, b = np.nonzero(linked(values, values, threshold) & ~behind[:, None] & behind[None, :] & (apart <= window))
            out.append((ids[a], ids[b]))
        a, b = (np.concatenate(side) for side in zip(*out))
        return pd.DataFrame({"a": a, "b": b})

    columns = ("bound", "behind", "task", "pos", "pass", "dim", "id", "vector")
    return rows.select(*columns).groupBy("bound").applyInPandas(met, "a long, b long")


def _counted(group: pd.DataFrame, threshold: float, dtype: str) -> pd.DataFrame:
    """Links of the rows of some whole components, or of a pair of blocks of one."""
    out = []
    for _, rows in group.groupby(["root", "dim"], sort=False):
        values = _unit(np.frombuffer(b"".join(rows["vector"]), dtype).reshape(len(rows), -1).astype(np.float64))
        copies, block = rows["copies"].to_numpy(), rows["block"].to_numpy()
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        met = linked(values, values, threshold)
        np.fill_diagonal(met, False)
        if low != high:  # pairs within a block are counted where it meets itself
            met &= block[:, None] != block[None, :]
        out.append(pd.DataFrame({"id": rows["id"].to_numpy(), "links": met @ copies}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "links": []}, dtype="int64")


def count_links(members: DataFrame, threshold: float, block: int, dtype: str) -> DataFrame:
    """``id`` and ``links``, the vectors of its component that it links with; members: id, vector, copies, root."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    members = members.join(sizes, "root").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    # Small components share a group of bounded size; a large one is dealt into blocks, of which each pair is a group.
    groups = max(-(-members.where("blocks = 1").count() // block), 1)
    small = F.pmod(F.xxhash64("root"), F.lit(groups)).cast("long")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = members.withColumn("block", own).withColumn("other", other)
    rows = rows.withColumns({
        "unit": F.when(F.col("blocks") == 1, small).otherwise(F.col("root")),
        "alone": F.col("blocks") == 1,
        "low": F.least("block", "other"), "high": F.greatest("block", "other"),
    })
    rows = rows.select("alone", "unit", "low", "high", "root", "block", "id", "copies", "dim", "vector")
    counted = rows.groupBy("alone", "unit", "low", "high").applyInPandas(
        lambda group: _counted(group, threshold, dtype), "id long, links long"
    )
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, vector: str = "embedding", threshold: float = THRESHOLD, passes: int | None = None,
                    bits: int = BITS, window: int = WINDOW, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """vec_id, n_links (other vectors linked with), component_id (smallest vec_id of its component), kept. ``passes``: as many as the number of vectors needs."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col(vector).alias("vector"))
    good = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    classes = stored(good.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors")
    count = classes.count()
    passes = passes or passes_for(count, threshold, window, bits)
    links = window_links(classes, threshold, passes, bits, window, seed, leading_bits(count, window, bits))
    roots = cut(components(links))
    members = classes.join(roots, classes["id"] == roots["node"]).select("id", "vector", "copies", "root")
    dtype = "<f4" if classes.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"
    packed = members.select(
        "id", "copies", "root", F.size("vector").alias("dim"), _as_bytes(dtype)(F.col("vector")).alias("vector")
    )
    links = count_links(packed, threshold, block, dtype)
    found = classes.join(roots, classes["id"] == roots["node"], "left").join(links, "id", "left").select(
        F.col("vector").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "id").alias("component_id"),
    )
    joined = good.join(found, F.col("vector") == F.col("of")).select("vec_id", "n_links", "component_id")
    rest = rows.where(~(usable(F.col("vector")) & F.col("vec_id").isNotNull()))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _as_bytes(dtype: str):
    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, dtype).tobytes())

    return packed
