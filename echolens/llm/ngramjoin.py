"""Jaccard join of documents on word n-grams, over count vectors in R-trees.

A document is the set of its hashed n-grams. Hashing them once more into groups gives a point, the counts of the
groups; the overlap of two documents is at most the sum of the smaller counts, coordinate by coordinate, and that of a document
with any in a box at most the sum of the minima with the box's upper corner. Pairs that this bound lets pass are verified
on the sets.

The space of points is dealt to the tasks without losing a pair. Documents are dealt by size into classes; two that
link differ in few n-grams for the sizes of their class, so when the groups are cut into somewhat more runs than that, at
least one run has equal contents, down to the finest groups, in both. A cell is a class, a run and its contents.

First every document goes to one other, the most popular that it shares a cell with, which has most partners in its cells: the
original among its copies. If the counts allow a link, both are dealt to the popular one's group. A group's sets meet in one task
(blocks of bounded size in large groups, each with the popular set), which packs their points into an R-tree, compares
boxes and then points, verifies the pairs that pass on the sets, skips those that links connect already, and writes
links, fewer than it has members. So a set is shipped once and pairs are never rows. The links form components. Of cells that still
hold several, the members are packed into R-trees, and the few pairs of different components that pass are verified in the
same way. Large cells are cut into blocks that meet pairwise there. Nothing is capped, so no link between different
components is lost.

Words are runs of other characters than ASCII white space, A-Z lower-cased. A text of fewer words than n is one
n-gram; null texts and texts without words have none and link with nothing. Equal sets are one node from the start,
so copies cost nothing more. N-grams are compared by 64-bit hashes. Repeated rows are documents of their own; rows
without id take part, and a component whose ids are all null has a null id. Other columns take no part. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import CHUNK_CHARS, chunks, cut, give_back, stored
from echolens.llm.components import components

#: Groups of a small set's point, and n-grams that share a group on average at most before a larger set's are doubled: counts of
#: crowded groups resemble each other in any two sets, so their minima would bound nothing.
GROUPS, PER_GROUP = 256, 16
#: Groups that a pair is compared in first.
COARSE = 32
#: Sizes of a class: each ends this many times higher than the one before.
CLASS_RATIO = 1.5
#: Members of a group's block, and of an R-tree page.
BLOCK, PAGE = 512, 16
#: Times that a cell's block is larger: only points are held of its members, and each block is shipped to all others.
CELL_BLOCKS = 8
#: N-grams of the sets of a group, on average, beyond which it is cut into blocks as well.
BLOCK_HASHES = 1 << 20
#: Tables of ids up to this size are broadcast, larger ones are joined by shuffle: 50 MB or so.
BROADCAST_ROWS = 2_000_000
#: Cells of a member that its partners know, so that a pair is written in the first cell they share, not in each.
FIRST_CELLS = 8
#: Numbers of points that one step compares.
_POINT_CELLS = 1 << 22
_FILL = np.iinfo(np.int64).max
#: Pairs that one task stores.
ROWS_PER_TASK = 50_000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Rule:
    """Two sets link when 100 * overlap >= percent * union."""

    n: int = 4
    percent: int = 85

    def least_overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return -(-self.percent * (a + b) // (100 + self.percent))

    def most_different(self, larger: int) -> int:
        """N-grams in one set only, at most, where neither set has more than ``larger``."""
        return (100 - self.percent) * 2 * larger // (100 + self.percent)

    def reaches(self, size: np.ndarray, larger: np.ndarray) -> np.ndarray:
        """Whether a set of ``size`` can link with one of ``larger``."""
        return 100 * size >= self.percent * larger


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: np.ndarray = np.ones(1, np.uint64)
_inverse: np.ndarray = np.ones(1, np.uint64)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < size:
        steps = np.full(max(size, CHUNK_CHARS), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = pow(_BASE, -1, 1 << 64)
        _inverse = np.cumprod(steps)
    return _powers, _inverse


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of all texts, sorted within each, and how many each text has."""
    encoded = [text.encode("utf-8", "surrogatepass") for text in texts]
    raw = b" ".join(encoded).lower()  # of bytes: ASCII letters only
    ends = np.cumsum(np.array([len(text) + 1 for text in encoded], np.int64)) - 1
    data = np.frombuffer(raw, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)])])
    words = _mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    owner = np.searchsorted(ends, first, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    hashed = np.zeros(len(words), np.uint64)
    for k in range(n):
        part = words[k:] if k else words
        hashed[:len(part)] = (hashed[:len(part)] + part) * np.uint64((_BASE + 2 * k * 0x51ED27) & _MASK)
    starts, out, found = np.concatenate([[0], np.cumsum(counts)]), [], np.zeros(len(texts), np.int64)
    hashed = _mixed(hashed)
    for i, count in enumerate(counts):
        a = starts[i]
        if count >= n:
            out.append(np.unique(hashed[a:a + count - n + 1]))
        elif count:
            whole = np.uint64(count)
            for word in words[a:a + count]:
                whole = np.uint64((int(whole) + int(word)) * _BASE & _MASK)
            out.append(_mixed(np.array([whole])))
        else:
            continue
        found[i] = len(out[-1])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), found


def _class_ends(largest: int) -> np.ndarray:
    """Ends (exclusive) of the size classes that hold sets up to ``largest``, and one more."""
    ends = [2]
    while len(ends) < 2 or ends[-2] <= largest:
        ends.append(max(ends[-1] + 1, int(ends[-1] * CLASS_RATIO)))
    return np.array(ends, np.int64)


def runs_of_class(end: int, rule: Rule) -> tuple[int, int]:
    """Number of runs for a class of sets smaller than ``end``, and how many of them may be empty unnoticed.

    So many are spare that few sets have more empty runs, the smallest of a class too: cells of empty runs are the largest.
    """
    most = rule.most_different(end - 1)
    spare = 0 if most == 0 else 2 + end // 100 + (most + 1) // 10
    return most + 1 + spare, spare


def cell_keys(hashes: np.ndarray, sizes: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells of all sets, and how many each set has.

    A set is in its own class, and in the next ones if it can link with their members. With s spare runs, two sets
    that link agree in more than s runs. If all of these are empty, the first of them has s empty ones behind it in both sets. So a
    set has keys for its empty runs but the last s.
    """
    ends = _class_ends(int(sizes.max(initial=1)))
    own = np.searchsorted(ends, sizes, side="right")
    keys, owners, step = [], [], 0
    while True:
        classes = own + step
        lowest = np.where(step == 0, sizes, ends[np.minimum(classes, len(ends) - 1) - 1])
        takes = (sizes > 0) & (classes < len(ends)) & rule.reaches(sizes, lowest)
        if not takes.any():
            break
        layout = {c: runs_of_class(int(ends[c]), rule) for c in np.unique(classes[takes])}
        runs = np.array([layout[c][0] if t else 0 for c, t in zip(classes, takes)], np.int64)
        spare = np.array([layout[c][1] if t else 0 for c, t in zip(classes, takes)], np.int64)
        places = np.concatenate([[0], np.cumsum(runs)])
        of = np.repeat(np.arange(len(sizes)), np.where(takes, sizes, 0))
        mine = hashes if takes.all() else hashes[np.repeat(takes, sizes)]
        run = ((mine >> np.uint64(32)) * runs[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        at = places[of] + run  # ascending, as the hashes of a set are
        begin = np.flatnonzero(np.r_[True, np.diff(at) != 0])
        sums, filled = np.zeros(places[-1], np.uint64), np.zeros(places[-1], np.int64)
        if len(mine):
            sums[at[begin]] = np.add.reduceat(_mixed(mine), begin)
            filled[at[begin]] = np.diff(np.r_[begin, len(at)])
        owner = np.repeat(np.arange(len(sizes)), runs)
        number = np.arange(places[-1]) - places[owner]
        empty = filled == 0
        behind = np.cumsum(empty)
        behind = behind[places[1:] - 1][owner] - behind  # empty runs of the set after each run
        kept = ~empty | (behind >= spare[owner])
        key = (classes[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)
        key = _mixed(_mixed(key) + sums * np.uint64(_BASE) + filled.astype(np.uint64))
        keys.append(key[kept])
        owners.append(owner[kept])
        step += 1
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(keys)[order], np.bincount(owner, minlength=len(sizes))


def groups_for(sizes: np.ndarray) -> np.ndarray:
    """Groups of the points of sets of these sizes."""
    crowded = np.log2(np.maximum(sizes, 1) / (GROUPS * PER_GROUP))
    return GROUPS << np.maximum(np.ceil(crowded), 0).astype(np.int64)


def group_counts(hashes: np.ndarray, sizes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Points: how many n-grams of each set fall into each group."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    group = (hashes & np.uint64(groups - 1)).astype(np.int64)
    flat = np.bincount(owner * groups + group, minlength=len(sizes) * groups)
    return flat.reshape(len(sizes), groups)


def packed_points(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Each set's point in as many groups as its size asks for, in the least bytes that hold its counts."""
    groups, ends, out = groups_for(sizes), np.cumsum(sizes), []
    for i in range(len(sizes)):
        point = np.bincount((hashes[ends[i] - sizes[i]:ends[i]] & np.uint64(groups[i] - 1)).astype(np.int64), minlength=groups[i])
        out.append(point.astype("<u1" if not len(point) or point.max() < 256 else "<u4").tobytes())
    return out


def unpacked_points(packed: list[bytes], sizes: np.ndarray, groups: int) -> np.ndarray:
    """Points as rows, folded to so many groups: the group of a hash is given by its last bits."""
    own = groups_for(sizes)
    if (own == groups).all() and all(len(x) == groups for x in packed):
        return np.frombuffer(b"".join(packed), "<u1").reshape(len(packed), groups).astype(np.int32)
    out = np.zeros((len(packed), groups), np.int32)
    for i, raw in enumerate(packed):
        point = np.frombuffer(raw, "<u1" if len(raw) == own[i] else "<u4")
        out[i] = point.reshape(-1, groups).sum(axis=0)
    return out


def _digests(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each set, equal for equal sets."""
    sums, some = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(some):
        sums[some] = np.add.reduceat(_mixed(hashes + np.uint64(_BASE)), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
    return _mixed(sums + sizes.astype(np.uint64)).view(np.int64)


_FEATURES = "doc_id long, n long, node long, counts binary, cells array<long>"


def features(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per document: set size, node (its set's digest, null for an empty set), point, and keys of its cells."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                hashes, sizes = shingle_sets(texts[a:b], rule.n)
                keys, many = cell_keys(hashes, sizes, rule)
                offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(sizes),
                    pa.array(_digests(hashes, sizes), mask=sizes == 0),
                    pa.array(packed_points(hashes, sizes), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64))),
                ], ["doc_id", "n", "node", "counts", "cells"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, _FEATURES)


def shared_cells(rows: DataFrame) -> DataFrame:
    """``cell`` and ``node`` of the cells that more than one node may be in.

    Ranges over cell and node deal the rows to the tasks, so that a cell of any size is spread over tasks and read as a
    stream. The cells that a task begins and ends with are kept even if it sees one node of them.
    """
    ordered = rows.repartitionByRange("cell", "node").sortWithinPartitions("cell", "node")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_cell = last_cell = last_node = None
        alone = False  # the last row is the first of its cell, and unwritten
        for batch in batches:
            cells, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(cells):
                continue
            first_cell = cells[0] if first_cell is None else first_cell
            new = np.r_[last_cell is None or cells[0] != last_cell, cells[1:] != cells[:-1]]
            other = new | np.r_[last_node is None or nodes[0] != last_node, nodes[1:] != nodes[:-1]]
            cells, nodes, new = cells[other], nodes[other], new[other]  # copies fall out
            if not len(cells):
                continue
            write = ~new | np.r_[~new[1:], False] | (cells == first_cell)
            out = [cells[write], nodes[write]]
            if alone and not new[0]:
                out = [np.r_[last_cell, out[0]], np.r_[last_node, out[1]]]
            yield _batch(*out)
            alone, last_cell, last_node = not write[-1], cells[-1], nodes[-1]
        if alone:
            yield _batch([last_cell], [last_node])

    return ordered.mapInArrow(streamed, "cell long, node long")


def _batch(cells: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (cells, nodes)], ["cell", "node"])


def different_cells(rows: DataFrame) -> DataFrame:
    """``cell``, ``node`` and the cell's ``size``, of cells with several nodes; of cells with the same nodes, one."""
    rows = rows.distinct()
    marks = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"mark{seed}") for seed in (0, 1)]
    cells = rows.groupBy("cell").agg(F.count("*").alias("size"), *marks).where("size > 1")
    cells = cells.groupBy("size", "mark0", "mark1").agg(F.min("cell").alias("cell")).select("cell", "size")
    return rows.join(cells, "cell")


def _popularity() -> Column:
    """An order of nodes by the sizes of their cells; ties by a hash of the node."""
    return F.struct("weight", F.xxhash64("node").alias("hash"), "node")


def most_popular(cells: DataFrame) -> DataFrame:
    """``hub`` and ``node``: for each node the most popular other one that leads one of its cells."""
    best = cells.groupBy("cell").agg(F.max(_popularity()).alias("best"))
    led = cells.join(best, "cell").where("node <> best.node").groupBy("node").agg(F.max("best").alias("best"))
    return led.select(F.col("best.node").alias("hub"), "node")


def _hubs(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as (``hub``, ``node``), the hub the end of more pairs, so that few sets are shipped more than once."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    degrees = cut(ends.groupBy("node").agg(F.count("*").alias("degree")))
    for end in ("a", "b"):
        pairs = pairs.join(degrees.select(F.col("node").alias(end), F.struct("degree", "node").alias(f"{end}_rank")), end)
    more = F.col("a_rank") > F.col("b_rank")
    return pairs.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("node"))


class Join:
    """State of one join: stored features, points of the nodes, and the links found."""

    def __init__(self, docs: DataFrame, rule: Rule) -> None:
        self.docs, self.rule = docs.select(F.col("doc_id").cast("long"), "text"), rule
        self.features = stored(features(self.docs, rule), "ngram-features")
        known = self.features.where(F.col("node").isNotNull())
        nodes = known.groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.count("*").alias("copies"))
        self.nodes = cut(nodes)
        self.tried: DataFrame | None = None
        self.links: DataFrame | None = None

    def _of_nodes(self, nodes: DataFrame) -> DataFrame:
        """Bounded ids are broadcast so that the wide side need not move."""
        return F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes

    def _gathered(self, rows: DataFrame) -> DataFrame:
        """Rows computed once, in as few partitions as hold them."""
        rows = cut(rows)
        return rows.coalesce(max(-(-rows.count() // ROWS_PER_TASK), 1))

    def cells(self) -> DataFrame:
        """Rows (cell, node) of one document for each node."""
        copied = cut(self.nodes.where("copies > 1").select(F.col("node").alias("of"), "doc"))
        rows = self.features.where(F.col("node").isNotNull()).select("node", "doc_id", "cells")
        rows = rows.join(self._of_nodes(copied), F.col("node") == F.col("of"), "left")
        rows = rows.where(F.col("of").isNull() | F.col("doc_id").eqNullSafe(F.col("doc")))
        return rows.select(F.explode("cells").alias("cell"), "node")

    def _points(self, wanted: DataFrame) -> DataFrame:
        rows = self.features.select("node", "n", "counts").join(self._of_nodes(wanted), "node", "left_semi")
        return rows.groupBy("node").agg(F.first("n").alias("n"), F.first("counts").alias("counts"))

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """``node`` and the bytes of its sorted hashes, from the text of one of its documents."""
        docs = cut(self.nodes.join(wanted, "node", "left_semi").select("doc").distinct())
        texts = self.docs.join(self._of_nodes(docs), F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi").select("text")
        n = self.rule.n

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [text or "" for text in batch.column(0).to_pylist()]
                for a, b in chunks(texts):
                    hashes, sizes = shingle_sets(texts[a:b], n)
                    cuts = np.split(hashes, np.cumsum(sizes)[:-1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(_digests(hashes, sizes)), pa.array([x.tobytes() for x in cuts], pa.binary()),
                    ], ["node", "hashes"])
            give_back()

        rows = texts.mapInArrow(made, "node long, hashes binary")
        return rows.groupBy("node").agg(F.first("hashes").alias("hashes"))

    def verify(self, pairs: DataFrame, among_members: bool = False) -> None:
        """Adds the links among pairs (``hub``, ``node``) that were not tried before: by the bound first, by the sets then.

        The pairs of a hub meet in groups that get each set once. With ``among_members`` a group's other pairs are tried
        as well, through its R-tree.
        """
        if self.tried is not None:
            tried = self.tried.union(self.tried.select("node", "hub"))
            pairs = pairs.join(tried, ["hub", "node"], "left_anti")
        pairs = self._gathered(pairs)
        ends = lambda rows: rows.select(F.col("hub").alias("node")).union(rows.select("node")).distinct()
        near = _both_ends(pairs, cut(self._points(cut(ends(pairs)))))
        near = self._gathered(near.where(_bound(self.rule)("hub_n", "hub_counts", "node_n", "node_counts")).select("hub", "node", "node_n"))
        fill = F.greatest(F.count("*") / (BLOCK - 1), F.sum("node_n") / BLOCK_HASHES)
        sizes = near.groupBy("hub").agg(F.ceil(fill).cast("int").alias("blocks"))
        members = near.join(sizes, "hub").select(
            "hub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", F.lit(False).alias("is_hub")
        )
        hubs = sizes.select(
            "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("node"),
            F.lit(True).alias("is_hub"),
        )
        sets = stored(self._sets(cut(ends(near))), "ngram-sets")
        rows = members.union(hubs).join(sets, "node").select("hub", "block", "is_hub", "node", "hashes")
        rows = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", F.desc("is_hub"))
        linked = cut(rows.mapInArrow(_grouped(self.rule, among_members), "a long, b long"))
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        self.links = linked if self.links is None else cut(self.links.union(linked))

    def roots(self) -> DataFrame:
        return cut(components(self.links))

    def open_cells(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Members, with their roots, of cells that hold more than one component."""
        rows = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rows.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        return cut(rows.join(mixed.select("cell"), "cell"))

    def tree_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of different components of a cell that pass the bound, by R-trees over blocks of bounded size."""
        points = self._points(cut(rows.select("node").distinct()))
        lists = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("cell")), 1, FIRST_CELLS).alias("first"))
        rows = rows.join(points, "node").join(lists, "node")
        rows = rows.withColumn("blocks", F.ceil(F.col("size") / (CELL_BLOCKS * BLOCK)).cast("int"))
        groups = max(-(-rows.where("blocks = 1").count() // BLOCK), 1)
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", other)
        small = F.pmod(F.xxhash64("cell"), F.lit(groups)).cast("long")
        rows = rows.withColumns({
            "alone": F.col("blocks") == 1, "unit": F.when(F.col("blocks") == 1, small).otherwise(F.col("cell")),
            "low": F.least("block", "other"), "high": F.greatest("block", "other"),
        })
        rows = rows.select("alone", "unit", "low", "high", "cell", "block", "node", "root", "n", "counts", "first")
        rule = self.rule
        found = rows.groupBy("alone", "unit", "low", "high").applyInPandas(
            lambda group: _tree_join(group, rule), "a long, b long"
        )
        return cut(found.distinct())


def _both_ends(pairs: DataFrame, points: DataFrame) -> DataFrame:
    for end in ("hub", "node"):
        pairs = pairs.join(points.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("n", "counts")]), end)
    return pairs


def _bound(rule: Rule):
    @F.pandas_udf("boolean")
    def passes(a_n: pd.Series, a: pd.Series, b_n: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a_n.to_numpy(), b_n.to_numpy()
        least, groups, out = rule.least_overlap(x, y), np.minimum(groups_for(x), groups_for(y)), np.zeros(len(a), bool)
        for width in np.unique(groups):
            at = np.flatnonzero(groups == width)
            for at in np.array_split(at, -(-len(at) * int(width) // _POINT_CELLS)):
                low, high = (unpacked_points(z.iloc[at].tolist(), n[at], int(width)) for z, n in ((a, x), (b, y)))
                out[at] = np.minimum(low, high).sum(axis=1) >= least[at]
        return pd.Series(out)

    return passes


def _linked(rule: Rule, x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    overlap = int((both[1:] == both[:-1]).sum())
    return 100 * overlap >= rule.percent * (len(both) - overlap)


def group_links(sets: list[np.ndarray], rule: Rule, among_members: bool) -> list[tuple[int, int]]:
    """Links that connect what the group's links connect, by place; the hub is the first. Candidates come from the R-tree."""
    sizes = np.array([len(x) for x in sets], np.int64)
    groups = int(groups_for(sizes).min())
    found = list(tree_matches(group_counts(np.concatenate(sets), sizes, groups), sizes, rule))
    if not found:
        return []
    a, b = (np.concatenate(part) for part in zip(*found))
    a, b = np.minimum(a, b), np.maximum(a, b)
    label, links = np.arange(len(sets)), []

    def go_through(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            if label[x] != label[y] and _linked(rule, sets[x], sets[y]):
                links.append((x, y))
                label[label == label[y]] = label[x]

    go_through(a[a == 0], b[a == 0])
    if among_members:
        apart = label[a] != label[b]
        go_through(a[apart], b[apart])
    return links


def _grouped(rule: Rule, among_members: bool):
    """Over rows sorted by (hub, block), the hub first: links of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                found = [(nodes[i], nodes[j]) for i, j in group_links(sets, rule, among_members)]
                if found:
                    low, high = ([f(pair) for pair in found] for f in (min, max))
                    yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

        for batch in batches:
            for hub, block, node, hashes in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)], batch.column(4)):
                if (hub, block) != group:
                    yield from links()
                    group, nodes, sets = (hub, block), [], []
                nodes.append(node)
                sets.append(np.frombuffer(hashes.as_buffer(), np.uint64))
        yield from links()
        give_back()

    return run


@dataclass
class Tree:
    """An R-tree of two levels, packed along the sizes: pages of points with the upper corners of their boxes."""

    pages: list[np.ndarray]
    corners: np.ndarray
    smallest: np.ndarray
    largest: np.ndarray


def pack(points: np.ndarray, sizes: np.ndarray) -> Tree:
    """Pages of neighbours: slices by size, within a slice by the fullest coordinate and its count."""
    order = np.argsort(sizes, kind="stable")
    slices = [part[np.lexsort((points[part].max(axis=1), points[part].argmax(axis=1)))]
              for part in np.array_split(order, max(1, -(-len(order) // (PAGE * 8))))]
    order = np.concatenate(slices)
    pages = [order[a:a + PAGE] for a in range(0, len(order), PAGE)]
    return Tree(
        pages, np.stack([points[p].max(axis=0) for p in pages]), np.array([sizes[p].min() for p in pages]),
        np.array([sizes[p].max() for p in pages]),
    )


def _near(points: np.ndarray, coarse: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, rule: Rule) -> np.ndarray:
    """Which pairs the bound lets pass: by a few groups first, by all of them then."""
    out = np.zeros(len(a), bool)
    step = max(_POINT_CELLS // max(points.shape[1], 1), 1)
    for start in range(0, len(a), step):
        x, y = a[start:start + step], b[start:start + step]
        least = rule.least_overlap(sizes[x], sizes[y])
        at = np.flatnonzero(np.minimum(coarse[x], coarse[y]).sum(axis=1, dtype=np.int64) >= least)
        fine = np.minimum(points[x[at]], points[y[at]]).sum(axis=1, dtype=np.int64) >= least[at]
        out[start + at[fine]] = True
    return out


def _compact(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points in one byte a count where that holds them, and their counts in ``COARSE`` groups."""
    coarse = points.reshape(len(points), -1, COARSE).sum(axis=1, dtype=np.int32) if len(points) else points
    return (points.astype(np.uint8) if points.max(initial=0) < 256 else points), coarse


def tree_matches(points: np.ndarray, sizes: np.ndarray, rule: Rule, worth=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points whose summed minima reach the least overlap, page against page; of those ``worth`` a look, if given."""
    tree = pack(points, sizes)
    points, coarse = _compact(points)
    for i, page in enumerate(tree.pages):
        corner = np.minimum(tree.corners[i], tree.corners[i:]).sum(axis=1)
        # No pair of the two pages needs less than its smallest members do.
        need = rule.least_overlap(tree.smallest[i], tree.smallest[i:])
        apart = ~(rule.reaches(tree.largest[i], tree.smallest[i:]) & rule.reaches(tree.largest[i:], tree.smallest[i]))
        met = np.flatnonzero((corner >= need) & ~apart) + i
        if not len(met):
            continue
        others = np.concatenate([tree.pages[j] for j in met])
        own = np.repeat(met == i, [len(tree.pages[j]) for j in met])
        a, b = np.repeat(page, len(others)), np.tile(others, len(page))
        kept = ~np.tile(own, len(page)) | (a < b)
        kept &= rule.reaches(np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b]))
        a, b = a[kept], b[kept]
        if worth is not None:
            kept = worth(a, b)
            a, b = a[kept], b[kept]
        near = _near(points, coarse, sizes, a, b, rule)
        yield a[near], b[near]


def _elsewhere(cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that meet in an earlier cell also; a, b: the first cells of each, in order, filled up with the largest number."""
    same = (a[:, :, None] == b[:, None, :]).any(axis=2) & (a != _FILL)
    return np.where(same, a, _FILL).min(axis=1, initial=_FILL) < cell


def _pages(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within each run of rows."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes):
        x, y = np.triu_indices(size, 1)
        base = starts[sizes == size][:, None]
        a.append((base + x).ravel())
        b.append((base + y).ravel())
    return np.concatenate(a), np.concatenate(b)


def _unit_pairs(packed: list[bytes], sizes: np.ndarray, cells: np.ndarray, worth, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within cells that pass the bound, of those that are ``worth`` a look; rows are sorted by cell.

    A cell of one page is a tree of one page: its points are compared at once, together with those of all such cells.
    """
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    numbers = np.diff(np.r_[starts, len(cells)])
    groups = np.minimum.reduceat(groups_for(sizes), starts)
    for width in np.unique(groups):
        mine = groups == width
        page = mine & (numbers <= PAGE)
        a, b = _pages(starts[page], numbers[page])
        kept = rule.reaches(np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b]))
        a, b = a[kept], b[kept]
        kept = worth(a, b)
        a, b = a[kept], b[kept]
        rows = np.unique(np.r_[a, b])
        if len(rows):
            points, coarse = _compact(unpacked_points([packed[i] for i in rows], sizes[rows], int(width)))
            near = _near(points, coarse, sizes[rows], np.searchsorted(rows, a), np.searchsorted(rows, b), rule)
            yield a[near], b[near]
        for start, number in zip(starts[mine & (numbers > PAGE)], numbers[mine & (numbers > PAGE)]):
            inside = slice(start, start + number)
            points = unpacked_points(packed[inside], sizes[inside], int(width))
            for a, b in tree_matches(points, sizes[inside], rule, lambda a, b: worth(a + start, b + start)):
                yield a + start, b + start


def _tree_join(group: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    group = group.sort_values("cell", kind="stable")
    sizes, nodes, roots, blocks, cells = (group[name].to_numpy() for name in ("n", "node", "root", "block", "cell"))
    across = group["low"].iloc[0] != group["high"].iloc[0]
    known = np.full((len(group), FIRST_CELLS), _FILL)
    lengths = group["first"].map(len).to_numpy()
    known[np.arange(FIRST_CELLS) < lengths[:, None]] = np.concatenate(group["first"].tolist())

    def worth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of different components (and blocks, if two meet) that do not meet in an earlier cell."""
        out = roots[a] != roots[b]
        if across:
            out &= blocks[a] != blocks[b]
        at = np.flatnonzero(out)
        for part in np.array_split(at, -(-len(at) // 100_000)) if len(at) else ():
            out[part] = ~_elsewhere(cells[a[part]], known[a[part]], known[b[part]])
        return out

    found = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
    for a, b in _unit_pairs(group["counts"].tolist(), sizes, cells, worth, rule):
        if len(a):
            found.append(pd.DataFrame({"a": np.minimum(nodes[a], nodes[b]), "b": np.maximum(nodes[a], nodes[b])}))
    return pd.concat(found).drop_duplicates()


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to, its own included."""
    state = Join(docs, rule)
    cells = different_cells(stored(shared_cells(state.cells()), "ngram-cells"))
    weights = cells.groupBy("node").agg(F.sum("size").alias("weight"))
    cells = cut(cells.join(weights, "node"))
    state.verify(most_popular(cells), among_members=True)
    roots = state.roots()
    open_ = state.open_cells(cells, roots)
    if not open_.isEmpty():
        state.verify(_hubs(state.tree_pairs(open_)))
        roots = state.roots()
    named = state.nodes.join(roots, "node").groupBy("root").agg(F.min("doc").alias("component"))
    of_node = roots.join(named, "root").select(F.col("node").alias("of"), "component")
    of_node = state.nodes.join(of_node, F.col("node") == F.col("of"), "left")
    of_node = of_node.select(F.col("node").alias("of"), F.coalesce("component", "doc").alias("component"))
    rows = state.features.select("doc_id", F.col("n").alias("n_shingles"), "node")
    joined = rows.join(of_node, F.col("node") == F.col("of"), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
