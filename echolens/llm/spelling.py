"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

*Words* are counted with DataFrame functions. A run of letters loses one character where a hash of its document and itself
says so (``damaged``), which plants variants; counts are pre-aggregated before they are shuffled.

*Cells.* Two words one edit apart agree outside any part of the word that holds the edit. Let m be the length of the shorter.
A word enters, for m its own length and one less, the cell of its first half (words that agree on the rest) and that of its second
half. A cell with more than ``most`` words is cut: its part is halved and its words enter the cells of both halves, until the
cells are small or the part is one character, which bounds a cell by the alphabet. So no cell grows with a common prefix, no
pair is lost, and no cell is capped. A pair belongs to the one cell whose part holds its leftmost possible edit.

*Scan.* Within a cell the words are sorted (spelled backwards if they agree more at the end), with the length of the common
prefix (LCP) of neighbours. Words whose LCP is d or more share the first d rows of the edit matrix, so a row is computed once
for each query and distinct prefix, in a band of three cells, since more than one step off the diagonal costs two edits. A
range of the list whose shared prefix has only band cells above one is skipped whole. All queries of a batch of cells go down one
character at a time, in numpy.

*Forms.* A word's form is its near word of largest count, the first in code point order among equals, if that count is at least
twice the word's. Counts at least double along a chain of forms, so a chain has no cycle and its end is found by pointer
doubling in a few joins.

Defined cases: a null text has no words; a null id hashes as an empty one; texts and words of any length are used whole; equal rows
are counted as often as they stand. Without words the result has no rows. Only the columns ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import cut, stored

RUN = r"[A-Za-zÀ-ÿ]"
#: Words of a cell beyond which it is cut.
MOST_WORDS = 512
#: Words of cells that one batch takes together.
BATCH_WORDS = 20_000
#: Query and range pairs that one step works on at a time.
STEP_ITEMS = 200_000
#: Cells to cut beyond which their keys are joined by shuffle instead of broadcast.
BROADCAST_CELLS = 200_000
_CELL = ("m", "s", "e", "head", "tail")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(doc_id: Column, run: Column, modulus: int) -> Column:
    """``run`` without its code point h % length if ``modulus`` divides h, the crc32 of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def words(docs: DataFrame, shortest: int = 5, least: int = 3, modulus: int = 97) -> DataFrame:
    """``word`` and ``n``: words of at least ``shortest`` code points that occur ``least`` times or more."""
    text = F.translate("text", _UPPER, _LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))  # shorter runs make no word
    rows = docs.select("doc_id", F.explode(runs).alias("run"))
    rows = rows.select(damaged(F.col("doc_id"), F.col("run"), modulus).alias("word")).where(F.length("word") >= shortest)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with ``m``, ``s``, ``e`` and what a word of the cell has before s and from e on (as seen in a word of length m)."""
    tail = (F.col("m") - F.col("e")).cast("int")
    return rows.select(
        "word", "n", "m", "s", "e", F.substr("word", F.lit(1), F.col("s")).alias("head"),
        F.when(tail > 0, F.right(F.col("word"), tail)).otherwise(F.lit("")).alias("tail"),
    )


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("s") + F.col("e") + 1) / 2).cast("int")
    halves = F.array(F.struct(F.col("s").alias("s"), middle.alias("e")), F.struct(middle.alias("s"), F.col("e").alias("e")))
    return _keyed(rows.select("word", "n", "m", F.inline(halves)))


def cells(vocabulary: DataFrame, shortest: int = 5, most: int = MOST_WORDS) -> DataFrame:
    """Words with the cells they are compared in."""
    lengths = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda m: m >= shortest)
    rows = vocabulary.select("word", "n", F.explode(lengths).alias("m"))
    rows = _halved(rows.select("word", "n", "m", F.lit(0).alias("s"), F.col("m").alias("e")))
    ready = []
    while True:
        rows = stored(rows, "spelling-cells")
        large = rows.where("e - s > 1").groupBy(*_CELL).count().where(F.col("count") > most).drop("count")
        large = cut(large.withColumnsRenamed({name: f"large_{name}" for name in _CELL}))
        number = large.count()
        if not number:
            ready.append(rows)
            return reduce(DataFrame.union, ready)
        large = F.broadcast(large) if number <= BROADCAST_CELLS else large
        same = reduce(Column.__and__, [F.col(name) == F.col(f"large_{name}") for name in _CELL])
        ready.append(rows.join(large, same, "left_anti"))
        rows = _halved(rows.join(large, same, "left_semi"))


class _Lists:
    """The words of a batch of cells as code points in one array, each cell sorted."""

    def __init__(self, texts: list[str], cell: np.ndarray):
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        bounds = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        ends = np.r_[bounds[1:], len(texts)]
        index = np.repeat(np.arange(len(bounds)), ends - bounds)
        self.begin, self.end = bounds[index], ends[index]
        self.lcp = np.full(len(texts), -1)  # with the word before, within the cell
        inner = np.setdiff1d(np.arange(len(texts)), bounds, assume_unique=True)
        self.lcp[inner] = self.shared(inner - 1, inner)

    def at(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Code points, -1 outside the word."""
        inside = (place >= 0) & (place < self.length[word])
        found = self.codes[np.where(inside, self.first[word] + place, 0)]
        return np.where(inside, found, -1)

    def shared(self, a: np.ndarray, b: np.ndarray, backwards: bool = False) -> np.ndarray:
        """How many code points the words have in common at their beginnings, or their ends."""
        out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
        most = np.minimum(self.length[a], self.length[b])
        while len(alive):
            alive = alive[out[alive] < most[alive]]
            x, y, d = a[alive], b[alive], out[alive]
            i, j = (self.length[x] - 1 - d, self.length[y] - 1 - d) if backwards else (d, d)
            alive = alive[self.codes[self.first[x] + i] == self.codes[self.first[y] + j]]
            out[alive] += 1
        return out


def _step(lists: _Lists, depth: int, starts: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray, band: np.ndarray):
    """One character further: ranges by their next character, the next row of the band; pairs one edit apart."""
    left = np.searchsorted(starts, low)
    number = np.searchsorted(starts, high) - left
    item = np.repeat(np.arange(len(query)), number)
    child = left[item] + np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number)
    bounds = np.r_[starts, len(lists.length)]
    low, high = bounds[child], np.minimum(bounds[child + 1], high[item])
    query, band = query[item], band[:, item]
    ends = lists.length[low] == depth  # the word that is the whole prefix
    place = lists.length[query] - depth + 1
    hit = ends & (place >= 0) & (place <= 2)
    hit[hit] = band[place[hit], np.flatnonzero(hit)] == 1
    pairs = query[hit], low[hit]
    on = ~ends
    query, low, high, band = query[on], low[on], high[on], band[:, on]
    c = lists.at(low, np.full(len(low), depth))
    size = lists.length[query]
    cost = [lists.at(query, np.full(len(query), depth - 1 + i)) != c for i in range(3)]
    new = np.empty_like(band)
    new[0] = np.minimum(band[0] + cost[0], band[1] + 1)
    new[1] = np.minimum(np.minimum(band[1] + cost[1], band[2] + 1), new[0] + 1)
    new[2] = np.minimum(band[2] + cost[2], new[1] + 1)
    for i in range(3):
        new[i][depth + i > size] = 2
    np.minimum(new, 2, out=new)
    near = new.min(axis=0) <= 1
    near &= (high - low > 1) | (low != query)  # a word meets itself alone
    return pairs, (query[near], low[near], high[near], new[:, near])


def near_pairs(texts: list[str], cell: np.ndarray, m: np.ndarray, agreed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words one edit apart in the same cell, the first of length m; the cells' words are sorted and share their
    first ``agreed`` code points."""
    lists = _Lists(texts, cell)
    queries = np.flatnonzero(lists.length == m)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # rows of the matrix below the shared beginning: the diagonal is 0, the cells beside it 1
    band = np.ones((3, len(queries)), np.int8)
    band[1] = 0
    if not agreed:
        band[0] = 2
    stack = [(agreed, queries, lists.begin[queries], lists.end[queries], band)]
    starts: dict[int, np.ndarray] = {}
    while stack:
        depth, query, low, high, band = stack.pop()
        if depth not in starts:
            starts[depth] = np.flatnonzero(lists.lcp <= depth)
        pairs, following = _step(lists, depth, starts[depth], query, low, high, band)
        found.append(pairs)
        parts = max(-(-len(following[0]) // STEP_ITEMS), 1)
        for part in range(parts):
            chosen = slice(part, None, parts)
            items = (*(x[chosen] for x in following[:3]), following[3][:, chosen])
            if len(items[0]):
                stack.append((depth + 1, *items))
    a = np.concatenate([x for x, _ in found])
    b = np.concatenate([y for _, y in found])
    return a, b


def _batch_pairs(rows: pd.DataFrame, backwards: bool) -> pd.DataFrame:
    """Both directions of the pairs of whole cells: ``word``, ``near_n``, ``near``; each pair in its own cell only."""
    cell = rows["cell"].to_numpy()
    m, s, e = (rows[name].to_numpy() for name in ("m", "s", "e"))
    agreed = int((m - e).min() if backwards else s.min())
    a, b = near_pairs(rows["listed"].tolist(), cell, m, agreed)
    lists = _Lists(rows["listed"].tolist(), cell)
    after = lists.shared(a, b, backwards=not backwards)  # common code points at the end of the words
    edit = np.where(lists.length[b] == m[a], m[a] - 1 - after, np.maximum(m[a] - after, 0))
    own = (s[a] <= edit) & ((edit < e[a]) | (edit == m[a]) & (e[a] == m[a]))
    a, b = a[own], b[own]
    longer = lists.length[b] > m[a]  # equal lengths are found from both sides
    a, b = np.r_[a, b[longer]], np.r_[b, a[longer]]
    word, n = rows["word"].to_numpy(), rows["n"].to_numpy()
    return pd.DataFrame({"word": word[a], "near": word[b], "near_n": n[b]})


def _counted(pairs: pd.DataFrame) -> pd.DataFrame:
    """For each word the number of near words and the best of them."""
    pairs = pairs.sort_values(["word", "near_n", "near"], ascending=[True, False, True], kind="stable")
    best = pairs.drop_duplicates("word")
    return best.assign(n_near=pairs.groupby("word", sort=False).size().to_numpy())[["word", "n_near", "near", "near_n"]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs over sorted cells, some whole ones at a time."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def done(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        for backwards, part in rows.groupby("backwards", sort=False):
            pairs = _batch_pairs(part.reset_index(drop=True), bool(backwards))
            if len(pairs):
                yield from pa.Table.from_pandas(_counted(pairs), schema, preserve_index=False).to_batches()

    held, number = [], 0
    last = None
    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        keys = rows[list(_CELL)]
        change = (keys != keys.shift()).any(axis=1).to_numpy()
        change[0] = tuple(keys.iloc[0]) != last
        last = tuple(keys.iloc[-1])
        rows["cell"] = number + np.cumsum(change)
        number = int(rows["cell"].iloc[-1])
        held.append(rows)
        if sum(map(len, held)) >= BATCH_WORDS:
            rows = pd.concat(held, ignore_index=True)
            whole = rows["cell"] < number
            held = [rows[~whole]]
            if whole.any():
                yield from done(rows[whole])
    if held:
        yield from done(pd.concat(held, ignore_index=True))


def near_words(vocabulary: DataFrame, shortest: int = 5, most: int = MOST_WORDS) -> DataFrame:
    """``word``, ``n_near`` (words one edit off), ``near`` and ``near_n``: the first of them by falling count; words without one are left out."""
    rows = cells(vocabulary, shortest, most)
    backwards = F.col("m") - F.col("e") > F.col("s")
    rows = rows.withColumn("backwards", backwards)
    rows = rows.withColumn("listed", F.when(F.col("backwards"), F.reverse("word")).otherwise(F.col("word")))
    order = ("backwards", *_CELL, "listed")
    found = rows.repartition(*_CELL).sortWithinPartitions(*order).mapInArrow(
        _compared, "word string, n_near long, near string, near_n long"
    )
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", "best.near", (-F.col("best.order")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of the chain of forms; by doubling, of rows (``word``, ``form``) without cycles."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        following = links.select(F.col("word").alias("via"), F.col("root").alias("further"))
        joined = links.join(following, F.col("root") == F.col("via"), "left")
        moved = cut(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, modulus: int = 97, times: int = 2) -> DataFrame:
    """Each word with ``form``, ``root``, ``n``, ``n_near`` and ``form_n``."""
    vocabulary = stored(words(docs, shortest, least, modulus), "spelling-words")
    near = near_words(vocabulary, shortest).withColumnRenamed("word", "of")
    rows = vocabulary.join(near, F.col("word") == F.col("of"), "left")
    strong = F.col("near_n") >= times * F.col("n")
    rows = stored(rows.select(
        "word", F.when(strong, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("near_n")).alias("form_n"),
    ), "spelling-forms")
    ends = roots(rows.where("form is not null")).withColumnRenamed("word", "of")
    rows = rows.join(ends, F.col("word") == F.col("of"), "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
