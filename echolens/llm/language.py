"""Language identification: unigram pieces of a fixed public vocabulary, summed over all segmentations.

Each language has probabilities of the pieces of a public subword vocabulary. A word, a run of letters in lower case
behind a word mark, has many segmentations into pieces; its probability is the sum over all of them, by the forward
algorithm, rescaled on its way so that words of any length are summed whole. A text scores the sum of its words' log-probabilities. The probabilities are fitted by expectation
maximisation with forward and backward sums over the words of a bounded sample of texts of each language.

A character that no piece covers is a piece of its own with one small probability in every language. Texts that are
null or without letters are ``und`` with score 0; the score is else the share of the predicted language among all.
Ties go to the first language in code point order. Without any learned language every text is ``und``.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolens.llm.common import chunks, code_points, cut, give_back, in_fold

UNKNOWN = "und"
#: Characters after which sums are rescaled, and characters of the words that are summed at once.
STEP, GROUP_CHARS = 8, 100_000
#: Bound of the sample: texts of a language. Every language is learned.
SAMPLE_PER_LANGUAGE = 400
#: Languages whose numbers of rows are broadcast; more are joined by shuffle.
BROADCAST_LANGUAGES = 100_000
_MARK = "▁"
#: Runs of letters and numbers other than digits, and runs of letters.
_RUN, _WORD = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
_FLOOR = 1e-9
_TABLE_BITS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """The pieces of letters in the vocabulary file, in lower case; a leading mark starts a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    fits = (p for p in pieces if p and (p == _MARK or p.removeprefix(_MARK).isalpha()))
    return sorted(fits)


def words_of(text: str) -> list[str]:
    """Runs of letters; a number such as a half or a Roman numeral is none."""
    runs = _RUN.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [word for run in runs for word in _WORD.findall(run)]


@dataclass
class PieceTable:
    """Open-addressed table from the hash of a string to the number of its piece, -1 without one."""

    pieces: list[str]
    keys: np.ndarray = field(init=False)
    numbers: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.keys = np.zeros(1 << _TABLE_BITS, np.uint64)
        self.numbers = np.full(1 << _TABLE_BITS, -1, np.int32)
        for number, piece in enumerate(self.pieces):
            key = np.zeros(1, np.uint64)
            for point in code_points(piece):
                key = _extended(key, np.array([point], np.uint32))
            slot = int(_slot(key)[0])
            while self.numbers[slot] >= 0:
                slot = (slot + 1) & ((1 << _TABLE_BITS) - 1)
            self.keys[slot], self.numbers[slot] = key[0], number

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = _slot(keys)
        found = np.where(self.keys[slots] == keys, self.numbers[slots], -1)
        open_ = np.flatnonzero((found < 0) & (self.numbers[slots] >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << _TABLE_BITS) - 1)
            hit = self.keys[slots[open_]] == keys[open_]
            taken = self.numbers[slots[open_]]
            found[open_[hit & (taken >= 0)]] = taken[hit & (taken >= 0)]
            open_ = open_[~hit & (taken >= 0)]
        return found


def _extended(keys: np.ndarray, points: np.ndarray) -> np.ndarray:
    return (keys + points.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


@dataclass
class Lattice:
    """Words of one length: for each end and piece length, the piece numbers (-1: none) of all words."""

    length: int
    longest: int
    pieces: dict[tuple[int, int], np.ndarray]


def lattice(words: list[str], table: PieceTable) -> Lattice:
    """All pieces that occur in the marked words, which have the same length."""
    points = np.stack([code_points(_MARK + word) for word in words])
    length, found = points.shape[1], {}
    keys = np.zeros(points.shape, np.uint64)
    for size in range(1, min(table.longest, length) + 1):
        keys = _extended(keys[:, :length - size + 1], points[:, size - 1:])
        numbers = table.find(keys.ravel()).reshape(keys.shape)
        for start in range(length - size + 1) if size == 1 else np.flatnonzero((numbers >= 0).any(axis=0)).tolist():
            found[start + size, size] = numbers[:, start]
    return Lattice(length, table.longest, found)


def _sums(paths: Lattice, chances: np.ndarray, count: int, backward: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums over all segmentations of every prefix or suffix by its length, and the logarithms of what scales them."""
    sums = [np.ones((count, chances.shape[1]))]
    recent, scale = list(sums), np.zeros_like(sums[0])
    scales = [scale]
    for done in range(1, paths.length + 1):
        here = np.zeros_like(scale)
        for size in range(1, min(paths.longest, done) + 1):
            numbers = paths.pieces.get((paths.length - done + size if backward else done, size))
            if numbers is not None:
                here += recent[-size] * _chance(numbers, chances, size)
        recent = [*recent[1 - paths.longest:], here] if paths.longest > 1 else [here]
        if done % STEP == 0:
            most = np.maximum.reduce(recent)
            recent = [x / most for x in recent]
            scale = scale + np.log(most)
        sums.append(recent[-1])
        scales.append(scale)
    return sums, scales


def log_forward(paths: Lattice, chances: np.ndarray, count: int) -> np.ndarray:
    """Log-probability of every word in every language, over all segmentations."""
    sums, scales = _sums(paths, chances, count, False)
    return np.log(np.maximum(sums[-1], 1e-300)) + scales[-1]


def _chance(numbers: np.ndarray, chances: np.ndarray, size: int) -> np.ndarray:
    """The last row of ``chances`` is zero; a single character that is no piece has the floor's probability."""
    got = chances[numbers]
    return np.where((numbers < 0)[:, None], _FLOOR, got) if size == 1 else got


def expected_counts(paths: Lattice, chances: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations, by forward and backward sums."""
    ahead, ahead_scales = _sums(paths, chances, len(weight), False)
    behind, behind_scales = _sums(paths, chances, len(weight), True)
    counts = np.zeros_like(chances)
    whole = np.log(np.maximum(ahead[-1], 1e-300)) + ahead_scales[-1]
    for (end, size), numbers in paths.pieces.items():
        known = numbers >= 0
        share = ahead[end - size] * _chance(numbers, chances, size) * behind[paths.length - end]
        share *= weight * np.exp(ahead_scales[end - size] + behind_scales[paths.length - end] - whole)
        for language in range(chances.shape[1]):
            counts[:, language] += np.bincount(numbers[known], share[known, language], len(chances))
    return counts


@dataclass
class LanguageModel:
    """``chances``: piece by language, with a last row of zeros."""

    languages: list[str]
    table: PieceTable
    chances: np.ndarray

    def __post_init__(self) -> None:
        self._cache: dict[str, int] = {}
        self._rows = np.zeros((0, len(self.languages)))

    def _look_up(self, words: set[str], most: int = 400_000) -> None:
        """Log-probabilities of the words that are not known yet; a full cache starts anew."""
        if len(self._cache) > most:
            self._cache, self._rows = {}, self._rows[:0]
        new = [word for word in words if word not in self._cache]
        added = [self._rows]
        for group in _by_length(new):
            for part in _parts(group):
                at = sum(map(len, added))
                added.append(log_chances(part, self.table, self.chances))
                self._cache.update(zip(part, range(at, at + len(part))))
        self._rows = np.concatenate(added)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for a, b in chunks(texts, 4_000_000):  # many new words at once keep the arrays long
            split = [words_of(text) for text in texts[a:b]]
            self._look_up(set().union(*split))
            for i, words in enumerate(split, a):
                if words:
                    total = self._rows[[self._cache[word] for word in words]].sum(axis=0)
                    best = int(total.argmax())
                    names[i], scores[i] = self.languages[best], 1 / np.exp(np.clip(total - total[best], -700, 0)).sum()
        return names, scores


def _by_length(words: list[str]) -> list[list[str]]:
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    return list(groups.values())


def _parts(group: list[str]) -> list[list[str]]:
    """Words of one length in lists of bounded size."""
    most = max(GROUP_CHARS // (len(group[0]) + 1), 1)
    return [group[a:a + most] for a in range(0, len(group), most)]


def log_chances(words: list[str], table: PieceTable, chances: np.ndarray) -> np.ndarray:
    """Log-probability of words of one length in every language."""
    return log_forward(lattice(words, table), chances, len(words))


def train(texts: list[str], languages: list[str], pieces: list[str], rounds: int = 4) -> LanguageModel:
    """Piece probabilities of every language, by expectation maximisation over its words."""
    names, table = sorted(set(languages)), PieceTable(pieces)
    counts = [Counter() for _ in names]
    for text, language in zip(texts, languages):
        counts[names.index(language)].update(words_of(text))
    vocabulary_ = sorted({word for count in counts for word in count})
    groups = []
    for group in _by_length(vocabulary_):
        for part in _parts(group):
            weight = np.array([[count[word] for count in counts] for word in part], dtype=float)
            groups.append((part, weight.reshape(len(part), len(names))))
    chances = np.zeros((len(pieces) + 1, len(names)))
    chances[:-1] = 1 / max(len(pieces), 1)
    for _ in range(rounds):
        total = np.zeros_like(chances)
        for part, weight in groups:
            total += expected_counts(lattice(part, table), chances, weight)
        total[:-1] += 0.01
        chances = total / np.maximum(total.sum(axis=0), 1e-300)
        chances[-1] = 0
    return LanguageModel(names, table, chances)


def fit(docs: DataFrame, vocabulary_path: str, per_language: int = SAMPLE_PER_LANGUAGE, fold: int = 4,
        held_out: int = 2) -> LanguageModel:
    """Model from at most ``per_language`` texts of each non-null ``lang`` outside the fold ``crc32 % fold = held_out``.

    The hash of its id decides whether a text is taken, at the rate that gives somewhat more of its language; those with the
    smallest hashes are used. Of several texts of one id and language the first in code point order counts. All this is
    cut in Spark, so no more texts reach the driver than are learned from.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~in_fold(F.col("doc_id"), fold, held_out)).select("doc_id", "lang", "text")
    counts = cut(known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids")))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGUAGES else counts
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.join(counts, "lang").where(draw * F.col("ids") < 1.2 * per_language + 20)
    drawn = drawn.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    rows = drawn.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language)
    rows = rows.select("lang", "doc_id", "text").toPandas().sort_values(["lang", "doc_id"], kind="stable")
    model = train(rows["text"].tolist(), rows["lang"].tolist(), vocabulary(vocabulary_path))
    del rows
    give_back()
    return model


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of the whole text; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.languages, model.table.pieces, model.chances))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _of_worker(shared)
        for batch in batches:
            names, scores = model.predict(batch.fillna("").tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    kept = [F.col(f"`{name}`") for name in docs.columns if name.lower() not in ("lang_pred", "score")]
    made = docs.select(*kept, predicted(F.col(text)).alias("__made"))
    return made.select(*kept, F.col("__made.lang_pred"), F.col("__made.score"))


_models: dict[str, LanguageModel] = {}


def _of_worker(shared: Broadcast) -> LanguageModel:
    """The model as this Python worker holds it; the words it has looked up stay from task to task."""
    key, languages, pieces, chances = shared.value
    if key not in _models:
        _models.clear()
        _models[key] = LanguageModel(languages, PieceTable(pieces), chances)
    return _models[key]
