"""Toxicity: subword-bag embeddings, averaged over a text, into a linear softmax; both trained jointly.

A text is lower-cased; what is no letter or digit separates words. Every n-gram of ``SHORTEST`` to ``LONGEST``
characters of a word, with a mark at either end of the word, hashes to one embedding. A text is the mean of its
n-grams' embeddings, rare n-grams weighing more, so an unseen misspelling lands near the words whose n-grams it shares.

Null and empty texts, and texts without letters, have no n-grams: they get the score of the bias alone. Repeated
rows are scored alike. With no labelled text, or one class only, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import alphanumeric, chunks, code_points, give_back, labelled_sample, sigmoid

SHORTEST, LONGEST = 3, 6
BUCKETS = 1 << 18
#: Bounds of the sample of labelled texts: clean ones and toxic ones.
SAMPLE = {0: 3000, 1: 1500}
_MARK = 32


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts and, for each, the place of its text."""
    parts = [code_points(f" {text.lower()} ") for text in texts]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    points = np.concatenate(parts)
    gap = ~alphanumeric()[points]
    points = np.where(gap, np.uint32(_MARK), points)
    gaps = np.concatenate([[0], np.cumsum(gap, dtype=np.int32)])
    hashed, buckets, owners = points.copy(), [], []
    for n in range(2, LONGEST + 1):
        if len(points) < n:
            break
        hashed = hashed[:-1] * np.uint32(0x01000193) + points[n - 1:]
        if n < SHORTEST:
            continue
        last = len(points) - n + 1
        whole = np.flatnonzero(gaps[n - 1:n - 1 + last] == gaps[1:1 + last])  # no gap inside; the ends may be marks
        mixed = hashed[whole]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        buckets.append((mixed >> np.uint32(32 - 18)).astype(np.int32))
        owners.append(owner[whole])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class SubwordModel:
    """``share``: an n-gram's weight in the mean; ``weights``: its embedding times the softmax's direction, times that."""

    share: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in chunks(texts):
            ids, owner = subwords(texts[a:b])
            total = np.bincount(owner, self.weights[ids], b - a)
            out[a:b] = total / np.maximum(np.bincount(owner, self.share[ids], b - a), 1e-12)
        return sigmoid(out + self.bias)


def rarity(bags: list[tuple[np.ndarray, np.ndarray]], at: float) -> np.ndarray:
    """Weight of every n-gram: a half where its share of all n-grams of the sample is ``at``, more the rarer it is."""
    seen = np.zeros(BUCKETS)
    for ids, counts in bags:
        seen[ids] += counts
    return (at / (at + seen / max(seen.sum(), 1))).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, dim: int = 8, epochs: int = 5, most_epochs: int = 40, steps: int = 22_500,
          rate: float = 0.2, at: float = 1e-4, seed: int = 7) -> SubwordModel:
    """Embeddings and softmax fitted together by Adagrad, one text a step, both classes weighing the same.

    Embeddings start at zero, so that n-grams without evidence say nothing. A sample so small that ``epochs`` passes
    are fewer than ``steps`` gets more, ``most_epochs`` at most.
    """
    rng = np.random.default_rng(seed)
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        return SubwordModel(np.ones(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), -np.inf)
    bags = []
    for text in texts:
        ids, counts = np.unique(subwords([text])[0], return_counts=True)
        bags.append((ids, counts.astype(np.int32)))  # all bags stay in the driver's memory
    share = rarity(bags, at)
    for i, (ids, counts) in enumerate(bags):
        weight = counts * share[ids]
        bags[i] = ids, (weight / max(weight.sum(), 1e-12)).astype(np.float32)
    importance = len(labels) / (2 * np.bincount(labels, minlength=2))
    embeddings = np.zeros((BUCKETS, dim), np.float32)
    softmax = rng.normal(0, 1, (2, dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen, seen_softmax, seen_bias = np.full(BUCKETS, 1e-8, np.float32), np.full((2, dim), 1e-2), np.full(2, 1.0)
    for _ in range(max(epochs, min(most_epochs, -(-steps // len(bags))))):
        for i in rng.permutation(len(bags)):
            ids, part = bags[i]
            mean = part @ embeddings[ids]
            logits = softmax @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= importance[labels[i]]
            back = p @ softmax
            slope = np.outer(p, mean)
            seen_softmax += slope ** 2
            seen_bias += p ** 2
            softmax -= (rate * slope / np.sqrt(seen_softmax)).astype(np.float32)
            bias -= (rate * p / np.sqrt(seen_bias)).astype(np.float32)
            seen[ids] += part ** 2 * np.float32(back @ back)
            embeddings[ids] -= np.outer(rate * part / np.sqrt(seen[ids]), back).astype(np.float32)
    direction = softmax[1] - softmax[0]
    return SubwordModel(share, share * (embeddings @ direction).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] = SAMPLE, fold: int = 5) -> SubwordModel:
    """Model from the sampled labelled texts outside the fold ``crc32(doc_id) % fold = 0``."""
    rows = labelled_sample(docs, labels, "toxic", most, fold)
    model = train(rows["text"].tolist(), rows["y"].to_numpy(dtype=int))
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: SubwordModel, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of toxicity of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.scores(batch.fillna("").tolist()))
        give_back()

    return docs.withColumn(name, scored(F.col(text)))
