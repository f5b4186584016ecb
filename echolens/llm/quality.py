"""Quality: a linear support vector machine over n-gram indicators scaled by naive Bayes log-count ratios.

The features of a text are the distinct hashed n-grams of one to four characters, case and punctuation kept, digits
alike and runs of white space as one blank. Feature f weighs r(f), the logarithm of its share among good texts over its
share among bad ones; a text's vector is scaled by the root of its number of features. The hinge loss is minimised by
dual coordinate descent, and the margin becomes a probability by a logistic fit on the same sample, weighted to the
classes' shares among all labels.

Null and empty texts have no features and get the score of the intercept alone. Repeated rows are scored alike. With
no labelled text, or one class only, every score is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import code_points, give_back, in_fold, labelled_sample, sigmoid

LONGEST = 4
BUCKET_BITS = 18
#: Bounds of the sample of labelled texts: bad ones and good ones.
SAMPLE = {0: 2000, 1: 2000}
_DIGIT = 48


def indicators(text: str) -> np.ndarray:
    """Buckets of the distinct n-grams of a text, in no particular order."""
    points = code_points(" ".join(text.split()))
    if not len(points):
        return np.zeros(0, np.int64)
    points = np.where((points >= 48) & (points <= 57), np.uint32(_DIGIT), points)
    hashed, grams = points.copy(), []
    for n in range(1, LONGEST + 1):
        if n > 1:
            if len(points) < n:
                break
            hashed = hashed[:-1] * np.uint32(0x01000193) + points[n - 1:]
        mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
        grams.append(mixed >> np.uint32(32 - BUCKET_BITS))
    grams = np.concatenate(grams)
    # Of equal buckets the last one written keeps its slot.
    slots, order = _slots(), np.arange(len(grams), dtype=np.int32)
    slots[grams] = order
    return grams[slots[grams] == order].astype(np.int64)


_buffer: np.ndarray | None = None


def _slots() -> np.ndarray:
    global _buffer
    if _buffer is None:
        _buffer = np.zeros(1 << BUCKET_BITS, np.int32)
    return _buffer


@dataclass
class QualityModel:
    """``weights``: ratio times hinge-loss weight; ``slope`` and ``offset`` turn the margin into log-odds."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum() / np.sqrt(max(len(features), 1)) + self.bias)

    def scores(self, texts: list[str]) -> np.ndarray:
        margins = np.array([self.margin(indicators(text)) for text in texts], dtype=float)
        return sigmoid(self.slope * margins + self.offset)


def log_count_ratios(bags: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << BUCKET_BITS), alpha)
    for bag, label in zip(bags, labels):
        counts[label, bag] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(bags: list[np.ndarray], values: np.ndarray, signs: np.ndarray, cost: np.ndarray,
                            epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; ``values`` scales feature f, a bag by its size's root."""
    rng = np.random.default_rng(seed)
    weights, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(bags))
    rows = [values[bag] / np.sqrt(max(len(bag), 1)) for bag in bags]
    norms = np.array([row @ row + 1 for row in rows])
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            bag, row = bags[i], rows[i]
            slope = signs[i] * (weights[bag] @ row + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                weights[bag] += step * row
                bias += step
                alpha[i] = new
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit of labels to margins, by Newton's method."""
    design = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(design @ beta)
        gradient = design.T @ (weight * (p - labels)) + 1e-3 * beta
        curve = design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(curve, gradient)
    return float(beta[0]), float(beta[1])


def train(texts: list[str], labels: np.ndarray, good_share: float, epochs: int = 15, seed: int = 11) -> QualityModel:
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        prior = np.clip(good_share, 1e-6, 1 - 1e-6)
        return QualityModel(np.zeros(1 << BUCKET_BITS), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    bags = [indicators(text).astype(np.int32) for text in texts]
    ratios = log_count_ratios(bags, labels)
    signs = np.where(labels == 1, 1.0, -1.0)
    weights, bias = dual_coordinate_descent(bags, ratios, signs, np.ones(len(bags)), epochs, seed)
    model = QualityModel((weights * ratios).astype(np.float32), bias, 1.0, 0.0)
    margins = np.array([model.margin(bag) for bag in bags])
    share = np.where(labels == 1, good_share / (labels == 1).mean(), (1 - good_share) / (labels == 0).mean())
    model.slope, model.offset = calibrate(margins, labels.astype(float), share)
    return model


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] = SAMPLE, fold: int = 5) -> QualityModel:
    """Model from the sampled labelled texts outside the fold ``crc32(doc_id) % fold = 0``."""
    rows = labelled_sample(docs, labels, "quality", most, fold)
    outside = labels.where(~in_fold(F.col("doc_id"), fold, 0))
    share = outside.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    model = train(rows["text"].tolist(), rows["y"].to_numpy(dtype=int), 0.5 if share is None else share)
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: QualityModel, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of good quality of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.scores(batch.fillna("").tolist()))
        give_back()

    return docs.withColumn(name, scored(F.col(text)))
