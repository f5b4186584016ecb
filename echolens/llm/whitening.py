"""Whitening of embeddings by a Jacobi-Davidson iteration on distributed, matrix-free products.

Entries become integers ``floor(scale * c) + shift``. With n vectors x and the sums S of each dimension, n*x - S is exact in
integers, so centring loses nothing however large the shift is; the covariance V is never formed. All that Spark computes
for the eigenvectors are products: for a block Z of few columns, sum of c (c' Z) / n over the centred rows c. One job
multiplies the whole block; a task returns one small sum (dimensions x columns), whatever the number of rows.

*Outer iteration*: an orthonormal basis B of a search space and the products V B. The Rayleigh-Ritz step takes the
eigenvectors of B'VB. A Ritz pair whose residual |Vu - eu| is at most ``accuracy`` times the largest eigenvalue is locked
once all larger ones are; locked vectors leave the search space, and everything new is kept orthogonal to them.
*Correction*: for the first pairs that are not locked, (I - QQ')(V - eI)(I - QQ') t = -r, with Q the locked and the
current Ritz vectors, is solved by a few steps of MINRES, all columns side by side, so that a step is one product job. The
corrections join the basis. A basis that outgrows its limit restarts from its best Ritz vectors. The residuals are taken from products, not from recurrences.

Defined cases: a null vector, and one with a null or non-finite entry, takes no part and gives no row. Vectors of another
length than the most common one (of two, the longer), and empty ones, take no part either. Repeated rows and ids are vectors of
their own. Components whose eigenvalue is zero to working accuracy are not returned: a table of fewer than two different
vectors, and an empty one, give no rows. ``deviation`` is null where it exceeds a long. Entries whose scaled value exceeds
2**52 are taken as 2**52. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
#: Largest absolute value of an entry before the shift.
_MOST = 2.0**52
_RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Moments:
    """Number of vectors and exact sums of each dimension."""

    n: int
    sums: tuple[int, ...]


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all entries are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def integers(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id`` and the integer vector ``x`` of each usable row, stored."""
    rows = rows.select("vec_id", F.col("embedding").alias("v")).where(usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is not None:
        rows = rows.where(F.size("v") == lengths["d"])

    def whole(c: Column) -> Column:
        value = F.greatest(F.least(F.floor(scale * c.cast("double")).cast("double"), F.lit(_MOST)), F.lit(-_MOST))
        return value.cast("long") + shift

    return stored(rows.select("vec_id", F.transform("v", whole).alias("x")), "whitening-x")


def moments(x: DataFrame) -> Moments:
    """Sums of each dimension, exact: as many numbers as dimensions reach the driver."""
    n = x.count()
    sums = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect()
    return Moments(n, tuple(int(total) for _, total in sorted(sums)))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of a batch as integers."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _deviations(batch: pa.RecordBatch, m: Moments) -> np.ndarray:
    """n*x - S, exact: in 64 bits if they suffice, else in Python's integers."""
    x = _matrix(batch, len(m.sums))
    most = max(int(np.abs(x).max(initial=0)) * m.n, max(map(abs, m.sums)))
    return m.n * x - np.array(m.sums, np.int64) if most < 2**62 else m.n * x.astype(object) - np.array(m.sums, object)


def _centred(batch: pa.RecordBatch, m: Moments) -> np.ndarray:
    return _deviations(batch, m).astype(float) / m.n


def _summed(x: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of one matrix each, added in Spark; a task of no rows adds nothing."""
    columns = shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = part(batches)
        if total is not None:
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

    out = np.zeros(shape)
    for i, value in x.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i // columns, i % columns] = value
    return out


def product_with(x: DataFrame, m: Moments) -> Product:
    """Z -> V Z, one Spark job for all columns of Z."""

    def product(z: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for batch in batches:
                c = _centred(batch, m)
                add = c.T @ (c @ z)
                total = add if total is None else total + add
            return total

        return _summed(x, part, z.shape) / m.n

    return product


def _orthonormal(z: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``z`` adds to the orthonormal columns ``against``."""
    z = z / np.maximum(np.linalg.norm(z, axis=0), 1e-300)
    for _ in range(2):  # once more, for what rounding left
        z = z - against @ (against.T @ z)
    left, sizes, _ = np.linalg.svd(z, full_matrices=False)
    left = left[:, sizes > 1e-10]
    left = left - against @ (against.T @ left)
    return np.linalg.qr(left)[0] if left.shape[1] else left


def minres(product: Product, shifts: np.ndarray, q: np.ndarray, b: np.ndarray, steps: int, least: float) -> np.ndarray:
    """Approximate solutions t of (I - QQ')(V - shift I)(I - QQ') t = b, column by column; one product a step.

    The usual Lanczos recurrence with Givens rotations, each number of which is a row of numbers here, one a column.
    """
    project = lambda z: z - q @ (q.T @ z)
    r = project(b)
    beta = np.linalg.norm(r, axis=0)
    t, phi = np.zeros_like(r), beta.copy()
    v, before = r / np.where(beta > 0, beta, 1), np.zeros_like(r)
    w, w_before = np.zeros_like(r), np.zeros_like(r)
    beta = np.zeros_like(beta)
    cos, sin, cos_before, sin_before = (np.full(len(phi), value) for value in (1.0, 0.0, 1.0, 0.0))
    for _ in range(steps):
        alive = np.abs(phi) > least
        if not alive.any():
            break
        z = project(product(v) - v * shifts)
        alpha = np.sum(v * z, axis=0)
        z = project(z - v * alpha - before * beta)
        following = np.linalg.norm(z, axis=0)
        third, second = sin_before * beta, cos * cos_before * beta + sin * alpha
        first = cos * alpha - sin * cos_before * beta
        rho = np.hypot(first, following)
        alive &= rho > 0
        safe = np.where(rho > 0, rho, 1)
        cos_before, sin_before, cos, sin = cos, sin, first / safe, following / safe
        w, w_before = (v - w * second - w_before * third) / safe, w
        t = t + np.where(alive, phi * cos, 0) * w
        phi = np.where(alive, -sin * phi, phi)
        before, v, beta = v, z / np.where(following > 0, following, 1), following
        phi = np.where(following > 0, phi, 0)
    return t


def eigenpairs(
    product: Product, d: int, k: int, seed: int = 1, block: int | None = None, steps: int = 6, accuracy: float | None = None,
    rounds: int = 200,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric, semi-definite matrix given by products, by falling value; their
    unit vectors as columns; the residuals. ``accuracy`` is that of the residuals, relative to the largest eigenvalue.

    ``block`` corrections are solved at once. A round that brings nothing new, as the search space is everything or all
    that rounding can tell apart, ends the iteration as well.
    """
    k, accuracy = min(k, d), accuracy or 4 * d * np.finfo(float).eps
    block = min(block or k, d)
    most = min(4 * max(k, block), d)
    locked, values, kept = np.zeros((d, 0)), np.zeros(0), np.zeros(0)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(k + 2, d))), locked)
    products = product(basis)
    best, stale = np.inf, 0
    for _ in range(rounds):
        small = basis.T @ products
        thetas, turn = np.linalg.eigh((small + small.T) / 2)
        thetas, turn = thetas[::-1], turn[:, ::-1]
        basis, products = basis @ turn, products @ turn  # Ritz vectors
        residuals = products - basis * thetas
        sizes = np.linalg.norm(residuals, axis=0)
        scale = max(values[0] if len(values) else thetas[0], 0.0)
        done = sizes <= accuracy * scale
        wanted = min(k - len(values), len(thetas))
        new = wanted if done[:wanted].all() else int(np.argmin(done[:wanted]))
        if new:  # locked: out of the search space
            locked = np.hstack([locked, basis[:, :new]])
            values, kept = np.append(values, thetas[:new]), np.append(kept, sizes[:new])
            basis, products, residuals = basis[:, new:], products[:, new:], residuals[:, new:]
            thetas, sizes, done = thetas[new:], sizes[new:], done[new:]
        if len(values) == k:
            break
        if basis.shape[1] + locked.shape[1] > most - 1 and most < d:  # restart
            stay = max(k - len(values) + k // 2, 1)
            basis, products, residuals = basis[:, :stay], products[:, :stay], residuals[:, :stay]
            thetas, sizes, done = thetas[:stay], sizes[:stay], done[:stay]
        worst = sizes[: k - len(values)].max(initial=0.0)
        better = worst < best / 2 or new or worst > 1000 * accuracy * scale  # far from rounding, slow progress is progress
        stale, best = (0, worst) if better else (stale + 1, best)
        open_ = np.flatnonzero(~done[: k - len(values)])[:block]
        fresh = basis[:, :0]
        if len(open_) and stale < 4:
            q = np.hstack([locked, basis[:, : k - len(values)]])
            t = minres(product, thetas[open_], q, -residuals[:, open_], steps, accuracy * scale / 10)
            fresh = _orthonormal(t, np.hstack([locked, basis]))
        if not fresh.shape[1] and locked.shape[1] + basis.shape[1] < k:  # fewer directions than asked: any other ones
            fresh = _orthonormal(np.random.default_rng(seed + 1).standard_normal((d, k)), np.hstack([locked, basis]))
        if not fresh.shape[1]:  # nothing left to add: what there is counts
            locked = np.hstack([locked, basis[:, : k - len(values)]])
            kept = np.append(kept, sizes[: k - len(values)])
            values = np.append(values, thetas[: k - len(values)])
            break
        basis, products = np.hstack([basis, fresh]), np.hstack([products, product(fresh)])
    else:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order], kept[order]


def _whitened(batch: pa.RecordBatch, m: Moments, axes: np.ndarray) -> np.ndarray:
    return _centred(batch, m) @ axes


def _identity_error(x: DataFrame, m: Moments, axes: np.ndarray) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, without sign; from a pass over all rows."""
    k = axes.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            w = _whitened(batch, m, axes)
            add = np.vstack([w.T @ w, w.sum(axis=0)])
            total = add if total is None else total + add
        return total

    sums = _summed(x, part, (k + 1, k)) / m.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = 32, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row for each usable vector of ``rows`` (``vec_id``, ``embedding``) and component up to ``components``.

    ``whitened`` is the centred integer vector on the component, over the root of its eigenvalue; ``explained`` the
    eigenvalue's share of the trace; ``deviation`` the exact sum of (n*x - S)^2; ``identity_error`` one value for all rows.
    """
    x = integers(rows, scale, shift)
    m = moments(x)
    d = len(m.sums)
    empty = rows.sparkSession.createDataFrame([], _RESULT)
    if m.n < 2:
        return empty

    def squares(batch: pa.RecordBatch) -> list[int]:
        exact = _deviations(batch, m)
        most = int(np.abs(exact).max(initial=0))
        exact = exact.astype(object) if most and most**2 * d >= 2**63 else exact
        return [int(value) for value in (exact * exact).sum(axis=1)]

    def variance(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        parts = [float((_centred(batch, m) ** 2).sum()) for batch in batches]
        return np.array([[sum(parts)]]) if parts else None

    trace = float(_summed(x, variance, (1, 1))[0, 0]) / m.n
    if trace <= 0:
        return empty
    values, vectors, _ = eigenpairs(product_with(x, m), d, components)
    held = values > d * np.finfo(float).eps * values[0] * 4
    values, vectors = values[held], vectors[:, held]
    axes, share = vectors / np.sqrt(values), values / trace
    error, k = _identity_error(x, m, axes), len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            w = _whitened(batch, m, axes)
            which = np.repeat(np.arange(count), k)
            spread = pa.array([s if s < 2**63 else None for s in squares(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").cast(pa.int64()).take(pa.array(which)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                pa.array(np.full(count * k, m.n, np.int64)), spread.take(pa.array(which)), pa.array(w.reshape(-1)),
                pa.array(np.tile(share, count)), pa.array(np.full(count * k, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, _RESULT)
