"""Draws by hash, and logistic regression on many bootstrap replicates at once.

Each row stands Poisson(1) many times in each replicate, by a hash of its key and the replicate's number, so no sample is drawn or moved.  All
replicates take their L-BFGS steps together: one pass over the rows gives every replicate's loss and gradient.  Rows stay sparse: a task holds
the numbers that are not zero of ``ROWS`` rows, and works on as many replicates at once as keep its products below ``PRODUCTS`` numbers.  Where the rows of
a batch share few features, up to ``DENSE`` for each number of a row, they are laid out over these features and meet the replicates as matrices."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the frame in a task at once, products at once, and partial sums that reach the driver.
ROWS, PRODUCTS, PARTS = 1024, 1 << 22, 8
#: Features of a batch, as a multiple of a row's mean count of numbers, up to which matrix products are the faster way.
DENSE = 16
_POISSON = np.exp(-1) * np.cumsum([1.0, 1.0, 1 / 2, 1 / 6, 1 / 24, 1 / 120, 1 / 720, 1 / 5040, 1 / 40320, 1 / 362880])


def _uniform(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each key and salt (arrays that broadcast), the same wherever it is asked for."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt * np.uint64(0xC2B2AE3D27D4EB4F)
        for shift in (30, 27, 31):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)) / 2.0**53


def poisson_weights(key: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each row stands in each replicate."""
    with np.errstate(over="ignore"):
        salt = np.arange(replicates, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x10001)
    return np.searchsorted(_POISSON, _uniform(key[:, None], salt[None, :]), side="right")


def poisson_draws(key: np.ndarray, rate: float, seed: int) -> np.ndarray:
    """How often each row is drawn when ``rate`` draws are expected of it: Poisson numbers by a hash of its key."""
    wide = 10 * math.sqrt(rate) + 20  # beyond, less than the hash resolves
    low = max(0, math.floor(rate - wide))
    k = np.arange(low, math.ceil(rate + wide) + 1)
    logs = k * math.log(rate) - rate - np.array([math.lgamma(i + 1) for i in k.tolist()])
    with np.errstate(over="ignore"):
        salt = np.uint64(seed) * np.uint64(0x10003) + np.uint64(1 << 40)
    return low + np.minimum(np.searchsorted(np.cumsum(np.exp(logs)), _uniform(key, salt), side="right"), len(k) - 1)


@dataclass
class SparseRows:
    """Rows with an intercept as last feature: where each row's numbers start, their features and values, and keys and classes."""

    start: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    key: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, width: int) -> SparseRows:
        vectors = batch.column("features")
        sparse, n = vectors.field("type").to_numpy() == 0, len(batch)
        values = vectors.field("values")
        length = np.diff(values.offsets.to_numpy())
        start = np.concatenate(([0], np.cumsum(length + 1)))
        feature, value = np.empty(start[-1], dtype=np.int64), np.empty(start[-1])
        own = np.ones(start[-1], dtype=bool)
        own[start[1:] - 1] = False
        value[own], value[~own], feature[~own] = values.flatten().to_numpy(), 1.0, width
        of_sparse = np.repeat(sparse, length)
        place = np.arange(len(of_sparse)) - np.repeat(np.cumsum(length) - length, length)  # of a dense vector's numbers
        place[of_sparse] = vectors.field("indices").flatten().to_numpy()
        feature[own] = place
        return cls(start, feature, value, batch.column("row_id").to_numpy(), batch.column("y").to_numpy().astype(np.float64))

    @cached_property
    def matrix(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The batch's own features and its rows over them, if these features are few."""
        features, place = np.unique(self.feature, return_inverse=True)
        if len(features) * len(self.y) > DENSE * len(self.value):
            return None
        cells = np.repeat(np.arange(len(self.y)), np.diff(self.start)) * len(features) + place
        return features, np.bincount(cells, self.value, len(self.y) * len(features)).reshape(len(self.y), len(features))

    def times(self, w: np.ndarray) -> np.ndarray:
        """rows x w's rows: the products of each row with each row of w."""
        if self.matrix is not None:
            features, rows = self.matrix
            return rows @ w[:, features].T
        return np.add.reduceat(w[:, self.feature] * self.value, self.start[:-1], axis=1).T

    def pulled(self, pull: np.ndarray, width: int) -> np.ndarray:
        """pull's columns x features: the sums of the rows' numbers, each row times its number in pull."""
        if self.matrix is not None:
            features, rows = self.matrix
            out = np.zeros((pull.shape[1], width))
            out[:, features] = pull.T @ rows
            return out
        order = np.argsort(self.feature, kind="stable")
        features, first = np.unique(self.feature[order], return_index=True)
        row = np.repeat(np.arange(len(self.y)), np.diff(self.start))[order]
        out = np.zeros((pull.shape[1], width))
        out[:, features] = np.add.reduceat(pull[row].T * self.value[order], first, axis=1)
        return out


def _summed(df: DataFrame, f: Callable[[SparseRows], np.ndarray], shape: tuple[int, ...], width: int) -> np.ndarray:
    """The sum over all rows of f: tasks add up their own, a shuffle theirs, and the driver PARTS arrays."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                total += f(SparseRows.of(batch.slice(a, ROWS), width))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % PARTS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for row in batch.column("sums"):
                total += np.frombuffer(row.as_buffer(), dtype=np.float64).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    made = "part int, sums binary"
    rows = df.mapInArrow(partial, made).repartition(PARTS, "part").mapInArrow(add, made).collect()  # PARTS rows
    return sum((np.frombuffer(r["sums"], dtype=np.float64).reshape(shape) for r in rows), np.zeros(shape))


def fit_replicates(df: DataFrame, replicates: int, seed: int = 42, max_iter: int = 100, tolerance: float = 1e-4) -> np.ndarray:
    """Coefficients (replicates x features) of the replicates' fits: L2 with C = 1, classes balanced in each replicate, free intercept.

    df: row_id, features (vectors, sparse or dense) and y."""
    rows = df.select(F.col("row_id").cast("long").alias("row_id"), "features", F.col("y").cast("int").alias("y")).persist()
    width = rows.first()["features"].size

    def counts(part: SparseRows) -> np.ndarray:
        w = poisson_weights(part.key, replicates, seed)
        classes = [(w * x[:, None]).sum(axis=0) for x in (1 - part.y, part.y)]
        return np.concatenate([*classes, np.bincount(part.feature, part.value**2, width + 1), [len(part.y)]])

    found = _summed(rows, counts, (2 * replicates + width + 2,), width)
    size = found[: 2 * replicates].reshape(2, replicates)
    weight = size.sum(axis=0) / (2 * np.maximum(size, 1))  # of the classes, in each replicate
    n = found[-1]
    ridge = np.append(np.ones(width), 0.0) / n
    scale = 1 / (found[2 * replicates : -1] / (4 * n) + np.append(np.ones(width) / n, 1e-9))  # inverse of a bound on the diagonal

    def evaluate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def loss(part: SparseRows) -> np.ndarray:
            sign = np.where(part.y == 1, 1.0, -1.0)[:, None]
            times = poisson_weights(part.key, replicates, seed) * np.where(part.y[:, None] == 1, weight[1], weight[0])
            out = np.empty((replicates, width + 2))
            tile = max(1, PRODUCTS // max(1, len(part.value)))
            for a in range(0, replicates, tile):
                margin = sign * part.times(w[a : a + tile])
                pull = -times[:, a : a + tile] * sign / (1 + np.exp(np.clip(margin, -50, 50)))
                out[a : a + tile, :-1] = part.pulled(pull, width + 1)
                out[a : a + tile, -1] = (times[:, a : a + tile] * np.logaddexp(0, -margin)).sum(axis=0)
            return out

        sums = _summed(rows, loss, (replicates, width + 2), width) / n
        return sums[:, -1] + 0.5 * (ridge * w * w).sum(axis=1), sums[:, :-1] + ridge * w

    w = _minimised(evaluate, np.zeros((replicates, width + 1)), scale, max_iter, tolerance)
    rows.unpersist()
    return w[:, :-1]


def _minimised(evaluate: Callable, w: np.ndarray, scale: np.ndarray, max_iter: int, tolerance: float, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving, for all rows of w side by side."""
    value, gradient = evaluate(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    length = np.ones(len(w))
    way = -gradient * scale
    for _ in range(max_iter):
        if np.abs(gradient * np.sqrt(scale)).max() <= tolerance:
            break
        new = w + length[:, None] * way
        found, slope = evaluate(new)
        better = found <= value + 1e-4 * length * (gradient * way).sum(axis=1) + 1e-15
        s = np.where(better[:, None], new - w, 0.0)
        d = np.where(better[:, None], slope - gradient, 0.0)
        steps = [*steps[-memory + 1 :], (s, d)]
        w, value, gradient = np.where(better[:, None], new, w), np.where(better, found, value), np.where(better[:, None], slope, gradient)
        way = -_inverse_times(gradient, steps, scale)
        length = np.where(better, 1.0, length / 2)
    return w


def _inverse_times(g: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray) -> np.ndarray:
    q, alphas = g.copy(), []
    for s, d in reversed(steps):
        curve = (s * d).sum(axis=1)
        rho = np.where(curve > 1e-18, 1 / np.where(curve > 1e-18, curve, 1), 0.0)
        alpha = rho * (s * q).sum(axis=1)
        q -= alpha[:, None] * d
        alphas.append((rho, alpha))
    q *= scale
    for (s, d), (rho, alpha) in zip(steps, reversed(alphas)):
        beta = rho * (d * q).sum(axis=1)
        q += (alpha - beta)[:, None] * s
    return q
