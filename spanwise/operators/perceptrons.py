"""Perceptrons over inputs that are sums of rows of a table, such as codes' vectors.

A row is kept as a sparse vector of its table rows, not as its wide input: the first layer of input = features x table is features x (table x
weights), and its gradient is table' x (features' x errors).  So tasks hold only the numbers that are not zero, whatever the input's width, and
equal rows come once with their number ``n``.  One pass over the rows gives loss and gradient; the L-BFGS steps are the driver's."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .replicates import ROWS, SparseRows, _inverse_times, _summed


def _forward(first: np.ndarray, rest: list[np.ndarray], part: SparseRows) -> list[np.ndarray]:
    """The layers' values, sigmoids in between and log-probabilities last.  Each matrix has the intercepts as last row."""
    values, z = [], part.times(first.T)
    for w in rest:
        values.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        z = values[-1] @ w[:-1] + w[-1]
    return [*values, z - np.logaddexp.reduce(z, axis=1, keepdims=True)]


@dataclass
class Perceptron:
    """``first``: table x weights of the first layer, a row for each feature, and the intercepts; ``rest``: the matrices of the layers behind."""

    first: np.ndarray
    rest: list[np.ndarray]

    def scored_rows(self, df: DataFrame) -> DataFrame:
        """row_id, y and score: the probability of class 1.  df: row_id, y and features."""
        first, rest, width = self.first, self.rest, len(self.first) - 1

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    rows = batch.slice(a, ROWS)
                    found = np.exp(_forward(first, rest, SparseRows.of(rows, width))[-1][:, 1])
                    yield pa.RecordBatch.from_arrays([rows.column("row_id"), rows.column("y"), pa.array(found)], names=["row_id", "y", "score"])

        return df.select(F.col("row_id").cast("long").alias("row_id"), "features", F.col("y").cast("int").alias("y")).mapInArrow(score, "row_id long, y int, score double")


def fit_perceptron(df: DataFrame, table: np.ndarray, hidden: tuple[int, ...], max_iter: int = 100, tolerance: float = 1e-6, seed: int = 42) -> Perceptron:
    """Sigmoid layers and two softmax outputs, by the mean cross-entropy over rows that count ``n`` times.  df: features, y and n."""
    rows = df.select(F.col("n").cast("long").alias("row_id"), "features", F.col("y").cast("int").alias("y")).persist()  # the number takes the key's place
    width, sizes = len(table), (table.shape[1], *hidden, 2)
    shapes = [(a + 1, b) for a, b in zip(sizes, sizes[1:])]
    ends = np.cumsum([a * b for a, b in shapes])
    rnd = np.random.default_rng(seed)
    start = np.concatenate([(rnd.random(a * b) * 4.8 - 2.4) / (a - 1) for a, b in shapes])
    total = _summed(rows, lambda part: np.array([part.key.sum()], dtype=np.float64), (1,), width)[0]

    def matrices(w: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        whole = [x.reshape(s) for x, s in zip(np.split(w, ends[:-1]), shapes)]
        return np.vstack((table @ whole[0][:-1], whole[0][-1:])), whole[1:]

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        first, rest = matrices(w)

        def loss(part: SparseRows) -> np.ndarray:
            *values, logs = _forward(first, rest, part)
            y = part.y.astype(np.int64)
            own = -(part.key * logs[np.arange(len(y)), y]).sum()
            error = np.exp(logs)
            error[np.arange(len(y)), y] -= 1
            error *= part.key[:, None]
            made = []
            for a, m in zip(reversed(values), reversed(rest)):
                made.append(np.vstack((a.T @ error, error.sum(axis=0))).ravel())
                error = (error @ m[:-1].T) * a * (1 - a)
            return np.concatenate([part.pulled(error, width + 1).T.ravel(), *reversed(made), [own]])

        sums = _summed(rows, loss, (first.size + sum(m.size for m in rest) + 1,), width) / total
        pulled = sums[: first.size].reshape(first.shape)
        return sums[-1], np.concatenate([(table.T @ pulled[:-1]).ravel(), pulled[-1], sums[first.size : -1]])

    w = _minimised(evaluate, start, max_iter, tolerance)
    rows.unpersist()
    return Perceptron(*matrices(w))


def _minimised(evaluate, w: np.ndarray, max_iter: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """L-BFGS: ``max_iter`` steps that each lower the loss, halved until they do; a step that can't ends it."""
    value, gradient = evaluate(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(gradient).max() <= tolerance:
            break
        way = -_inverse_times(gradient[None], steps, np.full(len(w), _scale(steps, gradient)))[0]
        for length in 0.5 ** np.arange(30):
            new = w + length * way
            found, slope = evaluate(new)
            if found <= value + 1e-4 * length * (gradient @ way):
                break
        else:
            break
        gained = value - found
        if (new - w) @ (slope - gradient) > 1e-18:
            steps = [*steps[-memory + 1 :], ((new - w)[None], (slope - gradient)[None])]
        w, value, gradient = new, found, slope
        if gained <= tolerance * max(abs(value), tolerance):
            break
    return w


def _scale(steps: list[tuple[np.ndarray, np.ndarray]], gradient: np.ndarray) -> float:
    """The length of the last step over the change of the gradient on it; at first a step of length 1."""
    if not steps:
        return 1 / max(np.linalg.norm(gradient), 1e-12)
    s, d = steps[-1]
    return float((s * d).sum() / (d * d).sum())
