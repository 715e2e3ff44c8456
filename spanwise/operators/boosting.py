"""Boosted trees over rows that are folded and kept in tasks as lists of rows by bin.

The method is that of Spark ML's GBTClassifier: trees of bounded depth fit the gradient of the logistic loss, each round draws a share of the rows, each split a
share of the features.  Equal rows come once with their number ``n``, of which a round draws a binomial part, as if each were drawn alone.  A feature's
lowest bin is not kept, so work follows the numbers that are not zero.  A level of a tree is one pass; the next round's first pass moves the rows' margins.
Several settings grow their trees together: a pass serves a level of each, and a task holds the rows once."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from .metrics import average_precision, roc_auc
from .replicates import ROWS, SparseRows

#: Bins of a feature, rows of a block, rows for which one more task pays, rounds between checkpoints, and tasks (times settings) whose sums go to the driver as they are.
BINS, BLOCK, TASK, KEPT, DIRECT = 32, 1 << 16, 1 << 14, 50, 128


@dataclass
class Block:
    """Rows in a task: ``row`` lists the rows of each bin, bin after bin, those of bin b from ``first[b]``.  y, n and a key; margins and the round's draws."""

    first: np.ndarray
    row: np.ndarray
    y: np.ndarray
    n: np.ndarray
    key: int
    margin: np.ndarray
    drawn: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], cuts: list[np.ndarray], key: int = 0) -> Block:
        """row_id is the number of equal rows."""
        width = len(cuts)
        parts = [SparseRows.of(b.slice(a, ROWS), width) for b in batches for a in range(0, b.num_rows, ROWS)]
        y, n = np.concatenate([p.y for p in parts]), np.concatenate([p.key for p in parts])
        row = np.repeat(np.arange(len(y), dtype=np.int32), np.concatenate([np.diff(p.start) for p in parts]))
        feature, value = np.concatenate([p.feature for p in parts]), np.concatenate([p.value for p in parts])
        order = np.argsort(feature, kind="stable")
        ends = np.searchsorted(feature[order], np.arange(width + 1))
        rows, sizes = [], []
        for f, cut in enumerate(cuts):
            at = order[ends[f] : ends[f + 1]]
            bins = np.full(len(y), np.searchsorted(cut, 0.0))
            bins[row[at]] = np.searchsorted(cut, value[at])
            held = np.flatnonzero(bins)
            rows.append(held[np.argsort(bins[held], kind="stable")].astype(np.int32))
            sizes.append(np.bincount(bins[held], minlength=len(cut) + 1)[1:])
        first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, dtype=np.int64)
        return cls(first, np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32), y, n, key, np.zeros(len(y)), np.zeros(len(y), dtype=np.int64))

    def places(self, splits: list[dict[int, tuple[int, int]]]) -> np.ndarray:
        """Each row's node, numbered inside its level, after the levels of ``splits``: a node without split sends its rows left."""
        node = np.zeros(len(self.y), dtype=np.int64)
        for level in splits:
            right = np.zeros(len(self.y), dtype=bool)
            for k, (low, high) in level.items():
                rows = self.row[self.first[low] : self.first[high]]
                right[rows[node[rows] == k]] = True
            node = 2 * node + right
        return node

    def target(self, start: bool) -> np.ndarray:
        sign = 2 * self.y - 1
        return sign if start else 4 * sign / (1 + np.exp(np.clip(2 * sign * self.margin, -500, 500)))

    def sums(self, splits: list[dict[int, tuple[int, int]]], weights: tuple[float, float], start: bool) -> np.ndarray:
        """3 x nodes x (bins + 1): drawn rows, their weight and weighted target; the last place is the node's own total."""
        nodes, bins = 2 ** len(splits), len(self.first) - 1
        weight = self.drawn * np.where(self.y == 1, weights[1], weights[0])
        node, of_row = self.places(splits), (self.drawn.astype(np.float64), weight, weight * self.target(start))
        cell = node[self.row] * bins + np.repeat(np.arange(bins), np.diff(self.first))
        out = np.empty((3, nodes, bins + 1))
        for i, w in enumerate(of_row):
            out[i, :, :-1] = np.bincount(cell, w[self.row], nodes * bins).reshape(nodes, bins)
            out[i, :, -1] = np.bincount(node, w, nodes)
        return out

    def draws(self, share: float, seed: int, turn: int) -> np.ndarray:
        return np.random.default_rng([seed, turn, self.key]).binomial(self.n, share)

    def moved(self, tree: Tree | None, share: float, seed: int, turn: int, drawn: np.ndarray | None = None) -> Block:
        """With the tree added to the margins, and the next round's draws."""
        margin = self.margin if tree is None else self.margin + tree.values[self.places(tree.splits)]
        return Block(self.first, self.row, self.y, self.n, self.key, margin, self.draws(share, seed, turn) if drawn is None else drawn)


@dataclass
class Tree:
    """For each level the split nodes with their bins that go right (from, to), and the values at the last level's nodes, times the step."""

    splits: list[dict[int, tuple[int, int]]]
    values: np.ndarray


@dataclass
class Trees:
    cuts: list[np.ndarray]
    trees: list[Tree]

    def scored_rows(self, df: DataFrame) -> DataFrame:
        """row_id, y and score: the probability of class 1.  df: row_id, y and features."""
        cuts, trees = self.cuts, self.trees

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    block = Block.of([batch], cuts)
                    margin = sum((t.values[block.places(t.splits)] for t in trees), np.zeros(batch.num_rows))
                    yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("y"), pa.array(1 / (1 + np.exp(-2 * margin)))], names=["row_id", "y", "score"])

        return df.select(F.col("row_id").cast("long").alias("row_id"), "features", F.col("y").cast("int").alias("y")).mapInArrow(score, "row_id long, y int, score double")


def feature_cuts(df: DataFrame) -> list[np.ndarray]:
    """For each feature the values that end its bins but the last: all values of a feature with up to BINS, else quantiles of the rows."""
    width = df.first()["features"].size
    cells = df.select(F.posexplode(vector_to_array("features")).alias("f", "x")).groupBy("f", "x").agg(F.count(F.lit(1)).alias("n"))
    points = [k / BINS for k in range(BINS + 1)]
    few = cells.groupBy("f").agg(F.count(F.lit(1)).alias("k"), F.percentile_approx("x", points, 10000).alias("q")).collect()  # a row a feature
    found = {r["f"]: r["q"] for r in few}
    many = sorted(r["f"] for r in few if r["k"] > BINS)
    if many:
        found |= df.agg(*(F.percentile_approx(vector_to_array("features")[f], points, 10000).alias(str(f)) for f in many)).first().asDict()
    return [np.unique(found.get(str(f)) or found[f])[:-1] for f in range(width)]


def _blocks(df: DataFrame, cuts: list[np.ndarray], rows: int) -> RDD:
    """The folded rows, dealt evenly over as many tasks as run at once, fewer if there are few."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, made, task = [], 0, TaskContext.get().partitionId()

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block.of(held, cuts, task << 20 | made))], pa.binary())], names=["block"])

        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= BLOCK:
                yield whole()
                held, made = [], made + 1
        if held:
            yield whole()

    folded = df.groupBy("features", F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("row_id"))  # the number takes the key's place
    tasks = max(1, min(-(-rows // TASK), df.sparkSession.sparkContext.defaultParallelism))
    return folded.repartition(tasks).mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


def _moved(own: list[Block], trees: list[Tree | None], shares: list[float], seed: int, turn: int) -> list[Block]:
    """Each setting's block; equal shares draw the same rows."""
    drawn = {share: own[0].draws(share, seed, turn) for share in dict.fromkeys(shares)}
    return [b.moved(tree, share, seed, turn, drawn[share]) for b, tree, share in zip(own, trees, shares)]


def _summed(blocks: RDD, asked: list[tuple], start: bool) -> list[np.ndarray]:
    """For each setting asked for (its place, splits and weights) the sums over all rows."""

    def plus(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [x + y for x, y in zip(a, b)]

    def add(part: Iterator[list[Block]]) -> Iterator[list[np.ndarray]]:
        total = None
        for own in part:
            found = [own[i].sums(*of, start) for i, *of in asked]
            total = found if total is None else plus(total, found)
        if total is not None:
            yield total

    made = blocks.mapPartitions(add)
    return reduce(plus, made.collect()) if blocks.getNumPartitions() * len(asked) <= DIRECT else made.treeReduce(plus)


def _split(sums: np.ndarray, features: np.ndarray, offsets: np.ndarray, min_rows: int) -> tuple[int, int] | None:
    """The bins that go right at the split of one node (3 x bins + 1) with the largest fall of squared error, if any lowers it."""

    def gains(right: np.ndarray) -> np.ndarray:
        left = sums[:, -1:] - right
        able = (right[0] >= min_rows) & (left[0] >= min_rows)
        out = np.full(right.shape[1], -np.inf)
        out[able] = (right[2, able] ** 2 / right[1, able] + left[2, able] ** 2 / left[1, able] - sums[2, -1] ** 2 / sums[1, -1]) / sums[1, -1]
        return out

    first, bins = offsets[features], offsets[features + 1] - offsets[features]
    best, low = np.full(len(features), -np.inf), first.copy()
    best[bins == 1] = gains(sums[:, first[bins == 1]])
    for i in np.flatnonzero(bins > 1):
        own = gains(np.cumsum(sums[:, first[i] : first[i] + bins[i]][:, ::-1], axis=1)[:, ::-1])
        best[i], low[i] = own.max(), first[i] + own.argmax()
    i = int(best.argmax())
    return (int(low[i]), int(first[i] + bins[i])) if best[i] > 1e-12 else None


@dataclass
class _Fit:
    """One setting: how its trees grow, those grown, and the levels of the one that grows."""

    depth: int
    rounds: int
    step: float
    min_rows: int
    share: float
    weights: tuple[float, float]
    rnd: np.random.Generator
    trees: list[Tree] = field(default_factory=list)
    splits: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    values: np.ndarray | None = None
    grown: list[int] = field(default_factory=list)

    def begin(self) -> None:
        self.splits, self.values, self.grown = [], None, [0]

    def grow(self, sums: np.ndarray, offsets: np.ndarray) -> None:
        """The next level, from the sums at its nodes."""
        if self.values is None:
            self.values = sums[2, :, -1] / np.maximum(sums[1, :, -1], 1e-300)
        width = len(offsets) - 1
        cut = {k: _split(sums[:, k], self.rnd.choice(width, int(np.ceil(self.share * width)), replace=False), offsets, self.min_rows) for k in self.grown}
        self.splits = [*self.splits, {k: at for k, at in cut.items() if at}]
        self.values, self.grown = _children(self.values, sums, self.splits[-1]), [2 * k + side for k in self.splits[-1] for side in (0, 1)]  # a leaf stays one

    def end(self) -> Tree:
        self.trees.append(Tree(self.splits, self.values * (self.step if self.trees else 1.0)))
        return self.trees[-1]


def fit_trees(df: DataFrame, depth: int = 4, rounds: int = 400, step: float = 0.05, min_rows: int = 8, share: float = 0.8, seed: int = 42) -> Trees:
    """Boosted trees with balanced weights of the classes; each round sees ``share`` of the rows and each split that share of the features.  df: features, y."""
    return fit_all(df, [{"depth": depth, "rounds": rounds, "step": step, "min_rows": min_rows, "share": share}], seed)[0]


def fit_all(df: DataFrame, grid: list[dict], seed: int = 42) -> list[Trees]:
    """What ``fit_trees`` gives for each setting (its parameters, and pos_weight: the weight of a positive to 1 of a negative), grown together."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    cuts = feature_cuts(df)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    balanced = (row["n"] / (2.0 * max(row["n"] - row["p"], 1)), row["n"] / (2.0 * max(row["p"], 1)))
    defaults = {"depth": 4, "rounds": 400, "step": 0.05, "min_rows": 8, "share": 0.8}
    fits = []
    for g in grid:
        own = dict(g)
        pos_weight = own.pop("pos_weight", None)
        fits.append(_Fit(**defaults | own, weights=balanced if pos_weight is None else (1.0, float(pos_weight)), rnd=np.random.default_rng(seed)))
    shares, kept, n = [f.share for f in fits], StorageLevel.MEMORY_AND_DISK, len(fits)
    blocks, last = _blocks(df, cuts, row["n"]).map(lambda b: [b] * n).persist(kept), [None] * n
    for turn in range(max(f.rounds for f in fits)):
        before, blocks = blocks, blocks.map(lambda own, last=last, turn=turn: _moved(own, last, shares, seed, turn)).persist(kept)
        if turn % KEPT == KEPT - 1:
            blocks.checkpoint()
        live = [i for i, f in enumerate(fits) if turn < f.rounds]
        for i in live:
            fits[i].begin()
        for level in range(max(fits[i].depth for i in live)):
            asked = [i for i in live if level < fits[i].depth and fits[i].grown]
            if not asked:
                break
            found = _summed(blocks, [(i, fits[i].splits, fits[i].weights) for i in asked], turn == 0)
            if level == 0:
                before.unpersist()
            for i, sums in zip(asked, found):
                fits[i].grow(sums, offsets)
        last = [f.end() if i in live else None for i, f in enumerate(fits)]
    blocks.unpersist()
    return [Trees(cuts, f.trees) for f in fits]


def tree_grid(train: DataFrame, valid: DataFrame, grid: list[dict], parallel: int = 4) -> DataFrame:
    """One row per setting with its validation metrics, for ``best_run``, as ``models.tree_grid``; all settings grow together, ``parallel`` are scored at once."""
    train, valid = train.persist(), valid.persist()
    trees = fit_all(train, grid)
    train.unpersist()

    def run(i: int) -> tuple[int, str, float, float]:
        scores = trees[i].scored_rows(valid).persist()
        metrics = average_precision(scores).crossJoin(roc_auc(scores)).first()  # two one-row frames
        scores.unpersist()
        return i, str(sorted(grid[i].items())), metrics["average_precision"], metrics["roc_auc"]

    with ThreadPool(min(parallel, len(grid))) as pool:
        found = pool.map(inheritable_thread_target(valid.sparkSession)(run), range(len(grid)))
    valid.unpersist()
    return valid.sparkSession.createDataFrame(found, "run int, params string, average_precision double, roc_auc double")


def _children(values: np.ndarray, sums: np.ndarray, cut: dict[int, tuple[int, int]]) -> np.ndarray:
    """The means at the nodes below; those of a node without split keep its own."""
    out = np.repeat(values, 2)
    for k, (low, high) in cut.items():
        right = sums[:, k, low:high].sum(axis=1)
        left = sums[:, k, -1] - right
        out[2 * k], out[2 * k + 1] = left[2] / left[1], right[2] / right[1]
    return out
