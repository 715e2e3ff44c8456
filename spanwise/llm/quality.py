"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy
whose probabilities are calibrated by a temperature.

Tokens are words of letters and digits (case kept), runs of ASCII punctuation, and one token of its own for every token
that repeats the one before it.  Each falls by hash into one of ``BUCKETS`` buckets; repeats have bucket 0 to themselves.

Random indexing: a bucket has a fixed sparse index vector (``SPARSE`` places of ``DIM`` with +1 or -1).  Its word vector is the sum
of the index vectors of all tokens up to two places away from it, over all texts of the training folds, labelled or not, at
length 1.  A document is the mean of its tokens' word vectors, and nothing else.  A two-layer network maps that to a
logit; one temperature, fitted on a part of the sample that the network has not seen, makes probabilities of it.

Context sums have a fixed size: each task sends its partial sums by blocks of buckets, which a shuffle adds up, and the driver gets
BUCKETS x DIM numbers.  Only the network's fit is bounded: ``sample`` labelled documents, picked by a hash of doc_id.  Scoring is a
map over all whole texts.

Labels: doc_ids whose crc32 as text modulo 5 is not 0, quality 0 or 1; several labels of one doc_id are averaged, and of several
texts of one labelled doc_id the one with the smallest XXH64 is learned from.  Null texts count as empty; an empty text gets the
score of zeros, and a text of any length is pooled whole.  Without labels of both kinds every score is the share of label 1 (1/2
without any).  Repeated rows are scored each by itself; an empty table gives an empty result.  Extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Words, fold_of, joined, own_first, packed, pieces, read_table, unpacked

BUCKETS, DIM, SPARSE = 1 << 14, 64, 4
#: Buckets whose sums travel together.
BLOCK = 256
#: Labelled documents that the network is fitted on, at most.
SAMPLE = 6_000
FOLDS, THRESHOLD = 5, 0.3

#: 1: words of letters and digits of either case; 2: ASCII punctuation.
_KIND = np.zeros(256, dtype=np.int8)
_KIND[0x21:0x7F] = 2
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of each bucket's index vector."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIM, (BUCKETS, SPARSE)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, SPARSE))


def tokens(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Each text's tokens, and their buckets."""
    data, offsets = joined(texts)
    kind = np.zeros(len(data) + 2, dtype=np.int8)
    kind[1:-1] = _KIND[data]
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    begins = np.flatnonzero(kind[edge + 1] > 0)  # the edge after it ends the run
    start = edge[begins]
    words = Words(data, start, edge[begins + 1] if len(begins) else start, np.searchsorted(start, offsets))
    h, doc = words.hashes(), words.doc
    bucket = (h % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
    bucket[again] = 0
    return words, bucket


def context_sums(words: Words, bucket: np.ndarray, index: tuple[np.ndarray, np.ndarray], into: np.ndarray) -> None:
    """Add to each bucket the index vectors of the tokens up to two places away in the same text."""
    place, sign = index
    doc = words.doc
    for step in (1, 2):
        here = np.flatnonzero(doc[step:] == doc[:-step])
        for a, b in ((here, here + step), (here + step, here)):
            x, y = bucket[a] * DIM, bucket[b]
            for j in range(SPARSE):
                into += np.bincount(x + place[y, j], sign[y, j], BUCKETS * DIM)


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows over each text's range."""
    n = np.diff(first)
    out = np.zeros((len(n), *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The mean of the word vectors of each text's tokens."""
    words, bucket = tokens(texts)
    pooled = np.zeros((len(texts), DIM))
    step = 1 << 18
    for a in range(0, len(bucket), step):  # bounded memory for one very long text
        first = np.clip(words.first, a, min(a + step, len(bucket))) - a
        pooled += _per_doc(vectors[bucket[a : a + step]], first)
    return pooled / np.maximum(words.counts, 1)[:, None]


@dataclass
class Network:
    """Two layers over standardised features; ``probability`` divides the logit by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 400, decay: float = 1e-3) -> Network:
    """Full-batch Adam on four fifths of the rows; the temperature on the last fifth."""
    share = float(y.mean()) if len(y) else 0.5
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    width = x.shape[1]
    if len(np.unique(y)) < 2 or len(y) < 10:
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), prior)
    rng = np.random.default_rng(11)
    order = rng.permutation(len(y))
    test, train = order[: len(y) // 5], order[len(y) // 5 :]
    net = Network(x[train].mean(axis=0), x[train].std(axis=0) + 1e-3, rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), prior)
    z, t = np.clip((x[train] - net.mean) / net.scale, -8, 8), y[train]
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        h = np.tanh(z @ params[0] + params[1])
        p = 1 / (1 + np.exp(-(h @ params[2] + params[3][0])))
        g = (p - t) / len(t)
        back = np.outer(g, params[2]) * (1 - h * h)
        grads = [z.T @ back + decay * params[0], back.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            params[i] -= 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logit, t = net.logit(x[test]), y[test]
    loss = lambda c: float(np.mean(np.logaddexp(0, logit / c) - t * logit / c))
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.network.probability(features(texts, self.vectors))


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The buckets' word vectors, from the contexts in all ``texts``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, into = index_vectors(), np.zeros(BUCKETS * DIM)

        def blocks() -> pa.RecordBatch:
            whole = into.astype(np.int32).reshape(-1, BLOCK * DIM)
            seen = np.flatnonzero(whole.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array([whole[i].tobytes() for i in seen], pa.binary())], names=["block", "sums"])

        for batch in pieces(batches):
            context_sums(*tokens(batch.column("text")), index, into)
            if max(into.max(), -into.min()) > 1 << 30:
                yield blocks()
                into[:] = 0
        yield blocks()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("sums")):
                have = total.setdefault(block, np.zeros(BLOCK * DIM, dtype=np.int64))
                have += np.frombuffer(part.as_buffer(), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "sums"])

    made = "block int, sums binary"
    vectors = np.zeros((BUCKETS // BLOCK, BLOCK * DIM), dtype=np.float64)
    for r in texts.select("text").mapInArrow(sums, made).repartition("block").mapInArrow(add, made).collect():  # BUCKETS / BLOCK rows
        vectors[r["block"]] = np.frombuffer(r["sums"], dtype=np.int64)
    vectors = vectors.reshape(BUCKETS, DIM)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)).astype(np.float32)


def fit_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """A model from the contexts of all texts of the training folds and at most ``sample`` of their labelled documents."""
    training = documents.where(fold_of(F.col("doc_id"), FOLDS) != 0).select("doc_id", "text")
    vectors = word_vectors(training)
    known = labels.where((fold_of(F.col("doc_id"), FOLDS) != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = training.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = features(batch.column("text"), vectors)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIM).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat, batch.column("y")], names=["doc_id", "x", "y"])

    schema = T.StructType([documents.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.IntegerType())])
    found = rows.mapInArrow(describe, schema).toPandas().sort_values("doc_id", kind="stable")  # at most ``sample`` rows
    x = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, DIM))
    return QualityModel(vectors, fit_network(x, found["y"].to_numpy(dtype=np.float64)))


MADE = ("score", "predicted")


def score_quality(df: DataFrame, model: QualityModel, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score (probability of label 1) and predicted (score >= threshold) of each row.  Kept columns with one of
    these names give way."""
    kept = own_first(keep, MADE)
    source = df.select(*dict.fromkeys((*kept, "text")))
    schema = T.StructType([*df.select(*kept).schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            p = model.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema=pa.schema([*(batch.schema.field(n) for n in kept), ("score", pa.float64()), ("predicted", pa.int32())]))

    return source.mapInArrow(score, schema)


def keep_good(df: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    whole = packed(df).select("row", F.col("row")["text"].alias("text"))
    return unpacked(score_quality(whole, model, threshold, ("row",)).where("predicted = 1"), df.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    scored = score_quality(documents, fit_quality(documents, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
