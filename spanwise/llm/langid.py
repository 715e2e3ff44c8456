"""Language identification by nearest centroids.

A text is the TF-IDF vector, at length 1, of its hashed letter n-grams (1 to 3 letters; all that is no letter counts as one
space).  Every language has up to ``CENTROIDS`` centroids, found by spherical k-means over its training texts, and
a text takes the language of the centroid with the largest cosine.  Each centroid also knows how close
its training texts come; a text farther away than all but a hundredth of them is marked as rejected.

Inverse document frequencies come from all training texts: tasks count, and BUCKETS numbers reach the driver.  Only the centroids are fitted on
a bounded sample, about ``PER_LANG`` texts of every language, picked by a hash of doc_id.  Their vectors are made by tasks and
clustered on the driver, one language at a time.  Prediction is a map over all whole texts.

Learned from: rows with text and lang whose crc32 of doc_id as text modulo 3 is not 1.  A null text or one without a letter is
``und`` with score 0, and so is every text when nothing can be learned.  Equally near languages: the first by name.  Repeated rows each count and
are each predicted; a text of any length is one vector; an empty table gives an empty result.  Extra columns may have any name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fold_of, own_first, pieces, read_table

BUCKETS = 4096
CENTROIDS = 3
#: Texts of each language that its centroids are fitted on (about).
PER_LANG = 800
FOLDS = 3
#: Rows turned into vectors at once.
ROWS = 1024
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and count of each text's n-grams; and which texts hold a letter."""
    n = len(texts)
    lowered = [(t or "").lower() for t in texts]
    code = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(n), np.fromiter(map(len, lowered), dtype=np.int64, count=n) + 1)
    code = np.where(letters()[code], code, 0).astype(np.uint64)
    stay = np.ones(len(code), dtype=bool)
    stay[1:] = (code[1:] != 0) | (code[:-1] != 0)
    code, doc = code[stay], doc[stay]
    found = []
    with np.errstate(over="ignore"):
        for size in (1, 2, 3):
            m = len(code) - size + 1
            if m <= 0:
                continue
            key = np.full(m, np.uint64(size))
            some = np.zeros(m, dtype=bool)
            for j in range(size):
                part = code[j : j + m]
                key = (key ^ part) * _MUL[j]
                key ^= key >> np.uint64(29)
                some |= part != 0
            some &= doc[:m] == doc[size - 1 :]
            found.append(doc[:m][some] * BUCKETS + (key[some] >> np.uint64(52)).astype(np.int64))
    cell = np.concatenate(found) if found else np.zeros(0, np.int64)
    total = np.bincount(cell, minlength=n * BUCKETS) if n * BUCKETS <= 1 << 24 else None
    if total is None:
        cell, count = np.unique(cell, return_counts=True)
    else:
        cell = np.flatnonzero(total)
        count = total[cell]
    has = np.zeros(n, dtype=bool)
    has[doc[code != 0]] = True
    return cell // BUCKETS, cell % BUCKETS, count, has


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF vectors of length 1 (tf is 1 + log count), one row for each text, and which texts hold a letter."""
    row, bucket, count, has = gram_counts(texts)
    x = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    x[row, bucket] = (1 + np.log(count)) * idf[bucket]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), has


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Up to k centroids of length 1 and each row's centroid; starts are farthest first, so the same rows give the same result."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(start) < min(k, len(x)):
        near = (x @ x[start].T).max(axis=1)
        nxt = int(np.argmin(near))
        if near[nxt] > 1 - 1e-6:
            break
        start.append(nxt)
    c = x[start].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                mean = x[own == j].mean(axis=0)
                c[j] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    return c, np.argmax(x @ c.T, axis=1)


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    lang_of: np.ndarray
    least: np.ndarray

    #: How sharply cosines become probabilities.
    sharp = 20.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is too far from all centroids."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        x, has = vectors(texts, self.idf)
        cosine = x @ self.centroids.T
        best = np.full((len(texts), len(self.langs)), -1.0)
        for j, lang in enumerate(self.lang_of.tolist()):
            best[:, lang] = np.maximum(best[:, lang], cosine[:, j])
        pick = np.argmax(best, axis=1)
        share = np.exp(self.sharp * (best - best.max(axis=1, keepdims=True)))
        score = np.where(has, (share / share.sum(axis=1, keepdims=True))[np.arange(len(texts)), pick], 0.0)
        far = ~(cosine >= self.least).any(axis=1) | ~has
        return [self.langs[p] if h else "und" for p, h in zip(pick.tolist(), has.tolist())], score, far


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the texts with a letter hold each bucket, and how many such texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in pieces(batches, most=2 << 20):
            for at in range(0, batch.num_rows, ROWS):
                _, bucket, _, has = gram_counts(batch.slice(at, ROWS).column("text").to_pylist())
                total[:-1] += np.bincount(bucket, minlength=BUCKETS)
                total[-1] += has.sum()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS + 1 rows
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    out[found["bucket"].to_numpy(int)] = found["n"]
    return out[:-1], int(out[-1])


def fit_languages(documents: DataFrame, per_lang: int = PER_LANG, k: int = CENTROIDS) -> LanguageModel:
    """A model from all texts of the training folds (frequencies) and about ``per_lang`` texts of each language (centroids)."""
    rows = documents.select("doc_id", "text", "lang").where((fold_of(F.col("doc_id"), FOLDS) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rates = rows.groupBy("lang").count().select("lang", (F.lit(float(per_lang)) / F.col("count")).alias("rate"))
    # A row a language.  The hash covers the text, so that one doc_id of many rows is sampled like others.
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    chosen = rows.join(F.broadcast(rates), "lang").where(share < F.col("rate")).select("doc_id", "lang", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row, bucket, count, has = gram_counts(part.column("text").to_pylist())
                edge = np.searchsorted(row, np.arange(part.num_rows + 1))
                packed = [(bucket[a:b].astype(np.uint16).tobytes(), count[a:b].astype(np.int64).tobytes()) for a, b in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([p for p, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())], names=["doc_id", "lang", "bucket", "n"])

    schema = T.StructType([documents.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("bucket", T.BinaryType()), T.StructField("n", T.BinaryType())])
    found = chosen.mapInArrow(describe, schema).toPandas()
    found = found[found["bucket"].map(len) > 0].sort_values(["lang", "doc_id", "bucket", "n"], kind="stable")
    if not len(found):
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((0, BUCKETS)), np.zeros(0, int), np.zeros(0))
    frequency, n_texts = document_frequencies(rows)
    idf = (np.log((1 + n_texts) / (1 + frequency)) + 1).astype(np.float32)
    names = sorted(found["lang"].unique())
    centroids, lang_of, least = [], [], []
    for i, (_, texts) in enumerate(found.groupby("lang", sort=True)):
        mine = np.zeros((len(texts), BUCKETS), dtype=np.float32)
        for row, (b, n) in zip(mine, zip(texts["bucket"], texts["n"])):
            at = np.frombuffer(b, np.uint16)
            row[at] = (1 + np.log(np.frombuffer(n, np.int64))) * idf[at]
        mine /= np.maximum(np.linalg.norm(mine, axis=1, keepdims=True), 1e-9)
        c, own = spherical_means(mine, k)
        for j in range(len(c)):
            near = (mine[own == j] @ c[j]) if (own == j).any() else np.ones(1)
            centroids.append(c[j])
            lang_of.append(i)
            least.append(np.quantile(near, 0.01))
    return LanguageModel(names, idf, np.stack(centroids), np.array(lang_of), np.array(least))


MADE = ("lang_pred", "score", "rejected")


def identify(df: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score and rejected of every row's whole ``text``.  Kept columns with one of these names give way."""
    kept = own_first(keep, MADE)
    source = df.select(*dict.fromkeys((*kept, "text")))
    schema = T.StructType([*df.select(*kept).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=2 << 20):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lang, score, far = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far)], names=[*kept, *MADE])

    return source.mapInArrow(predict, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    found = identify(documents, fit_languages(documents))
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
