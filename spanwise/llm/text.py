"""Small helpers shared by the text operators: cutting Arrow batches by bytes, finding words and
hashing them with numpy, and telling which rows a model may learn from.

Words are byte classes.  Every byte of a non-ASCII character counts as part of a word, so the classes
``[^\\x20\\x09-\\x0D]+`` and ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` give the same words on UTF-8
bytes as on characters.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at once; a single longer text is a piece of its own.
PIECE_BYTES = 4 << 20
#: Bytes hashed at once inside a piece, so that one very long text needs bounded memory.
HASH_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of letters and digits, over lower-cased bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_rng = np.random.default_rng(20_240_611)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 40, 1 << 62, dtype=np.uint64)) | 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan dealt over all cores where it has fewer splits than half of them, such as one small file; else as they are.

    For maps whose work on a row costs far more than moving it.  df has to be a scan: counting its partitions runs any shuffles in it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def fold_of(column: Column, folds: int) -> Column:
    """crc32 of an id written as text, modulo ``folds``; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % folds


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder the session names in spark.checkpoint.dir; one of our own only in local mode where it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spanwise-checkpoint-")
        context.setCheckpointDir(folder)


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def packed(df: DataFrame) -> DataFrame:
    """One column, ``row``: a struct of all columns, so that no helper column can clash with one of the input's."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("row").getField(c).alias(c) for c in columns))


def own_first(keep: tuple[str, ...], made: tuple[str, ...]) -> list[str]:
    """The columns to keep beside an operator's own: where names are equal, the operator's column is the one that comes out."""
    return [c for c in dict.fromkeys(keep) if c not in made]


def has_bit(bits: Column, bit: Column) -> Column:
    """Does a bucket's bitmap (null: empty) hold the bit?"""
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def cut(df: DataFrame) -> DataFrame:
    """The frame's rows, written to the checkpoint folder: later steps start from those files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right, which has one row a key and, in ``rows``, the number of left's rows with it."""
    total = right.agg(F.sum("rows")).first()[0] or 0
    hot, rest = right.where(F.col("rows") > total / 1000).drop("rows"), right.where(F.col("rows") <= total / 1000).drop("rows")
    through = left.join(F.broadcast(hot), key)  # fewer than 1,000 rows
    return through.unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most`` bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def power_table(size: int, inverse: bool = False) -> np.ndarray:
    """Powers of the hash base, or of its inverse, modulo 2**64."""
    key = int(inverse)
    have = _powers.get(key)
    if have is None or len(have) < size:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        full = max(size, 1 << 16)
        with np.errstate(over="ignore"):
            out = np.full(full, np.uint64(base), dtype=np.uint64)
            out[0] = 1
            out = np.multiply.accumulate(out)
        _powers[key] = have = out
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """Words of many texts: where each starts and ends in ``data``, and where each text's words start."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words' bytes (polynomial over random byte values, then mixed)."""
        out = np.empty(len(self.start), dtype=np.uint64)
        a = 0
        while a < len(self.start):
            base = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, base + HASH_BYTES, side="right")))
            part = self.data[base : self.end[b - 1]]
            with np.errstate(over="ignore"):
                sums = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(_BYTE[part] * power_table(len(part))[: len(part)], out=sums[1:])
                s = self.start[a:b] - base
                out[a:b] = (sums[self.end[a:b] - base] - sums[s]) * power_table(len(part), inverse=True)[s]
            a = b
        return mixed(out)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a line feed after each, and where each starts; null counts as empty."""
    empty, feed = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
    whole = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), empty), empty, feed)
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def find_words(texts: pa.Array, kind: np.ndarray, lower: bool = True) -> Words:
    """The words of byte class ``kind`` in each text, in order; A-Z are lower-cased first if ``lower``."""
    data, offsets = joined(texts)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = kind[data]
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return Words(data, start, end, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` consecutive word hashes at each place (places that run past the end are dropped)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, size):
            out *= _MIX
            out += hashes[j : j + n]
    return mixed(out)


def take_runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes start[0], start[0]+1, ... for each run, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    at = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - at, length)


def with_rows(batch: pa.RecordBatch, names: list[str], columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """``names`` of the batch beside new columns, as ``schema`` has them."""
    have = {n: batch.column(batch.schema.get_field_index(n)) for n in names} | columns
    return pa.RecordBatch.from_arrays([pa.array(have[f.name], type=f.type) if not isinstance(have[f.name], pa.Array) else have[f.name].cast(f.type) for f in schema], schema=schema)


def stored(df: DataFrame, folder: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The frame's rows, written as Parquet to the shared checkpoint folder and read again: smaller than a
    checkpoint, and later steps read only the columns they use.  ``by``: columns whose values get folders of their own."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{folder or df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of tables that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Shuffle files of finished steps may go: Spark deletes them once the driver's collector sees that nothing refers to them, which takes a few turns."""
    gc.collect()
    for _ in range(6):
        spark._jvm.System.gc()
        time.sleep(0.4)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``stored`` for tables that nothing reads after the block: their folder is deleted at its end."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df: stored(df, folder)
    finally:
        discard(spark, folder)
