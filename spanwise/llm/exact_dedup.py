"""Exact dedup by a log-structured merge index of digests, in DataFrame functions only.

Rows come in batches.  A batch is a memtable: tasks fold it to one entry for each digest (the id that stays, the number of rows), and it is
flushed as a run, a table sorted by digest that is never written again, with a filter, a bitmap over its digests whose size follows the number
of digests that the index is meant for.  An entry can only have an equal in another run if some other run's filter has its bit: entries of one row whose bit no other filter
has are finished without meeting anything.  The others are compacted: runs of one level are merged, digest by digest, into a
run of the next once there are ``FANOUT`` of them, and each look-up merges what is left.  A merge keeps the id that stays.  An index can be
saved to a folder, opened there by a later session and fed more batches; what it holds already is not read again but by look-ups and merges.

Digests of two and more rows are groups, and their rows are hits.  Each hit is compared
byte by byte with the text of the row that stays; a row whose text differs (a digest collision) is
grouped by its whole text instead, so results are exact for any digest.

No group meets in one task: ids and counts are folded before the shuffle, and the comparison deals a group's rows
over as many salts as its size asks for, on every path.  Texts move only for hits, as long as the groups fit the bound
``broadcast_groups``; above it the texts are joined by a shuffle.

Texts are equal when identical after lower-casing A-Z.  Null texts count as empty.  A null doc_id stays
only if its group has no other id.  Rows that repeat a doc_id and a text count as rows of the group, and all of them are
marked as kept when that id stays: they are one document.  A text of any length is one row.  An empty table gives an empty
result.  Extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import cut, has_bit, read_table, scratch, stored

#: Rows of a group that are compared with the kept row's text under one salt.
SALT_ROWS = 500
#: Groups of two and more rows up to which each task holds them all (about 100 bytes each).
BROADCAST_GROUPS = 200_000
#: Batches that one table is fed in, and runs of a level that are merged into the next.
BATCHES, FANOUT = 5, 4
#: Bits of a filter for each digest: 1 in 16 or fewer entries without an equal get through.
BITS_A_DIGEST = 16
#: Bits of one bitmap row, and of the largest filter that each task holds whole (16 MB); a larger one is joined by its rows.
BUCKET_BITS, BROADCAST_BITS = 1 << 15, 1 << 27


def filter_bits(digests: int) -> int:
    """Size of the filters for so many digests: a power of two."""
    return max(BUCKET_BITS, 1 << max(0, digests * BITS_A_DIGEST - 1).bit_length())


class MergeIndex:
    """Runs of (digest, keep_id, n), by level, each with its filter.  Batches may be added at any time; older runs stay as they are.

    ``digests``: how many the index is meant for, which sizes the filters.  More of them only let more entries through.
    """

    def __init__(self, digests: int, largest: bool = True, fanout: int = FANOUT, keep: Callable[[DataFrame], DataFrame] = stored):
        self.bits, self.largest, self.fanout, self.keep = filter_bits(digests), largest, fanout, keep
        self.pick = F.max if largest else F.min
        self.levels: list[list[tuple[DataFrame, DataFrame]]] = []

    def save(self, folder: str) -> None:
        """Write runs and filters as two tables, a partition for each level and run, to a new folder."""
        for name, part in (("runs", 0), ("filters", 1)):
            tables = [run[part].withColumns({"level": F.lit(i), "run": F.lit(j)}) for i, level in enumerate(self.levels) for j, run in enumerate(level)]
            about = {"size": F.lit(self.bits), "largest": F.lit(self.largest), "fanout": F.lit(self.fanout)}
            for table in tables:  # appended one by one: each keeps its sorted files
                (table.withColumns(about) if part else table).write.mode("append").partitionBy("level", "run").parquet(f"{folder}/{name}")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, keep: Callable[[DataFrame], DataFrame] = stored) -> MergeIndex:
        """The index that was saved there; the folder is only read."""
        runs, filters = (spark.read.parquet(f"{folder}/{name}") for name in ("runs", "filters"))
        about = filters.select("size", "largest", "fanout").first()
        index = cls(0, about["largest"], about["fanout"], keep)
        index.bits = about["size"]
        for level, run in sorted(tuple(r) for r in filters.select("level", "run").distinct().collect()):  # fewer than fanout a level
            here = (F.col("level") == level) & (F.col("run") == run)
            index.levels.extend([] for _ in range(level + 1 - len(index.levels)))
            index.levels[level].append((runs.where(here).select("digest", "keep_id", "n"), filters.where(here).select("bucket", "bits")))
        return index

    @property
    def runs(self) -> list[tuple[DataFrame, DataFrame]]:
        return [run for level in self.levels for run in level]

    def add(self, rows: DataFrame) -> None:
        """Flush one batch of (doc_id, digest) as a run, and compact full levels."""
        self._flush(rows.groupBy("digest").agg(self.pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._merged([run for run, _ in self.levels[level]])
            self.levels[level] = []
            level += 1
            self._flush(merged, level)

    def _flush(self, entries: DataFrame, level: int) -> None:
        run = self.keep(entries.sortWithinPartitions("digest"))
        bits = run.select(self._bit().alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((run, self.keep(bits)))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("digest").agg(self.pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def groups(self) -> DataFrame:
        """digest, keep_id and n of all digests with two and more rows."""
        runs = self.runs
        through = []
        for i, (run, _) in enumerate(runs):
            others = [bits for j, (_, bits) in enumerate(runs) if j != i]
            if not others:
                through.append(run.where("n > 1"))
                continue
            either = reduce(DataFrame.unionByName, others).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))  # bits / 32768 rows
            if self.bits <= BROADCAST_BITS:
                either = F.broadcast(either)
            met = run.withColumn("bucket", F.bitmap_bucket_number(self._bit())).join(either, "bucket", "left")
            through.append(met.where((F.col("n") > 1) | has_bit(F.col("bits"), self._bit())).select("digest", "keep_id", "n"))
        return self._merged(through).where("n > 1")

    def _bit(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.bits))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def dedup_exact(df: DataFrame, largest: bool = True, digest_hex: int = 64, broadcast_groups: int = BROADCAST_GROUPS, batches: int = BATCHES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``largest``: the largest doc_id of a group stays, else the smallest.  ``digest_hex``: hex digits of the SHA-256
    digest that the index keys on (fewer only make more collisions to resolve).  ``batches``: memtables that the rows are
    fed in, by a hash.
    """
    pick = F.max if largest else F.min
    body = normalised(F.col("text"))
    sha = F.sha2(body.cast("binary"), 256)
    digest = F.substring("text_sha256", 1, digest_hex)
    batch = F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(batches))
    rows = stored(df.select("doc_id", sha.alias("text_sha256")).withColumn("batch", batch), by=("batch",)).withColumn("digest", digest)
    n_rows = rows.count()
    with scratch(df.sparkSession) as keep:
        index = MergeIndex(n_rows, largest, keep=keep)
        for i in range(batches):
            index.add(rows.where(F.col("batch") == i))  # a folder of its own
        groups = cut(index.groups().select("digest", "keep_id", F.col("n").alias("group_size")))
    if groups.count() <= broadcast_groups:
        single = rows.join(F.broadcast(groups.select("digest")), "digest", "left_anti")
    else:
        hot, cold = (groups.where(cond) for cond in _hot(n_rows))
        single = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold.select("digest"), "digest", "left_anti")
    single = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")

    texts = df.select("doc_id", sha.alias("text_sha256"), body.alias("body")).withColumn("digest", digest)
    if groups.count() <= broadcast_groups:
        texts = texts.join(F.broadcast(groups), "digest")
    else:
        texts = texts.join(F.broadcast(hot), "digest").unionByName(texts.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest"))
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), salts).cast("int"))
    kept = texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("body").alias("kept_body"), F.max(salts).alias("salts"))
    kept = kept.select("digest", "kept_body", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    same = F.col("body") == F.col("kept_body")
    hits = cut(salted.join(kept, ["digest", "salt"]).select("doc_id", "digest", "keep_id", "group_size", "text_sha256", same.alias("same"), F.when(~same, F.col("body")).alias("body")))

    other = hits.where("not same")
    if other.isEmpty():  # no digest stands for two texts: the groups are right as they are
        good = hits.select("doc_id", "keep_id", "group_size", "text_sha256")
        return _marked(single.unionByName(good))
    lost = other.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    good = hits.where("same").join(lost, "digest", "left").select("doc_id", "keep_id", (F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"), "text_sha256")
    regrouped = other.groupBy("digest", "body").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    moved = other.select("doc_id", "digest", "body", "text_sha256").join(regrouped, ["digest", "body"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    return _marked(single.unionByName(good).unionByName(moved))


def _hot(n_rows: int) -> tuple[Column, Column]:
    """Groups of more than a thousandth of all rows, fewer than a thousand, which tasks can always hold; and the others."""
    return F.col("group_size") > n_rows / 1000, F.col("group_size") <= n_rows / 1000


def _marked(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(read_table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
