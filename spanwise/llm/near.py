"""One document of each set of near copies: Jaccard similarity of five-word shingles of ``least`` or more.

Definition.  Documents are taken by doc_id; one goes if its similarity to an earlier document that stays is ``least`` or more.
So no two documents that stay are near copies, and each that goes is one of a document that stays.

1. A text is its set of shingles (64-bit hashes; A-Z lower-cased, words between ASCII white space; a text of fewer words is one
   shingle).  Equal sets are folded to one node, which stands at its smallest doc_id.
2. Candidates share a key: one of ``BANDS`` bands of ``ROWS`` MinHash values (a pair at 0.8 shares none in 7 of 100,000 cases), or a component
   of op8's trie join over SimHash fingerprints.
3. In ``ROUNDS`` rounds, a node that is the earliest under each of its keys stays.  It is compared with the others of its keys by their
   whole shingle sets, and the near copies go.  A round makes at most one pair per key and node, never all pairs of a group.
   What is left after a round and fits ``FEW_ROWS`` and ``FEW_SHINGLES`` is settled in order by one task, with the same result.
4. What does not fit falls into parts that share no key.  Tasks settle parts side by side, each in order.  Of a part that passes the bounds, its
   first nodes up to them are settled, then the rest is dealt into chunks that meet those that stay; what is left of it comes next.  So the steps
   follow the size of the largest part, not the number of texts under a key that are no near copies of each other.

Documents without a doc_id all stay and make none go.  Null and empty texts are one empty set, so the first of them stays.  Rows that
repeat doc_id and text stand or fall together; of rows that share a doc_id only, each has its own set.  A text of any length is one
set; an empty table stays empty.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .simhash import components, near_duplicates
from .text import SPACED, cut, find_words, grams, hot_join, mixed, packed, pieces, stored, unpacked

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
#: Rows (key and node) and shingles up to which one task settles what is left, or a part of it, in order.
FEW_ROWS, FEW_SHINGLES = 50_000, 2_000_000
#: Rounds before what is left is settled part by part: the first ones take most copies away.
ROUNDS = 2
#: What a task does with a node: holds it as one that stays, decides on it and holds it if it stays, or only decides.
STAYS, IN_ORDER, TESTED = 0, 1, 2
_rng = np.random.default_rng(5_080)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = find_words(texts, SPACED)
    hashes = words.hashes()
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        own = hashes[a:b]
        out.append(np.unique(grams(own, min(SHINGLE, b - a))) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def digest(shingles: np.ndarray) -> int:
    """64 bits that tell shingle sets apart."""
    with np.errstate(over="ignore"):
        whole = np.add.reduce(mixed(shingles + np.uint64(len(shingles)))) + np.uint64(len(shingles))
    return int(mixed(np.array([whole], dtype=np.uint64)).view(np.int64)[0])


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band: the hash of its ``ROWS`` MinHash values."""
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 1 << 12):  # bounded memory for one very long text
            part = shingles[a : a + (1 << 12)]
            low = np.minimum(low, ((part[None, :] * _TIMES[:, None] + _PLUS[:, None]) >> np.uint64(16)).min(axis=1))
        keys = np.arange(BANDS, dtype=np.uint64)
        for row in low.reshape(BANDS, ROWS).T:
            keys = mixed(keys + row)
    return keys.view(np.int64)


def sketches(df: DataFrame) -> DataFrame:
    """doc_id, body, node (digest of the shingle set), n (its size) and keys of each text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("body"), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
            ], names=["doc_id", "body", "node", "n", "keys"])

    long = T.LongType()
    kept = T.StructType([df.schema["doc_id"], T.StructField("body", long), T.StructField("node", long), T.StructField("n", long), T.StructField("keys", T.ArrayType(long))])
    return df.select("doc_id", "text", "body").mapInArrow(make, kept)


def _sets(df: DataFrame) -> DataFrame:
    """node and its shingles, sorted, as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return df.select("node", "text").mapInArrow(make, "node long, shingles binary")


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """The nodes (gone) whose shingles are near copies of first's."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for node, a, b in zip(*(batch.column(c).to_pylist() for c in ("gone", "x", "y"))):
                if alike(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64), least):
                    near.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64())], names=["gone"])

    return pairs.select("gone", "x", "y").mapInArrow(make, "gone long")


def _settled(rows: DataFrame, sets: DataFrame, least: float, whole: bool = False) -> DataFrame:
    """The nodes (gone) of groups of bounded size, by the definition: a task goes through a group in order.

    rows: node, lead, keys, grp and kind.  ``whole``: all rows are one group."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay: dict[int, list[int]] = {}
        held: dict[int, np.ndarray] = {}
        last = None
        for batch in batches:
            gone = []
            for grp, kind, node, keys, shingles in zip(*(batch.column(c).to_pylist() for c in ("grp", "kind", "node", "keys", "shingles"))):
                if grp != last:
                    stay, held, last = {}, {}, grp
                own = np.frombuffer(shingles, dtype=np.uint64)
                others = {i for k in keys for i in stay.get(k, ())} if kind != STAYS else ()
                if any(alike(own, held[i], least) for i in others if min(len(own), len(held[i])) >= least * max(len(own), len(held[i])) - 1e-9):
                    gone.append(node)
                elif kind != TESTED:
                    held[node] = own
                    for k in keys:
                        stay.setdefault(k, []).append(node)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], names=["gone"])

    met = rows.join(sets, "node")
    met = met.coalesce(1) if whole else met.repartition("grp")
    return met.sortWithinPartitions("grp", "kind", "lead", "node").select("grp", "kind", "node", "keys", "shingles").mapInArrow(make, "gone long")


def _parts(state: DataFrame) -> DataFrame:
    """node and part, of nodes that share a key with another: nodes of two parts share none."""
    first = cut(state.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    return components(hot_join(state, first, "key").select(F.col("first").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "part")


def _side_by_side(state: DataFrame, parts: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The nodes (gone) found by settling each part up to the bounds, and the state of those not yet settled."""
    nodes = state.groupBy("node", "lead", "n").agg(F.collect_list("key").alias("keys")).join(parts, "node")
    order = Window.partitionBy("part").orderBy("lead", "node")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.sum("n").over(upto) <= FEW_SHINGLES) & (F.sum(F.size("keys")).over(upto) <= FEW_ROWS)
    nodes = cut(nodes.withColumn("now", fits | (F.row_number().over(order) == 1)))
    now, rest = nodes.where("now"), nodes.where("not now")
    found = cut(_settled(now.select("node", "lead", "keys", F.col("part").alias("grp"), F.lit(IN_ORDER).alias("kind")), sets, least))
    large = cut(rest.groupBy("part").agg(F.greatest(F.ceil(F.sum("n") / max(FEW_SHINGLES, 1)), F.ceil(F.sum(F.size("keys")) / max(FEW_ROWS, 1))).cast("int").alias("chunks")))
    if large.isEmpty():
        return found, cut(state.limit(0))
    # A row for a part beyond the bounds, so fewer than the bounds go into what is left.
    stays = now.join(F.broadcast(large), "part").join(found.withColumnRenamed("gone", "node"), "node", "left_anti").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tested = rest.join(F.broadcast(large), "part").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    both = [df.select("node", "lead", "keys", F.struct("part", "chunk").alias("grp"), F.lit(kind).alias("kind")) for df, kind in ((stays, STAYS), (tested, TESTED))]
    more = cut(_settled(both[0].union(both[1]).withColumn("grp", F.xxhash64("grp.part", "grp.chunk")), sets, least))
    gone = found.union(more)
    return gone, cut(state.join(rest.select("node"), "node", "left_semi").join(more.withColumnRenamed("gone", "node"), "node", "left_anti").select("key", "node", "lead", "n"))


def near_copies(df: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and body (XXH64 of the text) of the documents that go."""
    docs = df.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("body"))
    made = stored(sketches(docs))
    nodes = stored(made.groupBy("node").agg(F.min("doc_id").alias("lead"), F.min("n").alias("n"), F.count(F.lit(1)).alias("rows")))
    banded = made.select("node", F.explode("keys").alias("key")).distinct()
    simhashed = near_duplicates(docs, keep=("doc_id", "body")).where("component_id is not null").select("doc_id", "body", F.xxhash64(F.lit("simhash"), "component_id").alias("key")).distinct()
    grouped = simhashed.join(made.select("doc_id", "body", "node").distinct(), ["doc_id", "body"]).select("node", "key").distinct()
    state = stored(banded.union(grouped))
    many = cut(state.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    state = stored(hot_join(state, many, "key").join(nodes.drop("rows"), "node").select("key", "node", "lead", "n"))
    # One text of each node that has a candidate; (doc_id, body) may occur more than once.
    wanted = state.select("node", F.col("lead").alias("doc_id")).distinct().join(made.select("doc_id", "body", "node"), ["node", "doc_id"]).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("body").alias("body"))
    sets = stored(_sets(docs.join(wanted, ["doc_id", "body"]).dropDuplicates(["doc_id", "body"])))
    gone: DataFrame | None = None
    parts: DataFrame | None = None
    for turn in itertools.count():
        rows = state.count()
        if not rows:
            break
        if rows <= FEW_ROWS and state.select("node", "n").distinct().agg(F.sum("n")).first()[0] <= FEW_SHINGLES:
            left = state.groupBy("node", "lead").agg(F.collect_list("key").alias("keys")).select("*", F.lit(0).alias("grp"), F.lit(IN_ORDER).alias("kind"))
            found = cut(_settled(left, sets, least, whole=True))
            gone = found if gone is None else gone.union(found)
            break
        if turn >= ROUNDS:
            parts = cut(_parts(state)) if parts is None else parts
            found, state = _side_by_side(state, parts, sets, least)
            gone = found if gone is None else gone.union(found)
            continue
        first = cut(state.groupBy("key").agg(F.min(F.struct("lead", "node", "n")).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
        met = cut(hot_join(state, first, "key"))
        settled = met.groupBy("node").agg(F.bool_and(F.col("first.node") == F.col("node")).alias("stays")).where("stays").select("node")
        settled = cut(settled)
        sizes = F.least("n", "first.n") >= least * F.greatest("n", "first.n") - 1e-9
        pairs = met.where((F.col("first.node") != F.col("node")) & sizes).select(F.col("first.node").alias("stays"), F.col("node").alias("gone")).distinct().join(settled.withColumnRenamed("node", "stays"), "stays")
        pairs = cut(pairs)
        given = pairs.groupBy("stays").agg(F.count(F.lit(1)).alias("rows")).join(sets.select(F.col("node").alias("stays"), F.col("shingles").alias("x")), "stays")
        pairs = hot_join(pairs, cut(given), "stays").join(sets.select(F.col("node").alias("gone"), F.col("shingles").alias("y")), "gone")
        found = cut(_alike(pairs, least).distinct())
        gone = found if gone is None else gone.union(found)
        state = cut(met.select("key", "node", "lead", "n").join(settled, "node", "left_anti").join(found.withColumnRenamed("gone", "node"), "node", "left_anti"))
    copies = hot_join(made.select("doc_id", "body", "node"), nodes.drop("n"), "node").where("doc_id > lead").select("doc_id", "body")
    if gone is None:
        return copies
    losers = cut(nodes.select("node", "rows").join(gone.withColumnRenamed("gone", "node").distinct(), "node"))
    return copies.union(hot_join(made.select("doc_id", "body", "node"), losers, "node").select("doc_id", "body"))


def keep_first_of_near(df: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that stay; all columns stay, under any name."""
    keyed = packed(df).select("row", F.col("row")["doc_id"].alias("doc_id"), F.col("row")["text"].alias("text"), F.xxhash64(F.col("row")["text"]).alias("body"))
    gone = near_copies(keyed, least).distinct()
    return unpacked(keyed.join(gone, ["doc_id", "body"], "left_anti"), df.columns)
