"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 bits: bit i is 1 if it is set in more than half of the XXH64 hashes of a text's word
shingles.  Two documents are linked when their fingerprints differ in at most ``bits`` bits.

Distinct fingerprints only take part in the join.  Each is dealt out once for every choice of ``blocks - bits``
of its ``blocks`` bit blocks: two linked fingerprints agree on at least one choice, so they meet under one key.
Under a key the fingerprints form a binary trie, which is joined with itself: pairs of nodes are walked down together
from (root, root), bit by bit; a pair whose paths differ in more than ``bits`` bits is dropped, and a pair that spans
few fingerprints is compared directly.  ``blocks`` grows with the number of fingerprints, so the tries stay
small.  Keys that hold more than ``TRIE_ROWS`` fingerprints (close copies in masses) are split into chunks, and every pair
of chunks is a trie of its own.

A trie's links leave the task as the edges of a spanning forest, never as all pairs of a group.  Connected
components come from rounds of large-star and small-star steps over those edges, each written to the checkpoint folder.

Joins on a node or a component whose rows may be a large part of all (a hub, a mass of close copies) go two ways: keys of more than
a thousandth of the rows, fewer than a thousand, are broadcast; the rest are shuffled.

Null and empty texts have fingerprint zero, which links like any other.  A null doc_id takes the component
of its fingerprint but is never its smallest id; a component without any id is null.  Rows that repeat a doc_id come out each with the
fingerprint of its own text; a text of any length is one fingerprint.  An empty table gives an empty result.  Extra columns may
have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import cut, hot_join, packed, pieces, read_table, unpacked

SEED = 42
#: Fingerprints under one key above which it is split into chunks of this many.
TRIE_ROWS = 2_048
#: Fingerprints walked at once in a task, and node pairs held at once.
WALK_ROWS, WALK_PAIRS = 65_536, 1 << 20
_ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of one text: A-Z lower-cased, words between ASCII white space, ``shingle``-word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    n = len(words) - shingle + 1
    for a in range(0, n, 1 << 16):  # bounded memory for one very long text
        b = min(n, a + (1 << 16))
        hashes = np.array([digest(whole[i:j], SEED) for i, j in zip(start[a:b].tolist(), end[a + shingle - 1 : b + shingle - 1].tolist())], dtype=np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    on = np.flatnonzero(2 * total > n)
    return sum(1 << int(i) for i in on)


def fingerprints(df: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and print: the fingerprint as a signed 64-bit number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prints = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(prints.view(np.int64))], names=[*keep, "print"])

    return df.select(*keep, "text").mapInArrow(make, T.StructType([*df.select(*keep).schema, T.StructField("print", T.LongType())]))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_pairs(prints: np.ndarray, group: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of fingerprints of one group that differ in at most ``bits`` bits.

    ``prints`` is sorted inside each group, and groups stand one after the other.  A node of depth d is a range of the array
    whose fingerprints share their first d bits; every group's root meets itself, and all tries are walked together.
    """
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    zeros = [None] * 64

    def middle(depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if zeros[depth] is None:
            off = (prints >> np.uint64(63 - depth)) & _ONE == 0
            zeros[depth] = np.concatenate(([0], np.cumsum(off)))
        return lo + zeros[depth][hi] - zeros[depth][lo]

    roots = np.flatnonzero(np.diff(edge) > 1)
    work = [(0, edge[roots], edge[roots + 1], edge[roots], edge[roots + 1], np.zeros(len(roots), dtype=np.int8))]
    while work:
        depth, a, b, c, d, diff = work.pop()
        few = ((b - a) * (d - c) <= 16) | (depth == 64)
        if few.any():
            yield from _compared(prints, a[few], b[few], c[few], d[few], bits)
            a, b, c, d, diff = (x[~few] for x in (a, b, c, d, diff))
        if not len(a):
            continue
        if len(a) > WALK_PAIRS:
            half = len(a) // 2
            work += [(depth, a[:half], b[:half], c[:half], d[:half], diff[:half]), (depth, a[half:], b[half:], c[half:], d[half:], diff[half:])]
            continue
        m, n = middle(depth, a, b), middle(depth, c, d)
        same = a == c
        sides = [(a, m, c, n, diff), (m, b, n, d, diff), (a, m, n, d, diff + 1), (m, b, c, n, diff + 1)]
        keep = [np.ones(len(a), bool), np.ones(len(a), bool), diff < bits, (diff < bits) & ~same]
        nxt = [np.concatenate([x[i][k] for x, k in zip(sides, keep)]) for i in range(5)]
        full = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
        work.append((depth + 1, *(x[full] for x in nxt)))


def _compared(prints: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    left, right = b - a, d - c
    size = left * right
    for at in range(0, len(a), 1 << 18):
        part = slice(at, at + (1 << 18))
        n = size[part]
        pair = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = a[part][pair] + step // right[part][pair]
        j = c[part][pair] + step % right[part][pair]
        near = (i < j) & (popcount(prints[i] ^ prints[j]) <= bits)
        yield i[near], j[near]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest node linked with it, directly or not."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            x, y = root[i], root[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def block_edges(blocks: int) -> list[int]:
    return [round(64 * i / blocks) for i in range(blocks + 1)]


def block_keys(print_: Column, blocks: int, bits: int) -> Column:
    """One key for each choice of ``blocks - bits`` blocks: the choice's number and the bits of its blocks, hashed."""
    edge = block_edges(blocks)
    part = [F.shiftrightunsigned(print_, 64 - edge[i + 1]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1)) for i in range(blocks)]
    choices = itertools.combinations(range(blocks), blocks - bits)
    return F.array(*(F.xxhash64(F.lit(k), *(part[i] for i in c)) for k, c in enumerate(choices)))


def link_edges(prints: DataFrame, bits: int = 4, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links between distinct fingerprints (column print)."""
    n = prints.count()
    blocks = bits + 1
    while blocks < 8 and n / 2 ** (64 * (blocks - bits) / blocks) > trie_rows:
        blocks += 1
    dealt = prints.select("print", F.explode(block_keys(F.col("print"), blocks, bits)).alias("key"))
    counts = dealt.groupBy("key").count().where(F.col("count") > trie_rows)
    large = cut(counts.withColumn("chunks", F.ceil(F.col("count") / trie_rows).cast("int")))
    hot = large.where(F.col("count") > n // 1000).select("key", "chunks")  # fewer than 1,000 for each choice of blocks
    rest = large.where(F.col("count") <= n // 1000).select("key", F.col("chunks").alias("more"))
    chunk = F.pmod(F.xxhash64("print", F.lit("chunk")), F.col("chunks")).cast("int")
    tries = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != chunk), lambda j: F.least(chunk, j).cast("long") * F.lit(1 << 20) + F.greatest(chunk, j) + 1)
    )
    split = dealt.join(F.broadcast(hot), "key", "left")
    if not rest.isEmpty():
        split = split.join(rest, "key", "left").select("print", "key", F.coalesce("chunks", "more").alias("chunks"))
    placed = split.select("print", "key", F.explode(tries).alias("trie"))
    placed = placed.select("print", F.xxhash64("key", "trie").alias("key"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            prints = value.view(np.uint64) if value.dtype != np.uint64 else value
            order = np.lexsort((prints, key))
            key, prints = key[order], prints[order]
            root = forest(len(prints), trie_pairs(prints, key, bits))
            linked = np.flatnonzero(root != np.arange(len(root)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(prints[linked].view(np.int64)), pa.array(prints[root[linked]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("key").to_numpy(), batch.column("print").to_numpy()))
            if sum(len(k) for k, _ in held) >= WALK_ROWS:
                key, value = (np.concatenate(x) for x in zip(*held))
                cut_at = int(np.searchsorted(key, key[-1], "left"))  # keys come in order; the last may go on
                yield from done(key[:cut_at], value[:cut_at])
                held = [(key[cut_at:], value[cut_at:])]
        if held:
            key, value = (np.concatenate(x) for x in zip(*held))
            yield from done(key, value)

    return placed.repartition("key").sortWithinPartitions("key").mapInArrow(walk, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has an edge (a, b)."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = _state(edges)
    while size[0]:
        both = edges.union(edges.select("b", "a"))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows")).select("a", F.least("a", "m").alias("m"), "rows"))
        large = hot_join(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b"))).where("a > b").distinct()
        large = cut(large)
        down = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows")))
        small = hot_join(large, down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        edges = cut(small)
        now = _state(edges)
        if now == size:
            break
        size = now
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(pairs.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def near_duplicates(df: DataFrame, shingle: int = 4, bits: int = 4, trie_rows: int = TRIE_ROWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links)."""
    docs = cut(fingerprints(df, shingle, keep))
    prints = cut(docs.groupBy("print").agg(F.min("doc_id").alias("least")))
    rooted = components(link_edges(prints.select("print"), bits, trie_rows))
    member = cut(prints.join(rooted, prints["print"] == rooted["node"], "left").select("print", "least", "root"))
    linked = member.where("root is not null")
    ids = cut(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows")))
    of_print = hot_join(linked.select("print", "root"), ids, "root").select("print", "component_id").unionByName(member.where("root is null").select("print", F.col("least").alias("component_id")))
    per_print = of_print.join(docs.groupBy("print").agg(F.count(F.lit(1)).alias("rows")), "print")
    return hot_join(docs, cut(per_print), "print").select(*keep, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(df: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """The documents that stand for their component (smallest doc_id), and those without a doc_id; all columns stay.

    Rows are told apart by doc_id and text, so of rows that share a doc_id only those go whose own text is linked to an earlier document."""
    keyed = packed(df).select("row", F.col("row")["doc_id"].alias("doc_id"), F.col("row")["text"].alias("text"), F.xxhash64(F.col("row")["text"]).alias("body"))
    found = near_duplicates(keyed, shingle, bits, keep=("doc_id", "body"))
    dropped = found.where("component_id < doc_id").select("doc_id", "body").distinct()
    return unpacked(keyed.join(dropped, ["doc_id", "body"], "left_anti"), df.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
