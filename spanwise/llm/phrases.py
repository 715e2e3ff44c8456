"""Collocations: phrases of 2 to 4 words by how strongly their parts hold together, from a weighted de Bruijn graph.

A-Z are lower-cased; ``[.,;:!?\\x0A-\\x0D]`` part a text into pieces and ``[^\\x20\\x09]+`` are a piece's words.  All counts are per language (null:
``und``).  f(phrase) counts every contiguous occurrence inside pieces, overlaps included, and n all word occurrences.

Nodes of the graph are runs of three words, edges their overlaps: runs of four, weighted by how often they occur.

1. Hashed tables of saturating counters tell which grams can occur ``least`` times: first pairs of neighbouring words (``filter_slots``), then,
   where pairs pass, runs of three and four.  Pieces are cut where a pair can't be frequent: a phrase that counts lies inside one of the paths that
   are left, so its count is not touched.  Colliding grams only leave more.
2. Paths that occur several times in a task's batch are compacted to one, with a weight; words are numbered exactly, so equal means equal.
3. Each place of a path gives its longest gram that can be frequent: an edge of four words, or fewer.  Tasks fold these before the one shuffle by gram.
4. Shorter counts follow from node flow: a gram occurs as often as the longer ones that start with it, plus the places whose gram it is (path ends among them).
5. Level by level, a phrase joins its two nodes, the phrases without its last and its first word, and takes over their counts and those of
   their heads and tails: all its cuts.  A phrase inside a longer one that is nearly as frequent lies in one that has just one word more
   and is at least as frequent, so each level only looks at the next.  Each language's best are picked in two steps, so that no task sorts all of a language.

A filter's slots follow the text's bytes up to ``MAX_SLOTS``, where each task holds 128 MB and each of two broadcast bitmaps 16 MB; beyond, more grams pass and the
shuffle grows, with the same result.  Counts are added as 64-bit numbers and compared as decimals.

Null and empty texts have no words.  Repeated rows count as often as they are there.  A text of any length is one row.  Equal scores go by count, then by the
phrase's bytes.  Extra columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import Words, find_words, hot_join, mixed, pieces, read_table, scratch, stored, take_runs

LEAST, LONGEST, COVERED, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
#: Texts' bytes for each slot of the pair filter (about six pairs), and the most and fewest slots.
BYTES_PER_SLOT, MAX_SLOTS, MIN_SLOTS = 40, 1 << 27, 1 << 16
#: Ranges that the slots are added up by.
SLOT_RANGES = 64
#: Phrases up to which tasks hold all counts (about 100 bytes each) instead of joining by a shuffle.
BROADCAST_PHRASES = 200_000
BATCH_BYTES = 8 << 20
WORD = np.ones(256, dtype=bool)
WORD[[0x20, 0x09, *range(0x0A, 0x0E), *b".,;:!?"]] = False
ENDS = np.zeros(256, dtype=bool)
ENDS[[*range(0x0A, 0x0E), *b".,;:!?"]] = True


def _linked(words: Words) -> np.ndarray:
    """Is each word, but the last, followed by another one of its piece?"""
    ends = np.cumsum(ENDS[words.data], dtype=np.int32)[words.start]
    return ends[1:] == ends[:-1]


def _slots(words: Words, langs: pa.Array, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots of the pairs, triples and quadruples of words from each place that has as many behind it."""
    h = words.hashes()
    grams, own = [], h + _lang_hashes(langs)[words.doc]
    with np.errstate(over="ignore"):
        for k in range(1, LONGEST):
            own = mixed(own[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
            grams.append((own & np.uint64(slots - 1)).astype(np.int64))
    return tuple(grams)


def _has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return ((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    own = np.array([int.from_bytes(x.encode()[:8].ljust(8, b"\0"), "little") for x in coded.dictionary.to_pylist()] or [0], dtype=np.uint64)
    return mixed(own)[coded.indices.to_numpy(zero_copy_only=False)]


def filter_slots(texts: DataFrame, least: int, slots: int, pairs: np.ndarray | None = None) -> np.ndarray:
    """A bitmap of the slots whose grams occur ``least`` times (255 at most) or more together; ``slots`` is a power of two from 8.

    The grams are pairs of neighbouring words or, given the bitmap of those, the runs of three and four in which all pairs pass."""
    size = max(8, slots // SLOT_RANGES)  # a multiple of 8, as slots is
    shared = None if pairs is None else texts.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(slots, dtype=np.uint8)
        for batch in pieces(batches, most=BATCH_BYTES):
            words = find_words(batch.column("text"), WORD)
            if len(words.start) < 2:
                continue
            two, three, four = _slots(words, batch.column("lang"), slots)
            on = _linked(words)
            if shared is None:
                at = two[on]
            else:
                on &= _has(shared.value, two)
                at = np.concatenate((three[on[:-1] & on[1:]], four[on[:-2] & on[1:-1] & on[2:]]))
            at, n = np.unique(at, return_counts=True)
            seen[at] = np.minimum(seen[at].astype(np.int64) + n, 255).astype(np.uint8)
        for a in range(0, slots, size):
            if seen[a : a + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([a // size], pa.int32()), pa.array([pa.compress(seen[a : a + size].tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(pa.decompress(counts, size, codec="zstd", asbytes=True), dtype=np.uint8)
                total[part] = np.minimum(total.get(part, 0) + own.astype(np.uint16), least).astype(np.uint16)
        for part, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(counts >= least).tobytes()], pa.binary())], names=["part", "bits"])

    rows = texts.mapInArrow(count, "part int, counts binary").repartition(SLOT_RANGES, "part").mapInArrow(add, "part int, bits binary").collect()  # slots / 8 bytes
    bits = np.zeros(max(1, slots // 8), dtype=np.uint8)
    for r in rows:
        bits[r["part"] * size // 8 : (r["part"] + 1) * size // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def _numbered(words: Words, langs: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """A number for each word, by its language and bytes, and the languages and words of the numbers."""
    length = words.end - words.start
    inside = np.zeros(len(words.data) + 1, dtype=np.int8)
    inside[words.start] = 1
    inside[words.end] -= 1
    body = words.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(length) + 1, dtype=np.int64)
    np.cumsum(length, out=offsets[1:])
    coded = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
    lang = langs.dictionary_encode()
    own = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.doc]
    both = pa.array((own << 32) | coded.indices.to_numpy(zero_copy_only=False)).dictionary_encode()
    pairs = both.dictionary.to_numpy(zero_copy_only=False)
    return both.indices.to_numpy(zero_copy_only=False), lang.dictionary.take(pa.array(pairs >> 32)), coded.dictionary.take(pa.array(pairs & 0xFFFFFFFF))


def _paths(ids: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal sequences of words that go on, equal ones once: the words' numbers, where each path starts, how often it occurs, and the
    places of its words' first occurrence."""
    start = np.concatenate(([0], np.flatnonzero(~goes_on) + 1, [len(ids)])).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(start) - 1, [None, pa.py_buffer(start * 4), pa.py_buffer(np.ascontiguousarray(ids, dtype=np.int32))]).dictionary_encode()
    number = whole.indices.to_numpy(zero_copy_only=False)
    _, first = np.unique(number, return_index=True)  # numbers follow first occurrence
    length = start[first + 1] - start[first]
    at = take_runs(start[first], length)
    return ids[at], np.concatenate(([0], np.cumsum(length))), np.bincount(number, minlength=len(first)), at


def _grams(ids: np.ndarray, length: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of all places, ``length`` words from each (numbers, -1 behind its end), and the sums of their weights."""
    at = np.arange(len(ids))
    columns = np.full((LONGEST, len(ids)), -1, dtype=np.int64)
    for j in range(LONGEST):
        there = length > j
        columns[j, there] = ids[at[there] + j]
    low, high = (columns[0] << 32) | (columns[1] + 1), ((columns[2] + 1) << 32) | (columns[3] + 1)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    first = np.flatnonzero(new)
    return columns[:, order[first]], np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)


def longest_grams(texts: DataFrame, pairs: np.ndarray, runs: np.ndarray, slots: int) -> DataFrame:
    """lang, k, gram and n: the weighted edges (k is 4) and shorter grams (k below 4) of the texts' places."""
    context = texts.sparkSession.sparkContext
    shared_pairs, shared_runs = context.broadcast(pairs), context.broadcast(runs)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=BATCH_BYTES):
            words = find_words(batch.column("text"), WORD)
            if not len(words.start):
                continue
            two, three, four = _slots(words, batch.column("lang"), slots)
            on = _linked(words) & _has(shared_pairs.value, two)
            may = on[:-1] & on[1:] & _has(shared_runs.value, three)
            longest = np.ones(len(words.start), dtype=np.int8)
            longest[:-1] += on
            longest[:-2] += may
            if len(four):
                longest[:-3] += may[:-1] & may[1:] & _has(shared_runs.value, four)
            ids, langs, names = _numbered(words, batch.column("lang"))
            own, start, weight, at = _paths(ids, on)
            grams, n = _grams(own, longest[at], np.repeat(weight, np.diff(start)))
            parts = [names.take(pa.array(g, pa.int64(), mask=g < 0)) for g in grams]
            gram = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()), null_handling="skip")
            columns = [langs.take(pa.array(grams[0])).cast(pa.string()), pa.array((grams >= 0).sum(axis=0), pa.int32()), gram.cast(pa.string()), pa.array(n, pa.int64())]
            whole = pa.RecordBatch.from_arrays(columns, names=["lang", "k", "gram", "n"])
            yield from (whole.slice(a, 50_000) for a in range(0, len(whole), 50_000))

    found = texts.mapInArrow(make, "lang string, k int, gram string, n long")
    return found.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def _words(phrase: str, start: int, length: int | None = None) -> Column:
    words = F.split(phrase, " ")
    return F.array_join(F.slice(words, start, F.size(words) - (start - 1) if length is None else F.lit(length)), " ")


def node_flow(grams: DataFrame) -> DataFrame:
    """lang, k, phrase and f of all phrases of 1 to 4 words that lie on paths."""
    f = grams.where(F.col("k") == LONGEST).select("lang", "k", F.col("gram").alias("phrase"), F.col("n").alias("f"))
    levels = [f]
    for k in range(LONGEST - 1, 0, -1):
        through = f.select("lang", _words("phrase", 1, k).alias("phrase"), "f")
        ends = grams.where(F.col("k") == k).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("f"))
        f = through.unionByName(ends).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).select("lang", F.lit(k).alias("k"), "phrase", "f")
        levels.append(f)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def _looked_up(rows: DataFrame, part: str, nodes: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of the node that each row's ``part`` names."""
    own = nodes.withColumnRenamed("phrase", part)
    if few:
        return rows.join(F.broadcast(own), ["lang", part])
    key = F.struct("lang", part)
    sizes = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    given = own.select(key.alias("key"), *(c for c in own.columns if c not in ("lang", part))).join(sizes, "key")
    return hot_join(rows.withColumn("key", key), given, "key").drop("key")


def _level(counts: DataFrame, nodes: DataFrame, k: int, few: bool) -> DataFrame:
    """Phrases of k words with f and the counts of all their heads (shortest first) and tails (longest first)."""
    rows = counts.where(F.col("k") == k).select("lang", "phrase", "f", _words("phrase", 1, k - 1).alias("head"), _words("phrase", 2).alias("tail"))
    heads = nodes.select("lang", "phrase", F.concat("heads", F.array("f")).alias("heads"))
    tails = nodes.select("lang", "phrase", F.concat(F.array("f"), "tails").alias("tails"))
    return _looked_up(_looked_up(rows, "head", heads, few), "tail", tails, few).select("lang", "phrase", "f", "heads", "tails", "head", "tail")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, slots: int | None = None, broadcast_phrases: int = BROADCAST_PHRASES) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    lang = F.coalesce("lang", F.lit("und"))
    texts = docs.where(F.octet_length("text") > 0).select(lang.alias("lang"), "text")
    with scratch(docs.sparkSession) as keep:
        if slots is None:
            size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
            slots = min(MAX_SLOTS, max(MIN_SLOTS, 1 << (size // BYTES_PER_SLOT).bit_length()))
        pairs = filter_slots(texts, min(least, 255), slots)
        grams = keep(longest_grams(texts, pairs, filter_slots(texts, min(least, 255), slots, pairs), slots))
        # Every occurrence of a word starts one gram.
        total = grams.groupBy("lang").agg(F.sum("n").alias("n"))
        counts = keep(node_flow(grams).where(F.col("f") >= least))
        few = counts.count() <= broadcast_phrases
        none = F.array().cast("array<bigint>")
        nodes = counts.where("k = 1").select("lang", "phrase", "f", none.alias("heads"), none.alias("tails"))
        levels = []
        for k in range(2, LONGEST + 1):
            nodes = keep(_level(counts, nodes, k, few))
            levels.append(nodes)
        rows = None
        for level, above in zip(levels, [*levels[1:], None]):
            if above is not None:
                inside = above.select("lang", F.col("head").alias("phrase"), "f").unionByName(above.select("lang", F.col("tail").alias("phrase"), "f"))
                longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
                level = level.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * _exact("longer") < F.lit(COVERED) * _exact("f")))
            level = level.select("lang", "phrase", "f", "heads", "tails")
            rows = level if rows is None else rows.unionByName(level)
        score = f"(CAST(f AS DECIMAL(20,0)) * {SCALE}) div (CAST(heads[c] AS DECIMAL(20,0)) + tails[c])"
        cuts = F.expr(f"array_min(transform(sequence(0, size(heads) - 1), c -> named_struct('score', {score}, 'cut', c, 'l', heads[c], 'r', tails[c])))")
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), cuts.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
        order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(256)))
        near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        return stored(best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, k, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 :], ' ') AS tail FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c)),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, h.f AS l, t.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (h.f + t.f) AS BIGINT) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(w[i : i + j - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, k, j, unnest(generate_series(1, k - j + 1)) AS i FROM c, (SELECT unnest([2, 3]) AS j) WHERE j < k)),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY lang, phrase),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
