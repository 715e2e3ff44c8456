"""Benchmark decontamination by winnowing.

Every ``GRAM``-word gram of a text is hashed, and of each ``WINDOW`` consecutive grams the smallest hash
(the rightmost of equal ones) is kept as a fingerprint.  Any span of ``span = GRAM + WINDOW - 1`` words that
two texts share contains one whole window, whose choice depends on its words only: both texts keep the
same fingerprint there.  Joined fingerprints give the places to compare; from each, the hit is extended to the left and
right over equal words, and what is at least ``span`` words long counts.  Items shorter than ``span`` are looked up
whole.

Benchmarks are small beside a corpus.  While the index is at most ``broadcast_words`` words, every
task holds it and joins and extends in one pass over the documents: no shuffle.  Above that bound
fingerprints are joined with a shuffle, which gives each document its candidate items, at most ``CANDIDATES`` in
a row; the same extension then runs over a document and its candidates, and the spans of a document's rows are merged.
Both ways give the same result.  Words are found by 64-bit hashes; every hit is then compared byte by byte.

Nulls have no words.  Rows that repeat a doc_id are looked at each by itself; items that repeat an
item_id count as one.  An item without an item_id hits like any other, but adds nothing to the list of items.  An item
without words cannot occur.  A text of any length is one row.  Empty tables: no documents give no rows, no items give no hits.
Extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ALNUM, Words, cut, find_words, grams, hot_join, own_first, packed, pieces, read_table, stored, take_runs, unpacked

GRAM, WINDOW = 6, 5
#: Words of benchmark text up to which each task holds the whole index (24 bytes a word).
BROADCAST_WORDS = 2_000_000
#: Items that meet a document in one row above that bound.
CANDIDATES = 64


def winnow(hashes: np.ndarray, window: int, edge: np.ndarray) -> np.ndarray:
    """Places whose hash is the smallest, rightmost of equals, of some ``window`` neighbours.

    ``edge``: for each place, where the run of grams it belongs to ends; windows stay inside a run."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best = np.zeros(n, dtype=np.int64)
    least = hashes[:n].copy()
    for j in range(1, window):
        now = hashes[j : j + n]
        better = now <= least
        best[better] = j
        least = np.where(better, now, least)
    inside = np.arange(n) + window <= edge[:n]
    return np.unique((np.arange(n) + best)[inside])


class Prints:
    """Word hashes of many texts, and where each text's words begin."""

    def __init__(self, words: Words):
        self.words = words
        self.hash = words.hashes()
        self.first = words.first
        self.end = np.repeat(words.first[1:], words.counts)

    def selected(self, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Winnowed places and their gram hashes."""
        h = grams(self.hash, gram)
        at = winnow(h, window, self.end[: len(h)] - gram + 1)
        return at, h[at]

    def whole(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Every place of a ``size``-word gram inside one text, and its hash."""
        h = grams(self.hash, size)
        at = np.flatnonzero(np.arange(len(h)) + size <= self.end[: len(h)])
        return at, h[at]


class Index:
    """Items by fingerprint: winnowed grams of long items, whole grams of short ones."""

    def __init__(self, ids: list, texts: list[str | None], span: int):
        self.ids, self.span = ids, span
        self.window = span - GRAM + 1 if span > GRAM else 1
        self.gram = span - self.window + 1
        words = find_words(pa.array(texts, pa.string()), ALNUM)
        self.own = Prints(words)
        counts = words.counts
        self.item = words.doc
        at, h = self.own.selected(self.gram, self.window)
        order = np.argsort(h, kind="stable")
        self.long = h[order], at[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted(set(counts[(counts > 0) & (counts < span)].tolist())):
            at, h = self.own.whole(size)
            mine = counts[self.item[at]] == size
            at, h = at[mine], h[mine]
            order = np.argsort(h, kind="stable")
            self.short[size] = h[order], at[order]

    @staticmethod
    def _matches(at: np.ndarray, h: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        found = np.flatnonzero(hi > lo)
        many = hi[found] - lo[found]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(at[found], many), places[np.repeat(lo[found], many) + step]

    def spans(self, doc: Prints) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the documents' words: start and end of every maximal shared span, and the item's number."""
        mine, theirs = self._matches(*doc.selected(self.gram, self.window), *self.long)
        a, b, theirs = self._compared(doc, *self._extend(doc, mine, theirs))
        enough = b - a >= self.span
        out = [(a[enough], b[enough], self.item[theirs[enough]])]
        for size, (keys, places) in self.short.items():
            mine, theirs = self._matches(*doc.whole(size), keys, places)
            same = np.ones(len(mine), dtype=bool)
            for j in range(size):
                same &= doc.hash[mine + j] == self.own.hash[theirs + j]
            a, b, theirs = self._compared(doc, mine[same], mine[same] + size, theirs[same])
            whole = b - a == size
            out.append((a[whole], b[whole], self.item[theirs[whole]]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _compared(self, doc: Prints, a: np.ndarray, b: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The spans [a, b) of the documents' words and where they stand in the items, parted at words whose bytes differ."""
        n = b - a
        i, j = take_runs(a, n), take_runs(theirs, n)
        size, other = (w.end[k] - w.start[k] for w, k in ((doc.words, i), (self.own.words, j)))
        equal = size == other
        i, j, size = i[equal], j[equal], size[equal]
        differ = doc.words.data[take_runs(doc.words.start[i], size)] != self.own.words.data[take_runs(self.own.words.start[j], size)]
        equal[np.flatnonzero(equal)[np.repeat(np.arange(len(i)), size)[differ]]] = False
        if equal.all():
            return a, b, theirs
        owner = np.repeat(np.arange(len(a)), n)
        before = np.concatenate(([False], equal[:-1] & (owner[1:] == owner[:-1])))
        after = np.concatenate((equal[1:] & (owner[1:] == owner[:-1]), [False]))
        first, last = np.flatnonzero(equal & ~before), np.flatnonzero(equal & ~after)
        place = take_runs(a, n)
        return place[first], place[last] + 1, take_runs(theirs, n)[first]

    def _extend(self, doc: Prints, mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grow each pair of places over equal words, both ways, inside both texts: start and end of the documents' words, and start of the items'.

        Pairs on one diagonal stop where the next begins and are chained there, so no word is walked over twice."""
        if not len(mine):
            return mine, mine, theirs
        order = np.lexsort((mine, theirs - mine))
        mine, theirs = mine[order], theirs[order]
        chained = np.append(theirs[1:] - mine[1:] == theirs[:-1] - mine[:-1], False)
        limit = np.minimum(doc.end[mine], mine + self.own.end[theirs] - theirs)
        stop = np.where(chained, np.minimum(limit, np.append(mine[1:], 0)), limit)
        b = self._walk(doc, mine, theirs, stop - mine, 1)
        chained &= b == np.append(mine[1:], -1)
        first = np.flatnonzero(np.concatenate(([True], ~chained[:-1])))
        end = b[np.flatnonzero(~chained)]
        mine, theirs = mine[first], theirs[first]
        low = np.minimum(mine - doc.first[np.searchsorted(doc.first, mine, "right") - 1], theirs - self.own.first[np.searchsorted(self.own.first, theirs, "right") - 1])
        a = self._walk(doc, mine, theirs, low, -1)
        return a, end, theirs - (mine - a)

    def _walk(self, doc: Prints, mine: np.ndarray, theirs: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """The end of the equal words from each pair of places on (way 1), or their start (way -1), after ``most`` words at most."""
        step, live = np.zeros(len(mine), dtype=np.int64), np.flatnonzero(most > 0)
        while len(live):
            at = way * step[live] - (way < 0)
            live = live[doc.hash[mine[live] + at] == self.own.hash[theirs[live] + at]]
            step[live] += 1
            live = live[step[live] < most[live]]
        return mine + way * step

    def report(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int]], list]]:
        """For each text: its words, its hit spans (merged, from word 0), and the ids of occurring items."""
        words = find_words(texts, ALNUM)
        start, end, item = self.spans(Prints(words))
        doc = np.searchsorted(words.first, start, "right") - 1
        order = np.lexsort((end, start, doc))
        start, end, item, doc = start[order], end[order], item[order], doc[order]
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = []
        for d, n in enumerate(words.counts.tolist()):
            a, b = edge[d], edge[d + 1]
            merged: list[tuple[int, int]] = []
            for s, e in zip((start[a:b] - words.first[d]).tolist(), (end[a:b] - words.first[d]).tolist()):
                if merged and s <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                else:
                    merged.append((s, e))
            out.append((n, merged, [self.ids[i] for i in np.unique(item[a:b]).tolist()]))
        return out


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _sorted_ids(ids: list) -> list[str]:
    return sorted({str(i) for i in ids if i is not None})


def _rows(batch: pa.RecordBatch, keep: list[str], found: list) -> pa.RecordBatch:
    hit = [sum(b - a for a, b in spans) for _, spans, _ in found]
    made = [
        pa.array([n for n, _, _ in found], pa.int64()),
        pa.array(hit, pa.int64()),
        pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans, _ in found], _ARROW_SPAN),
        pa.array([_sorted_ids(ids) for _, _, ids in found], pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *made], names=[*keep, *MADE])


MADE = ("n_words", "n_hit", "spans", "items")


def find_contamination(documents: DataFrame, benchmark: DataFrame, span: int = GRAM + WINDOW - 1, keep: tuple[str, ...] = ("doc_id",), broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``keep`` columns, n_words, n_hit, spans (merged hit spans in words, end excluded) and items (sorted
    item_ids as strings) of every document.  Kept columns with one of these names give way."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    sized = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    kept = own_first(keep, MADE)
    source = documents.select(*dict.fromkeys((*kept, "text")))
    out = T.StructType([*documents.select(*kept).schema, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))])
    if sized <= 8 * broadcast_words:  # a bound on the index that each task holds
        rows = items.collect()
        ids, texts = [r["item_id"] for r in rows], [r["text"] for r in rows]

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(ids, texts, span)
            for batch in pieces(batches):
                yield _rows(batch, kept, index.report(batch.column("text")))

        return source.mapInArrow(look, out)
    return _by_shuffle(source.select(F.struct(*kept).alias("kept") if kept else F.struct(F.lit(0)).alias("kept"), "text"), items, span).select(*(F.col("kept").getField(c).alias(c) for c in kept), *MADE)


def _by_shuffle(source: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """The same for a benchmark of any size: fingerprints are joined by a shuffle, then each document meets its candidates."""
    window = span - GRAM + 1 if span > GRAM else 1
    gram = span - window + 1
    items = stored(items.select(F.monotonically_increasing_id().alias("key"), F.col("item_id").cast("string").alias("item_id"), "text"))
    lengths = items.select(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))).alias("n"))
    short = [r["n"] for r in lengths.where((F.col("n") > 0) & (F.col("n") < span)).distinct().collect()]  # fewer than span values

    def prints(only_own: bool):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                words = find_words(batch.column("text"), ALNUM)
                own, counts, doc = Prints(words), words.counts, words.doc
                at, h = own.selected(gram, window)
                found = [(doc[at], h, np.full(len(at), 0))]
                for size in short:
                    at, h = own.whole(size)
                    mine = counts[doc[at]] == size if only_own else np.ones(len(at), bool)
                    found.append((doc[at][mine], h[mine], np.full(int(mine.sum()), size)))
                row, h, size = (np.concatenate(x) for x in zip(*found))
                once = pa.table({"row": row, "print": h.view(np.int64), "size": size}).group_by(["row", "print", "size"]).aggregate([])
                yield pa.RecordBatch.from_arrays([batch.column("key").take(once["row"].combine_chunks()), once["print"].combine_chunks(), once["size"].combine_chunks().cast(pa.int32())], names=["key", "print", "size"])

        return emit

    numbered = stored(source.withColumn("key", F.monotonically_increasing_id()))
    made = "key long, print long, size int"
    # A passage that stands in a large part of all documents, or of which an item consists, is joined by hot_join.
    both = F.xxhash64("print", "size").alias("both")
    theirs = items.select("key", "text").mapInArrow(prints(True), made).groupBy(both).agg(F.collect_set("key").alias("items"))
    mine = stored(numbered.select("key", "text").mapInArrow(prints(False), made).select("key", both))
    theirs = cut(theirs.join(mine.groupBy("both").agg(F.count(F.lit(1)).alias("rows")), "both"))
    pairs = cut(hot_join(mine, theirs, "both").select("key", F.explode("items").alias("item")).distinct())
    chunk = F.floor((F.row_number().over(Window.partitionBy("key").orderBy("item")) - 1) / CANDIDATES).alias("chunk")
    named = items.select(F.col("key").alias("item"), "item_id", F.col("text").alias("item_text")).join(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("rows")), "item")
    given = hot_join(pairs.select("key", "item", chunk), cut(named), "item").groupBy("key", "chunk").agg(F.collect_list(F.struct("item_id", "item_text")).alias("candidates"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = []
            for i, mine in enumerate(batch.column("candidates").to_pylist()):
                index = Index([c["item_id"] for c in mine], [c["item_text"] for c in mine], span)
                found += index.report(batch.column("text").slice(i, 1))
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for _, x, _ in found], _ARROW_SPAN)
            yield pa.RecordBatch.from_arrays([batch.column("key"), spans, pa.array([_sorted_ids(x) for _, _, x in found], pa.list_(pa.string()))], names=["key", "spans", "items"])

    part = T.StructType([T.StructField("key", T.LongType()), T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))])
    met = given.join(numbered.select("key", "text"), "key").select("key", "text", "candidates").mapInArrow(look, part)
    whole = met.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Sorted spans are merged where they touch; a document has fewer of them than words.
    last = lambda done: F.element_at(done, -1)
    grown = lambda done, x: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], x["end"]).alias("end"))))
    merged = F.aggregate("spans", F.array().cast(_SPAN), lambda done, x: F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]), grown(done, x)).otherwise(F.concat(done, F.array(x))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(find_words(batch.column("text"), ALNUM).counts, pa.int64())], names=["key", "n_words"])

    counted = numbered.select("key", "text").mapInArrow(count, "key long, n_words long")
    spans = F.coalesce(merged, F.array().cast(_SPAN))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    joined = numbered.select("key", "kept").join(counted, "key").join(whole.withColumn("spans", spans), "key", "left")
    return joined.select("kept", "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The documents that share no benchmark window, with all their columns."""
    whole = packed(documents).select("row", F.col("row")["text"].alias("text"))
    return unpacked(find_contamination(whole, benchmark, keep=("row",), broadcast_words=broadcast_words).where(F.col("n_hit") == 0), documents.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
