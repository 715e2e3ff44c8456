"""Repeated byte strings: every string of ``length`` bytes that also starts earlier goes, whole suffix buckets at a time.

A text is its UTF-8 bytes.  Places are ordered by doc_id, then by where they start; a byte is removed if a string of ``length``
bytes that covers it also starts at an earlier place, judged on the texts as they came.

Suffixes are told apart by their first ``length`` bytes, which is all that matters here.  They are never all gathered:

0. *Copies.*  Of equal whole texts (by SHA-256) all but the first go at once; what follows does without them.
1. *Cover.*  The places whose number, after a shift by document, lies in a difference cover modulo ``PERIOD`` are samples, about one in seven.  Any two equal
   strings have a sample at the same distance, less than ``PERIOD``, from their starts, whatever the numbers of those are.
2. *Ranks.*  A sample's rank is the 64-bit print of the ``length - PERIOD + 1`` bytes from it, which lie in both strings.  Samples are dealt to buckets by
   their rank and met there; those whose rank occurs once are done with.  Only places with a *shared* sample behind them can repeat: an eighth of the text
   in the tables at hand.
3. *Blocks.*  The suffixes of those places are dealt to buckets by the print of their first ``PERIOD - 1`` bytes.  Bucket after bucket is sorted by that print,
   long ties by the rank of what follows, then by place.  All but the first suffix of equal ones repeat.  ``blocks`` ranges of
   buckets go one after the other, so that only one range is on disk.
4. The places found are met by document, and the runs of bytes that they cover are merged.

Memory: a task holds a piece of text (``PIECE``; a longer text whole, hashed in parts), one bucket or one group of documents.  A print that a
piece holds many times is sent once, so a bucket has one entry for each piece and string, however often a string occurs.  Prints take part with 40 bits beside their bucket's
24, and suffixes with two such prints; the first only lets more places through, for the second two different strings of a bucket of a million meet once in 2**40 buckets.

Null texts are empty, and null doc_ids come last.  Rows that share a doc_id come in the order of their texts' hashes; of rows that repeat doc_id and text
one comes first, and the others repeat it.  Texts shorter than ``length`` bytes have no strings and stay.  A text of any length is one row.  Extra columns are not looked
at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import _BYTE, joined, mixed, pieces, power_table, read_table, released, scratch, stored, take_runs

LENGTH = 100
#: A perfect difference set: every difference modulo 57 but 0 occurs once.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
#: Bytes of text that a task works on at once, and hashes at once.
PIECE, HASHED = 6 << 20, 2 << 20
#: Samples (or suffixes) of a bucket, buckets of a task, and the most buckets.
BUCKET, BUCKETS_OF_TASK, MAX_BUCKETS = 400_000, 4, 1 << 24
#: Ranges of suffix buckets that go one after the other.
BLOCKS = 2
#: Suffixes that a task folds before it sends them.
SUFFIXES = 1_500_000
#: Copies of whole texts up to which every task holds their numbers (8 bytes each).
BROADCAST_COPIES = 1_000_000
#: Documents whose places are met together.
GROUP_BITS = 10
_LOW40 = np.uint64((1 << 40) - 1)


def pack(values: np.ndarray) -> bytes:
    """Differences of whole numbers, by byte planes of as many bytes as they need (4 or 8, told by the first byte), compressed."""
    steps = np.diff(values, prepend=0)
    small = not len(steps) or (steps.max() < 1 << 31 and steps.min() >= -1 << 31)
    planes = steps.astype(np.int32 if small else np.int64).view(np.uint8).reshape(len(steps), -1).T if len(steps) else steps
    return (b"\4" if small else b"\10") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    wide = packed[0]
    planes = np.frombuffer(pa.decompress(memoryview(packed)[1:], wide * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(wide, n).T).view(np.int32 if wide == 4 else np.int64).reshape(n), dtype=np.int64)


def pack40(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack40(packed: bytes) -> np.ndarray:
    low = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 5)
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, :5] = low
    return out.view(np.uint64).reshape(len(low))


def prints(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the ``length`` bytes from each place of ``at`` (ascending)."""
    out = np.empty(len(at), dtype=np.uint64)
    a = 0
    while a < len(at):
        base = int(at[a])
        b = int(np.searchsorted(at, base + HASHED))
        part = data[base : int(at[b - 1]) + length]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[part] * power_table(len(part))[: len(part)], out=sums[1:])
            s = at[a:b] - base
            out[a:b] = (sums[s + length] - sums[s]) * power_table(len(part), inverse=True)[s]
        a = b
    return mixed(out)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a print's upper 24 bits, in order of the print."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def in_order(keys: np.ndarray) -> np.ndarray:
    """Indexes by the upper bits of 64-bit keys, then by index: one sort of numbers that hold both, several times as fast as a stable one.

    Equal keys come in order of index, but keys that differ in their lower bits alone may stand between them."""
    bits = np.uint64(max(1, (len(keys) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    return (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)


def _slices(order: np.ndarray, groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, indexes) of each group, for an order in which groups ascend."""
    own = groups[order]
    edges = np.concatenate((np.flatnonzero(np.diff(own, prepend=own[0] - 1)), [len(own)])) if len(own) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(own[a]), order[a:b]


_PLACES = "team long, n long, ids binary, starts binary, lengths binary"


def _places(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray | None = None) -> dict[str, list]:
    """Runs of places, packed by team of documents."""
    out: dict[str, list] = {c: [] for c in ("team", "n", "ids", "starts", "lengths")}
    order = np.lexsort((starts, ids))
    for team, at in _slices(order, ids >> GROUP_BITS):
        for c, v in (("team", team), ("n", len(at)), ("ids", pack(ids[at])), ("starts", pack(starts[at])), ("lengths", None if lengths is None else pack(lengths[at]))):
            out[c].append(v)
    return out


def _asks(columns: dict[str, list], places: dict[str, list]) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets, beside rows of places that are known already, in small batches."""
    kinds = {"bucket": pa.int32(), "prints": pa.binary(), "more": pa.binary(), "team": pa.int64(), "n": pa.int64(), "ids": pa.binary(), "starts": pa.binary(), "lengths": pa.binary()}
    for own in (columns, places):
        rows = len(own["n"])
        own = {c: own.get(c, [None] * rows) for c in kinds}
        if own is not columns and rows and own["bucket"][0] is None:
            own["bucket"] = [int(t) & 0x7FFFFFFF for t in own["team"]]  # dealt like buckets, only passed on
        for a in range(0, rows, 256):
            yield pa.RecordBatch.from_arrays([pa.array(own[c][a : a + 256], kind) for c, kind in kinds.items()], names=list(kinds))


_ASKS = "bucket int, prints binary, more binary, " + _PLACES


def _by_bucket(asks: DataFrame, tasks: int, settle: Callable[[list[dict]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Places of the rows that ``settle`` picks from each bucket's rows, and the places known already."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            found = _places(*settle(held))
            for a in range(0, len(found["n"]), 256):
                yield pa.RecordBatch.from_arrays([pa.array(found[c][a : a + 256], pa.int64() if c in ("team", "n") else pa.binary()) for c in found], names=list(found))

        for batch in batches:
            known = batch.filter(pa.compute.is_valid(batch.column("team"))).select(["team", "n", "ids", "starts", "lengths"])
            if known.num_rows:
                yield known
            for row in batch.filter(pa.compute.is_null(batch.column("team"))).to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from done()
                    held = []
                held.append(row)
        if held:
            yield from done()

    return asks.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(work, _PLACES)


def _by_team(places: DataFrame, fold: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, pa.Array]], schema: str) -> DataFrame:
    """``fold`` over all places (ids, starts, lengths; sorted) of each team of documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        team = None

        def done() -> pa.RecordBatch:
            ids, starts, lengths = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((starts, ids))
            made = fold(ids[order], starts[order], lengths[order])
            return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

        for batch in batches:
            for row in batch.to_pylist():
                if held and team != row["team"]:
                    yield done()
                    held = []
                team, n = row["team"], row["n"]
                held.append((unpack(row["ids"], n), unpack(row["starts"], n), np.ones(n, np.int64) if row["lengths"] is None else unpack(row["lengths"], n)))
        if held:
            yield done()

    return places.repartition("team").sortWithinPartitions("team").mapInArrow(work, schema)


def _lists(ids: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    offsets = pa.array(np.append(first, len(ids)).astype(np.int32))
    return {"id": pa.array(ids[first])} | {c: pa.ListArray.from_arrays(offsets, pa.array(v)) for c, v in columns.items()}


def _samples(offsets: np.ndarray, shift: np.ndarray, length: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the samples of texts that start at ``offsets``, and the number of each one's document."""
    size = np.diff(offsets) - 1  # a line feed follows each text
    first = (np.array(COVER)[None, :] - shift[:, None]) % PERIOD
    n = np.where((size >= length)[:, None], np.maximum(0, (size[:, None] - depth - first) // PERIOD + 1), 0)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n.ravel(), n.ravel())
    there = np.zeros(int(offsets[-1]), dtype=bool)
    there[np.repeat((offsets[:-1, None] + first).ravel(), n.ravel()) + step * PERIOD] = True
    return np.flatnonzero(there), np.repeat(np.arange(len(size)), n.sum(axis=1))


def shared_samples(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """row and starts: the samples of each text whose rank another sample shares."""
    depth = length - PERIOD + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=PIECE):
            data, offsets = joined(batch.column("text"))
            rows, shift = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "shift"))
            at, doc = _samples(offsets, shift, length, depth)
            if not len(at):
                continue
            keys = prints(data, at, depth)
            ids, starts = rows[doc], at - offsets[doc]
            order = in_order(keys)
            own = keys[order]
            new = np.diff(own, prepend=~own[:1]) != 0
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(own))) > 1
            known = order[np.repeat(many, np.diff(np.append(first, len(own))))]
            once, several = np.sort(order[first[~many]]), order[first[many]]
            of = bucket_of(keys, buckets)
            both = dict(_slices(several[np.argsort(of[several], kind="stable")], of))
            out: dict[str, list] = {c: [] for c in ("bucket", "prints", "more", "n", "ids", "starts")}
            for bucket, x in _slices(once[np.argsort(of[once], kind="stable")], of):
                more = both.pop(bucket, np.zeros(0, np.int64))
                for c, v in (("bucket", bucket), ("prints", pack40(keys[x])), ("more", pack40(keys[more])), ("n", len(x)), ("ids", pack(ids[x])), ("starts", pack(starts[x]))):
                    out[c].append(v)
            for bucket, more in both.items():
                for c, v in (("bucket", bucket), ("prints", b""), ("more", pack40(keys[more])), ("n", 0), ("ids", None), ("starts", None)):
                    out[c].append(v)
            yield from _asks(out, _places(ids[known], starts[known]))

    def settle(held: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        once = np.concatenate([unpack40(r["prints"]) for r in held])
        more = np.concatenate([unpack40(r["more"]) for r in held])
        whole = np.concatenate((once, more))
        order = np.argsort(whole)
        first = np.flatnonzero(np.diff(whole[order], prepend=~whole[order[:1]]) != 0)
        times = np.add.reduceat(np.where(order < len(once), 1, 2), first) if len(first) else first
        shared = np.empty(len(whole), dtype=bool)
        shared[order] = np.repeat(times > 1, np.diff(np.append(first, len(whole))))
        shared = shared[: len(once)]
        at = [(unpack(r["ids"], r["n"]), unpack(r["starts"], r["n"])) for r in held if r["n"]]
        ids, starts = (np.concatenate(x) for x in zip(*at)) if at else (np.zeros(0, np.int64),) * 2
        return ids[shared], starts[shared]

    asks = texts.select("row", "shift", "text").mapInArrow(ask, _ASKS)
    found = _by_bucket(asks, max(1, buckets // BUCKETS_OF_TASK), settle)
    return _by_team(found, lambda ids, starts, lengths: _lists(ids, {"starts": starts}), "id long, starts array<long>").withColumnRenamed("id", "row")


def later_places(texts: DataFrame, length: int, buckets: int, low: int, high: int) -> DataFrame:
    """Places (ids: rank) where a string of a bucket from ``low`` to below ``high`` starts that also starts earlier."""

    def suffixes(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Prints of the first bytes and of those behind, document and start of the suffixes with a shared sample in reach."""
        data, offsets = joined(batch.column("text"))
        lists = batch.column("starts")
        doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        at = lists.flatten().to_numpy(zero_copy_only=False) + offsets[doc]
        first = np.maximum(at - PERIOD + 1, offsets[doc])
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(edge, first, 1)
        np.add.at(edge, np.maximum(np.minimum(at, offsets[doc + 1] - 1 - length) + 1, first), -1)
        at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int32) > 0)
        heads = prints(data, at, PERIOD - 1)
        of = bucket_of(heads, buckets)
        own = (of >= low) & (of < high)
        at, heads = at[own], heads[own]
        doc = np.searchsorted(offsets, at, side="right") - 1
        return heads, prints(data, at + PERIOD - 1, length - PERIOD + 1), batch.column("rank").to_numpy(zero_copy_only=False)[doc], at - offsets[doc]

    def sent(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        heads, tails, ids, starts = (np.concatenate(x) for x in zip(*held))
        # Documents by their numbers: places are in order then.
        edges = np.append(np.flatnonzero(np.diff(ids, prepend=~ids[:1]) != 0), len(ids))
        by_id = np.argsort(ids[edges[:-1]])
        order = take_runs(edges[:-1][by_id], np.diff(edges)[by_id])
        heads, tails, ids, starts = heads[order], tails[order], ids[order], starts[order]
        with np.errstate(over="ignore"):
            order = in_order(heads + tails * np.uint64(0x9E3779B97F4A7C15))
        first = np.ones(len(order), dtype=bool)  # where other keys stand between, one more is sent than need be
        first[1:] = (np.diff(heads[order]) != 0) | (np.diff(tails[order]) != 0)
        again, once = np.sort(order[~first]), np.sort(order[first])
        of = bucket_of(heads[once], buckets)
        out: dict[str, list] = {c: [] for c in ("bucket", "prints", "more", "n", "ids", "starts")}
        for bucket, at in _slices(np.argsort(of, kind="stable"), of):
            x = once[at]
            for c, v in (("bucket", bucket), ("prints", pack40(heads[x])), ("more", pack40(tails[x])), ("n", len(x)), ("ids", pack(ids[x])), ("starts", pack(starts[x]))):
                out[c].append(v)
        runs = np.flatnonzero((np.diff(starts[again], prepend=-2) != 1) | (np.diff(ids[again], prepend=-1) != 0))
        yield from _asks(out, _places(ids[again[runs]], starts[again[runs]], np.diff(np.append(runs, len(again)))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in pieces(batches, most=PIECE):
            held.append(suffixes(batch))
            if sum(len(x[0]) for x in held) >= SUFFIXES:
                yield from sent(held)
                held = []
        if held:
            yield from sent(held)

    def settle(held: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        heads, tails = (np.concatenate([unpack40(r[c]) for r in held]) for c in ("prints", "more"))
        ids, starts = (np.concatenate([unpack(r[c], r["n"]) for r in held]) for c in ("ids", "starts"))
        order = np.lexsort((starts, ids, tails, heads))
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (np.diff(heads[order]) == 0) & (np.diff(tails[order]) == 0)
        return ids[order[again]], starts[order[again]]

    return _by_bucket(texts.select("rank", "starts", "text").mapInArrow(ask, _ASKS), max(1, (high - low) // BUCKETS_OF_TASK), settle)


def _spans(length: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, pa.Array]]:
    def fold(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> dict[str, pa.Array]:
        ends = starts + lengths - 1 + length
        number = np.cumsum(np.diff(ids, prepend=ids[0]) != 0)
        wide = int(ends.max()) + 1
        reach = np.maximum.accumulate(number * wide + ends)
        new = np.ones(len(ids), dtype=bool)
        new[1:] = number[1:] * wide + starts[1:] > reach[:-1]
        new[1:] |= ids[1:] != ids[:-1]
        first = np.flatnonzero(new)
        return _lists(ids[first], {"first": starts[first], "end": np.append(reach[first[1:] - 1], reach[-1:]) - number[first] * wide})

    return fold


def repeated_spans(df: DataFrame, keep: Callable[[DataFrame], DataFrame], length: int = LENGTH, buckets: int | None = None, blocks: int = BLOCKS, broadcast_copies: int = BROADCAST_COPIES) -> tuple[DataFrame, DataFrame]:
    """The texts (row, doc_id, text) and, by row, the byte ranges to remove (first and end, arrays)."""
    if length < PERIOD + 8:
        raise ValueError(f"strings have {PERIOD + 8} bytes at least")
    text = F.coalesce("text", F.lit(""))
    shift = F.pmod(F.xxhash64("doc_id", F.lit("shift")), F.lit(PERIOD))
    texts = keep(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("body"), F.octet_length(text).cast("long").alias("n"), shift.alias("shift"), text.alias("text")))
    size = texts.agg(F.sum("n")).first()[0] or 0
    if buckets is None:
        buckets = min(MAX_BUCKETS, BUCKETS_OF_TASK * max(1, size * len(COVER) // PERIOD // BUCKET // BUCKETS_OF_TASK + 1))
    long = texts.where(F.col("n") >= length)
    order = (F.asc_nulls_last("doc_id"), F.asc("body"), F.asc("row"))
    # Numbers in the order of documents: partitions are ranges, and rows are sorted in each.
    ranks = keep(long.select("row", "doc_id", "body", "n").repartitionByRange(*order).sortWithinPartitions(*order).select("row", "body", "n", F.monotonically_increasing_id().alias("rank")))
    # A whole text that stands earlier goes, and holds no string that it does not hold.
    copies = keep(ranks.join(ranks.groupBy("body").agg(F.min("rank").alias("rank")).select("rank"), "rank", "left_anti").select("row", "n"))
    few = copies.count() <= broadcast_copies
    long = long.join(F.broadcast(copies.select("row")) if few else copies.select("row"), "row", "left_anti")
    shared = keep(shared_samples(long, length, buckets))
    released(df.sparkSession)
    near = keep(long.select("row", "text").join(shared.join(ranks.select("row", "rank"), "row"), "row").select("row", "rank", "starts", "text"))
    edges = [buckets * i // blocks for i in range(blocks + 1)]
    found = None
    for low, high in zip(edges, edges[1:]):
        if high > low:
            released(df.sparkSession)
            places = keep(later_places(near, length, buckets, low, high))
            found = places if found is None else found.unionByName(places)
    released(df.sparkSession)
    spans = _by_team(found, _spans(length), "id long, first array<long>, end array<long>").withColumnRenamed("id", "rank")
    whole = copies.select("row", F.array(F.lit(0).cast("long")).alias("first"), F.array("n").alias("end"))
    return texts, spans.join(ranks, "rank").select("row", "first", "end").unionByName(whole)


def remove_repeats(df: DataFrame, length: int = LENGTH, buckets: int | None = None, blocks: int = BLOCKS, digest: bool = False, broadcast_copies: int = BROADCAST_COPIES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and what is left of each text: its bytes (kept), or their SHA-256 (kept_sha256) if ``digest``.

    A cut may fall inside a character, so what is left is bytes, not text.
    """
    kept_kind, kept_name = (pa.string(), "kept_sha256") if digest else (pa.binary(), "kept")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=PIECE):
            data, offsets = joined(batch.column("text"))
            sizes = np.diff(offsets) - 1
            removed, kept = [], []
            body = memoryview(data)
            for a, n, first, end in zip(offsets[:-1].tolist(), sizes.tolist(), batch.column("first").to_pylist(), batch.column("end").to_pylist()):
                if first is None:
                    removed.append((0, 0))
                    left = body[a : a + n]
                else:
                    removed.append((sum(end) - sum(first), len(first)))
                    left = b"".join(body[a + x : a + y] for x, y in zip([0, *end], [*first, n]))
                kept.append(hashlib.sha256(left).hexdigest() if digest else bytes(left))
            gone, spans = (np.array([r[i] for r in removed], dtype=np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(gone), pa.array(spans), pa.array(kept, kept_kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", kept_name])

    with scratch(df.sparkSession) as keep:
        texts, spans = repeated_spans(df, keep, length, buckets, blocks, broadcast_copies)
        kind = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, {kept_name} {'string' if digest else 'binary'}"
        return stored(texts.join(spans, "row", "left").select("doc_id", "text", "first", "end").mapInArrow(make, kind))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)
