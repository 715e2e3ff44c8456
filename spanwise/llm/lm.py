"""LM scoring with a Brown class-based bigram model.

P(word | previous word) = P(class | previous class) * P(word | class).

Classes.  Exchange clustering in two steps; every training word is clustered as itself.  1. The ``CORE`` most frequent words and the end of
a text are clustered by exchange over their bigram counts, a matrix of fixed size: in each sweep every word moves to the class that
raises the likelihood of the class bigrams most.  2. All words, however rare, are swept over by tasks: a word's contexts are counted by the
core classes of its neighbours (one more class stands for neighbours outside the core), and ``SWEEPS`` times every word moves
to the class that raises the likelihood of the table classes x contexts most.  Only that table goes to the driver and to the tasks.

Probabilities.  Class transitions come from all training bigrams, with ``SMOOTH_CLASS`` added.  Word emissions come from
exact counts of every training word, with 0.1 added to each known word of the class and to one unknown: a word of count c in a
class of N tokens and V words has (c + 0.1) / (N + 0.1 (V + 1)).  Words that training lacks belong to the class with the most words of count 1.

Work.  1. Words are counted (tasks count first; one shuffle by word).  2. Core bigrams are counted.  3. Contexts leave the tasks by word and
block of tokens, folded to a fixed size where a word is frequent, and meet by word.  4. All texts are mapped to classes.  Tasks know
the ``FREQUENT`` most frequent words; others leave as posting lists, one for each word and block, which meet the words' table by a
shuffle on the word and come back to their block by a shuffle on the block.  No word is hot there: the frequent ones never enter it.
5. Class transitions are counted from the texts of classes, a byte a token, and the texts are scored.

Words are known by 64-bit hashes.  Learned from: documents whose crc32 of doc_id as text modulo 10 is not 0; a
null doc_id is neither learned from nor held out, and doc_ids can be of any simple type.  Null and empty texts count as one token, the end; a very long text is a block of
its own.  Repeated rows each count and are each scored.  Without training documents all words are unknown; an empty table gives an
empty result.  Extra columns may have any name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .text import SPACED, find_words, fold_of, pieces, read_table, scratch, stored, take_runs

CORE, CLASSES = 1024, 32
CORE_SWEEPS, SWEEPS = 8, 2
#: Words whose class and count every task holds (17 bytes each).
FREQUENT = 100_000
SMOOTH_WORD, SMOOTH_CLASS = 0.1, 0.5
FOLDS = 10
#: Tokens of one block, unless a single text has more.
BLOCK_TOKENS = 2_000_000
#: Contexts of a word in a block that leave one by one; more are folded to counts.
LOOSE = 512
#: The end of a text, counted as a word.  Its hash can't be told from a word's with that hash.
END = np.int64(-0x5DEECE66D1234567)
#: Codes of contexts: the class of the next word (CLASSES: outside the core), then the class of the word before.
CODES = 2 * (CLASSES + 1)
_UNKNOWN = 255


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's words, then of its end, one text after the other; and how many tokens each text has."""
    words = find_words(texts, SPACED)
    out = np.full(len(words.start) + len(texts), END, dtype=np.int64)
    out[np.arange(len(words.start)) + words.doc] = words.hashes().view(np.int64)
    return out, words.counts + 1


def count_words(training: DataFrame) -> DataFrame:
    """word (hash) and n of every word of the training texts, and of the end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def folded() -> pa.Table:
            return pa.concat_tables(held).group_by(["word"]).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in pieces(batches):
            word, n = np.unique(token_hashes(batch.column("text"))[0], return_counts=True)
            held.append(pa.table({"word": word, "n": n}))
            rows += len(word)
            if rows > 1_000_000:
                whole = folded()
                if whole.num_rows > 500_000:  # bounded memory: what is counted so far goes out
                    yield from whole.to_batches(max_chunksize=65_536)
                    held, rows = [], 0
                else:
                    held, rows = [whole], whole.num_rows
        if held:
            yield from folded().to_batches(max_chunksize=65_536)

    return training.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Values of a bounded number of words, by sorted hash."""

    word: np.ndarray
    value: np.ndarray

    def place(self, word: np.ndarray) -> np.ndarray:
        """The place of each word here, or -1."""
        if not len(self.word):
            return np.full(len(word), -1, dtype=np.int64)
        at = np.searchsorted(self.word, word)
        at[at == len(self.word)] = 0
        return np.where(self.word[at] == word, at, -1)

    def of(self, word: np.ndarray, missing: int) -> np.ndarray:
        at = self.place(word)
        return np.where(at >= 0, self.value[at], missing) if len(self.word) else np.full(len(word), missing)


def shifted(x: np.ndarray, first) -> np.ndarray:
    """What stands before each token; before the first text stands the end of a text."""
    return np.concatenate(([first], x[:-1])).astype(x.dtype)


def count_bigrams(training: DataFrame, core: np.ndarray) -> np.ndarray:
    """Bigram counts of the core words and the end (all sorted) over all training texts: a matrix of fixed size."""
    size = len(core) + 1  # one more for all other words
    table = Table(core, np.arange(len(core)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        end = int(table.of(np.array([END]), size - 1)[0])
        for batch in pieces(batches):
            unit = table.of(token_hashes(batch.column("text"))[0], size - 1)
            pair = shifted(unit, end) * size + unit
            pair, n = np.unique(pair[(unit < size - 1) & (pair < (size - 1) * size)], return_counts=True)
            total[pair] += n
        seen = np.flatnonzero(total)
        if len(seen):
            yield from pa.table({"pair": seen, "n": total[seen]}).to_batches(max_chunksize=65_536)

    found = training.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(size * size)
    matrix[found["pair"].to_numpy()] = found["n"].to_numpy()
    return matrix.reshape(size, size)[:-1, :-1]


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = CORE_SWEEPS) -> np.ndarray:
    """Each unit's class: starts by frequency, then moves every unit to its best class until none moves."""
    size = len(bigrams)
    order = np.argsort(-(bigrams.sum(axis=0) + bigrams.sum(axis=1)), kind="stable")
    own = np.empty(size, dtype=np.int64)
    own[order] = np.arange(size) % classes
    belongs = np.zeros((size, classes))
    belongs[np.arange(size), own] = 1
    table = belongs.T @ bigrams @ belongs
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            here = own[u]
            self_count = bigrams[u, u]
            after, prior = bigrams[u] @ belongs, bigrams[:, u] @ belongs
            after[here] -= self_count
            prior[here] -= self_count
            if not after.any() and not prior.any() and not self_count:
                continue
            table[here] -= after
            table[:, here] -= prior
            table[here, here] -= self_count
            diagonal = np.diag(table)
            gain = (f(table + after) - f(table)).sum(axis=1) + (f(table + prior[:, None]) - f(table)).sum(axis=0)
            gain -= f(diagonal + after) - f(diagonal) + f(diagonal + prior) - f(diagonal)
            gain += f(diagonal + after + prior + self_count) - f(diagonal)
            left, right = table.sum(axis=1) + prior, table.sum(axis=0) + after  # margins with the unit's pairs, but for its own row and column
            gain -= f(left + after.sum() + self_count) - f(left) + f(right + prior.sum() + self_count) - f(right)
            best = int(np.argmax(gain))
            if gain[best] <= gain[here] + 1e-9:
                best = int(here)
            moved += best != here
            belongs[u, here], own[u] = 0, best
            belongs[u, best] = 1
            table[best] += after
            table[:, best] += prior
            table[best, best] += self_count
        if not moved:
            break
    return own


def token_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """Token hashes, tokens of each row, and the rows, for blocks of about BLOCK_TOKENS tokens."""
    held: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]] = []
    size = 0

    def block() -> tuple[np.ndarray, np.ndarray, pa.Table]:
        return np.concatenate([h for h, _, _ in held]), np.concatenate([n for _, n, _ in held]), pa.Table.from_batches([r for _, _, r in held])

    for batch in pieces(batches, most=2 << 20):
        own, n = token_hashes(batch.column("text"))
        if held and size + len(own) > BLOCK_TOKENS:
            yield block()
            held, size = [], 0
        held.append((own, n, batch.drop_columns(["text"])))
        size += len(own)
    if held:
        yield block()


def word_contexts(training: DataFrame, core: Table) -> DataFrame:
    """word, n, and its contexts: codes (a byte each) and how often each occurs (counts, 64-bit)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, _, _ in token_blocks(batches):
            own = core.of(word, CLASSES)
            right, left = np.roll(own, -1), np.roll(own, 1) + CLASSES + 1  # an end stands before each text's first word
            order = np.argsort(word, kind="stable")
            word = word[order]
            edge = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            n = np.diff(np.append(edge, len(word)))
            both = np.stack([right[order], left[order]], axis=1).astype(np.uint8)
            few = 2 * n <= LOOSE
            inside = np.repeat(few, n)
            offsets = np.concatenate(([0], np.cumsum(2 * n[few]))).astype(np.int32)
            loose = pa.Array.from_buffers(pa.binary(), int(few.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(both[inside]))])
            yield from pa.table({"word": word[edge][few], "folded": np.zeros(int(few.sum()), dtype=bool), "codes": loose}).to_batches(max_chunksize=65_536)
            many = np.flatnonzero(~few)
            for a in range(0, len(many), 1024):
                part = many[a : a + 1024]
                counts = [np.bincount(both[edge[i] : edge[i] + n[i]].ravel(), minlength=CODES).astype(np.int64).tobytes() for i in part]
                yield pa.RecordBatch.from_arrays([pa.array(word[edge[part]]), pa.array(np.ones(len(part), dtype=bool)), pa.array(counts, pa.binary())], names=["word", "folded", "codes"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def packed(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            at = np.append(edge, len(word)).astype(np.int32)
            codes = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(at), pa.py_buffer(code.astype(np.uint8))])
            counts = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(at * 8), pa.py_buffer(np.ascontiguousarray(n))])
            occurs = np.add.reduceat(np.where(code <= CLASSES, n, 0), edge)
            yield from pa.table({"word": word[edge], "n": occurs, "codes": codes, "counts": counts}).to_batches(max_chunksize=16_384)

        for batch in batches:
            if not batch.num_rows:
                continue
            word, folded = batch.column("word").to_numpy(), batch.column("folded").to_numpy(zero_copy_only=False)
            raw, length = _bytes(batch.column("codes"))
            inside = np.repeat(folded, length)
            dense = np.frombuffer(raw[inside].tobytes(), dtype=np.int64)
            loose = np.repeat(word[~folded], length[~folded])
            words = np.concatenate((held[0], loose, np.repeat(word[folded], CODES)))
            codes = np.concatenate((held[1], raw[~inside].astype(np.int64), np.tile(np.arange(CODES), int(folded.sum()))))
            n = np.concatenate((held[2], np.ones(len(loose), dtype=np.int64), dense))
            words, codes, n = (x[n > 0] for x in (words, codes, n))
            order = np.lexsort((codes, words))
            words, codes, n = words[order], codes[order], n[order]
            edge = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (codes[1:] != codes[:-1]))))
            words, codes, n = words[edge], codes[edge], np.add.reduceat(n, edge)
            cut_at = int(np.searchsorted(words, words[-1], "left"))  # words come in order; the last may go on
            if cut_at:
                yield from packed(words[:cut_at], codes[:cut_at], n[:cut_at])
            held = words[cut_at:], codes[cut_at:], n[cut_at:]
        if len(held[0]):
            yield from packed(*held)

    made = training.select("text").mapInArrow(emit, "word long, folded boolean, codes binary")
    return made.repartition("word").sortWithinPartitions("word").mapInArrow(fold, "word long, n long, codes binary, counts binary")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the length of each value."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], np.diff(offsets)


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(first: np.ndarray, code: np.ndarray, n: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood of the table (classes x codes) most.

    Word i has contexts code[first[i]:first[i + 1]], each n times; own is its class now (-1: none), which the table counts."""
    edge = first[:-1]
    size = table[:, : CLASSES + 1].sum(axis=1)
    total = np.add.reduceat(np.where(code <= CLASSES, n, 0), edge).astype(np.float64)
    cell = table.T[code]
    gain = np.add.reduceat(_gain(cell + n[:, None]) - _gain(cell), edge, axis=0) - 2 * (_gain(size + total[:, None]) - _gain(size))
    has = np.flatnonzero(own >= 0)
    if len(has):
        word = np.repeat(np.arange(len(own)), np.diff(first))
        mine = table[np.maximum(own[word], 0), code]
        stay = np.add.reduceat(_gain(mine) - _gain(np.maximum(mine - n, 0)), edge) - 2 * (_gain(size[own]) - _gain(np.maximum(size[own] - total, 0)))
        gain[has, own[has]] = stay[has]
    return np.argmax(gain, axis=1)


def _assigned(batch: pa.RecordBatch, core: Table, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """contexts of the batch's words (first, code, n) and their classes after the sweeps over ``tables``."""
    code, length = _bytes(batch.column("codes"))
    n = np.frombuffer(_bytes(batch.column("counts"))[0].tobytes(), dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(length)))
    own = core.of(batch.column("word").to_numpy(), -1)
    for table in tables:
        own = best_classes(first, code, n, own, table)
    return first, code, n, own


def class_table(contexts: DataFrame, core: Table, tables: list[np.ndarray]) -> np.ndarray:
    """Context counts of the classes after the sweeps so far."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CODES, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                first, code, n, own = _assigned(batch, core, tables)
                own = np.repeat(own, np.diff(first))
                has = own >= 0
                total += np.bincount(own[has] * CODES + code[has], n[has], CLASSES * CODES).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["cell", "n"])

    return _cells(contexts.mapInArrow(count, "cell long, n long"), CLASSES, CODES)


def _cells(df: DataFrame, *shape: int) -> np.ndarray:
    """Sums of n by cell, as a matrix."""
    found = df.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(shape)


def cluster_words(training: DataFrame) -> DataFrame:
    """word, n and cls of every training word."""
    counts = count_words(training)
    top = counts.where(F.col("word") != int(END)).orderBy(F.desc("n"), "word").limit(CORE).toPandas()
    words = np.sort(np.append(top["word"].to_numpy(np.int64), END))
    core = Table(words, exchange(count_bigrams(training, words)))
    tables: list[np.ndarray] = []

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _assigned(batch, core, tables)[3]
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(own, pa.int32())], names=["word", "n", "cls"])

    with scratch(training.sparkSession) as kept:
        contexts = kept(word_contexts(training, core))
        for _ in range(SWEEPS):
            tables.append(class_table(contexts, core, tables))
        return stored(contexts.mapInArrow(assign, "word long, n long, cls int"))


@dataclass
class Emissions:
    """Totals of the words' table, and the frequent words of it."""

    tokens: int
    distinct: int
    #: -log10 of each class's emission denominator.
    denominator: np.ndarray
    unknown: int
    frequent: Table
    counts: np.ndarray

    @property
    def end(self) -> int:
        return int(self.frequent.of(np.array([END]), self.unknown)[0])


def emissions(words: DataFrame) -> Emissions:
    rows = words.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once")).toPandas()  # CLASSES rows
    n, v, once = (np.zeros(CLASSES) for _ in range(3))
    for x, c in ((n, "n"), (v, "v"), (once, "once")):
        x[rows["cls"].to_numpy(int)] = rows[c]
    known = words.where(F.col("word") == int(END)).unionByName(words.where(F.col("word") != int(END)).orderBy(F.desc("n"), "word").limit(FREQUENT)).toPandas().sort_values("word")
    table = Table(known["word"].to_numpy(np.int64), known["cls"].to_numpy(np.int64))
    return Emissions(int(n.sum()), int(v.sum()), -np.log10(n + SMOOTH_WORD * (v + 1)), int(np.argmax(once)), table, known["n"].to_numpy(np.int64))


def map_texts(documents: DataFrame, e: Emissions) -> DataFrame:
    """Rows of two kinds, of few and flat columns.  Blocks: block and data, the pickled arrays of its documents (doc_id, n_tokens, and what
    frequent words give: n_known, log_counts, the sum of log10(c + 0.1)) and of its classes (a byte a token, 255 where a task does
    not know the word).  Posting lists: block, word and data, the word's places (32-bit) in the block."""
    logs = np.log10(e.counts + SMOOTH_WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for word, n, rows in token_blocks(batches):
            at = e.frequent.place(word)
            known = at >= 0
            classes = np.where(known, e.frequent.value[at], _UNKNOWN).astype(np.uint8) if len(logs) else np.full(len(word), _UNKNOWN, dtype=np.uint8)
            edge = np.cumsum(n) - n
            n_known = np.add.reduceat(known.astype(np.int64), edge)
            log = np.add.reduceat(np.where(known, logs[at], 0.0) if len(logs) else np.zeros(len(word)), edge)
            data = pickle.dumps((rows.column("doc_id").to_pylist(), n, n_known, log, classes), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int64()), pa.array([data], pa.binary())], names=["block", "word", "data"])
            place = np.flatnonzero(~known)
            if len(place):
                rare = word[place]
                order = np.argsort(rare, kind="stable")
                rare, place = rare[order], place[order].astype(np.uint32)
                edge = np.flatnonzero(np.concatenate(([True], rare[1:] != rare[:-1])))
                offsets = np.append(edge, len(rare)).astype(np.int32) * 4
                lists = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets), pa.py_buffer(place)])
                yield from pa.table({"block": np.full(len(edge), block), "word": rare[edge], "data": lists}).to_batches(max_chunksize=65_536)
            block += 1

    return documents.select("doc_id", "text").mapInArrow(run, "block long, word long, data binary")


class _Block:
    """One block, put together from its own row and its posting lists, whichever comes first."""

    def __init__(self, unknown: int, kind: pa.DataType):
        self.unknown, self.kind, self.row, self.held = unknown, kind, None, []

    def add(self, place: np.ndarray, cls: np.ndarray, log: np.ndarray, known: np.ndarray) -> None:
        self.held.append((place, cls.astype(np.uint8), log.astype(np.float64), known))

    def done(self) -> pa.RecordBatch:
        doc_id, n, n_known, log, classes = self.row
        edge = np.cumsum(n)
        for place, cls, more, known in self.held:
            classes[place] = cls
            doc = np.searchsorted(edge, place, "right")
            log = log + np.bincount(doc, more, len(n))
            n_known = n_known + np.bincount(doc[known], minlength=len(n))
        offsets = np.concatenate(([0], edge)).astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(classes)])
        return pa.RecordBatch.from_arrays([pa.array(doc_id, self.kind), pa.array(n), pa.array(n_known), pa.array(log), texts], names=["doc_id", "n_tokens", "n_known", "log_counts", "classes"])


def class_texts(documents: DataFrame, words: DataFrame, e: Emissions) -> DataFrame:
    """doc_id, n_tokens, n_known, log_counts and classes (a byte a token) of every text, as a stored table."""
    kind = to_arrow_type(documents.schema["doc_id"].dataType)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Block] = {}
        for batch in batches:
            owner, n = batch.column("block").to_numpy(), batch.column("n").to_numpy()
            whole = n < 0
            for i in np.flatnonzero(whole).tolist():
                held.setdefault(int(owner[i]), _Block(e.unknown, kind)).row = pickle.loads(batch.column("data")[i].as_py())
            rest = np.flatnonzero(~whole)
            if not len(rest):
                continue
            part = batch.take(pa.array(rest)) if whole.any() else batch
            owner, n, cls = (part.column(c).to_numpy() for c in ("block", "n", "cls"))
            raw, length = _bytes(part.column("data"))
            place, length = np.frombuffer(raw.tobytes(), dtype=np.uint32).astype(np.int64), length // 4
            log = np.log10(n + SMOOTH_WORD)
            start = np.cumsum(length) - length
            order = np.argsort(owner, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], owner[order][1:] != owner[order][:-1], [True])))
            for a, b in zip(edge, edge[1:]):
                mine = order[a:b]
                m = length[mine]
                held.setdefault(int(owner[mine[0]]), _Block(e.unknown, kind)).add(place[take_runs(start[mine], m)], np.repeat(cls[mine], m), np.repeat(log[mine], m), np.repeat(n[mine] > 0, m))
        for block in list(held):
            made = held.pop(block).done()
            for a in range(0, made.num_rows, 4096):
                yield made.slice(a, 4096)

    with scratch(documents.sparkSession) as kept:
        mapped = kept(map_texts(documents, e))
        blocks = mapped.where("word is null").select("block", "data", F.lit(-1).cast("long").alias("n"), F.lit(0).alias("cls"))
        lists = mapped.where("word is not null").join(words, "word", "left").select("block", "data", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("cls", F.lit(e.unknown)).alias("cls"))
        parts = max(blocks.count(), int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = lists.unionByName(blocks).repartition(parts, "block")
        return stored(rows.mapInArrow(put_together, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, log_counts double, classes binary"))


def count_transitions(texts: DataFrame, end: int) -> np.ndarray:
    """Class bigram counts of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                now, before, _ = _pairs(batch.column("classes"), end)
                total += np.bincount(before * CLASSES + now, minlength=CLASSES * CLASSES)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["cell", "n"])

    training = texts.where(fold_of(F.col("doc_id"), FOLDS) != 0)
    return _cells(training.select("classes").mapInArrow(count, "cell long, n long"), CLASSES, CLASSES)


def _pairs(classes: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token, class before it (that of the end at a text's start), and where each text starts."""
    raw, length = _bytes(classes)
    now = raw.astype(np.int64)
    edge = np.cumsum(length) - length
    before = shifted(now, end)
    before[edge] = end
    return now, before, edge


def score_texts(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams), score (class bigrams) and perplexity
    of every whole text; scores are log10 probabilities."""
    words = cluster_words(documents.where(fold_of(F.col("doc_id"), FOLDS) != 0))
    e = emissions(words)
    texts = class_texts(documents, words, e)
    pairs = count_transitions(texts, e.end) + SMOOTH_CLASS
    step = np.log10(pairs / pairs.sum(axis=1, keepdims=True)) + e.denominator[None, :]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                now, before, edge = _pairs(batch.column("classes"), e.end)
                made = np.add.reduceat(step[before, now], edge)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "log_counts")), pa.array(made)], names=["doc_id", "n_tokens", "n_known", "log_counts", "of_classes"])

    rows = texts.mapInArrow(score, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, log_counts double, of_classes double")
    denominator = float(np.log10(e.tokens + SMOOTH_WORD * (e.distinct + 1)))
    total = F.col("log_counts") + F.col("of_classes")
    return rows.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(e.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * denominator).alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))
