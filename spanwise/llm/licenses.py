"""License scans: phrases, and license notices found by an exact set-similarity join.

For each template a text is cut into blocks a quarter longer than the template, a new one at every quarter, so that a notice stands
whole inside one.  A block meets a template when it holds at least ``threshold`` of the template's distinct words; every such
block is returned.  Sets know no order, so prose made of a notice's words meets it too: a block gives its
text the template's label only if it also holds at least ``order`` of the template's distinct pairs of neighbouring words.

Template words are ordered by how many documents of the whole corpus hold them, rarest first.  A block can only meet the threshold
if it holds one of the template's first n - need + 1 words (prefix filter) and has at least ``need`` words (length filter).
The distinct words found in the prefix, and behind it the smaller of the template's words and the block's occurrences of them, have to
reach ``need`` together (positional filter).  Only the blocks that are left are counted, exactly.

Templates and phrases are fixed and few; the corpus is mapped over twice (word frequencies, scan) and never
shuffled, but for one small row per task and template word.  Words are found by hash and compared as bytes.

Nulls count as empty texts: no words, no labels, score 0.  Rows are judged each by itself, repeated ones too; a text of any length is
cut whole; an empty table gives an empty result.  Extra columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ALNUM, Words, find_words, own_first, pieces, read_table, take_runs

# Phrases and what they label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The wording of public license notices (SPDX names MIT, Apache-2.0, GPL-3.0-or-later, BSD-3-Clause, ISC), without names and years.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License along
        with this program. If not, see https://www.gnu.org/licenses/""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
        ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
}

#: Shares of a template's distinct words, and of its distinct neighbouring pairs, that a block has to hold.
THRESHOLD, ORDER = 0.8, 0.6


class Vocabulary:
    """The words of phrases and templates, found in texts by hash and then compared as bytes."""

    def __init__(self, texts: list[str]):
        words = find_words(pa.array(texts, pa.string()), ALNUM)
        h = words.hashes()
        self.hash, at = np.unique(h, return_index=True)
        self.word = [words.text(i) for i in at.tolist()]
        self.size = np.array([len(w) for w in self.word])
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(self.word), dtype=np.uint8)
        number = np.searchsorted(self.hash, h)
        self.of = [number[a:b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]

    def numbers(self, words: Words) -> np.ndarray:
        """For each word its number here, or -1."""
        h = words.hashes()
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        found = np.flatnonzero((self.hash[at] == h) & (self.size[at] == words.end - words.start))
        own, size = at[found], self.size[at[found]]
        differ = words.data[take_runs(words.start[found], size)] != self.data[take_runs(self.start[own], size)]
        wrong = np.zeros(len(found), dtype=bool)
        wrong[np.repeat(np.arange(len(found)), size)[differ]] = True
        number = np.full(len(h), -1, dtype=np.int64)
        number[found[~wrong]] = own[~wrong]
        return number


def word_frequencies(df: DataFrame, vocabulary_of: list[str]) -> dict[bytes, int]:
    """How many documents hold each template word: at most one row for each task and word is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(vocabulary_of)
        total = np.zeros(len(own.hash), dtype=np.int64)
        for batch in pieces(batches):
            words = find_words(batch.column("text"), ALNUM)
            number = own.numbers(words)
            found = number >= 0
            pairs = np.unique(words.doc[found] * len(own.hash) + number[found])
            total += np.bincount(pairs % len(own.hash), minlength=len(own.hash))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([own.word[i] for i in seen.tolist()], pa.binary()), pa.array(total[seen])], names=["word", "n"])

    counted = df.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}  # at most one row a template word


_BLOCK = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64()), ("ordered", pa.bool_())])
_BLOCK_TYPE = T.StructType().add("label", "string").add("first", "long").add("last", "long").add("share", "double").add("ordered", "boolean")
_MADE = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("blocks", pa.list_(_BLOCK))]
_SCHEMA = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.ArrayType(T.StringType())), ("labels", T.ArrayType(T.StringType())), ("score", T.DoubleType()), ("blocks", T.ArrayType(_BLOCK_TYPE))]


def block_shape(n_words: int) -> tuple[int, int]:
    """Words of a block for a template of ``n_words`` words, and words from one block to the next: every run of n_words stands whole in a block."""
    step = max(1, -(-n_words // 4))
    return n_words + step, step


class Template:
    """A template's distinct words, globally rarest first, its pairs of neighbouring words, and the filters' bounds."""

    def __init__(self, label: str, words: np.ndarray, rarity: np.ndarray, threshold: float, order: float):
        self.label, (self.block, self.step) = label, block_shape(len(words))
        own = np.unique(words)
        self.words = own[np.lexsort((own, rarity[own]))]
        self.need = math.ceil(threshold * len(self.words) - 1e-9)
        self.prefix = len(self.words) - self.need + 1
        self.local = np.full(len(rarity), -1, dtype=np.int64)
        self.local[self.words] = np.arange(len(self.words))
        self.pairs = np.unique(words[:-1] * len(rarity) + words[1:])
        self.need_pairs = math.ceil(order * len(self.pairs) - 1e-9)


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str], frequency: dict[bytes, int], threshold: float, order: float):
        self.vocabulary = Vocabulary([*phrases, *templates.values()])
        self.phrases = list(zip(self.vocabulary.of, phrases.values()))
        rarity = np.array([frequency.get(w, 0) for w in self.vocabulary.word])
        self.templates = [Template(label, words, rarity, threshold, order) for label, words in zip(templates, self.vocabulary.of[len(phrases) :])]

    def scan(self, texts: pa.Array) -> list[tuple]:
        words = find_words(texts, ALNUM)
        number = self.vocabulary.numbers(words)
        doc, counts = words.doc, words.counts
        end = np.repeat(words.first[1:], counts)
        n_docs = len(counts)
        places: list[list[int]] = [[] for _ in range(n_docs)]
        base: list[set[str]] = [set() for _ in range(n_docs)]
        for phrase, label in self.phrases:
            at = np.flatnonzero(number == phrase[0])
            at = at[at + len(phrase) <= end[at]]
            for j in range(1, len(phrase)):
                at = at[number[at + j] == phrase[j]]
            for i in at.tolist():
                places[doc[i]].append(i - int(words.first[doc[i]]))
                base[doc[i]].add(label)
        labels = [set(x) for x in base]
        score = [1.0 if x else 0.0 for x in base]
        met: list[list[dict]] = [[] for _ in range(n_docs)]
        for template in self.templates:
            for d, block in self.blocks(template, words, number):
                met[d].append(block)
                if block["ordered"]:
                    labels[d].add(template.label)
                    score[d] = max(score[d], block["share"])
        return [(n, len(p), min(p, default=None), max(p, default=None), sorted(b), sorted(m), s, x) for n, p, b, m, s, x in zip(counts.tolist(), places, base, labels, score, met)]

    def blocks(self, t: Template, words: Words, number: np.ndarray) -> Iterator[tuple[int, dict]]:
        """(text, block) for each block that meets the template, in order of place."""
        local = np.where(number >= 0, t.local[number], -1)
        at = np.flatnonzero((local >= 0) & (local < t.prefix))  # prefix filter: a block that can meet holds one of these
        if not len(at):
            return
        of_text = words.counts // t.step + 1
        before = np.cumsum(of_text) - of_text  # blocks of the texts before
        doc = words.doc[at]
        place = at - words.first[doc]
        reach = -(-t.block // t.step)
        block = (place // t.step)[:, None] - np.arange(reach)[None, :]
        holds = (block >= 0) & (block * t.step + t.block > place[:, None])
        held = np.unique((((before[doc][:, None] + block) * t.prefix) + local[at][:, None])[holds])  # a row for each block and word
        found, early = np.unique(held // t.prefix, return_counts=True)
        doc = np.searchsorted(before, found, side="right") - 1
        start = words.first[doc] + (found - before[doc]) * t.step
        stop = np.minimum(start + t.block, words.first[doc + 1])
        behind = np.concatenate([[0], np.cumsum(local >= t.prefix)])
        most = early + np.minimum(len(t.words) - t.prefix, behind[stop] - behind[start])
        live = np.flatnonzero((stop - start >= t.need) & (most >= t.need))  # length and positional filters
        for a in range(0, len(live), 4096):  # bounded memory
            part = live[a : a + 4096]
            inside = take_runs(start[part], stop[part] - start[part])
            row = np.repeat(np.arange(len(part)), stop[part] - start[part])
            mine = local[inside] >= 0
            has = np.zeros((len(part), len(t.words)), dtype=bool)
            has[row[mine], local[inside][mine]] = True
            full = has.sum(axis=1)
            for i in np.flatnonzero(full >= t.need).tolist():
                k = part[i]
                own = number[start[k] : stop[k]]
                pair = own[:-1] * len(t.local) + own[1:]
                ordered = np.isin(t.pairs, pair[(own[:-1] >= 0) & (own[1:] >= 0)]).sum() >= t.need_pairs
                origin = words.first[doc[k]]
                yield int(doc[k]), {"label": t.label, "first": int(start[k] - origin), "last": int(stop[k] - origin) - 1, "share": float(full[i]) / len(t.words), "ordered": bool(ordered)}


def scan_licenses(df: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, order: float = ORDER, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted), score and blocks.  Kept columns with
    one of these names give way.

    blocks: all that meet the threshold, each with the template's label, its first and last word (from 0), the share of the template's words
    that it holds, and whether they stand in the template's order.  labels: of phrases and of blocks in order.
    score: 1 where a phrase stands, else the largest share among blocks in order, else 0.
    """
    frequency = word_frequencies(df, [*phrases, *templates.values()])
    kept = own_first(keep, tuple(n for n, _ in _MADE))
    source = df.select(*dict.fromkeys((*kept, "text")))
    schema = T.StructType([*df.select(*kept).schema, *(T.StructField(n, t) for n, t in _SCHEMA)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, frequency, threshold, order)
        for batch in pieces(batches):
            made = zip(*scanner.scan(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(x, t) for x, (_, t) in zip(made, _MADE))], names=[*kept, *(n for n, _ in _MADE)])

    return source.mapInArrow(scan, schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    listed = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    contained = F.array_join(F.array_sort(F.array_distinct("blocks.label")), ",")
    return found.withColumns(listed | {"contained": contained, "n_blocks": F.size("blocks").cast("long")}).drop("blocks")
