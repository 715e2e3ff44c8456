"""BPE encoding and decoding by batched numpy merge rounds.

The distinct words of a piece stand as one flat symbol array.  In each round the rank of every pair of
neighbours is known (binary search over the sorted pair keys, only where a neighbour changed), the
lowest rank of each word is taken, and all its pairs of that rank are merged at once.  Merging all at once
equals merging one by one unless the new symbol takes part in a merge of lower rank; those ranks
are found when the vocabulary is read, and for them only the leftmost pair of a word is merged in a round.

Nulls count as empty texts; an empty text has no tokens.  Rows with a null or repeated doc_id are encoded
like any other.  Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .text import own_first, pieces, read_table, spread, take_runs

_NONE = np.int32(np.iinfo(np.int32).max)
#: White space as the tokenizer's patterns see it.
_WS = r"\t-\r \x85\xa0  -     　"

#: The normalisation that ``split`` carries out; a file that names another one is refused.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BpeCodec:
    """A word-end BPE vocabulary (a tokenizers .json file): ``encode`` and ``decode`` of many texts at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        other = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if spec["normalizer"] != NORMALIZER or spec["decoder"] or other:
            raise ValueError("this codec knows NFC, white space to blanks and lower-casing, plain BPE and no decoder; the file asks for something else")
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *special.values()]) + 1
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _WS)
        self.words = regex.compile(pattern)
        self.special, self.special_re = special, regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        chars = byte_characters()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int32)
        self.final = np.array([vocab[chars[b] + self.suffix] for b in range(256)], dtype=np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], dtype=np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order.astype(np.int32), made
        lowest_use = np.full(self.size, len(merges), dtype=np.int64)
        np.minimum.at(lowest_use, left, np.arange(len(merges)))
        np.minimum.at(lowest_use, right, np.arange(len(merges)))
        #: Ranks whose product is used by a merge of lower rank.
        self.one_by_one = lowest_use[made] < np.arange(len(merges))
        token = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        raw = [token.get(i, "").encode() + b" " for i in range(self.size)]
        self.token_text = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.token_len = np.array([len(x) for x in raw], dtype=np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        digits = [b"%d " % i for i in range(self.size)]
        self.digit_text = np.frombuffer(b"".join(digits), dtype=np.uint8)
        self.digit_len = np.array([len(x) for x in digits], dtype=np.int64)
        self.digit_at = np.cumsum(self.digit_len) - self.digit_len

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.rank_of[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one word after the other, and how many each has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        size = np.array([len(w) for w in words], dtype=np.int64)
        last = np.cumsum(size) - 1
        symbol = self.inner[data]
        symbol[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(symbol), _NONE, dtype=np.int32)
        near = np.flatnonzero(word[1:] == word[:-1])
        rank[near] = self._ranks(symbol[near], symbol[near + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.append(begin, len(word)))
            least = np.minimum.reduceat(rank, begin)
            ended = least == _NONE
            if ended.any():
                out = np.repeat(ended, length)
                done.append((symbol[out], word[out]))
                symbol, word, rank = symbol[~out], word[~out], rank[~out]
                if not len(symbol):
                    break
                least, length = least[~ended], length[~ended]
                begin = np.cumsum(length) - length
            pick = np.flatnonzero(rank == np.repeat(least, length))
            keep = np.ones(len(pick), dtype=bool)
            touching = np.flatnonzero(np.diff(pick) == 1) + 1  # such as a a a: every second pair of a run
            if len(touching):
                run_start = np.ones(len(pick), dtype=bool)
                run_start[touching] = False
                at = np.arange(len(pick))
                keep = (at - np.maximum.accumulate(np.where(run_start, at, 0))) % 2 == 0
            single = self.one_by_one[rank[pick]]
            if single.any():
                new_word = np.concatenate(([True], word[pick][1:] != word[pick][:-1]))
                keep &= ~single | new_word
            pick = pick[keep]
            symbol[pick] = self.made[rank[pick]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[pick + 1] = False
            moved = np.cumsum(stay) - 1
            symbol, word, rank = symbol[stay], word[stay], rank[stay]
            at = moved[pick]
            again = np.unique(np.concatenate((at, at[at > 0] - 1)))
            again = again[again < len(symbol)]
            rank[again] = _NONE
            again = again[again + 1 < len(symbol)]
            again = again[word[again] == word[again + 1]]
            rank[again] = self._ranks(symbol[again], symbol[again + 1])
        symbol = np.concatenate([s for s, _ in done])
        word = np.concatenate([w for _, w in done])
        return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def split(self, text: str) -> list[str | int]:
        """The words of a text after normalisation; special tokens come as their ids."""
        parts = self.special_re.split(text) if self.special_re is not None and "<|" in text else [text]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower-cased letter by letter: no final sigma
                out += self.words.findall(part.lower())
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one text after the other, and how many tokens each has."""
        index: dict[str | int, int] = {}
        codes: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            words = self.split(text or "")
            codes += [index.setdefault(w, len(index)) for w in words]
            counts[i] = len(words)
        distinct = list(index)
        plain = [i for i, w in enumerate(distinct) if isinstance(w, str)]
        ids, sizes = self.encode_words([distinct[i].encode() for i in plain])
        length = np.ones(len(distinct), dtype=np.int64)
        start = np.zeros(len(distinct), dtype=np.int64)
        length[plain], start[plain] = sizes, np.cumsum(sizes) - sizes
        special = [(i, w) for i, w in enumerate(distinct) if isinstance(w, int)]
        for k, (i, _) in enumerate(special):
            start[i] = len(ids) + k
        ids = np.concatenate((ids, np.array([w for _, w in special], dtype=np.int32)))
        code = np.array(codes, dtype=np.int64)
        upto = np.concatenate(([0], np.cumsum(length[code])))
        edge = np.concatenate(([0], np.cumsum(counts)))
        return ids[take_runs(start[code], length[code])], np.diff(upto[edge])

    def _spelled(self, ids: np.ndarray, counts: np.ndarray, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[bytes]:
        """The spellings of each text's tokens joined by one space."""
        edge = np.concatenate(([0], np.cumsum(counts)))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            part = ids[a:b]
            yield text[take_runs(at[part], size[part])][:-1].tobytes()

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """Each text's tokens joined by one space, in UTF-8 (the vocabulary names no decoder)."""
        return self._spelled(ids, counts, self.token_text, self.token_at, self.token_len)

    def decimal(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """Each text's ids in decimal, joined by one space."""
        return self._spelled(ids, counts, self.digit_text, self.digit_at, self.digit_len)


@functools.cache
def codec(path: str) -> BpeCodec:
    """One codec for each worker process."""
    return BpeCodec(path)


_TYPES = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def bpe_round_trip(df: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode ``text`` and decode the ids again.  A map over the input's partitions: nothing is shuffled.

    ``outputs``: any of n_tokens, ids, decoded, and the SHA-256 digests ids_sha256 and decoded_sha256 of
    the decimal ids joined by a space and of the decoded text; ``keep``: input columns that stay, but for names of outputs.
    """
    keep = own_first(keep, outputs)
    source = df.select(*dict.fromkeys((*keep, "text")))
    fields = [(f.name, f) for f in source.select(*keep).schema]
    schema = T.StructType([f for _, f in fields] + [T.StructField(n, _TYPES[n]) for n in outputs])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in pieces(batches):
            ids, counts = own.encode(batch.column("text").to_pylist())
            made: dict[str, pa.Array] = {}
            if "n_tokens" in outputs:
                made["n_tokens"] = pa.array(counts, pa.int64())
            if "ids" in outputs:
                edge = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                made["ids"] = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))
            if "ids_sha256" in outputs:
                made["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in own.decimal(ids, counts)])
            if "decoded_sha256" in outputs:
                made["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids, counts)])
            if "decoded" in outputs:
                made["decoded"] = pa.array([x.decode() for x in own.decode(ids, counts)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *(made[n] for n in outputs)], names=[*keep, *outputs])

    return source.mapInArrow(encode, schema)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe_round_trip(documents, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))
