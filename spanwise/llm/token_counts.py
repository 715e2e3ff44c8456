"""Token counts: an Arrow function that encodes batches of about equal bytes and returns lengths only.

A long text is split where the pre-tokenizer always ends a word: before a single white-space character
that stands between two other characters.  No word of the byte-level pattern reaches over such
a place, and special strings hold no white space, so the parts' counts add up to the text's count.  A text
without such places stays whole.  Nulls count as empty texts (0 bytes, 0 tokens).
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import own_first, pieces, read_table, spread

#: Characters after which a long text is split at the next safe place.
PART_CHARS = 16_384
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n][^\s\x1c-\x1f\x85])")


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def safe_parts(text: str, most: int = PART_CHARS) -> list[str]:
    """The text in parts of about ``most`` characters whose tokens, one part after the other, are the text's."""
    out, a = [], 0
    while len(text) - a > most:
        cut = _SAFE.search(text, a + most)
        if cut is None:
            break
        out.append(text[a : cut.start()])
        a = cut.start()
    out.append(text[a:])
    return out


def count_tokens(df: DataFrame, path: str, limit: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's whole ``text``.  Kept columns with one of these
    names give way."""
    kept = own_first(keep, ("n_bytes", "n_tokens", "over_limit"))
    source = df.select(*dict.fromkeys((*kept, "text")))
    fields = list(source.select(*kept).schema)
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in pieces(batches, most=1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts, owner = [], []
            for i, text in enumerate(texts):
                mine = safe_parts(text) if len(text) > PART_CHARS else [text]
                parts += mine
                owner += [i] * len(mine)
            lengths = [len(e) for e in own.encode_batch_fast(parts, add_special_tokens=False)]
            n_tokens = np.bincount(np.array(owner), np.array(lengths, dtype=np.float64), len(texts)).astype(np.int64)
            n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), n_bytes, pa.array(n_tokens)], names=[*kept, "n_bytes", "n_tokens"])

    return source.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"), 512)
