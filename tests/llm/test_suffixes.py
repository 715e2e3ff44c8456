"""Suffix dedup against a plain pass over all strings in order."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from spanwise.llm import suffixes

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("row", T.LongType()), ("starts", T.StringType()))])


def plain(docs, length=100):
    """Of each document, in order: doc_id, bytes, removed bytes, spans and what is left."""
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        body = (text or "").encode()
        gone = np.zeros(len(body) + 1, dtype=bool)
        for p in range(len(body) - length + 1):
            own = body[p : p + length]
            if own in seen:
                gone[p : p + length] = True
            seen.add(own)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(body), int(gone.sum()), spans, bytes(b for b, g in zip(body, gone) if not g)))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdé中") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (12, 25, 30, 60, 200)]
    short = ["x" * 99, "y" * 100, "z" * 101, "a" * 700, "ab" * 300]
    docs = []
    for _ in range(120):
        parts = [text(rnd.randint(0, 40)) for _ in range(3)]
        parts.insert(rnd.randint(0, 3), rnd.choice(passages + short))
        if rnd.random() < 0.3:
            parts.append(rnd.choice(passages))
        docs.append(rnd.choice(("", " ")).join(parts))
    docs += [docs[3]] * 40 + [docs[7][1:]] * 3 + ["a" * 5000, None, "", " ", "é" * 120, passages[4] * 3, passages[4][:-1] + "!"]
    ids = list(range(len(docs)))
    rnd.shuffle(ids)
    return list(zip(ids, docs))


def test_cover_holds_every_difference():
    differences = sorted((a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER if a != b)
    assert differences == list(range(1, suffixes.PERIOD))


def test_packing_round_trips():
    rnd = np.random.default_rng(1)
    for values in (np.zeros(0, np.int64), np.array([5]), rnd.integers(0, 1 << 62, 100), np.sort(rnd.integers(0, 1 << 20, 1000)), np.array([-3, 1 << 40, 2])):
        assert suffixes.unpack(suffixes.pack(values), len(values)).tolist() == values.tolist()
    low = rnd.integers(0, 1 << 40, 50, dtype=np.uint64)
    assert suffixes.unpack40(suffixes.pack40(low)).tolist() == low.tolist()


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in docs], DOCS)


@pytest.mark.parametrize("buckets,blocks,piece", [(None, 2, None), (1, 1, 3000), (300, 3, 500)])
def test_repeats_equal_a_plain_pass(spark, monkeypatch, buckets, blocks, piece):
    docs = corpus()
    if piece:
        # Workers read the module anew, so the bound goes in with the function.
        whole = suffixes.pieces
        monkeypatch.setattr(suffixes, "pieces", lambda batches, text="text", most=0, size=piece, cut=whole: cut(batches, text, size))
    got = suffixes.remove_repeats(frame(spark, docs).repartition(5), buckets=buckets, blocks=blocks, broadcast_copies=0 if piece else 1000).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == plain(docs)
    assert sum(r["n_removed"] for r in got) > 20_000


def test_digest_and_other_lengths(spark):
    docs = corpus()[:60]
    got = suffixes.remove_repeats(frame(spark, docs), length=70, digest=True).collect()
    want = [(i, n, r, s, hashlib.sha256(k).hexdigest()) for i, n, r, s, k in plain(docs, 70)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        suffixes.remove_repeats(frame(spark, docs), length=20)


def test_null_and_repeated_ids_and_empty_tables(spark):
    rnd = random.Random(4)
    one, two = ("".join(rnd.choices("abcdefgh", k=n)) for n in (150, 190))
    docs = [(None, one), (5, one), (5, one), (6, two), (None, None), (7, "tail" + two)]
    got = suffixes.remove_repeats(frame(spark, docs)).collect()
    assert sorted(((r["doc_id"], r["n_removed"], len(r["kept"])) for r in got), key=str) == sorted([(None, 150, 0), (5, 0, 150), (5, 150, 0), (6, 0, 190), (None, 0, 0), (7, 190, 4)], key=str)
    assert suffixes.remove_repeats(frame(spark, []).limit(0)).count() == 0
    assert suffixes.remove_repeats(frame(spark, [(1, "short"), (2, None)])).count() == 2
