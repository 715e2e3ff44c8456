"""Collocations against a plain count of all grams."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import types as T

from spanwise.llm import phrases

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("phrase", T.StringType()), ("n", T.LongType()))])


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain(docs, least, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = lang or "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    longer = {}
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                key = lang, w[i : i + k]
                longer[key] = max(longer.get(key, 0), a)
    rows = {}
    for (lang, w), a in found.items():
        if 100 * longer.get((lang, w), -1) >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i + 1): (p.decode(), -a, l, r, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])}


def corpus():
    rnd = random.Random(5)
    vocab = ["New", "york", "city", "of", "the", "é", "Ünï", "a", "b", "中文", "x-y", "\x1c", "\xa0"]
    passage = "once upon a time there was, the end"
    texts = [" ".join(rnd.choices(vocab, k=rnd.randint(0, 30))).replace("a b", rnd.choice(["a. b", "a\tb", "a\nb", "a  b"])) for _ in range(900)]
    texts += [passage] * 240 + [None, "", " \t", "...", "a " * 3000, "the the the the the"]
    return [(i, t, (None, "en", "en", "fr", "und", "")[i % 6], "p", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("slots,few,top", [(None, 200_000, 2000), (8, 0, 7), (1 << 16, 0, 2000)])
def test_collocations_equal_a_plain_count(spark, slots, few, top):
    docs = corpus()
    got = phrases.collocations(spark.createDataFrame(docs, DOCS).repartition(3), top=top, slots=slots, broadcast_phrases=few).collect()
    assert {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} == plain(docs, 30, top)
    assert len(got) == len(plain(docs, 30, top)) > 5


def test_counts_beyond_64_bits_of_products(spark):
    big = 3 << 60
    rows = spark.createDataFrame([("en", 2, "a b", big)], "lang string, k int, gram string, n long")
    flow = {(r["phrase"], r["f"]) for r in phrases.node_flow(rows).collect()}
    assert flow == {("a b", big), ("a", big)}
    score = spark.createDataFrame([(big, big, 5)], "a long, l long, r long").selectExpr(f"(CAST(a AS DECIMAL(20,0)) * {phrases.SCALE}) div (CAST(l AS DECIMAL(20,0)) + r) AS s").first()[0]
    assert score == 2_000_000 * big // (big + 5)


def test_empty_tables_and_equal_paths(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None), (2, "rare words", "en", None, None)], DOCS)).count() == 0
    import numpy as np

    ids, start, weight, at = phrases._paths(np.array([1, 2, 3, 1, 2, 3, 4, 1, 2]), np.array([True, True, False, True, True, False, False, True]))
    assert ids.tolist() == [1, 2, 3, 4, 1, 2] and start.tolist() == [0, 3, 4, 6] and weight.tolist() == [2, 1, 1] and at.tolist() == [0, 1, 2, 6, 7, 8]
