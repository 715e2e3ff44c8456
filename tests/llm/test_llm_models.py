"""Language model, language identification, quality classifier and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm import langid, lm, quality
from spanwise.llm.text import find_words, grams, SPACED, take_runs

BASE = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("row", T.LongType())])
ODD = [None, "", " \n", "A", "a b a b", "word " * 3000, "Été ΣΣ İ straße 中文 🎉", "12 34 !!", "same", "SAME", "same"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, 1) for i, t, lang in rows], DOCS)


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def fold(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def words_of(n, seed, letters):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(n)]


def corpus(n=240, seed=0):
    rnd = random.Random(seed)
    vocab = {"en": words_of(60, 1, "etaoinshr"), "xx": words_of(60, 2, "äöüßzkwvj"), "yy": words_of(60, 3, "ñíóqux")}
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(vocab))
        rows.append((i, " ".join(rnd.choice(vocab[lang]) for _ in range(rnd.randint(5, 60))).capitalize() + ".", lang))
    return rows


def test_words_match_the_pattern():
    texts = [t or "" for t in ODD] + ["\x0b\x0c a\tb\r\n\x1c\x85c  "]
    words = find_words(pa.array(texts), SPACED)
    got = [[words.text(i).decode() for i in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", low(t)) for t in texts]
    h = words.hashes()
    seen = {}
    for i in range(len(h)):
        assert seen.setdefault(int(h[i]), words.text(i)) == words.text(i)
    assert len(seen) == len({words.text(i) for i in range(len(h))})
    assert len(grams(h[:3], 5)) == 0 and take_runs(np.array([3, 7]), np.array([2, 0])).tolist() == [3, 4]


def word_hash(word):
    return int(lm.END) if word is None else int(find_words(pa.array([word]), SPACED).hashes().view(np.int64)[0])


def tokens_of(rows):
    return [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t or "")) + [None]) for i, t, _ in rows]


def plain_classes(train, core, sweeps):
    """Classes of all words by the docstring: contexts by core classes, then sweeps of all words at once."""
    left, right = {}, {}
    for w in train:
        for a, b in zip([None, *w], w):
            left.setdefault(b, Counter())[core.get(a, "other")] += 1
            right.setdefault(a, Counter())[core.get(b, "other")] += 1
    own = dict(core)
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    context = {w: {**{("r", c): n for c, n in right[w].items()}, **{("l", c): n for c, n in left[w].items()}} for w in left}
    for _ in range(sweeps):
        table, size = Counter(), Counter()
        for w, cs in context.items():
            if w in own:
                size[own[w]] += sum(right[w].values())
                for c, n in cs.items():
                    table[own[w], c] += n
        new = {}
        for w, cs in context.items():
            total = sum(right[w].values())
            gains = []
            for k in range(lm.CLASSES):
                if own.get(w) == k:
                    gains.append(sum(f(table[k, c]) - f(table[k, c] - n) for c, n in cs.items()) - 2 * (f(size[k]) - f(size[k] - total)))
                else:
                    gains.append(sum(f(table[k, c] + n) - f(table[k, c]) for c, n in cs.items()) - 2 * (f(size[k] + total) - f(size[k])))
            new[w] = max(range(lm.CLASSES), key=lambda k: (round(gains[k], 7), -k))
        own = new
    return own


def test_all_words_are_clustered_as_brute_force_does(spark, monkeypatch):
    monkeypatch.setattr(lm, "CORE", 12)
    monkeypatch.setattr(lm, "CLASSES", 5)
    monkeypatch.setattr(lm, "CODES", 12)
    monkeypatch.setattr(lm, "LOOSE", 6)
    rows = corpus(120, 9) + [(500 + i, t, None) for i, t in enumerate(ODD)]
    train = [w for _, w in tokens_of(rows)]
    c = Counter(x for w in train for x in w)
    # the clustering runs in tasks that import the module anew, so its steps are called here on arrays
    words = [w for w, _ in sorted(((w, n) for w, n in c.items() if w is not None), key=lambda x: (-x[1], word_hash(x[0])))[:12]]
    rnd = random.Random(2)
    core = {w: rnd.randrange(5) for w in [*words, None]}
    order = sorted(core, key=word_hash)
    table = lm.Table(np.array([word_hash(w) for w in order]), np.array([core[w] for w in order]))
    want = plain_classes(train, core, 2)
    flat = [x for w in train for x in w]
    own = table.of(np.array([word_hash(w) for w in flat]), 5)
    right, left = np.roll(own, -1), np.roll(own, 1) + 6
    pairs = {}
    for w, r, left_code in zip(flat, right.tolist(), left.tolist()):
        pairs.setdefault(w, Counter()).update([r, left_code])
    names = sorted(pairs, key=word_hash)
    first = np.concatenate(([0], np.cumsum([len(pairs[w]) for w in names])))
    code = np.array([k for w in names for k in sorted(pairs[w])])
    n = np.array([pairs[w][k] for w in names for k in sorted(pairs[w])])
    now = table.of(np.array([word_hash(w) for w in names]), -1)
    for _ in range(2):
        whole = np.zeros((5, 12))
        flat_own = np.repeat(now, np.diff(first))
        np.add.at(whole, (flat_own[flat_own >= 0], code[flat_own >= 0]), n[flat_own >= 0])
        now = lm.best_classes(first, code, n, now, whole)
    assert [want[w] for w in names] == now.tolist()


def test_contexts_are_counted_whole(spark):
    rows = corpus(80, 10) + [(900 + i, t, None) for i, t in enumerate(ODD)]
    df = docs(spark, rows).repartition(4)
    train = [w for _, w in tokens_of(rows)]
    common = [w for w, _ in Counter(x for w in train for x in w).most_common(20)]
    order = sorted({*common, None}, key=word_hash)
    core = lm.Table(np.array([word_hash(w) for w in order]), np.arange(len(order)) % lm.CLASSES)
    cls = {w: i % lm.CLASSES for i, w in enumerate(order)}
    left, right = {}, {}
    for w in train:
        for a, b in zip([None, *w], w):
            left.setdefault(word_hash(b), Counter())[cls.get(a, lm.CLASSES) + lm.CLASSES + 1] += 1
            right.setdefault(word_hash(a), Counter())[cls.get(b, lm.CLASSES)] += 1
    got = lm.word_contexts(df, core).collect()
    assert len(got) == len(left)
    for r in got:
        codes, counts = np.frombuffer(r["codes"], np.uint8), np.frombuffer(r["counts"], np.int64)
        assert dict(zip(codes.tolist(), counts.tolist())) == dict(left[r["word"]] + right[r["word"]]) and r["n"] == sum(left[r["word"]].values())


def test_language_model_equals_its_definition(spark):
    rows = corpus() + [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(None, "no id here", None), (5, rows_text := "twice the same", None), (5, rows_text, None)]
    df = docs(spark, rows)
    words = lm.cluster_words(df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0))
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score_texts(df).collect())
    tokens = tokens_of(rows)
    train = [w for i, w in tokens if fold(i, 10) not in (None, 0)]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    held = {r["word"]: (r["n"], r["cls"]) for r in words.collect()}
    assert {w: k for w, (k, _) in held.items()} == {word_hash(w): k for w, k in c.items()}
    once = Counter(k for m, k in held.values() if m == 1)
    unknown = min(once, key=lambda k: (-once[k], k))
    cls = {w: held.get(word_hash(w), (0, unknown))[1] for _, ws in tokens for w in ws}
    assert len(set(cls.values())) > 3
    n_class, v_class = Counter(), Counter()
    for w, k in c.items():
        n_class[cls[w]] += k
        v_class[cls[w]] += 1
    pairs = Counter((cls[a], cls[b]) for w in train for a, b in zip([None, *w], w))
    left = Counter()
    for (a, _), k in pairs.items():
        left[a] += k
    want = Counter()
    for i, w in tokens:
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for a, b in zip([None, *w], w):
            ca, cb = cls[a], cls[b]
            score += math.log10((pairs[ca, cb] + lm.SMOOTH_CLASS) / (left[ca] + lm.SMOOTH_CLASS * lm.CLASSES))
            score += math.log10((c[b] + 0.1) / (n_class[cb] + 0.1 * (v_class[cb] + 1)))
        want[(i, fold(i, 10) == 0, len(w), sum(x in c for x in w), n, round(base, 6), round(score, 6))] += 1
    assert got == want
    held_out = [(r["base_score"], r["score"]) for r in lm.score_texts(df).where("held_out and doc_id < 1000").collect()]
    assert sum(s for _, s in held_out) > sum(b for b, _ in held_out)
    assert lm.score_texts(df.limit(0)).count() == 0
    named = df.where("doc_id < 60").selectExpr("lpad(cast(doc_id as string), 3, '0') as doc_id", "text")
    marked = {r["doc_id"]: r["held_out"] for r in lm.score_texts(named).collect()}
    assert marked == {f"{i:03}": zlib.crc32(f"{i:03}".encode()) % 10 == 0 for i in range(60)}
    untrained = lm.score_texts(df.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in untrained} == {(0, 0)}


def test_language_model_with_rare_words_in_many_blocks(spark, monkeypatch):
    """Posting lists: with few frequent words and small blocks the scores are the same."""
    df = docs(spark, corpus(150, 12) + [(700, "word rare1 rare2 " * 20_000, None)]).repartition(3)
    words = lm.cluster_words(df)
    whole = lm.emissions(words)
    e = lm.Emissions(whole.tokens, whole.distinct, whole.denominator, whole.unknown, lm.Table(whole.frequent.word[:3], whole.frequent.value[:3]), whole.counts[:3])
    texts = lambda x: sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["log_counts"], 6), bytes(r["classes"])) for r in lm.class_texts(df, words, x).collect())
    assert texts(whole) == texts(e)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    true = rng.integers(0, 4, 60)
    bigrams = rng.poisson(np.where(true[:, None] == (true[None, :] + 1) % 4, 6, 0.2)).astype(float)

    def likelihood(own):
        b = np.eye(4)[own]
        t = b.T @ bigrams @ b
        return (t * np.log(np.maximum(t, 1e-300))).sum() - sum((m * np.log(np.maximum(m, 1e-300))).sum() for m in (t.sum(axis=0), t.sum(axis=1)))

    start = np.empty(60, dtype=int)
    start[np.argsort(-(bigrams.sum(axis=0) + bigrams.sum(axis=1)), kind="stable")] = np.arange(60) % 4
    found = lm.exchange(bigrams, 4, 20)
    assert likelihood(found) > likelihood(start) + 1
    assert likelihood(found) >= 0.98 * likelihood(true) if likelihood(true) > 0 else True


def test_languages(spark):
    rows = corpus(400, 4) + [(2000 + i, t, "en" if i % 2 else None) for i, t in enumerate(ODD)]
    df = docs(spark, rows)
    model = langid.fit_languages(df)
    assert model.langs == ["en", "xx", "yy"] and len(model.centroids) <= 9
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    for i, t, lang in rows:
        assert 0 <= got[i]["score"] <= 1
        if not any(ch.isalpha() for ch in t or ""):
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"]
        else:
            assert got[i]["lang_pred"] in model.langs
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows[:400] if fold(i, 3) == 1]
    assert np.mean(right) > 0.97
    assert got[2006]["rejected"] or got[2006]["lang_pred"] in model.langs
    nothing = langid.fit_languages(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def plain_grams(text):
    """Buckets of a text's letter n-grams, and how often each occurs, by plain loops."""
    runs = "".join(ch if ch.isalpha() else "\0" for ch in (text or "").lower() + "\0")
    runs = re.sub("\0+", "\0", runs)
    mul = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    out = Counter()
    for size in (1, 2, 3):
        for a in range(len(runs) - size + 1):
            gram = runs[a : a + size]
            if gram.strip("\0"):
                key = size
                for ch, m in zip(gram, mul):
                    key = (key ^ (0 if ch == "\0" else ord(ch))) * m % (1 << 64)
                    key ^= key >> 29
                out[key >> 52] += 1
    return out


def test_languages_equal_brute_force(spark):
    rows = corpus(90, 7) + [(600 + i, t, "en") for i, t in enumerate(ODD)] + [(700, "aé b! " * 30_000, "xx"), (3, "a doc_id again", "yy"), (3, "a doc_id again", "yy")]
    df = docs(spark, rows).repartition(4)
    model = langid.fit_languages(df)
    train = [(plain_grams(t), lang) for i, t, lang in rows if fold(i, 3) != 1 and t is not None]
    train = [(g, lang) for g, lang in train if g]
    frequency = Counter(b for g, _ in train for b in g)
    idf = [math.log((1 + len(train)) / (1 + frequency[b])) + 1 for b in range(langid.BUCKETS)]
    assert np.allclose(model.idf, idf, atol=1e-5)

    def vector(g):
        x = {b: (1 + math.log(n)) * idf[b] for b, n in g.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / length for b, v in x.items()}

    cosine = lambda x, c: sum(v * c[b] for b, v in x.items())
    for i, lang in enumerate(model.langs):  # each centroid is the mean, at length 1, of the training texts nearest to it
        own = [c for c, j in zip(model.centroids, model.lang_of) if j == i]
        sums = [np.zeros(langid.BUCKETS) for _ in own]
        for x in (vector(g) for g, name in train if name == lang):
            near = [cosine(x, c) for c in own]
            for b, v in x.items():
                sums[int(np.argmax(near))][b] += v
        for c, total in zip(own, sums):
            assert cosine(dict(enumerate(total / np.linalg.norm(total))), c) > 0.99
    got = {(r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in langid.identify(df, model).collect()}
    for i, t, _ in rows:
        g = plain_grams(t)
        if not g:
            assert (i, "und", 0.0) in got
            continue
        x = vector(g)
        best = [max(cosine(x, c) for c, j in zip(model.centroids, model.lang_of) if j == k) for k in range(len(model.langs))]
        share = [math.exp(model.sharp * (b - max(best))) for b in best]
        pick = int(np.argmax(best))
        assert any(d == i and lang == model.langs[pick] and abs(s - share[pick] / sum(share)) < 1e-3 for d, lang, s in got)


def test_every_language_can_be_predicted(spark):
    letters = [chr(0x400 + i) + chr(0x440 + i) + chr(0x3B1 + i % 20) for i in range(230)]
    rows = [(i, " ".join([w] * 6), f"l{k:03}") for k, w in enumerate(letters) for i in range(k * 4, k * 4 + 4)]
    df = docs(spark, rows)
    model = langid.fit_languages(df)
    assert len(model.langs) > 200
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model, keep=("doc_id", "score")).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows if fold(i, 3) != 1]) > 0.99


def test_quality(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for i, t, lang in corpus(500, 6):
        bad = i % 4 == 0
        rows.append((i, " ".join([t.split()[0]] * 30) if bad and i % 8 else t.upper().replace(" ", "!! ") if bad else t, lang))
        labels += [(i, int(not bad), 0)] * rnd.choice([1, 2])
    labels += [(7, None, 0), (None, 1, 0), (99_999, 1, 1)]
    rows += [(3000 + i, t, None) for i, t in enumerate(ODD)]
    df, known = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit_quality(df, known)
    got = {r["doc_id"]: r for r in quality.score_quality(df, model).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [(got[i]["predicted"], int(i % 4 != 0)) for i in range(500) if fold(i, 5) == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(df, quality.fit_quality(df, known)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    kept = quality.keep_good(df, model)
    assert kept.columns == DOCS.names and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    one = quality.fit_quality(df, known.limit(0))
    assert {round(r["score"], 6) for r in quality.score_quality(df, one).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), model).count() == 0


def plain_tokens(text):
    """Tokens of one text: words, runs of punctuation, None for a token that repeats the one before it."""
    found = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode())
    return found, [None if i and found[i - 1] == t else t for i, t in enumerate(found)]


def test_quality_equals_brute_force(spark):
    texts = ["The cat, the CAT sat!!! sat", "a a a b a", "", None, "é é -- -- x1 ... x1", "  ", "one"] + [t for t in ODD if t]
    df = docs(spark, [(i, t, None) for i, t in enumerate(texts)]).repartition(3)
    place, sign = quality.index_vectors()

    def bucket(t):
        return 0 if t is None else int(find_words(pa.array([t.decode()]), quality._KIND > 0, lower=False).hashes()[0] % np.uint64(quality.BUCKETS - 1)) + 1

    sums = np.zeros((quality.BUCKETS, quality.DIM))
    buckets = [[bucket(t) for t in plain_tokens(x)[1]] for x in texts]
    for b in buckets:
        for i in range(len(b)):
            for j in range(max(0, i - 2), min(len(b), i + 3)):
                if i != j:
                    np.add.at(sums[b[i]], place[b[j]], sign[b[j]])
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1)
    assert np.allclose(quality.word_vectors(df), vectors, atol=1e-6)
    x = np.stack([vectors[b].mean(axis=0) if b else np.zeros(quality.DIM) for b in buckets])
    assert np.allclose(quality.features(pa.array(texts), vectors), x)
    rng = np.random.default_rng(1)
    net = quality.fit_network(rng.normal(size=(60, quality.DIM)), (rng.random(60) < 0.5).astype(float))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(df, quality.QualityModel(vectors, net)).collect()}
    for i, row in enumerate(x):
        z = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(row, net.mean, net.scale)]
        hidden = [math.tanh(sum(a * w for a, w in zip(z, net.w1[:, k])) + net.b1[k]) for k in range(len(net.b1))]
        logit = (sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / net.temperature
        assert got[i] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)


def test_quality_with_odd_rows_and_columns(spark):
    names = ("score", "predicted", "row", "a.b")
    texts = ["plain words here and there", "more plain words of text", "BAD!! BAD!! words!!", None, "", "x " * 2_000_000]
    ids = [1, 2, 3, None, 2, 6]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in zip(ids, texts)], T.StructType([*DOCS.fields[:2], *(T.StructField(n, T.LongType()) for n in names)]))
    model = quality.fit_quality(df, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int"))
    scored = quality.score_quality(df, model, keep=("doc_id", "score", "row"))
    assert scored.columns == ["doc_id", "row", "score", "predicted"] and scored.count() == len(ids)
    kept = quality.keep_good(df, model, 0.0)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))


def test_held_out_quality_and_languages_on_the_tables(spark):
    base = "/root/testdata/sf0.01"
    scored = quality.op10_quality(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out")
    held = scored.select("score", "predicted", "quality").toPandas()
    assert (held["predicted"] == held["quality"]).mean() > 0.97
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert len(bad) > 5 and (good[:, None] > bad[None, :]).mean() > 0.97  # AUC from the word vectors alone
    named = langid.op7_language_id(spark, base).join(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert named.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("a")).first()["a"] > 0.97


def test_pipeline_stages_with_odd_rows_and_columns(spark):
    """Null ids and texts, empty and long texts, repeated rows, an empty table, and columns named like the operators' own."""
    import corpus_pipeline

    names = ("row", "runs", "left", "bit", "bucket", "body", "place", "node", "key", "print", "n_hit", "n_words", "items", "spans", "score", "predicted", "a.b")
    line = "These words of a repeated passage stand in a good number of documents and nobody minds that they do so, since there are more than twenty five. "
    texts = [(1, "plain text one"), (2, None), (2, None), (3, ""), (None, "no id"), (4, line + "and more"), (5, line + "but other"), (5, line + "but other"), (6, "w " * 300_000), (7, "tab\tand\r\nfeed")]
    schema = T.StructType([*DOCS.fields[:5], *(T.StructField(n, T.LongType()) for n in names)])
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(names))) for i, t in texts], schema)
    for name, stage in corpus_pipeline.STAGES:
        for frame in (odd, odd.limit(0)):
            out = stage(spark, frame, BASE)
            rows = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == odd.columns and all(tuple(r)[5:] == tuple(range(len(names))) for r in rows), name
            assert len(rows) <= frame.count(), name
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.line_stage(spark, odd, BASE).collect())
    assert kept == Counter({(1, "plain text one"): 1, (2, None): 2, (3, ""): 1, (None, "no id"): 1, (4, line + "and more"): 1, (5, "but other"): 2, (6, "w " * 300_000): 1, (7, "tab\tand\r\nfeed"): 1})
    near = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, odd, BASE).collect())
    assert near[(2, None)] == 2 and near[(3, "")] == 0 and near[(None, "no id")] == 1 and near[(5, line + "but other")] in (0, 2)


def test_pipeline(spark):
    import corpus_pipeline

    docs_in = spark.read.parquet(f"{BASE}/documents.parquet")
    frame, sizes = docs_in, [docs_in.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, BASE)
        if k < 4:
            assert frame.columns == docs_in.columns
            frame = spark.createDataFrame(frame.collect(), docs_in.schema)
        sizes.append(frame.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] <= sizes[3] and sizes[5] == sizes[4]
    again = corpus_pipeline.run(spark, BASE)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in again.collect()) == Counter((r["doc_id"], r["ids_sha256"]) for r in frame.collect())
