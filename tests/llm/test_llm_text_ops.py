"""BPE, token counts, decontamination, license scans, exact dedup, SimHash and line dedup against plain models."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import types as T

from spanwise.llm import bpe, decontam, exact_dedup, licenses, line_dedup, queries, simhash, token_counts

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [None, "", " ", "\n\n", "A", "a" * 5000, "word " * 3000, "Été ΣΣ İ straße 中文 🎉👍", "<|endoftext|>x<|startoftext|>", "tab\tand\x0bfeed\x1c\x85\xa0end", "same", "SAME", "same"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("print", T.LongType()), T.StructField("key", T.StringType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, None, "s", len(t or ""), 1, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def fuzz(n, seed=1, alphabet="abcdefgzAZ 019'.,!?<|>\n\t\x1c\x85\xa0éÉßüñΣσςİıǅ中文字🎉👍ﬁ٣½_-"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(n)]


def test_bpe_equals_the_library(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = tokenizers.Tokenizer.from_file(path)
    texts = ODD + fuzz(400) + ["aaaaa", "hahahahaha", "I'll don't WE'VE"]
    got = {r["doc_id"]: r for r in bpe.bpe_round_trip(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == own.decode(ids, skip_special_tokens=False)
    digests = bpe.bpe_round_trip(docs(spark, texts), path, ("ids_sha256", "decoded_sha256")).collect()
    for r in digests:
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, got[r["doc_id"]]["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(got[r["doc_id"]]["decoded"].encode()).hexdigest()
    assert bpe.bpe_round_trip(docs(spark, []), path).count() == 0
    clash = bpe.bpe_round_trip(docs(spark, ["a b"]).withColumnRenamed("key", "ids"), path, keep=("doc_id", "ids", "print"))
    assert clash.columns == ["doc_id", "print", "n_tokens", "ids", "decoded"] and clash.count() == 1
    other = json.loads(open(path, encoding="utf-8").read()) | {"normalizer": {"type": "NFKC"}}
    (tmp_path / "other.json").write_text(json.dumps(other))
    with pytest.raises(ValueError):
        bpe.BpeCodec(str(tmp_path / "other.json"))


def test_token_counts_equal_the_library(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tokenizers.Tokenizer.from_file(path)
    long = ["ab cd\n\nef  gh\tij 12 <|endoftext|> " * 3000, "x" * 60_000, "a b\nc\x85d\x1ce " * 9000]
    texts = ODD + fuzz(300, 2) + long
    for r in token_counts.count_tokens(docs(spark, texts), path, 512).collect():
        t = texts[r["doc_id"]] or ""
        n = len(own.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)
    for t in long + fuzz(200, 3):
        parts = token_counts.safe_parts(t, 7)
        assert "".join(parts) == t
        assert sum(len(own.encode(p, add_special_tokens=False).ids) for p in parts) == len(own.encode(t, add_special_tokens=False).ids)
    assert token_counts.count_tokens(docs(spark, []), path, 512).count() == 0
    clash = token_counts.count_tokens(docs(spark, ["a b"]).withColumnRenamed("key", "n_tokens"), path, 512, keep=("doc_id", "n_tokens"))
    assert clash.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and clash.count() == 1


def test_tokenizers_take_very_long_texts(spark):
    rnd = random.Random(31)
    long = " ".join(rnd.choice(["alpha", "Beta", "gam-ma", "É9", "x" * 40, "12,345"]) for _ in range(400_000))
    assert len(long) > 3_000_000
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    ids = tokenizers.Tokenizer.from_file(word).encode(long, add_special_tokens=False).ids
    got = bpe.bpe_round_trip(docs(spark, [long, "b"]), word, ("n_tokens", "ids_sha256")).where("doc_id = 0").first()
    assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    n = len(tokenizers.Tokenizer.from_file(byte).encode(long, add_special_tokens=False).ids)
    assert token_counts.count_tokens(docs(spark, [long]), byte, 512).first()["n_tokens"] == n


def contamination(texts, items, span=10):
    out = []
    its = [(i, WORD.findall(low(t or ""))) for i, t in items]
    for t in texts:
        w, hit, got = WORD.findall(low(t or "")), set(), set()
        for i, x in its:
            k = min(span, len(x))
            wins = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if x else set()
            for j in range(len(w) - k + 1):
                if x and tuple(w[j : j + k]) in wins:
                    hit |= set(range(j, j + k))
                    got.add(str(i))
        out.append((len(w), len(hit), sorted(got)))
    return out


def test_decontamination_finds_every_window(spark):
    rnd = random.Random(5)

    def mk(n):
        return "".join(rnd.choice(["a", "b", "c", "É", "x9", "Zz"]) + rnd.choice([" ", "\n", "-", ". "]) for _ in range(n))

    items = [(i, mk(rnd.choice([0, 1, 3, 9, 10, 11, 14, 25]))) for i in range(12)] + [(90, None), (3, "zz b c zz b c")]
    texts = [mk(rnd.choice([0, 2, 9, 30, 80])) for _ in range(20)] + ODD
    texts += [mk(7) + (rnd.choice(items)[1] or "") + mk(5) for _ in range(20)]
    want = contamination(texts, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (decontam.BROADCAST_WORDS, 0):  # in one pass, and by a shuffle
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.find_contamination(docs(spark, texts), bench, broadcast_words=bound).collect()}
        assert [got[i] for i in range(len(texts))] == want
    clean = decontam.remove_contaminated(docs(spark, texts), bench)
    assert clean.columns == DOCS.names and {r["doc_id"] for r in clean.collect()} == {i for i, x in enumerate(want) if not x[1]}
    assert decontam.find_contamination(docs(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.find_contamination(docs(spark, []), bench).count() == 0


@pytest.mark.parametrize("bound", [decontam.BROADCAST_WORDS, 0])
def test_decontamination_with_odd_items_and_columns(spark, bound, monkeypatch):
    monkeypatch.setattr(decontam, "CANDIDATES", 2)
    words = [f"w{i}" for i in range(200)]
    items = [(None, " ".join(words[:20])), ("b", " ".join(words[30:45])), ("b", " ".join(words[60:75])), ("a,x", "only three words"), ("", None), ("long", " ".join(words))]
    texts = [" ".join(words[5:40]), "say only THREE words", "none", None, "", " ".join(words[25:]), "x " * 100_000 + " ".join(words[55:90])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = contamination(texts, items)
    names = ("n_hit", "n_words", "items", "spans", "row", "kept", "key", "a.b")
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in enumerate(texts)], T.StructType([*DOCS.fields[:2], *(T.StructField(n, T.LongType()) for n in names)]))
    got = {r["doc_id"]: r for r in decontam.find_contamination(df, bench, keep=("doc_id", "n_hit", "key"), broadcast_words=bound).collect()}
    for i, (n, hit, found) in enumerate(want):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["key"]) == (n, hit, [x for x in found if x != "None"], names.index("key"))
        assert sum(x["end"] - x["start"] for x in got[i]["spans"]) == hit and all(x["end"] < y["start"] for x, y in zip(got[i]["spans"], got[i]["spans"][1:]))
    clean = decontam.remove_contaminated(df, bench, broadcast_words=bound)
    assert clean.columns == df.columns
    assert sorted(tuple(r) for r in clean.collect()) == [(i, t, *range(len(names))) for i, t in enumerate(texts) if not want[i][1]]
    twice = decontam.find_contamination(docs(spark, [texts[0]] * 2, [1, 1]), bench, broadcast_words=bound)
    assert [(r["doc_id"], r["n_hit"]) for r in twice.collect()] == [(1, want[0][1])] * 2


def test_hits_are_compared_as_bytes(monkeypatch):
    from spanwise.llm.text import Words

    monkeypatch.setattr(Words, "hashes", lambda self: (self.end - self.start).astype(np.uint64))  # all words of one length collide
    index = decontam.Index([1, 2], ["aa bb cc dd ee ff gg hh ii jj kk", "x1 x2"], 10)
    texts = ["aa bb cc dd ee ff gg hh ii zz", "qq aa bb cc dd ee ff gg hh ii jj x1 x2", "x1 x3"]
    assert index.report(pa.array(texts)) == [(10, [], []), (13, [(1, 13)], [1, 2]), (2, [], [])]


def test_long_shared_texts_are_walked_once():
    rnd = np.random.default_rng(6)
    words = [f"w{i}" for i in rnd.integers(0, 10**6, 300_000)]
    index = decontam.Index([1], [" ".join(words)], 10)
    text = " ".join(["start", *words[5:200_000], "other", *words[200_001:], "end"])
    assert index.report(pa.array([text])) == [(299_997, [(1, 199_996), (199_997, 299_996)], [1])]


def test_winnowing_keeps_a_print_of_every_shared_span():
    rnd = np.random.default_rng(3)
    shared = rnd.integers(0, 9, 10, dtype=np.uint64)
    for _ in range(50):
        a, b = (np.concatenate((rnd.integers(0, 9, 30, dtype=np.uint64), shared, rnd.integers(0, 9, 30, dtype=np.uint64))) for _ in range(2))
        kept = [set(g[decontam.winnow(g, 5, np.full(len(g), len(g)))].tolist()) for g in (decontam.grams(a, 6), decontam.grams(b, 6))]
        assert kept[0] & kept[1] & set(decontam.grams(shared, 6).tolist())


def test_licenses_equal_brute_force(spark):
    rnd = random.Random(8)
    notice = licenses.TEMPLATES["mit"]
    broken = " ".join(w for w in notice.split() if rnd.random() < 0.93)
    half = " ".join(notice.split()[: len(notice.split()) // 2])
    filler = " ".join(rnd.choice(["of", "the", "software", "zz", "any"]) for _ in range(700))
    mixed = notice.split()
    rnd.shuffle(mixed)
    texts = ODD + [notice, filler + " " + broken + " " + filler, half, "The MIT License. apache-license; GENERAL public\nlicense mit license", filler, licenses.TEMPLATES["gpl"].upper(), "mit", "license", " ".join(mixed), filler * 30 + " " + licenses.TEMPLATES["isc"]]
    texts += [f"{x} {y}" for x in licenses.TEMPLATES.values() for y in licenses.TEMPLATES.values()]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    found = Counter()
    for i, t in enumerate(texts):
        w = WORD.findall(low(t or ""))
        places, base, labels, best, blocks = [], set(), set(), 0.0, []
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [j for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
            places += at
            base |= {label} if at else set()
        for label, body in licenses.TEMPLATES.items():
            x = WORD.findall(low(body))
            own, pairs, step = set(x), set(zip(x, x[1:])), -(-len(x) // 4)
            for a in range(0, len(w), step):
                part = w[a : a + len(x) + step]
                share = len(own & set(part)) / len(own)
                if share < licenses.THRESHOLD:
                    continue
                ordered = len(pairs & set(zip(part, part[1:]))) >= licenses.ORDER * len(pairs) - 1e-9
                blocks.append((label, a, a + len(part) - 1, pytest.approx(share), ordered))
                if ordered:
                    labels.add(label)
                    best = max(best, share)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == sorted(base) and r["labels"] == sorted(base | labels)
        assert r["score"] == pytest.approx(1.0 if base else best)
        assert [tuple(b) for b in r["blocks"]] == blocks
        found.update(labels)
        found.update("apart " + b[0] for b in blocks if not b[4])
    assert found["mit"] == 11 and found["gpl"] >= 10 and found["apart mit"] >= 1
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_each_license_gets_its_own_label_only(spark):
    prose = "Permission to use the hall for any purpose with or without a fee is granted to all, provided that this notice and the above rules appear in and on all copies of the form, and that copyright, copy and software matters are sent to the office to modify or distribute them."
    texts = [*licenses.TEMPLATES.values(), "Copyright (c) 2020 X\n\n" + licenses.TEMPLATES["mit"] + "\n\n" + licenses.TEMPLATES["bsd"], prose, prose * 20]
    rows = docs(spark, texts).withColumnRenamed("key", "score")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(rows, keep=("doc_id", "score")).collect()}
    assert [got[i] for i in range(len(texts))] == [[x] for x in licenses.TEMPLATES] + [["bsd", "mit"], [], []]


def test_blocks_in_disorder_are_returned_without_a_label(spark):
    rnd = random.Random(4)
    shuffled = []
    for body in licenses.TEMPLATES.values():
        words = WORD.findall(low(body).replace("license", "licence"))
        rnd.shuffle(words)
        shuffled.append(" ".join(words))
    got = licenses.scan_licenses(docs(spark, shuffled + list(licenses.TEMPLATES.values()))).orderBy("doc_id").collect()
    names, n = list(licenses.TEMPLATES), len(shuffled)
    for i, r in enumerate(got):
        assert names[i % n] in [b["label"] for b in r["blocks"]]
        assert r["labels"] == ([] if i < n else [names[i % n]]) and all(b["ordered"] == (i >= n) for b in r["blocks"] if b["label"] == names[i % n] and b["first"] == 0)


def test_words_are_compared_as_bytes(monkeypatch):
    from spanwise.llm.text import Words

    monkeypatch.setattr(Words, "hashes", lambda self: (self.end - self.start).astype(np.uint64))
    v = licenses.Vocabulary(["ab abc"])
    assert v.numbers(licenses.find_words(pa.array(["abc ab xy xyz a", None, ""]), licenses.ALNUM)).tolist() == [1, 0, -1, -1, -1]


@pytest.mark.parametrize("digest_hex,bound", [(64, 10), (1, 10), (1, 0), (64, 0)])
def test_exact_dedup_by_bytes(spark, digest_hex, bound):
    texts = ODD + fuzz(60, 4, "aAbBéÉ") + ["Common text"] * 1200 + ["É", "é", None]
    ids = [*range(len(texts) - 3), None, 3, 3]
    rows = exact_dedup.dedup_exact(docs(spark, texts, ids), digest_hex=digest_hex, broadcast_groups=bound).collect()
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[low(t or "")].append(i)
    want = Counter()
    for t, members in groups.items():
        keep = max((m for m in members if m is not None), default=None)
        for m in members:
            want[(m, keep, len(members), m == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert exact_dedup.dedup_exact(docs(spark, [])).count() == 0
    smallest = exact_dedup.dedup_exact(docs(spark, ["x", "X", "y"]), largest=False).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in smallest} == {(0, 0), (1, 0), (2, 2)}


def test_merge_index_keeps_older_runs(spark, monkeypatch):
    rnd = random.Random(21)
    rows = [(i, f"{rnd.randint(0, 150):03}") for i in range(400)]
    for digests, broadcast_bits in ((10**6, 1 << 27), (10, 1 << 27), (10**4, 0)):
        monkeypatch.setattr(exact_dedup, "BROADCAST_BITS", broadcast_bits)
        index = exact_dedup.MergeIndex(digests, largest=False, fanout=3)
        files = []
        for k in range(0, 400, 50):
            index.add(spark.createDataFrame(rows[k : k + 50], "doc_id long, digest string"))
            want = defaultdict(list)
            for i, d in rows[: k + 50]:
                want[d].append(i)
            assert {(r["digest"], r["keep_id"], r["n"]) for r in index.groups().collect()} == {(d, min(x), len(x)) for d, x in want.items() if len(x) > 1}
            files.append({f for run, _ in index.runs for f in run.inputFiles()})
        assert [len(level) for level in index.levels] == [2, 2]
        assert files[0] < files[1] and files[6] < files[7]  # a batch adds a run beside the others
        for run, _ in index.runs:
            for f in run.inputFiles():
                own = [r["digest"] for r in spark.read.parquet(f).collect()]
                assert own == sorted(set(own))


def test_merge_index_can_be_opened_and_extended(spark, tmp_path):
    rnd = random.Random(22)
    rows = [(i, f"{rnd.randint(0, 90):03}") for i in range(300)]
    index = exact_dedup.MergeIndex(300, largest=False, fanout=3)
    for k in range(0, 200, 50):
        index.add(spark.createDataFrame(rows[k : k + 50], "doc_id long, digest string"))
    index.save(f"{tmp_path}/index")
    for _ in range(2):  # opening and extending leaves the folder as it was
        again = exact_dedup.MergeIndex.open(spark, f"{tmp_path}/index")
        assert [len(level) for level in again.levels] == [1, 1] and (again.bits, again.largest, again.fanout) == (index.bits, False, 3)
        old = {f for run, _ in again.runs for f in run.inputFiles()}
        for upto in (200, 250, 300):
            if upto > 200:
                again.add(spark.createDataFrame(rows[upto - 50 : upto], "doc_id long, digest string"))
            want = defaultdict(list)
            for i, d in rows[:upto]:
                want[d].append(i)
            assert {(r["digest"], r["keep_id"], r["n"]) for r in again.groups().collect()} == {(d, min(x), len(x)) for d, x in want.items() if len(x) > 1}
            if upto == 250:
                assert old < {f for run, _ in again.runs for f in run.inputFiles()}


def plain_fingerprint(text, k=4):
    w = low(text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(prints, bits=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    rnd = random.Random(9)
    texts = list(ODD)
    for _ in range(12):
        base = [rnd.choice(["ka", "lo", "mi", "nu", "po", "Re"]) + str(rnd.randint(0, 30)) for _ in range(rnd.choice([5, 60, 300]))]
        for _ in range(12):
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == components_of(prints)
    kept = simhash.keep_one_of_each(docs(spark, texts))
    assert kept.columns == DOCS.names and {r["doc_id"] for r in kept.collect()} == set(components_of(prints))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    names = ("print", "body", "row", "root", "component_id", "a.b")
    rows = [(3, one), (7, one), (7, other), (None, one), (9, None), (8, "")]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], T.StructType([*DOCS.fields[:2], *(T.StructField(n, T.LongType()) for n in names)]))
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter((i, t, *range(len(names))) for i, t in rows if (i, t) not in ((7, one), (9, None)))
    long = "word " * 400_000 + "end"
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, [long, long + " more", one])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize("trie_rows", [2048, 40])
def test_trie_join_links_what_brute_force_links(spark, trie_rows):
    rnd = random.Random(trie_rows)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 25])):
            x = base
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    rooted = {r["node"]: r["root"] for r in simhash.components(simhash.link_edges(df, 4, trie_rows)).collect()}
    want = components_of(prints)
    smallest = defaultdict(lambda: 1 << 64)
    for p, c in zip(signed, want):
        smallest[c] = min(smallest[c], p)
    assert [rooted.get(p, p) for p in signed] == [smallest[c] for c in want]


def test_trie_pairs_are_all_pairs():
    rng = np.random.default_rng(4)
    group = np.sort(rng.integers(0, 5, 300))
    prints = rng.integers(0, 1 << 9, 300, dtype=np.uint64) << np.uint64(20)
    order = np.lexsort((prints, group))
    prints = prints[order]
    got = {(int(i), int(j)) for a, b in simhash.trie_pairs(prints, group, 2) for i, j in zip(a, b)}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and int(prints[i] ^ prints[j]).bit_count() <= 2}
    assert got == want


def test_line_dedup_equals_its_definition(spark):
    rnd = random.Random(11)

    def sentence(n):
        return " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 3) for _ in range(n)).capitalize() + rnd.choice([".", "!", "?"])

    passages = [" ".join(sentence(rnd.randint(2, 9)) for _ in range(8)) for _ in range(6)] + [sentence(30), sentence(12) + "\n" + sentence(15)]
    texts = []
    for _ in range(60):
        parts = [sentence(rnd.randint(1, 8)) for _ in range(rnd.randint(0, 12))]
        for p in rnd.sample(passages, rnd.randint(0, 2)):
            parts.insert(rnd.randint(0, len(parts)), p)
        texts.append(rnd.choice([" ", "\n"]).join(parts))
    texts += [t for t in ODD if t not in ("same", "SAME")] + [passages[0], passages[0] + " " + passages[0]]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    want = earlier_lines(texts, line_dedup.MIN_WORDS)
    assert [got[i] for i in range(len(texts))] == want
    for p in passages[:6]:
        inside = " ".join(p.split(". ")[1:-1])
        assert sum(inside in " ".join((t or "").split(". ")) for t in got.values()) <= 1 or len(inside.split()) < 25
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    nobody = line_dedup.dedup_lines(docs(spark, ["x " * 30, "X " * 30 + "\n", None], [4, None, None])).orderBy("n_chars").collect()
    assert {(r["doc_id"], r["text"]) for r in nobody} == {(4, "x " * 30), (None, ""), (None, None)}
    same = line_dedup.dedup_lines(docs(spark, ["One sentence. " + "word " * 40] * 2, [7, 7]))
    assert [r["text"] for r in same.collect()] == ["One sentence. " + "word " * 40] * 2
    counted = line_dedup.dedup_lines(docs(spark, ["x y. " + "word " * 40, "new. " + "word " * 40], [1, 2])).orderBy("doc_id").collect()
    assert counted[1]["text"] == "new. " and counted[1]["n_chars"] == 5 and counted[0]["n_chars"] == 205


def lines_of(texts):
    """Of each text, its lines, and (number, plain form) of those that are not blank."""
    cuts, lines = [], []
    for t in texts:
        cut = re.split(r"(?<=\n)|(?<=[.!?] )", t) if t is not None else []
        plain = [x.removesuffix("\n").replace("\t", " ").replace("\r", " ").lower().strip(" ") for x in cut]
        cuts.append(cut)
        lines.append([(i, x) for i, x in enumerate(plain) if x])
    return cuts, lines


def common_sequences(texts, min_words):
    """The lines of each text that are in a sequence of min_words words or more which also starts at an earlier place: a plain pass over all pairs of places."""
    _, lines = lines_of(texts)
    places = defaultdict(list)
    drop = [set() for _ in texts]
    for d, own in enumerate(lines):
        for p, (_, x) in enumerate(own):
            for e, q in places[x]:
                other = lines[e]
                if p and q and own[p - 1][1] == other[q - 1][1]:
                    continue
                n = 0
                while p + n < len(own) and q + n < len(other) and own[p + n][1] == other[q + n][1]:
                    n += 1
                if sum(y.count(" ") + 1 for _, y in own[p : p + n]) >= min_words:
                    drop[d] |= set(range(own[p][0], own[p + n - 1][0] + 1))
            places[x].append((d, p))
    return drop


def earlier_lines(texts, min_words):
    """What stays of each text (in order of doc_id) by the definition: runs of lines linked by pairs that stand earlier, or long lines that do."""
    cuts, lines = lines_of(texts)
    seen, out = set(), []
    for t, cut, own in zip(texts, cuts, lines):
        words = [x.count(" ") + 1 for _, x in own]
        linked = []
        for p, (_, x) in enumerate(own):
            pair = (x, own[p + 1][1]) if p + 1 < len(own) else None
            linked.append((pair in seen, words[p] >= min_words and x in seen))
            seen |= {pair, x if words[p] >= min_words else None} - {None}
        drop, a = set(), 0
        while a < len(own):
            b = a
            while b < len(own) and linked[b][0]:
                b += 1
            end = b if b > a or linked[a][1] else a - 1
            if end >= a and sum(words[a : end + 1]) >= min_words:
                drop |= set(range(own[a][0], own[end][0] + 1))
            a = max(end, a) + (0 if end > a and end < len(own) and linked[end][1] else 1)
        out.append(None if t is None else "".join(x for i, x in enumerate(cut) if i not in drop))
    return out


def test_line_dedup_deletes_all_common_sequences(spark):
    """Against the plain search: nothing that it finds stays, and here hardly anything else goes."""
    rnd = random.Random(21)
    stock = [" ".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 9))) for _ in range(300)]
    passages = [rnd.sample(stock, rnd.randint(6, 12)) for _ in range(12)]
    texts = []
    for i in range(80):
        parts = rnd.sample(stock, rnd.randint(0, 15)) + [f"own {i}"]
        for p in rnd.sample(passages, 2):
            a = rnd.randint(0, 3)
            parts[1:1] = p[a:]
        texts.append("\n".join(parts))
    texts += [texts[3], "x\n" + texts[5], None]
    cuts, _ = lines_of(texts)
    want = common_sequences(texts, line_dedup.MIN_WORDS)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    counted = line_dedup.dedup_lines(docs(spark, texts), report=True).agg({"n_deleted": "sum"}).first()[0]
    exact = sum(map(len, want))
    assert [got[i] for i in range(len(texts))] == earlier_lines(texts, line_dedup.MIN_WORDS)
    for i, (cut, gone) in enumerate(zip(cuts, want)):
        stays = [x for j, x in enumerate(cut) if j not in gone]
        left = iter(stays)
        assert all(x in left for x in re.split(r"(?<=\n)", got[i] or "") if x), i  # what stays is part of what the search leaves
    assert exact <= counted <= 1.02 * exact


def test_line_dedup_keeps_lines_that_stood_apart(spark):
    lines = [f"line {i} has six words here" for i in range(5)]
    texts = [f"own {i} a\n{x}\nother {i} b" for i, x in enumerate(lines)] + ["\n".join(reversed(lines)), "\n".join(lines), "start\n" + "\n".join(lines) + "\nend"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in range(7)] == texts[:7] and got[7] == "start\nend"


def test_line_dedup_takes_ids_of_any_type(spark):
    line = "word " * 30
    df = spark.createDataFrame([("d-2", "a\n" + line), ("b-1", line), ("a", "own text"), (None, line), ("b-1", line), ("010", None)], "doc_id string, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == sorted([("d-2", "a\n"), ("b-1", line), ("a", "own text"), (None, ""), ("b-1", line), ("010", None)], key=str)


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ("row", "place", "body", "runs", "left", "line", "pos", "w", "print", "n_lines", "_text", "a.b", "`q`")
    line = "word " * 30
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in enumerate([line, "own\n" + line, line])], T.StructType([*DOCS.fields[:2], *(T.StructField(n, T.LongType()) for n in names)]))
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", *names]
    assert sorted(tuple(r) for r in got.collect()) == [(i, t, *range(len(names))) for i, t in enumerate([line, "own\n", ""])]
    counted = line_dedup.dedup_lines(df, report=True)
    assert counted.columns == ["doc_id", "text", *(n for n in names if n != "n_lines"), "n_lines", "n_deleted", "words_deleted"]
    assert [tuple(r) for r in counted.select("n_lines", "n_deleted", "words_deleted").orderBy("doc_id").collect()] == [(1, 0, 0), (2, 1, 30), (1, 1, 30)]


def test_line_dedup_takes_very_long_texts(spark):
    rnd = random.Random(16)
    long = "".join(" ".join(f"w{rnd.randint(0, 10**9)}" for _ in range(12)) + rnd.choice(["\n", ". ", "! "]) for _ in range(70_000))
    assert len(long) > 8_000_000
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, [long, "a\n" + long + "b"])).collect()}
    assert got == {0: long, 1: "a\nb"}


def test_line_dedup_compares_all_earlier_places(spark):
    rnd = random.Random(14)
    common = [f"w{i}" for i in range(60)]  # each stands first in a text of its own, so no neighbours of first places agree
    texts = [f"{x}\nown {i}" for i, x in enumerate(common)]
    for i in range(20):
        texts.append("\n".join([f"start {i}", *rnd.sample(common, 50), f"end {i}"]))
    whole = "\n".join(rnd.sample(common, 40) + [f"new {i}" for i in range(30)])
    texts += [whole, "other\n" + whole]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == earlier_lines(texts, line_dedup.MIN_WORDS)
    assert got[len(texts) - 1] == "other\n"


def test_line_dedup_passes_over_blank_lines(spark):
    rnd = random.Random(15)
    passages = ["\n\n".join(" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(15)) for _ in range(5)) for _ in range(20)]
    texts = [f"{p}\n" for p in passages] + [f"head {i}\n\n{p}\n\ntail {i}\n" for i, p in enumerate(passages)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in range(20)] == texts[:20]
    assert [got[20 + i] for i in range(20)] == [f"head {i}\n\n\ntail {i}\n" for i in range(20)]
    assert [got[i] for i in range(40)] == earlier_lines(texts, line_dedup.MIN_WORDS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    rows = Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in want.select(*columns).fetchall())
    got = queries.QUERIES[name](spark, base)
    assert sorted(got.columns) == columns
    assert Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got.select(*columns).collect()) == rows
