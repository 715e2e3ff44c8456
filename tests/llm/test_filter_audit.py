"""The filter audit against a plain loop over documents and orders."""

import itertools
import re

from pyspark.sql import types as T

from spanwise.llm import filter_audit

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("part", T.StringType()), ("mask", T.LongType()))])
LABELS = "doc_id long, quality int, toxic int, part string"


def plain(docs, labels):
    marks = {}
    for i, q, x, *_ in labels:
        good, toxic = marks.get(i, (0, 0))
        marks[i] = (max(good, int(q == 1)), max(toxic, int(x == 1)))
    first = {}
    for i, t, *_ in docs:
        key = (i is None, i or 0)
        first[t or ""] = min(first.get(t or "", key), key)
    judged = []
    for i, t, source, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": (i is None, i or 0) > first[t]}
        judged.append((source or "", {c for c in fails if fails[c]}, *((0, 0) if i is None else marks.get(i, (0, 0)))))
    out = {}
    for part in {j[0] for j in judged}:
        own = [j[1:] for j in judged if j[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                before = set(order[:k])
                gone = [j for j in own if c in j[0] and not j[0] & before]
                total[c] += len(gone)
                out[part, "".join(order), k + 1] = [
                    sum(not j[0] & (before | {c}) for j in own), len(gone), sum(c in j[0] and bool(j[0] & before) for j in own), sum(j[0] == {c} for j in own), sum(j[1] for j in gone), sum(j[2] for j in gone),
                ]
        for key in [k for k in out if k[0] == part]:
            out[key].append(total[key[1][key[2] - 1]])
    return out


def test_audit_equals_a_plain_loop(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t\n", long, long, long.upper(), "a " * 60, long + " #", long + "|x", "A" * 50, long + "\x1c\x85 é", "x\x0by\x0cz " * 200, long, "#"]
    docs = [(i, t, (None, "s", "t", "")[i % 4], "p", 1) for i, t in enumerate(texts)]
    docs += [(4, long, "s", "p", 1), (None, long, "t", "p", 1), (None, "only", "t", "p", 1), (None, "only", "t", "p", 1), (3, "#", None, "p", 1)]
    labels = [(0, 1, 0, "x"), (3, 1, 1, "x"), (3, 0, None, "x"), (5, None, 1, "x"), (99, 1, 1, "x"), (13, 1, 1, "x"), (None, 1, 1, "x")]
    frame = spark.createDataFrame(docs, DOCS)
    marked = spark.createDataFrame(labels, LABELS)
    got = filter_audit.audit_orders(filter_audit.mask_cells(frame, marked)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == plain(docs, labels)
    assert len(got) == 600 * 3
    assert filter_audit.audit_orders(filter_audit.mask_cells(frame.limit(0), marked)).count() == 0


def test_more_parts_than_the_recursion_limit(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit", "1000000")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "400")
    try:
        docs = spark.createDataFrame([(i, "x", f"s{i}", "p", 1) for i in range(3)], DOCS)
        assert filter_audit.audit_orders(filter_audit.mask_cells(docs, spark.createDataFrame([], LABELS))).count() == 1800
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
