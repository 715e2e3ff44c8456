"""Interval, spell and cohort operators against hand-made cases and a day-by-day model."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from spanwise.operators import cohort, spells

D0 = date(2020, 1, 1)
FILL = "member_id long, atc_3_code string, filldate date, supplydayscount int, is_query_drug boolean"


def day(n):
    return None if n is None else D0 + timedelta(n)


def fills(spark, rows):
    """rows: (member, drug, first day, days, listed)"""
    return spark.createDataFrame([(m, d, day(s), n, q) for m, d, s, n, q in rows], FILL)


def model(rows, k, grace, min_len):
    """Spells by walking through the change points of each member."""
    out = []
    for m in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == m]
        spans = []
        for drug in sorted({r[1] for r in own}):
            mine = sorted((s, s + n - 1) for _, d, s, n, _ in own if d == drug)
            listed = any(q for _, d, _, _, q in own if d == drug)
            lo, hi = mine[0]
            for s, e in mine[1:]:
                if s <= hi + 1 + grace:
                    hi = max(hi, e)
                else:
                    spans.append((lo, hi, listed))
                    lo, hi = s, e
            spans.append((lo, hi, listed))
        points = sorted({p for s, e, _ in spans for p in (s, e + 1)})
        up = [sum(s <= p <= e for s, e, _ in spans) >= k and any(s <= p <= e and q for s, e, q in spans) for p in points]
        entry, low, below, found = None, None, 0, []
        for i, p in enumerate(points):
            width = points[i + 1] - p if i + 1 < len(points) else 1
            if entry is None:
                if up[i]:
                    entry, low, below = p, None, 0
                continue
            if up[i]:
                low, below = None, 0
                continue
            low = p if low is None else low
            below += width
            if below >= grace:
                found.append((entry, low - 1))
                entry, low, below = None, None, 0
        if entry is not None:
            found.append((entry, points[-1]))
        n = 0
        for a, b in found:
            if b + grace - a + 1 >= min_len + grace:
                n += 1
                out.append((m, m * 1000 + n, a, b))
    return out


@pytest.mark.parametrize("k,grace,min_len", [(3, 15, 7), (2, 5, 1), (2, 21, 30), (1, 1, 7)])
def test_spells_equal_a_sequential_model(spark, k, grace, min_len):
    rnd = random.Random(k * 100 + grace)
    rows = []
    for m in range(1, 41):
        listed = set(rnd.sample("abcdef", 2))
        rows += [(m, d := rnd.choice("abcdef"), rnd.randint(0, 300), rnd.randint(1, 60), d in listed) for _ in range(rnd.randint(1, 25))]
    iv = spells.drug_intervals(fills(spark, rows), grace)
    got = [(r["member_id"], r["spell_id"], (r["entry_date"] - D0).days, (r["raw_exit_date"] - D0).days) for r in spells.detect_spells(iv, k, grace, min_len).collect()]
    assert sorted(got) == model(rows, k, grace, min_len)


def test_fills_join_up_to_grace_plus_one(spark):
    rows = [(1, "a", 0, 10, True), (1, "a", 10 + 5, 10, True), (2, "a", 0, 10, False), (2, "a", 10 + 6 + 1, 10, False), (3, None, 0, 5, True), (3, "b", None, 5, True)]
    got = {(r["member_id"], (r["start"] - D0).days, (r["end"] - D0).days, r["is_op"]) for r in spells.drug_intervals(fills(spark, rows), 5).collect()}
    assert got == {(1, 0, 24, 1), (2, 0, 9, 0), (2, 17, 26, 0)}


SPELL = "member_id long, spell_id long, entry_date date, raw_exit_date date, extended_exit_date date, spell_length_days int, followup_end_date date"


def spell(spark, *rows):
    """rows: (spell, entry, exit, follow-up end)"""
    return spark.createDataFrame([(s // 1000, s, day(a), day(b), day(b), b - a + 1, day(f)) for s, a, b, f in rows], SPELL)


def test_enrollment_and_washout(spark):
    base = spell(spark, (1001, 200, 300, None), (2001, 200, 300, None), (3001, 200, 300, None)).drop("followup_end_date")
    rows = [(1, 0, 250), (1, 240, 280), (2, 0, 100), (2, 101, 400), (3, 310, 400), (3, 300, 200)]
    enroll = spark.createDataFrame([(m, day(a), day(b)) for m, a, b in rows], "member_id long, effectivedate date, terminationdate date")
    got = {r["spell_id"]: (r["followup_end_date"] - D0).days for r in spells.censor_enrollment(base, enroll).collect()}
    assert got == {1001: 280, 2001: 300}
    assert [r["spell_id"] for r in spells.require_washout(base, enroll, 180).collect()] == [1001]
    assert sorted(r["spell_id"] for r in spells.require_washout(base, enroll, 180, bridge=True).collect()) == [1001, 2001]


def test_first_event(spark):
    base = spell(spark, (1001, 100, 200, 200), (2001, 100, 200, 200), (3001, 100, 200, 150), (4001, 100, 200, 200), (5001, 100, 200, 200))
    events = [(1, 101, "B"), (1, 101, "A"), (1, 150, "C"), (2, 90, "A"), (2, 120, "A"), (2, 120, "B"), (3, 152, "A"), (4, 90, "Z"), (4, 120, "A"), (4, 130, "Z"), (5, 101, "Q")]
    ae = spark.createDataFrame([(m, day(d), c) for m, d, c in events], "member_id long, event_date date, code_value string")
    got = {r["spell_id"]: r for r in spells.label_first_event(base, ae).collect()}
    assert set(got) == {1001, 3001, 4001, 5001}  # 2001's first code was known before
    assert (got[1001]["first_ae_code"], got[1001]["first_ae_date"], got[1001]["ae_codes"]) == ("A", day(100), ["A", "B", "C"])
    assert not got[3001]["had_ae"] and got[3001]["ae_codes"] == []
    assert got[4001]["ae_codes"] == ["A"] and got[5001]["first_ae_date"] == day(100)


def changes(spark, rows):
    return spark.createDataFrame([(s // 1000, s, day(d), t, c, 0) for s, d, t, c in rows], "member_id long, spell_id long, date date, change_type string, atc_3_code string, is_op int")


def labelled(spark, *rows):
    """rows: (spell, entry, exit, follow-up end, event day)"""
    df = spell(spark, *((s, a, b, f) for s, a, b, f, _ in rows))
    ev = spark.createDataFrame([(s, day(e)) for s, *_, e in rows], "spell_id long, first_ae_date date")
    return df.join(ev, "spell_id").select(*df.columns, F.col("first_ae_date").isNotNull().alias("had_ae"), "first_ae_date", F.array(F.lit("X")).alias("ae_codes"), F.lit("X").alias("first_ae_code"))


def test_segments_and_combinations(spark):
    base = labelled(spark, (1001, 10, 50, 40, None), (2001, 10, 50, 50, 30), (3001, 10, 50, 50, None), (4001, 10, 50, 50, 20))
    ch = changes(spark, [(1001, 10, "add", "a"), (1001, 10, "ADD", "b"), (1001, 20, "add", "c"), (1001, 20, "drop", "a"), (1001, 40, "add", "d"), (1001, 45, "add", "e"), (2001, 12, "add", "a"), (2001, 25, "add", "b"), (3001, 5, "add", "a"), (4001, 20, "add", "a")])
    got = {(r["spell_id"], r["split_seq"]): r for r in spells.split_at_adds(base, ch).collect()}
    ends = {k: ((r["entry_date"] - D0).days, (r["extended_exit_date"] - D0).days, r["segment_end_reason"], r["had_ae"]) for k, r in got.items()}
    assert ends == {
        (1001, 1): (10, 19, "next_add", False), (1001, 2): (20, 39, "next_add", False), (1001, 3): (40, 40, "followup_end", False), (2001, 1): (12, 24, "next_add", False), (2001, 2): (25, 30, "ae", True),
        (3001, 1): (10, 50, "no_adds", False), (4001, 1): (20, 20, "ae", True),
    }
    assert got[(2001, 1)]["first_ae_date"] is None and got[(2001, 1)]["first_ae_code"] == "X"
    segs = spells.split_at_adds(base, ch)
    combo = {(r["spell_id"], r["split_seq"]): r["drug_combo"] for r in spells.label_combo(segs, ch).collect()}
    assert combo[(1001, 1)] == ["a", "b"] and combo[(1001, 2)] == ["b", "c"] and combo[(1001, 3)] == ["b", "c", "d"]
    assert combo[(3001, 1)] == ["a"]
    iv = spark.createDataFrame([(1, "a", day(-300), day(15), 0), (1, "z", day(-300), day(300), 0)], "member_id long, atc_3_code string, start date, end date, is_op int")
    exact = {(r["spell_id"], r["split_seq"]): r["drug_combo"] for r in spells.label_combo(segs, ch, True, iv).collect()}
    assert exact[(1001, 1)] == ["a", "z"] and exact[(1001, 2)] == ["z"] and exact[(3001, 1)] == []


def test_cohort_filters(spark):
    rows = [
        (1, 1001, 1, 0, 30, True, 10, ["A11"], ["a", "b", "c"]), (1, 1001, 2, 5, 30, False, None, [], ["a", "b", "c"]), (2, 2001, 1, 0, 10, False, None, [], ["a", "b", "c"]), (3, 3001, 1, 0, 30, True, 0, [], ["a", "b", "c"]),
        (4, 4001, 1, 0, 30, True, 40, ["X12", "E11"], ["a", "b", "c"]), (5, 5001, 1, 0, 30, True, 40, [], ["a", "b"]), (6, 6001, 1, 0, 30, False, None, [], ["a", "b", "c"]), (7, 7001, 1, 0, 30, True, 40, [], ["a", "b", "d"]),
    ]
    segs = spark.createDataFrame([(m, s, q, day(e), n, h, day(f), "E119", c) for m, s, q, e, n, h, f, _, c in rows], "member_id long, spell_id long, split_seq int, entry_date date, spell_length_days int, had_ae boolean, first_ae_date date, first_ae_code string, drug_combo array<string>")
    icd = spark.createDataFrame([(s, q, i) for _, s, q, *_, i, _ in rows], "spell_id long, split_seq int, icd10_codes array<string>")
    people = spark.createDataFrame([(1, 1950, "F"), (1, 1960, "M"), (4, 1950, "F"), (6, 1850, "F"), (7, 1950, None)], "member_id long, birthyear int, gendercode string")
    steps = cohort.cohort_steps(segs, people, icd)
    sizes = {r["name"]: r["n_rows"] for r in cohort.attrition(segs, people, icd).collect()}
    assert sizes == {"segments": 8, "size": 7, "entry_day": 6, "length": 5, "dedup": 4, "leakage": 3, "age": 2, "gender": 1}
    members = {r["name"]: r["n_members"] for r in cohort.attrition(segs, people, icd).collect()}
    assert members == {name: df.select("member_id").distinct().count() for name, df in steps.items()}
    kept = steps["gender"].collect()
    assert [(r["spell_id"], r["split_seq"], r["y"], r["age"]) for r in kept] == [(1001, 1, 1, 70)]
