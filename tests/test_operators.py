"""Codes, combinations, metrics, features, sources and the SQL twins of the named queries."""

import datetime
import itertools
import json
import math
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from spanwise.functions import columns as C
from spanwise.operators import codes, combos, features, intervals, metrics, models, spells, summary
from spanwise.plans.oracles import ORACLES
from spanwise.plans.queries import QUERIES
from spanwise.sources import storage, tables

BASE = "/root/testdata/sf0.001"
FAST = ("view_rx_fills", "latest_change", "filled_status", "attrition", "combo_trios", "json_file_products", "json_file_vectors", "bucketed_spells", "batched_extract", "sketched_lengths", "eligible_members", "clean_map", "match_rate", "opioid_products", "detect_spells", "label_first_event", "ae_by_description", "average_precision", "roc_auc", "pr_curve", "precision_at_fraction", "threshold_for_precision", "best_f1", "f1_sweep", "class_report", "key_range_batches", "validate_dataset", "one_hot_long", "json_explode", "split_at_adds", "label_combo", "cluster_codes", "top_pairs_by_rate", "top_trios_by_rate", "top_member_codes_20", "combo_pairs", "stratified_split", "median_age", "encode_sequence", "pooled_embedding", "pooled_icd_embedding", "flattened_embedding")


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,want", [
    ("1-22-3", None), ("12345678901", "12345678901"), ("1234-5678-90", "01234567890"), ("12345-678-90", "12345067890"), ("12345-6789-0", "12345678900"), ("12345-6789-01", "12345678901"),
    ("1234-567-89", None), ("1234-5678-9", None), ("123456-1-1", None), ("1234567890", None), ("abc", None), (None, None),
])
def test_ndc11(spark, raw, want):
    assert one(spark, raw, C.ndc11) == want


@pytest.mark.parametrize("raw,want", [("e11.9", "E11"), (" I10 ", "I10"), ("12345", None), (None, None), ("A1", None), ("T402X1A", "T40")])
def test_code_cluster(spark, raw, want):
    assert one(spark, raw, C.code_cluster) == want


def test_scalar_columns(spark):
    assert one(spark, "123456789012", C.zero_filled) == "123456789012" and one(spark, "12", C.zero_filled) == "00000000012"
    assert [one(spark, a, C.age_bucket, "int") for a in (3, 24, 25, 74, 75, None)] == ["18-24", "18-24", "25-34", "65-74", "75+", None]
    assert one(spark, "02", C.race_label) == "Black or African American" and one(spark, None, C.race_label) == "Other/Unmapped"
    assert one(spark, "x" * 50, C.shortened) == "x" * 37 + "..."
    for z in (0.01, 0.5, 1.0, 3.0, 5.0):
        assert one(spark, z, C.erfc, "double") == pytest.approx(math.erfc(z), rel=2e-7)


def test_chi_square_with_correction(spark):
    df = spark.createDataFrame([(10, 20, 30, 40), (0, 0, 30, 40), (5, 5, 5, 5)], "a int, b int, c int, d int")
    rows = df.select(C.chi_square(*map(F.col, "abcd")).alias("x")).withColumn("p", C.chi_square_p(F.col("x"))).collect()
    assert rows[0]["x"] == pytest.approx(0.4464285714) and rows[0]["p"] == pytest.approx(0.5040358, abs=1e-6)
    assert rows[1]["x"] is None and rows[1]["p"] == 1 and rows[2]["x"] == 0 and rows[2]["p"] == pytest.approx(1, abs=1e-6)


def test_combinations_and_adjustment(spark):
    sets = [(["a", "b", "c"], True), (["a", "b"], False), (["b", "c", "d"], True), ([], False), (["a"], True)]
    df = spark.createDataFrame(sets, "drug_combo array<string>, had_ae boolean")
    pairs = {(r["item1"], r["item2"]): (r["n_total"], r["n_ae"]) for r in combos.count_combinations(df, "drug_combo", F.col("had_ae"), 2).collect()}
    assert pairs == {("a", "b"): (2, 1), ("a", "c"): (1, 1), ("b", "c"): (2, 2), ("b", "d"): (1, 1), ("c", "d"): (1, 1)}
    trios = {(r["item1"], r["item2"], r["item3"]) for r in combos.count_combinations(df, "drug_combo", F.col("had_ae"), 3).collect()}
    assert trios == {("a", "b", "c"), ("b", "c", "d")}
    p = [0.01, 0.04, 0.03, 0.5, 0.5]
    adj = {r["k"]: r["p_adj"] for r in combos.bh_adjust(spark.createDataFrame(list(enumerate(p)), "k int, p double"), "p", ["k"]).collect()}
    assert [round(adj[i], 6) for i in range(5)] == [0.05, 0.066667, 0.066667, 0.5, 0.5]
    rnd = random.Random(8)
    many = [(i, round(rnd.random() ** 3, 2)) for i in range(500)]
    order = sorted(many, key=lambda x: (x[1], x[0]))
    raw = [p * 500 / (r + 1) for r, (_, p) in enumerate(order)]
    for method, want in (("bh", [min(1.0, *raw[i:]) for i in range(500)]), ("forward_cummin", [min(1.0, *raw[: i + 1]) for i in range(500)])):
        got = {r["k"]: r["p_adj"] for r in combos.bh_adjust(spark.createDataFrame(many, "k int, p double"), "p", ["k"], method).collect()}
        assert all(got[k] == pytest.approx(w) for (k, _), w in zip(order, want))
    top = spark.createDataFrame([("a", "b", 0.5, 3, True), ("a", "c", 0.9, 1, False), ("b", "c", 0.5, 9, True)], "item1 string, item2 string, rate double, n_ae int, signal boolean")
    assert [r["item2"] for r in combos.top_mined(top, "rate", 2).collect()] == ["c", "b"] and [r["n_ae"] for r in combos.top_mined(top, "n_ae", 5, True).collect()] == [9, 3]


def test_metrics_against_plain_loops(spark):
    rnd = random.Random(1)
    rows = [(i, int(rnd.random() < 0.3), round(rnd.random(), 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, y int, score double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx(auc, abs=1e-6)
    ap, seen = 0.0, 0
    for t in sorted({s for _, _, s in rows}, reverse=True):
        tp, n = sum(y for _, y, s in rows if s >= t), sum(s >= t for _, _, s in rows)
        ap += (tp - seen) / len(pos) * tp / n
        seen = tp
    assert metrics.average_precision(df).first()["average_precision"] == pytest.approx(ap, abs=1e-6)
    for n, make in ((3000, lambda: rnd.choice([0.0, 0.1, 0.5])), (3000, rnd.random), (5, rnd.random), (1, rnd.random)):
        rows = [(i * 7, int(rnd.random() < 0.4 or n == 1), make()) for i in range(n)]
        df = spark.createDataFrame(rows, "row_id int, y int, score double")
        best, pos = sorted(rows, key=lambda r: (-r[2], r[0])), sum(y for _, y, _ in rows)
        for r in metrics.precision_at_fraction(df, (0.001, 0.1, 0.5, 1.0)).collect():
            k = math.floor(r["fraction"] * n)
            hits = sum(y for _, y, _ in best[:k])
            assert r["k"] == k and (r["precision"] is None if not k else r["precision"] == pytest.approx(hits / k, abs=1e-6) and r["recall"] == pytest.approx(hits / pos, abs=1e-6))
        cum = {r["score"]: (r["cn"], r["ctp"]) for r in metrics.by_score(df).collect()}
        assert all(cum[t] == (sum(s >= t for _, _, s in rows), sum(y for _, y, s in rows if s >= t)) for t in list(cum)[:50])
    assert metrics.best_run(spark.createDataFrame([(0, 0.1), (1, 0.3), (2, 0.3)], "run int, average_precision double")).first()["run"] == 1


def test_mapping_checks(spark):
    rx = spark.createDataFrame([("1",), ("00000000001",), ("7",)], "ndc11code string")
    mapping = spark.createDataFrame([("1", "A")], "ndc string, atc_3_code string")
    assert Counter((r["ndc11code"], r["atc_3_code"]) for r in codes.enrich_classes(rx, mapping).collect()) == {("00000000001", "A"): 2, ("00000000007", None): 1}
    with pytest.raises(codes.DuplicateKeys):
        codes.enrich_classes(rx, mapping.union(spark.createDataFrame([("01", "B")], mapping.schema)))
    with pytest.raises(tables.MissingColumns):
        codes.enrich_classes(rx.toDF("other"), mapping)


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("007", "x"), ("08", None)], "code string, name string")
    tables.write_parquet(df, str(tmp_path / "p"))
    assert tables.read_parquet(spark, str(tmp_path / "p"), ["code"]).columns == ["code"]
    tables.write_ranked_csv(df, str(tmp_path / "c"), "code")
    assert [r["code"] for r in tables.read_csv_strings(spark, str(tmp_path / "c"), ["code", "name"]).collect()] == ["007", "08"]
    product = {"results": [{"brand_name": "b", "labeler_name": "l", "route": ["ORAL", "RECTAL"], "active_ingredients": [{"name": "Oxycodone HCl", "strength": "5 mg"}, {"name": "Acetaminophen", "strength": "325 mg"}], "packaging": [{"package_ndc": "1234-5678-90"}]}, {"brand_name": "c", "packaging": [{"package_ndc": "1-1-1"}]}]}
    (tmp_path / "j.json").write_text(json.dumps(product, indent=1))
    found = codes.opioid_products(tables.read_products(spark, str(tmp_path / "j.json"))).collect()
    assert [tuple(r) for r in found] == [("01234567890", "b", "Oxycodone HCl 5 mg, Acetaminophen 325 mg", "ORAL, RECTAL", "l")]
    (tmp_path / "v.json").write_text('{"a": [1.0, 2.0], "b": [3.0, 4.0]}')
    assert {r["code"]: list(r["vec"]) for r in tables.read_code_vectors(spark, str(tmp_path / "v.json")).collect()} == {"a": [1, 2], "b": [3, 4]}


def test_jdbc_is_read_in_ranges(spark):
    url = "jdbc:derby:memory:claims;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("cast(id as int) as MEMBER_ID", "cast(id % 7 as int) as N").write.jdbc(url, "FILLS", mode="overwrite", properties=driver)
    got = tables.read_jdbc_ranges(spark, url, "SELECT MEMBER_ID, N FROM FILLS WHERE N < 3", "MEMBER_ID", 0, 100, 4, driver)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in got.collect()) == [(i, i % 7) for i in range(100) if i % 7 < 3]


def test_splits_and_vectors(spark):
    rows = [(i, int(i % 10 == 0)) for i in range(1005)]
    split = features.split_rows(spark.createDataFrame(rows, "id int, y int"), "id")
    assert {(r["y"], r["is_train"]): r["count"] for r in split.groupBy("y", "is_train").count().collect()} == {(0, True): 723, (0, False): 181, (1, True): 80, (1, False): 21}
    again = features.split_rows(spark.createDataFrame(rows[::-1], "id int, y int").repartition(5), "id")
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 6.0])], "code string, vec array<double>")
    items = spark.createDataFrame([(1, ["a", "b", "q"]), (2, ["q"]), (3, [])], "id int, items array<string>")
    for most in (features.BROADCAST_BYTES, 0):
        features.BROADCAST_BYTES, kept = most, features.BROADCAST_BYTES
        assert {r["id"]: r["pooled"] for r in features.pooled_vectors(items, ["id"], "items", vectors, 2).collect()} == {1: [2.0, 4.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
        assert {r["id"]: r["flat"] for r in features.flattened_vectors(items, ["id"], "items", vectors, 2, 2).collect()} == {1: [1.0, 2.0, 3.0, 6.0], 2: [0.0] * 4, 3: [0.0] * 4}
        features.BROADCAST_BYTES = kept
    tokens = features.one_hot_tokens(items.withColumn("g", F.when(F.col("id") == 1, "F")), ["id"], [(F.col("g"), ["F", "M"])])
    assert {r["id"]: r["tokens"] for r in tokens.collect()} == {1: [1, 0, 0], 2: [0, 0, 1], 3: [0, 0, 1]}


def test_summary_and_features(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 10.0, "a"), (3, 5.0, "b"), (4, 11.0, None)], "id int, x double, g string")
    assert {(r["bin"], r["n"]) for r in summary.histogram(df, "x", 0, 10, 5).collect()} == {(0, 1), (4, 1), (2, 1)}
    assert {r["grp"]: r["n"] for r in summary.top_or_other(df, "g", 1).groupBy("grp").agg(F.count("*").alias("n")).collect()} == {"a": 2, "Other": 2}
    sets = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, ["z", "b", "q", "a"])], "id int, items array<string>")
    vocab = features.vocabulary(sets.where("id < 3"), "items")
    assert {r["id"]: r["ids"] for r in features.encode_sequence(sets, ["id"], "items", vocab, 3).collect()} == {1: [3, 2, 0], 2: [0, 0, 0], 3: [1, 3, 1]}


def test_balanced_draws(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 40 == 0, 1).when(F.col("id") % 997 != 1, 0).alias("y"))
    draws = [Counter((r["id"], r["y"]) for r in features.resample_balanced(df.repartition(n), "y", "id").collect()) for n in (1, 8)]
    assert draws[0] == draws[1]
    sizes = Counter()
    for (_, y), n in draws[0].items():
        sizes[y] += n
    assert set(sizes) == {0, 1} and all(abs(n - 2000) < 5 * 2000**0.5 for n in sizes.values())
    times = {y: Counter(n for (_, c), n in draws[0].items() if c == y) for y in (0, 1)}
    assert max(times[0]) > 1 and len(times[1]) > 5 and sum(times[0].values()) < 2500
    assert features.resample_balanced(df, "y", "id", seed=7).count() != sum(sizes.values())
    assert features.resample_balanced(df.limit(0), "y", "id").count() == 0


def test_poisson_draws_follow_their_law():
    import numpy as np

    from spanwise.operators.replicates import poisson_draws

    for rate in (0.02, 0.51, 1.0, 37.0, 50_000.0):
        n = poisson_draws(np.arange(40_000), rate, 3)
        assert abs(n.mean() - rate) < 5 * (rate / 40_000) ** 0.5 and abs(n.var() / rate - 1) < 0.1


def test_sparse_and_dense_rows_fit_alike(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from spanwise.operators import replicates

    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (80, 6)) * (rng.random((80, 6)) < 0.4)
    y = (x[:, 0] + rng.random(80) > 1).astype(int)
    rows = [(i, Vectors.dense(r) if i % 3 else Vectors.sparse(6, {j: float(v) for j, v in enumerate(r) if v}), int(c)) for i, (r, c) in enumerate(zip(x.astype(float), y))]
    mixed = replicates.fit_replicates(spark.createDataFrame(rows, ["row_id", "features", "y"]).repartition(2), 3, max_iter=60)
    dense = replicates.fit_replicates(spark.createDataFrame([(i, Vectors.dense(v.toArray()), c) for i, v, c in rows], ["row_id", "features", "y"]), 3, max_iter=60)
    assert np.allclose(mixed, dense, atol=1e-6)
    many = replicates.PRODUCTS
    try:
        replicates.PRODUCTS = 1  # one replicate at a time
        assert np.allclose(replicates.fit_replicates(spark.createDataFrame(rows, ["row_id", "features", "y"]), 3, max_iter=60), mixed, atol=1e-6)
    finally:
        replicates.PRODUCTS = many


def test_merged_as_of_joins(spark):
    rnd = random.Random(2)
    probes = [(k, i, rnd.randint(0, 30)) for i, k in enumerate(rnd.choices([1, 2, 3, None], k=60))]
    changes = [(k, rnd.randint(-5, 35), rnd.choice("abcd"), rnd.random() < 0.5) for k in rnd.choices([1, 2, 4, None], k=150)]
    p = spark.createDataFrame(probes, "k int, id int, day int")
    c = spark.createDataFrame(changes, "k int, at int, item string, on boolean")
    latest = {r["id"]: (r["at"], r["item"]) for r in intervals.latest_on_or_before(p, c, ["k"], "day", "at", ["at", "item"]).collect()}
    active = {r["id"]: r["held"] for r in intervals.active_at(p, c, ["k"], "day", "at", "item", "on", "held").collect()}
    assert len(latest) == len(active) == 60
    for k, i, day in probes:
        before = [x for x in changes if x[0] == k and x[1] <= day]  # here null keys meet, as in a window
        assert latest[i] == (max((x[1], x[2]) for x in before) if before else (None, None))
        last = {item: max((at, on) for _, at, it, on in before if it == item) for item in {x[2] for x in before}}
        assert active[i] == sorted(item for item, (_, on) in last.items() if on)
    filled = intervals.forward_fill(spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, None), (2, 1, None), (1, 4, 6)], "k int, t int, v int"), ["k"], ["t"], ["v"]).collect()
    assert sorted((r["k"], r["t"], r["v"]) for r in filled if r["v"] is not None) == [(1, 2, 5), (1, 3, 5), (1, 4, 6)]
    plan = intervals.active_at(p, c, ["k"], "day", "at", "item", "on", "held")._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_replicates_take_few_features_as_a_matrix(monkeypatch):
    import numpy as np

    from spanwise.operators import replicates

    rng = np.random.default_rng(3)
    length = rng.integers(1, 6, 50)
    feature = np.concatenate([rng.choice(9, n, replace=False) for n in length])
    value, w, pull = rng.random(len(feature)), rng.random((7, 20)), rng.random((50, 7))
    few, many = (replicates.SparseRows(np.concatenate(([0], np.cumsum(length))), feature, value, np.arange(50), np.ones(50)) for _ in range(2))
    assert few.matrix is not None and few.matrix[1].shape == (50, 9)
    monkeypatch.setattr(replicates, "DENSE", 0)
    assert many.matrix is None
    assert np.allclose(few.times(w), many.times(w)) and np.allclose(few.pulled(pull, 20), many.pulled(pull, 20))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_interval_steps_sort_once(spark):
    rnd = random.Random(5)
    day = lambda i: datetime.date(2000, 1, 1) + datetime.timedelta(i)
    rows = [(rnd.choice([1, 2, 3]), s, s + rnd.randint(-40, 30), rnd.randint(0, 1)) for s in (rnd.randint(0, 400) for _ in range(90))]
    df = spark.createDataFrame([(k, day(s), day(e), q) for k, s, e, q in rows], "k int, s date, e date, q int")
    expected = []
    for k in (1, 2, 3):
        islands, so_far = [], None
        for s, e in sorted((s, e) for j, s, e, _ in rows if j == k):
            if so_far is None or s > so_far + 1 + 5:
                islands.append([s, e])
            islands[-1][1] = max(islands[-1][1], e)
            so_far = e if so_far is None else max(so_far, e)
        expected += [(k, day(s), day(e), max(q for j, _, _, q in rows if j == k)) for s, e in islands]
    joined = intervals.coalesce_intervals(df, ["k"], "s", "e", 5, key_marks=["q"])
    assert sorted(map(tuple, joined.collect())) == sorted(expected)
    swept = intervals.concurrency_sweep(df, "k", "s", "e", "q")
    moves = [(k, day(s), 1, q) for k, s, e, q in rows] + [(k, day(e + 1), -1, -q) for k, s, e, q in rows]
    found = [(k, d, sum(x[2] for x in moves if x[0] == k and x[1] <= d), sum(x[3] for x in moves if x[0] == k and x[1] <= d)) for k, d in {x[:2] for x in moves}]
    assert sorted(map(tuple, swept.collect())) == sorted(found)
    for out in (joined, swept):
        logical, physical = plan_of(out)
        assert "Aggregate" not in logical and physical.count("+- Sort [") == 1


def test_status_of_items_at_probes_without_a_join(spark):
    rnd = random.Random(7)
    probes = [(k, i, rnd.randint(0, 30)) for i, k in enumerate(rnd.choices([1, 2, 3], k=40))]
    changes = [(k, rnd.randint(-5, 35), rnd.choice("abcd"), rnd.randint(0, 1)) for k in rnd.choices([1, 2, 4], k=120)]
    found = intervals.status_at(spark.createDataFrame(probes, "k int, id int, day int"), spark.createDataFrame(changes, "k int, at int, item string, on int"), ["k"], "day", "at", "item", "on")
    expected = []
    for k, i, day in probes:
        before = [x for x in changes if x[0] == k and x[1] <= day]
        expected += [(k, i, day, item, max((at, on) for _, at, it, on in before if it == item)[1]) for item in {x[2] for x in before}]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    active = intervals.active_at(spark.createDataFrame(probes, "k int, id int, day int"), spark.createDataFrame(changes, "k int, at int, item string, on int"), ["k"], "day", "at", "item", "on", "held")
    for out in (found, active):
        logical, _ = plan_of(out)
        assert "Join" not in logical and "Aggregate" not in logical


def test_segments_take_one_add_a_day_without_a_fold(spark):
    base = spark.sql("SELECT 1L AS member_id, 1001L AS spell_id, DATE'2020-01-01' AS entry_date, DATE'2020-03-01' AS raw_exit_date, DATE'2020-03-01' AS extended_exit_date, 61 AS spell_length_days, DATE'2020-03-01' AS followup_end_date, CAST(NULL AS DATE) AS first_ae_date, false AS had_ae")
    adds = spark.sql("SELECT 1L AS member_id, 1001L AS spell_id, explode(array(DATE'2020-01-01', DATE'2020-01-01', DATE'2020-02-01', DATE'2020-02-01', DATE'2019-12-01')) AS date, 'add' AS change_type")
    cut = spells.split_at_adds(base, adds)
    assert sorted((str(r["entry_date"]), str(r["raw_exit_date"]), r["split_seq"]) for r in cut.collect()) == [("2020-01-01", "2020-01-31", 1), ("2020-02-01", "2020-03-01", 2)]
    assert "Aggregate" not in plan_of(cut)[0]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("5000", "0")):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_large_json_is_read_in_splits(spark, tmp_path, small_splits, indent):
    rnd = random.Random(1)
    vectors = {f'c"{i}]\\[{{x' if i % 7 == 0 else f"code{i}": [float(rnd.randint(0, 9)) for _ in range(rnd.randint(0, 20))] for i in range(500)}
    path = str(tmp_path / "v.json")
    Path(path).write_text(json.dumps(vectors, indent=indent) + "\n" * bool(indent))
    assert spark.read.option("lineSep", "]").text(path).rdd.getNumPartitions() > 3
    assert {r["code"]: list(r["vec"]) for r in tables.read_code_vectors(spark, path).collect()} == vectors
    products = [{"openfda": {"x": {"y": [i]}}, "z": [{}], "brand_name": f'b{{{i}}} "q" \\', "active_ingredients": [{"name": "n", "strength": "s}"}] * (i % 4), "packaging": [{"package_ndc": "1234-5678-90"}]} for i in range(300)]
    files = {
        "described": json.dumps({"meta": {"d": "x{", "results": {"skip": 0}}, "results": products}, indent=indent), "plain": json.dumps({"results": products}, indent=indent), "empty": json.dumps({"results": []}, indent=indent),
        "two": json.dumps({"results": products[:90], "tail": {"a": 1}}, indent=indent) + "\n" + json.dumps({"results": products[90:], "n": "x{"}, indent=indent),
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
        found = tables.read_products(spark, str(tmp_path / f"{name}.json")).collect()
        want = [] if name == "empty" else products
        assert sorted((r["brand_name"], len(r["active_ingredients"])) for r in found) == sorted((p["brand_name"], len(p["active_ingredients"])) for p in want)


def test_storage_by_member(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, i) for i in range(400)], "member_id long, x long")
    kept = storage.bucketed(df, "member_id", 4, str(tmp_path / "b"))
    other = storage.bucketed(df.select("member_id").distinct(), "member_id", 4, str(tmp_path / "c"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = kept.join(other, "member_id").groupBy("member_id").agg(F.sum("x").alias("x"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    batches, path = codes.key_range_batches(df, "member_id", 10), str(tmp_path / "parts")
    assert storage.missing_batches(spark, batches, path) == [0, 1, 2, 3]
    storage.write_batches(df, batches, "member_id", path, [0, 2])
    assert storage.missing_batches(spark, batches, path) == [1, 3]
    storage.write_batches(df, batches, "member_id", path, [1, 3])
    times = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    storage.write_batches(df.withColumn("x", F.lit(0)), batches, "member_id", path, [2])
    again = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    assert {f for f in again if again[f] != times.get(f)} == {f for f in again if f.parent.name == "batch=2"}
    sums = {r["batch"]: (r["n"], r["s"]) for r in spark.read.parquet(path).groupBy("batch").agg(F.count("*").alias("n"), F.sum("x").alias("s")).collect()}
    assert {b: n for b, (n, _) in sums.items()} == {0: 100, 1: 100, 2: 100, 3: 100} and sums[2][1] == 0 and sums[1][1] > 0


def test_buckets_follow_the_rows(spark, monkeypatch):
    from spanwise.plans import queries

    assert [storage.buckets_for(n, 500_000) for n in (0, 8_000_000, 8_000_001, 216_000_000)] == [16, 16, 32, 512]
    asked, plain = [], queries.bucketed
    monkeypatch.setattr(queries, "ROWS_A_BUCKET", 200)
    monkeypatch.setattr(queries, "bucketed", lambda df, key, buckets: asked.append(buckets) or plain(df, key, buckets))
    chain = queries.Chain(spark, "/root/testdata/sf0.001")
    found = queries.bucketed_spells(chain)
    assert asked == [32] and sorted(found.collect()) == sorted(chain.spells.collect())


def test_small_batches_are_one_file_each(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, i) for i in range(400)], "member_id long, x long")
    batches, path = codes.key_range_batches(df, "member_id", 10), tmp_path / "parts"
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small shuffles would meet in one task anyway
    try:
        storage.write_batches(df, batches, "member_id", str(path), [0, 1, 3])
        assert sorted(f.parent.name for f in path.rglob("*.parquet")) == ["batch=0", "batch=1", "batch=3"]
        storage.write_batches(df, batches, "member_id", str(path), files=4)
        assert len(list(path.rglob("*.parquet"))) > 4 and spark.read.parquet(str(path)).count() == 400
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("few", [200_000, 0])
def test_pruned_combinations_equal_plain_counts(spark, monkeypatch, few):
    rnd = random.Random(6)
    rows = [(sorted(rnd.sample("abcdefghij", rnd.randint(0, 7))), rnd.random() < 0.3) for _ in range(120)]
    df = spark.createDataFrame(rows, "drug_combo array<string>, had_ae boolean")
    monkeypatch.setattr(combos, "FEW_PAIRS", few)
    for size, least in ((2, 1), (2, 30), (3, 1), (3, 12)):
        want = Counter()
        events = Counter()
        for items, y in rows:
            for c in itertools.combinations(items, size):
                want[c] += 1
                events[c] += y
        got = {tuple(r)[:size]: (r["n_total"], r["n_ae"]) for r in combos.count_combinations(df, "drug_combo", F.col("had_ae"), size, least).collect()}
        assert got == {c: (n, events[c]) for c, n in want.items() if n >= least}


def test_signals_come_first(spark):
    """Pairs with raised rates are significant and lead the list by events."""
    rows = [(["a", "b"], i % 2 == 0) for i in range(60)] + [(["a", "c"], i % 3 == 0) for i in range(30)] + [(["c", "d"], i % 40 == 0) for i in range(400)]
    mined = combos.mine_combinations(spark.createDataFrame(rows, "drug_combo array<string>, had_ae boolean"), 2, 20)
    top = combos.top_mined(mined, "n_ae", 10, signals=True).collect()
    assert [(r["item1"], r["item2"], r["n_ae"]) for r in top] == [("a", "b", 30), ("a", "c", 10)] and all(r["significant"] for r in top)


def test_sketches_of_parts_equal_the_whole(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("part"), (F.col("id") % 2).alias("g"), (F.xxhash64("id") % 9000).alias("who"), (F.col("id") % 1000).alias("x"))
    parts = summary.sketch_parts(df, ["part", "g"], "who", "x")
    for r in summary.from_sketches(parts, ["g"]).collect():
        own = df.where(F.col("g") == r["g"])
        assert r["n"] == own.count() and abs(r["n_entities"] / own.select("who").distinct().count() - 1) < 5 * 1.04 / 2 ** (summary.LG_K / 2)
        assert all(abs(r[f"p{p}"] - 10 * p) < 20 for p in (25, 50, 75))
    earlier = summary.merged_sketches(parts.where("part < 5"), ["g"])
    both = earlier.unionByName(parts.where("part >= 5").drop("part"))
    assert {(r["g"], r["n_entities"]) for r in summary.from_sketches(both, ["g"]).collect()} == {(r["g"], r["n_entities"]) for r in summary.from_sketches(parts, ["g"]).collect()}


def test_dataset_checks_on_a_path(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "b")], "id int, name string").write.parquet(str(tmp_path / "d"))
    (tmp_path / "bad.parquet").write_text("no parquet")
    got = {r["check"]: r["value"] for r in tables.validate_path(spark, str(tmp_path / "d"), ("id", "zip")).collect()}
    assert got == {"exists": 1, "readable": 1, "rows": 2, "columns": 2, "nulls:id": 0, "nulls:name": 1, "has:id": 1, "has:zip": 0}
    assert [tuple(r) for r in tables.validate_path(spark, str(tmp_path / "none")).collect()] == [("exists", 0)]
    assert {tuple(r) for r in tables.validate_path(spark, str(tmp_path / "bad.parquet")).collect()} == {("exists", 1), ("readable", 0)}
    assert len(tables.preview(spark, str(tmp_path / "d"), 1)) == 1


def test_models_find_a_planted_signal(spark, tmp_path):
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        drugs = sorted(rnd.sample("abcdef", 3))
        rows.append((i, drugs, ["I10"] if i % 3 else ["E11"], 40 + i % 30, rnd.choice(["F", "M", None]), int(rnd.random() < (0.8 if "a" in drugs else 0.1))))
    df = spark.createDataFrame(rows, "row_id int, drug_combo array<string>, icd10_codes array<string>, age int, gendercode string, y int")
    frame, names = features.design_matrix(df, ["age"], ["gendercode"], icd_floor=50)
    assert names[:8] == [f"DRUG_{c}" for c in "abcdef"] + ["ICD_E11", "ICD_I10"] and frame.first()["features"].size == len(names)
    model = models.fit_logistic(frame, 20)
    odds = {r["feature"]: r["odds_ratio"] for r in models.odds_ratios(spark, model, names).collect()}
    assert max(odds, key=odds.get) == "DRUG_a"
    assert metrics.roc_auc(models.scored_rows(model, frame)).first()["roc_auc"] > 0.75
    models.save_model(model, names, str(tmp_path / "m"))
    again, same = models.load_model(str(tmp_path / "m"))
    assert same == names and again.coefficients == model.coefficients
    found = {r["feature"]: r for r in models.bootstrap_odds_ratios(frame.select("row_id", "features", "y"), names, replicates=30).collect()}
    assert set(found) == set(names) and all(r["low"] <= r["mean"] * 1.5 and r["low"] <= r["high"] for r in found.values())
    assert found["DRUG_a"]["low"] > 1 and found["DRUG_a"]["odds_ratio"] == pytest.approx(odds["DRUG_a"], rel=0.2)
    settings = models.tree_settings(frame, True, 3)
    assert len(settings) == 8 and len(models.tree_settings(frame, False)) == 4 and {s["rounds"] for s in settings} == {3}
    runs = models.tree_grid(frame, frame, [settings[0], {**settings[7], "depth": 2}])
    best = metrics.best_run(runs).first()
    assert best["roc_auc"] > 0.75 and runs.count() == 2
    vectors = models.array_features(frame.select("row_id", "y", F.transform(F.array(*map(F.lit, "abcdef")), lambda d: F.array_contains("drug_combo", d).cast("double")).alias("held")), "held")
    net = models.fit_perceptron(vectors, (4,), 50)
    assert metrics.roc_auc(models.scored_rows(net, vectors)).first()["roc_auc"] > 0.75


def test_replicates_equal_plain_fits(spark):
    """Each replicate is the minimum of its weighted loss: its gradient, by plain loops over weighted rows, is zero."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from spanwise.operators.replicates import fit_replicates, poisson_weights

    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 2, (150, 4)), rng.integers(20, 90, 150)]).astype(float)
    y = (rng.random(150) < 1 / (1 + np.exp(1 - 2 * x[:, 0]))).astype(int)
    df = spark.createDataFrame([(i, Vectors.dense(r), int(v)) for i, (r, v) in enumerate(zip(x, y))], ["row_id", "features", "y"]).repartition(3)
    w = fit_replicates(df, 6, seed=5, max_iter=300, tolerance=1e-7)
    weights = poisson_weights(np.arange(150), 6, 5)
    assert abs(weights.mean() - 1) < 0.1 and abs(weights.var() - 1) < 0.2 and len({tuple(c) for c in weights.T}) == 6
    for b in range(6):
        n = [(weights[:, b] * (y == k)).sum() for k in (0, 1)]
        times = weights[:, b] * np.where(y == 1, sum(n) / 2 / n[1], sum(n) / 2 / n[0])
        least = min((np.abs(((1 / (1 + np.exp(-(x @ w[b] + t))) - y) * times).sum()), t) for t in np.linspace(-8, 8, 16001))[1]
        gradient = x.T @ ((1 / (1 + np.exp(-(x @ w[b] + least))) - y) * times) + w[b]
        assert np.abs(gradient[:4]).max() < 0.1 and np.abs(gradient[4]) < 8


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, BASE)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    quoted = [f'"{c}"' for c in columns]
    assert Counter(tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == Counter(want.select(*quoted).fetchall())


def test_table_perceptron_equals_dense_inputs(spark):
    """Sparse rows over a table give the loss and gradient of the dense inputs, so a fit ends where the folded and the repeated rows agree."""
    import numpy as np

    from spanwise.operators import perceptrons

    vectors = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [-1.0, 2.0]), ("c", [0.0, 1.0])], "code string, vec array<double>")
    rnd = random.Random(2)
    rows = [(i, rnd.choice("FM"), rnd.sample("abcz", rnd.randint(0, 3))) for i in range(200)]
    rows = [(i, g, d, int("a" in d) if i % 10 else 1 - int("a" in d)) for i, g, d in rows]
    df = spark.createDataFrame(rows, "row_id long, g string, d array<string>, y int")
    for made in (features.mean_codes, features.placed_codes):
        build, table = features.table_features(df, [("g", ["F"])], [("d", vectors, 3)], 2, made)
        known = {"a": [1.0, 0.5], "b": [-1.0, 2.0], "c": [0.0, 1.0]}
        for r in build(df).collect():
            own = [known[x] for x in r["d"] if x in known]
            flat = [v for x in r["d"] for v in known.get(x, [0.0, 0.0])]
            want = list(np.mean(own, axis=0)) if own else [0.0, 0.0]
            want = want if made is features.mean_codes else flat + [0.0] * (6 - len(flat))
            assert np.allclose(r["features"].toArray() @ table, [r["g"] == "F", r["g"] != "F", *want])
        folded = build(df.groupBy("g", "d", "y").agg(F.count(F.lit(1)).alias("n")))
        a, b = (perceptrons.fit_perceptron(x, table, (4, 3), 25) for x in (folded, build(df.withColumn("n", F.lit(1)))))
        assert folded.count() < 150
        scored = [{r["row_id"]: r["score"] for r in m.scored_rows(build(df)).collect()} for m in (a, b)]
        assert max(abs(scored[0][i] - scored[1][i]) for i in scored[0]) < 1e-3
        assert metrics.roc_auc(a.scored_rows(build(df))).first()["roc_auc"] > 0.8


def test_perceptron_rows_stay_at_their_codes(spark, monkeypatch):
    """What is fitted are a few numbers a row, not vectors as wide as the input (4,160 numbers and the tokens)."""
    from spanwise.operators import perceptrons
    from spanwise.plans import queries

    seen, fit = [], perceptrons.fit_perceptron
    monkeypatch.setattr(perceptrons, "fit_perceptron", lambda df, table, *settings: seen.append((df.select("features").collect(), table.shape[1])) or fit(df, table, (2,), 2))
    found = queries.sequence_quality(queries.Chain(spark, "/root/testdata/sf0.001")).first()
    (rows, width), dim = seen[0], queries.DIM
    assert width > (queries.MAX_CODES + queries.MAX_DRUGS) * dim and 0 <= found["roc_auc"] <= 1
    assert rows and all(r["features"].numNonzeros() <= 3 + queries.MAX_CODES + queries.MAX_DRUGS for r in rows)


def test_tree_settings_are_fitted_side_by_side(spark, monkeypatch):
    import threading

    from pyspark.ml.linalg import Vectors

    rnd = random.Random(8)
    frame = spark.createDataFrame([(i, Vectors.dense([rnd.random(), i % 3]), int(i % 3 == 0)) for i in range(90)], ["row_id", "features", "y"])
    grid = models.tree_settings(frame, True, 1)[:2]
    alone = [models.tree_grid(frame, frame, [g]).first()["average_precision"] for g in grid]
    met, fit = threading.Barrier(2), models.fit_trees
    monkeypatch.setattr(models, "fit_trees", lambda df, **params: met.wait(30) is not None and fit(df, **params))
    runs = models.tree_grid(frame, frame, grid).orderBy("run").collect()
    assert [r["run"] for r in runs] == [0, 1] and [r["average_precision"] for r in runs] == alone
