import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from spanwise.operators import boosting, metrics, models
from spanwise.plans import queries


def _frame(spark, rows, copies=1, seed=3):
    rnd = np.random.default_rng(seed)
    x = np.column_stack([rnd.integers(0, 2, (rows, 4)), rnd.integers(-4, 25, rows), rnd.integers(0, 9, rows), np.zeros(rows)]).astype(float)
    y = (rnd.random(rows) < 1 / (1 + np.exp(2 - x[:, 0] - x[:, 1] * (x[:, 4] > 9) * 1.7 + 0.1 * x[:, 5]))).astype(int)
    vectors = [Vectors.dense(v) if i % 3 else Vectors.sparse(len(v), [(j, float(z)) for j, z in enumerate(v) if z]) for i, v in enumerate(x)]
    made = [(i * copies + c, v, int(k)) for i, (v, k) in enumerate(zip(vectors, y)) for c in range(copies)]
    return spark.createDataFrame(made, ["row_id", "features", "y"]).withColumn("y", F.col("y").cast("int"))


def test_trees_without_draws_score_as_those_of_spark_ml(spark):
    frame = _frame(spark, 1500).persist()
    theirs = GBTClassifier(labelCol="y", weightCol="weight", maxDepth=4, maxIter=6, stepSize=0.05, minInstancesPerNode=8, seed=42).fit(models.with_weights(frame))
    expected = {r["row_id"]: r["score"] for r in models.scored_rows(theirs, frame).collect()}
    found = boosting.fit_trees(frame, rounds=6, share=1.0).scored_rows(frame).collect()
    assert len(found) == 1500 and max(abs(r["score"] - expected[r["row_id"]]) for r in found) < 1e-9


def test_equal_rows_are_kept_once_and_drawn_one_by_one(spark):
    once, twice = _frame(spark, 600), _frame(spark, 600, copies=5)
    cuts = boosting.feature_cuts(once)
    assert all((a == b).all() for a, b in zip(cuts, boosting.feature_cuts(twice))) and len(cuts[6]) == 0
    small, large = (boosting._blocks(df, cuts, 600).collect() for df in (once, twice))
    assert sum(len(b.y) for b in small) == sum(len(b.y) for b in large) and 5 * sum(b.n.sum() for b in small) == sum(b.n.sum() for b in large)
    drawn = large[0].moved(None, 0.8, 42, 1).drawn
    assert 0.77 < drawn.sum() / large[0].n.sum() < 0.83 and ((0 < drawn) & (drawn < large[0].n)).any()


def test_many_rounds_are_cut_by_checkpoints(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEPT", 2)
    frame = _frame(spark, 400)
    model = boosting.fit_trees(frame, rounds=5, depth=2)
    assert len(model.trees) == 5 and model.scored_rows(frame).where("score between 0 and 1").count() == 400


def test_settings_that_grow_together_give_the_trees_of_each_alone(spark):
    frame = _frame(spark, 500).persist()
    grid = [{"pos_weight": 2.0, "rounds": 3}, {"pos_weight": 0.5, "rounds": 4, "depth": 2, "min_rows": 5, "share": 0.9}, {"rounds": 2}]
    together = boosting.fit_all(frame, grid)
    for found, g in zip(together, grid):
        alone = boosting.fit_all(frame, [g])[0]
        assert len(found.trees) == g["rounds"] and all(a.splits == b.splits and np.allclose(a.values, b.values, rtol=1e-12) for a, b in zip(found.trees, alone.trees))
    runs = boosting.tree_grid(frame, frame, grid[:2]).orderBy("run").collect()
    scored = together[0].scored_rows(frame)
    assert [r["run"] for r in runs] == [0, 1] and runs[0]["roc_auc"] == metrics.roc_auc(scored).first()["roc_auc"] > 0.6
    theirs = GBTClassifier(labelCol="y", weightCol="weight", maxDepth=4, maxIter=3, stepSize=0.05, minInstancesPerNode=8, seed=42).fit(models.with_weights(frame, pos_weight=2.0))
    expected = {r["row_id"]: r["score"] for r in models.scored_rows(theirs, frame).collect()}
    plain = boosting.fit_all(frame, [{"pos_weight": 2.0, "rounds": 3, "share": 1.0}])[0].scored_rows(frame).collect()
    assert max(abs(r["score"] - expected[r["row_id"]]) for r in plain) < 1e-9


def test_registered_searches_run_all_rounds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(boosting, "fit_all", lambda df, grid, seed=42: seen.extend(grid) or [boosting.Trees(boosting.feature_cuts(df), [])] * len(grid))
    for name, n in (("tree_search", 4), ("tree_full_search", 8), ("tree_best", 4)):
        seen.clear()
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == (1 if name == "tree_best" else n)
        assert len(seen) == n and all(g["rounds"] == 400 for g in seen)
