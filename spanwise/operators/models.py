"""Models of Spark ML over the design matrix: logistic regression with odds ratios and bootstrap intervals, boosted trees, perceptrons, saved models."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import average_precision, roc_auc
from .replicates import fit_replicates


def with_weights(df: DataFrame, y: str = "y", pos_weight: float | None = None) -> DataFrame:
    """weight: balanced over the classes, or ``pos_weight`` for positives."""
    if pos_weight is None:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p")).first()
        n, p = row["n"], row["p"] or 0
        return df.withColumn("weight", F.when(F.col(y) == 1, n / (2.0 * max(p, 1))).otherwise(n / (2.0 * max(n - p, 1))))
    return df.withColumn("weight", F.when(F.col(y) == 1, float(pos_weight)).otherwise(1.0))


def fit_logistic(df: DataFrame, max_iter: int = 100):
    """L2 logistic regression with balanced weights; the penalty equals 1/n, that is C = 1."""
    weighted = with_weights(df).cache()
    n = weighted.count()
    model = LogisticRegression(labelCol="y", weightCol="weight", elasticNetParam=0.0, regParam=1.0 / max(n, 1), standardization=False, maxIter=max_iter).fit(weighted)
    weighted.unpersist()
    return model


_ODDS = T.StructType([T.StructField("feature", T.StringType()), T.StructField("coef", T.DoubleType()), T.StructField("odds_ratio", T.DoubleType())])


def odds_ratios(spark, model, names: list[str]) -> DataFrame:
    import math

    return spark.createDataFrame([(n, float(c), math.exp(float(c))) for n, c in zip(names, model.coefficients.toArray())], _ODDS)


def top_and_bottom(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n/2 largest and the n/2 smallest rows."""
    return df.orderBy(F.desc(column), "feature").limit(n // 2).unionByName(df.orderBy(column, "feature").limit(n // 2))


_INTERVALS = T.StructType([T.StructField(n, T.StringType() if n == "feature" else T.DoubleType()) for n in ("feature", "odds_ratio", "mean", "low", "high")])


def bootstrap_odds_ratios(df: DataFrame, names: list[str], replicates: int = 200, seed: int = 42, max_iter: int = 100) -> DataFrame:
    """feature, odds_ratio of the fit on df, and over fits on ``replicates`` bootstrap samples exp of the mean coefficient (mean) and of
    its 2.5 and 97.5 percentiles (low, high).  df: row_id, features and y."""
    import numpy as np

    own = fit_logistic(df, max_iter).coefficients.toArray()
    coefs = fit_replicates(df, replicates, seed, max_iter)
    low, high = np.percentile(coefs, (2.5, 97.5), axis=0)
    return df.sparkSession.createDataFrame([(n, *map(float, x)) for n, *x in zip(names, *map(np.exp, (own, coefs.mean(axis=0), low, high)))], _INTERVALS)  # a row a feature


def scored_rows(model, df: DataFrame) -> DataFrame:
    return model.transform(df).select("row_id", F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("score"))


def fit_trees(df: DataFrame, pos_weight: float | None = None, depth: int = 4, rounds: int = 400, step: float = 0.05, min_rows: int = 8, share: float = 0.8):
    """Gradient-boosted trees; each round sees ``share`` of the rows and each split that share of the features."""
    return GBTClassifier(labelCol="y", weightCol="weight", maxDepth=depth, maxIter=rounds, stepSize=step, subsamplingRate=share, featureSubsetStrategy=str(share), minInstancesPerNode=min_rows, seed=42).fit(with_weights(df, pos_weight=pos_weight))


# The sweep's shares of negatives per positive, and the settings of the full search.
SWEEP = (0.05, 0.1, 0.15, 0.2)
GRID = tuple({"depth": depth, "min_rows": rows, "share": share} for share in (0.8, 0.9) for depth in (3, 4) for rows in (5, 10))


def tree_settings(train: DataFrame, full: bool, rounds: int = 400) -> list[dict]:
    """The weight sweep, or (``full``) the search over depth, leaf size and subsampling at the plain weight."""
    row = train.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    ratio = (row["n"] - row["p"]) / max(row["p"], 1)
    return [{"pos_weight": ratio, "rounds": rounds, **g} for g in GRID] if full else [{"pos_weight": ratio * s, "rounds": rounds} for s in SWEEP]


def tree_grid(train: DataFrame, valid: DataFrame, grid: list[dict], parallel: int = 4) -> DataFrame:
    """One row per setting with its validation metrics, for ``best_run``.  ``parallel`` settings are fitted at once: boosting is a chain of
    short jobs, between which one fit alone leaves cores idle."""
    train, valid = train.persist(), valid.persist()

    def run(i: int) -> tuple[int, str, float, float]:
        scores = scored_rows(fit_trees(train, **grid[i]), valid).cache()
        metrics = average_precision(scores).crossJoin(roc_auc(scores)).first()  # two one-row frames
        scores.unpersist()
        return i, str(sorted(grid[i].items())), metrics["average_precision"], metrics["roc_auc"]

    with ThreadPool(min(parallel, len(grid))) as pool:
        found = pool.map(inheritable_thread_target(train.sparkSession)(run), range(len(grid)))
    train.unpersist()
    valid.unpersist()
    return train.sparkSession.createDataFrame(found, "run int, params string, average_precision double, roc_auc double")


def fit_perceptron(df: DataFrame, hidden: tuple[int, ...] = (256, 128), max_iter: int = 100):
    """A perceptron over a dense ``features`` vector."""
    width = df.select(F.size(vector_to_array("features")).alias("n")).first()["n"]
    return MultilayerPerceptronClassifier(labelCol="y", layers=[width, *hidden, 2], maxIter=max_iter, seed=42).fit(df)


def array_features(df: DataFrame, *columns: str) -> DataFrame:
    """df with ``features``: the arrays of the columns, one after the other, as a dense vector."""
    return df.withColumn("features", array_to_vector(F.concat(*(F.col(c).cast("array<double>") for c in columns))))


def save_model(model, names: list[str], path: str) -> None:
    """A fitted model and its features' names."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame(list(enumerate(names)), "place int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")


def load_model(path: str):
    """What ``save_model`` wrote: (model, names)."""
    spark = SparkSession.active()
    names = [r["name"] for r in spark.read.parquet(f"{path}/names").orderBy("place").collect()]  # a row a feature
    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark), names
