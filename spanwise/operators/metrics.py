"""Ranking and classification metrics over (y, score) rows.

Rows are folded to distinct scores first; ties share a threshold.  Scores are then ranked by value ranges, since a model's scores are
about as many as the rows: no task sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running


def by_score(df: DataFrame) -> DataFrame:
    """score, n, tp of each distinct score, and cumulative cn, ctp from the top."""
    folded = df.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("tp"))
    return running(folded, "score", {"cn": (F.sum, "n"), "ctp": (F.sum, "tp")}, descending=True)


def average_precision(df: DataFrame) -> DataFrame:
    """Step sum over thresholds: recall gained times precision there."""
    total = df.agg(F.sum("y").alias("_pos"))
    return by_score(df).join(F.broadcast(total)).agg(F.round(F.sum(F.col("tp") / F.col("_pos") * F.col("ctp") / F.col("cn")), 6).alias("average_precision"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    total = df.agg(F.sum("y").alias("_pos"), F.sum(1 - F.col("y")).alias("_neg"))
    below = F.col("_neg") - (F.col("cn") - F.col("ctp"))
    area = F.sum(F.col("tp") * (below + (F.col("n") - F.col("tp")) / 2) / F.col("_pos") / F.col("_neg"))
    return by_score(df).join(F.broadcast(total)).agg(F.round(area, 6).alias("roc_auc"))


def precision_at_fraction(df: DataFrame, fractions: tuple[float, ...] = (0.001, 0.01, 0.05, 0.1), key: str = "row_id", ranges: int = 1000) -> DataFrame:
    """Precision, recall and enrichment among the top int(fraction * n) rows by score; of equal scores those with the smallest ``key``,
    a whole number that tells rows apart.

    Folded scores tell which score is the last to count and how many of its rows do.  Only those rows are ranked, by ranges of the key."""
    total = df.agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_pos"))
    wanted = total.select("*", F.explode(F.array(*map(F.lit, fractions))).alias("fraction")).withColumn("k", F.floor(F.col("fraction") * F.col("_n")))
    inside = (F.col("cn") - F.col("n") < F.col("k")) & (F.col("cn") >= F.col("k"))
    last = by_score(df).join(F.broadcast(wanted), inside).select("fraction", "score", (F.col("k") - F.col("cn") + F.col("n")).alias("need"), (F.col("ctp") - F.col("tp")).alias("above"))
    last = df.sparkSession.createDataFrame(last.collect(), last.schema)  # one row a fraction, read several times below
    tied = df.select("score", "y", F.col(key).alias("_key")).join(F.broadcast(last), "score").select("fraction", "need", "_key", "y")
    span = tied.groupBy("fraction").agg(F.min("_key").alias("_low"), (F.floor((F.max("_key") - F.min("_key")) / ranges) + 1).alias("_width"))
    placed = tied.join(F.broadcast(span), "fraction").withColumn("_range", F.floor((F.col("_key") - F.col("_low")) / F.col("_width")))
    sizes = placed.groupBy("fraction", "need", "_range").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("tp"))  # at most ranges + 1 rows a fraction
    up = Window.partitionBy("fraction").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0)))
    whole = sizes.where(F.col("before") + F.col("n") <= F.col("need")).groupBy("fraction").agg(F.sum("tp").alias("tp"))
    part = sizes.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") > F.col("need"))).select("fraction", "_range", "before")  # one row a fraction
    place = F.row_number().over(Window.partitionBy("fraction").orderBy("_key")) + F.col("before")
    rest = placed.join(F.broadcast(part), ["fraction", "_range"]).withColumn("_place", place).where(F.col("_place") <= F.col("need")).groupBy("fraction").agg(F.sum("y").alias("tp"))
    hits = last.select("fraction", F.col("above").alias("tp")).unionByName(whole).unionByName(rest).groupBy("fraction").agg(F.sum("tp").alias("tp"))
    rate = F.col("tp") / F.nullif("k", F.lit(0))
    return wanted.join(F.broadcast(hits), "fraction", "left").select(
        "fraction", "k", F.round(rate, 6).alias("precision"), F.round(F.col("tp") / F.col("_pos"), 6).alias("recall"), F.round(rate / (F.col("_pos") / F.col("_n")), 6).alias("enrichment")
    )


def pr_curve(df: DataFrame) -> DataFrame:
    """threshold, precision, recall and f1 at every distinct score."""
    total = df.agg(F.sum("y").alias("_pos"))
    precision, recall = F.col("ctp") / F.col("cn"), F.col("ctp") / F.col("_pos")
    rows = by_score(df).join(F.broadcast(total)).select(F.col("score").alias("threshold"), precision.alias("p"), recall.alias("r"))
    return rows.select("threshold", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + 1e-12), 6).alias("f1"))


def best_f1(df: DataFrame) -> DataFrame:
    """The threshold with the largest F1, the smallest of equals."""
    top = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")
    return pr_curve(df).agg(top).select("b.*")


def threshold_for_precision(df: DataFrame, targets: tuple[float, ...] = (0.05, 0.1, 0.2)) -> DataFrame:
    """For each target the smallest threshold whose precision reaches it; targets that none reaches are left out."""
    total = df.agg(F.sum("y").alias("_pos"))
    precision, recall = F.col("ctp") / F.col("cn"), F.col("ctp") / F.col("_pos")
    found = F.struct(F.col("score").alias("threshold"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"))
    best = by_score(df).join(F.broadcast(total)).agg(*(F.min_by(F.when(precision >= t, found), F.when(precision >= t, F.col("score"))).alias(f"t{i}") for i, t in enumerate(targets)))
    each = F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"t{i}").alias("b")) for i, t in enumerate(targets)))
    return best.select(F.inline(each)).where("b is not null").select("target", "b.*")


def f1_sweep(df: DataFrame, steps: int = 100) -> DataFrame:
    """F1 at thresholds 0, 1/steps, ..., 1: rows are folded by the highest threshold they reach."""
    reach = df.groupBy(F.floor(F.col("score") * steps + 1e-9).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("tp"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    total = df.agg(F.sum("y").alias("_pos"))
    down = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    cum = grid.join(reach, "step", "left").withColumn("cn", F.coalesce(F.sum("n").over(down), F.lit(0))).withColumn("ctp", F.coalesce(F.sum("tp").over(down), F.lit(0)))
    f1 = F.when(F.col("cn") + F.col("_pos") > 0, 2 * F.col("ctp") / (F.col("cn") + F.col("_pos"))).otherwise(0.0)
    return cum.join(F.broadcast(total)).select((F.col("step") / steps).alias("threshold"), F.round(f1, 6).alias("f1"))


def with_label(df: DataFrame, threshold: float) -> DataFrame:
    return df.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def class_report(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of both classes, their plain and weighted means, and accuracy."""
    p = with_label(df, threshold)
    counts = p.agg(*(F.count_if((F.col("y") == y) & (F.col("predicted") == z)).alias(f"n{y}{z}") for y in (0, 1) for z in (0, 1)))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)

    def rates(y: int):
        hit = F.col(f"n{y}{y}")
        precision, recall = safe(hit, F.col(f"n0{y}") + F.col(f"n1{y}")), safe(hit, F.col(f"n{y}0") + F.col(f"n{y}1"))
        return precision, recall, safe(2 * precision * recall, precision + recall), F.col(f"n{y}0") + F.col(f"n{y}1")

    zero, one = rates(0), rates(1)
    n = zero[3] + one[3]
    accuracy = (F.col("n00") + F.col("n11")) / n
    lines = [("0", *zero), ("1", *one), ("macro", *((a + b) / 2 for a, b in zip(zero[:3], one[:3])), n), ("weighted", *((a * zero[3] + b * one[3]) / n for a, b in zip(zero[:3], one[:3])), n), ("accuracy", accuracy, accuracy, accuracy, n)]
    made = [F.struct(F.lit(name).alias("label"), *(F.round(x.cast("double"), 6).alias(k) for k, x in zip(("precision", "recall", "f1"), rest)), rest[3].cast("long").alias("support")) for name, *rest in lines]
    return counts.select(F.inline(F.array(*made)))


def best_run(results: DataFrame, metric: str = "average_precision", order: str = "run") -> DataFrame:
    """The run with the best metric; the first of equals."""
    return results.agg(F.max_by(F.struct(*results.columns), F.struct(metric, -F.col(order))).alias("b")).select("b.*")
