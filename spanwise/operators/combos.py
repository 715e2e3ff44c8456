"""Item combinations: support, event rates, chi-square tests and false-discovery-rate control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import chi_square, chi_square_p, pairs_of
from ..sources.tables import stored
from .ranges import running, with_range


#: Frequent items up to which rows are pruned by a list, and frequent pairs up to which every task holds them.
FEW_ITEMS, FEW_PAIRS = 10_000, 200_000


def _without_rare(df: DataFrame, items: str, min_n: int) -> DataFrame:
    """df whose arrays hold only items of ``min_n`` rows or more: no other can be in a combination that counts."""
    counted = df.select(F.explode(F.array_distinct(items)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    frequent = [r["x"] for r in counted.where(F.col("n") >= min_n).select("x").limit(FEW_ITEMS + 1).collect()]
    return df if len(frequent) > FEW_ITEMS else df.withColumn(items, F.filter(items, lambda x: x.isin(frequent)))


def count_combinations(df: DataFrame, items: str, outcome: Column, size: int | None, min_n: int = 1) -> DataFrame:
    """item columns (or items, for whole sets), n_total and n_ae of combinations that ``min_n`` rows or more hold.

    Level by level: rare items go before pairs are made, and pairs of rare ones before a third item is added, so a row makes few combinations that can't
    count.  Tasks fold the counts of each combination before the shuffle."""
    if size is None:
        counted = df.groupBy(F.array_join(items, "+").alias("items")).agg(F.count(F.lit(1)).alias("n_total"), F.sum(outcome.cast("int")).alias("n_ae"))
        return counted.where(F.col("n_total") >= min_n)
    rows = df.select(F.col(items).alias("x"), outcome.cast("int").alias("_y"))
    if min_n > 1:
        rows = _without_rare(rows, "x", min_n)
    found = _folded(rows.select(F.explode(pairs_of(F.col("x"))).alias("c"), "x", "_y").select("c.*", "x", "_y"), ["item1", "item2"], min_n)
    if size == 2:
        return found
    pairs = stored(found.select("item1", "item2"))
    few = pairs.count() <= FEW_PAIRS
    met = rows.select(F.explode(pairs_of(F.col("x"))).alias("c"), "x", "_y").select("c.*", "x", "_y")
    kept = F.broadcast(pairs) if few else pairs
    if min_n > 1:
        met = met.join(kept, ["item1", "item2"], "left_semi")
    trios = met.select("item1", "item2", F.explode(F.slice("x", F.array_position("x", F.col("item2")).cast("int") + 1, F.size("x"))).alias("item3"), "_y")
    if min_n > 1 and few:
        for a, b in (("item1", "item3"), ("item2", "item3")):
            trios = trios.join(F.broadcast(pairs.select(F.col("item1").alias(a), F.col("item2").alias(b))), [a, b], "left_semi")
    return _folded(trios, ["item1", "item2", "item3"], min_n)


def _folded(rows: DataFrame, keys: list[str], min_n: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), F.sum("_y").alias("n_ae")).where(F.col("n_total") >= min_n)


def bh_adjust(df: DataFrame, p: str, keys: list[str], method: str = "bh") -> DataFrame:
    """p_adj: Benjamini-Hochberg over all rows of df, which is read twice.  ``forward_cummin`` is a variant that takes the running minimum from the smallest p on.

    Rows are folded to distinct values of p, which are ranked by value ranges; equal p share the last one's rank, but in
    the variant, where ``keys`` order them."""
    m = df.agg(F.count(F.lit(1)).alias("_m"))
    folded = with_range(stored(df.groupBy(p).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(m))), p)
    ranked = running(folded, p, {"_rank": (F.sum, "_n")}).withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    if method == "forward_cummin":
        least = running(ranked, p, {"_least": (F.min, "_raw")}, own=False).select(p, "_m", (F.col("_rank") - F.col("_n")).alias("_before"), "_least")
        place = F.row_number().over(Window.partitionBy(p).orderBy(*keys)) + F.col("_before")
        return df.join(least, p).withColumn("p_adj", F.least(F.lit(1.0), F.col("_least"), F.col(p) * F.col("_m") / place)).select(*df.columns, "p_adj")
    least = running(ranked, p, {"_least": (F.min, "_raw")}, descending=True)
    return df.join(least.select(p, F.least(F.lit(1.0), "_least").alias("p_adj")), p).select(*df.columns, "p_adj")


def mine_combinations(cohort: DataFrame, size: int | None = 2, min_n: int = 200, outcome: str = "had_ae", must_contain: str | None = None, names: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """Combinations with at least ``min_n`` rows: rate, chi-square against the rest, p, adjusted p and whether the rate is raised and significant.

    ``must_contain`` keeps combinations with that text in a code or name, after the adjustment.  names: code and name."""
    y = F.col(outcome).cast("boolean")
    counted = count_combinations(cohort, "drug_combo", y, size, min_n)
    totals = cohort.agg(F.count(F.lit(1)).alias("all_n"), F.sum(y.cast("int")).alias("all_ae"))
    keys = [c for c in counted.columns if c.startswith("item")]
    a, n = F.col("n_ae"), F.col("n_total")
    chi = chi_square(a, n - a, F.col("all_ae") - a, F.col("all_n") - F.col("all_ae") - (n - a))
    tested = counted.join(F.broadcast(totals)).withColumn("rate", a / n).withColumn("chi2", chi).withColumn("p_value", chi_square_p(F.col("chi2"))).withColumn("overall_rate", F.col("all_ae") / F.col("all_n"))
    done = bh_adjust(stored(tested.drop("all_n", "all_ae")), "p_value", keys)
    significant = F.col("p_adj") < alpha
    done = done.withColumn("significant", significant).withColumn("signal", significant & (F.col("rate") > F.col("overall_rate"))).drop("overall_rate")
    if names is not None:
        for k in keys:
            done = done.join(F.broadcast(names.select(F.col("code").alias(k), F.col("name").alias(k.replace("item", "name")))), k, "left")
    if must_contain:
        texts = [c for c in done.columns if c.startswith(("item", "name"))]
        done = done.where(F.array_contains(F.array(*(F.coalesce(F.col(c).contains(must_contain), F.lit(False)) for c in texts)), True))
    return done


def top_combos(df: DataFrame, size: int, n: int = 10, names: DataFrame | None = None) -> DataFrame:
    """The n most frequent whole combinations of ``size`` items, with the items' names."""
    top = df.where(F.size("drug_combo") == size).groupBy("drug_combo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "drug_combo").limit(n)
    if names is None:
        return top
    named = top.select("drug_combo", "n", F.explode("drug_combo").alias("code")).join(F.broadcast(names), "code", "left")
    return named.groupBy("drug_combo", "n").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("name", "code"))), ", ").alias("names"))


def top_mined(mined: DataFrame, by: str = "rate", n: int = 10, signals: bool = False) -> DataFrame:
    """The n mined combinations with the largest rate or n_ae; ``signals``: among significant ones with a raised rate only."""
    keys = [c for c in mined.columns if c.startswith("item")]
    return (mined.where("signal") if signals else mined).orderBy(F.desc(by), *keys).limit(n)
