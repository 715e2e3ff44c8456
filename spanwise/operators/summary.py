"""Descriptive tables: frequencies, shares, histograms, distributions, baseline tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import RACE_LABELS


def frequency_table(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Value, n and share (of the rows shown, in percent)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if top:
        counts = counts.orderBy(F.desc("n"), "value").limit(top)
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select("value", "n", F.round(100.0 * F.col("n") / F.col("_total"), 6).alias("share"))


def describe(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    aggs = [F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("std"), F.min(column).cast("double").alias("min"), q.alias("q"), F.max(column).cast("double").alias("max")]
    out = (df.groupBy(by) if by else df).agg(*aggs)
    return out.select(*([by] if by else []), "n", "mean", "std", "min", *(F.round(F.col("q")[i], 6).alias(f"p{p}") for i, p in enumerate((25, 50, 75))), "max")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, by: str | None = None) -> DataFrame:
    """Equal bins over [low, high]; the top edge falls into the last bin, values outside are left out."""
    width = (high - low) / bins
    inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("long")
    return inside.groupBy(*([by] if by else []), at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, column: str, name: str) -> DataFrame:
    """Percent of rows per value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select("value", F.round(100.0 * F.col("n") / F.col("_total"), 6).alias(name))


def aligned_distributions(left: DataFrame, right: DataFrame, column: str, names: tuple[str, str]) -> DataFrame:
    """Two groups' distributions side by side; a category that one lacks counts 0."""
    return distribution(left, column, names[0]).join(distribution(right, column, names[1]), "value", "full_outer").fillna(0.0, list(names))


def top_or_other(df: DataFrame, column: str, n: int, name: str = "grp", pool: DataFrame | None = None, other: str = "Other") -> DataFrame:
    """The value when it is among the n most frequent of ``pool`` (default: the frame itself), else Other."""
    top = (df if pool is None else pool).where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n).select(F.col(column).alias("_top"))
    return df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left").withColumn(name, F.coalesce("_top", F.lit(other))).drop("_top")


def total_and_members(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("member_id").alias("n_members"), F.round(F.count(F.lit(1)) / F.countDistinct("member_id"), 6).alias("ratio"))


def count_of_counts(df: DataFrame, key: str, name: str = "n_events") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def member_code_counts(df: DataFrame, codes: str) -> DataFrame:
    """Distinct codes per member over all its rows."""
    return df.select("member_id", F.explode(codes).alias("code")).groupBy("member_id").agg(F.countDistinct("code").alias("n_codes"))


def top_member_codes(df: DataFrame, codes: str, n: int) -> DataFrame:
    """The n codes that most members have, with their members' number."""
    held = df.select("member_id", F.explode(codes).alias("code")).distinct()
    return held.groupBy("code").agg(F.count(F.lit(1)).alias("n_members")).orderBy(F.desc("n_members"), "code").limit(n)


def baseline_table(cohort: DataFrame, outcome: str, race: Column) -> DataFrame:
    """Per outcome group: sizes, median and quartiles of age and code counts, percent per gender and race; in long form."""
    q = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    # The order of the races; item names are fixed too.
    labels = [RACE_LABELS[k] for k in ("01", "02", "11", "04", "06", "09")]
    share = lambda cond: F.round(100.0 * F.avg(F.coalesce(cond, F.lit(False)).cast("int")), 6)
    rows = cohort.withColumn("_race", race).withColumn("_codes", F.size(F.array_distinct("icd10_codes")))
    wide = rows.groupBy(F.col(outcome).alias("grp")).agg(
        F.count(F.lit(1)).cast("double").alias("N spells"), F.countDistinct("member_id").cast("double").alias("N patients"), F.percentile("age", q).alias("_age"),
        share(F.col("gendercode") == "F").alias("Female, %"), share(F.col("gendercode") == "M").alias("Male, %"), share(~F.coalesce(F.col("gendercode").isin("F", "M"), F.lit(False))).alias("Other/Unknown gender, %"),
        *(share(F.col("_race") == r).alias(f"{r}, %") for r in labels), F.percentile("_codes", q).alias("_n"),
    )
    flat = [c for c in wide.columns if c not in ("grp", "_age", "_n")]
    items = [F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").alias("value")) for c in flat]
    items += [F.struct(F.lit(f"{what} p{p}").alias("item"), F.round(F.col(col)[i], 6).alias("value")) for what, col in (("Age", "_age"), ("ICD10 codes", "_n")) for i, p in enumerate((25, 50, 75))]
    return wide.select("grp", F.inline(F.array(*items)))


#: Relative standard error of distinct counts (1.04 / 2**(LG_K / 2)), and rank error of quantiles at 99 % (about 2.7 / KLL_K**0.92).
LG_K, KLL_K = 12, 800


def sketch_parts(df: DataFrame, keys: list[str], entity: str, column: str) -> DataFrame:
    """One row per value of ``keys``: the number of rows, and sketches of the entities and of the column's values.

    Such rows are kept for each part of the data (a day, a batch).  ``from_sketches`` adds them up, so that counts of new parts
    need no row of old ones."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(entity, F.lit(LG_K)).alias("entities"), F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(KLL_K)).alias("quantiles"))


def merged_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser ``keys``, or of several parts: of the same form as the parts."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("entities").alias("entities"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def from_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (exact), n_entities (estimate) and the quartiles p25, p50 and p75 (estimates)."""
    whole = merged_sketches(parts, keys)
    quartile = lambda q: F.kll_sketch_get_quantile_double("quantiles", F.lit(q))
    return whole.select(*keys, "n", F.hll_sketch_estimate("entities").alias("n_entities"), *(quartile(p / 100).alias(f"p{p}") for p in (25, 50, 75)))
