"""From segments to the modelling cohort, and the counts of what each step leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import letter_and_digits

STEPS = ("segments", "size", "entry_day", "length", "dedup", "leakage", "age", "gender")


def keep_first_per_combo(df: DataFrame, outcome: str = "y") -> DataFrame:
    """One row per member and combination: rows with the outcome first, then the earliest."""
    order = Window.partitionBy("member_id", "drug_combo").orderBy(F.desc(outcome), "spell_id", "split_seq")
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _outcome(window: int) -> Column:
    return F.coalesce(F.col("had_ae") & (F.col("first_ae_date") <= F.date_add("entry_date", window)), F.lit(False)).cast("int")


def _early_filters(min_size: int, min_days: int) -> dict[str, Column]:
    """The filters before the fold by combination, each true for rows that stay."""
    return {
        "size": F.size("drug_combo") >= min_size,
        "entry_day": ~F.coalesce(F.col("first_ae_date") == F.col("entry_date"), F.lit(False)),
        "length": F.col("had_ae") | (F.col("spell_length_days") >= min_days),
    }


def _late_filters(max_age: int) -> dict[str, Column]:
    """Those after it, over rows ``_described``."""
    own = letter_and_digits(F.col("first_ae_code"))
    leaks = F.col("had_ae") & own.isNotNull() & F.exists("icd10_codes", lambda c: letter_and_digits(c) == own)
    return {"leakage": ~F.coalesce(leaks, F.lit(False)), "age": F.col("age") <= max_age, "gender": F.col("gendercode").isNotNull()}


def _described(rows: DataFrame, demographics: DataFrame, icd: DataFrame) -> DataFrame:
    rest = [c for c in demographics.columns if c != "member_id"]
    person = demographics.groupBy("member_id").agg(F.min(F.struct(*rest)).alias("d")).select("member_id", *(f"d.{c}" for c in rest))
    joined = rows.join(person, "member_id", "left").join(icd.select("spell_id", "split_seq", "icd10_codes"), ["spell_id", "split_seq"], "left")
    return joined.withColumn("icd10_codes", F.coalesce("icd10_codes", F.array().cast("array<string>"))).withColumn("age", F.year("entry_date") - F.col("birthyear"))


def cohort_steps(segments: DataFrame, demographics: DataFrame, icd: DataFrame, window: int = 30, min_size: int = 3, min_days: int = 15, max_age: int = 120) -> dict[str, DataFrame]:
    """The cohort after each filter, in order."""
    at = {"segments": segments}
    rows = segments
    for name, stays in _early_filters(min_size, min_days).items():
        at[name] = rows = rows.where(stays)
    at["dedup"] = rows = keep_first_per_combo(rows.withColumn("y", _outcome(window)))
    rows = _described(rows, demographics, icd)
    for name, stays in _late_filters(max_age).items():
        at[name] = rows = rows.where(stays)
    return at


def finalize_cohort(segments: DataFrame, demographics: DataFrame, icd: DataFrame, window: int = 30) -> DataFrame:
    return cohort_steps(segments, demographics, icd, window)["gender"]


def _passed(filters: list[Column], start: int) -> Column:
    """The step that a row reaches: ``start`` and one for each filter up to the first that it fails."""
    out = F.lit(start + len(filters))
    for i, stays in reversed(list(enumerate(filters))):
        out = F.when(F.coalesce(stays, F.lit(False)), out).otherwise(start + i)
    return out


def attrition(segments: DataFrame, demographics: DataFrame, icd: DataFrame, window: int = 30, min_size: int = 3, min_days: int = 15, max_age: int = 120) -> DataFrame:
    """Rows and members after each step of ``cohort_steps``, by one pass over the segments.

    Each row gets the last step it reaches, each member that of its best row; both are folded and added up from the end."""
    early = list(_early_filters(min_size, min_days).values())
    rows = segments.withColumns({"_step": _passed(early, 0), "y": _outcome(window)})
    order = Window.partitionBy("member_id", "drug_combo").orderBy(F.desc("_step"), F.desc("y"), "spell_id", "split_seq")
    first = (F.col("_step") == len(early)) & (F.row_number().over(order) == 1)
    rows = rows.withColumn("_step", F.when(first, len(early) + 1).otherwise(F.col("_step")))
    late = _passed(list(_late_filters(max_age).values()), len(early) + 1)
    rows = _described(rows, demographics, icd).select("member_id", F.when(F.col("_step") > len(early), late).otherwise(F.col("_step")).alias("step"))
    best = Window.partitionBy("member_id")
    marked = rows.groupBy("member_id", "step").agg(F.count(F.lit(1)).alias("n")).withColumn("is_best", (F.col("step") == F.max("step").over(best)).cast("int"))
    at = marked.groupBy("step").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("member_id").isNotNull(), F.col("is_best")).otherwise(0)).alias("members"))
    names = segments.sparkSession.createDataFrame(list(enumerate(STEPS)), "step int, name string")
    later = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)  # a row a step
    total = lambda c: F.coalesce(F.sum(c).over(later), F.lit(0))
    return names.join(at, "step", "left").select("step", "name", total("n").alias("n_rows"), total("members").alias("n_members"))


def members_without_event(segments: DataFrame) -> DataFrame:
    return segments.select("member_id").distinct().join(segments.where("had_ae").select("member_id").distinct(), "member_id", "left_anti")
