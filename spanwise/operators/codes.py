"""Eligibility, code maps and code clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import code_cluster, has_term, ndc11, zero_filled
from ..sources.tables import require_columns


class DuplicateKeys(ValueError):
    pass


def eligible_members(rx: DataFrame, query_list: DataFrame, min_distinct: int = 3) -> DataFrame:
    """Members with a fill from the list and at least ``min_distinct`` drugs, among fills with days of supply."""
    listed = query_list.select(F.trim("ndc11").alias("ndc11code")).distinct().withColumn("listed", F.lit(1))
    flagged = rx.where(F.col("supplydayscount").isNotNull()).join(listed, "ndc11code", "left")
    counted = flagged.groupBy("member_id").agg(F.max(F.coalesce("listed", F.lit(0))).alias("listed"), F.countDistinct("ndc11code").alias("n_drugs"))
    return counted.where((F.col("listed") == 1) & (F.col("n_drugs") >= min_distinct)).select("member_id", "n_drugs")


def restrict_to_members(df: DataFrame, members: DataFrame) -> DataFrame:
    return df.join(members.select("member_id"), "member_id", "left_semi")


def flag_listed(rx: DataFrame, query_list: DataFrame) -> DataFrame:
    """rx with is_query_drug."""
    listed = query_list.select(F.trim("ndc11").alias("ndc11code")).distinct().withColumn("_listed", F.lit(True))
    return rx.join(listed, "ndc11code", "left").withColumn("is_query_drug", F.coalesce("_listed", F.lit(False))).drop("_listed")


def clean_map(raw: DataFrame) -> DataFrame:
    """Codes and names trimmed; of several rows for an NDC the first in column order stays."""
    require_columns(raw, "ndc")
    trimmed = raw.select(*(F.trim(c).alias(c) for c in raw.columns))
    rest = [c for c in raw.columns if c != "ndc"]
    return trimmed.groupBy("ndc").agg(F.min(F.struct(*rest)).alias("r")).select("ndc", *(f"r.{c}" for c in rest))


def enrich_classes(rx: DataFrame, mapping: DataFrame, check: bool = True) -> DataFrame:
    """rx with the mapping's columns; unmatched rows stay with nulls.  Raises DuplicateKeys for an ambiguous mapping."""
    require_columns(rx, "ndc11code")
    keyed = require_columns(mapping, "ndc").withColumn("ndc11code", zero_filled(F.col("ndc"))).drop("ndc")
    if check and keyed.groupBy("ndc11code").count().where("count > 1").limit(1).count():
        raise DuplicateKeys("the mapping has several rows for one NDC")
    return rx.withColumn("ndc11code", zero_filled(F.col("ndc11code"))).join(keyed, "ndc11code", "left").select(*rx.columns, *(c for c in keyed.columns if c != "ndc11code"))


def match_rate(enriched: DataFrame, column: str = "atc_3_code") -> DataFrame:
    return enriched.agg(F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("n_matched"), F.round(F.count(column) / F.count(F.lit(1)), 6).alias("share"))


def cluster_codes(df: DataFrame, keys: tuple[str, ...], code: str = "code_value") -> DataFrame:
    """Sorted distinct three-character clusters of each key's codes; null and odd codes are dropped."""
    return df.withColumn("_c", code_cluster(F.col(code))).where(F.col("_c").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set("_c")).alias("icd10_codes"))


def describe_codes(codes: DataFrame, descriptions: DataFrame, code: str = "code_value", unknown: str = "Unknown AE code") -> DataFrame:
    """Each distinct code with the description of the first prefix (by ord) that starts it.

    Prefixes are few: each length gets an equi-join key, so no code meets a prefix it does not start with."""
    prefixes = descriptions.withColumn("prefix", F.regexp_replace(F.regexp_replace("prefix", r"\.", ""), "%$", "")).withColumn("n", F.length("prefix"))
    distinct = codes.select(code).distinct()
    cut = distinct.select(code, F.explode(F.transform(F.sequence(F.lit(1), F.length(code)), lambda n: F.substring(F.col(code), F.lit(1), n))).alias("prefix"))
    found = cut.join(prefixes, "prefix").groupBy(code).agg(F.min_by("description", "ord").alias("description"))
    return distinct.join(found, code, "left").withColumn("description", F.coalesce("description", F.lit(unknown)))


def opioid_products(products: DataFrame) -> DataFrame:
    """One row per 11-digit package code of products whose ingredients or classes name an opioid; the first per code stays.

    strength: each ingredient's name and strength; route: all routes; both joined by commas."""
    names = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in (F.col("active_ingredients.name"), F.col("pharm_class"), F.col("pharm_class_cs"), F.col("pharm_class_epc"))))
    named = F.transform("active_ingredients", lambda i: F.concat(i["name"], F.lit(" "), F.coalesce(i["strength"], F.lit("None"))))
    strength = F.array_join(F.coalesce(named, F.array().cast("array<string>")), ", ")
    route = F.array_join(F.coalesce("route", F.array().cast("array<string>")), ", ")
    rows = products.where(has_term(names)).select(F.explode("packaging.package_ndc").alias("raw"), "brand_name", strength.alias("strength"), route.alias("route"), "labeler_name")
    coded = rows.withColumn("ndc11", ndc11(F.col("raw"))).where(F.col("ndc11").isNotNull())
    first = Window.partitionBy("ndc11").orderBy("brand_name", "strength", "route", "labeler_name")
    return coded.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("ndc11", "brand_name", "strength", "route", "labeler_name")


def key_range_batches(df: DataFrame, key: str, size: int, ranges: int = 1000) -> DataFrame:
    """Each distinct whole-number key's rank and batch of ``size`` keys.

    The span of keys is cut into ``ranges`` equal ranges; a rank is the place inside the range plus the sizes of the ranges
    before it, so no task sees all keys."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    span = keys.agg(F.min(key).alias("low"), F.max(key).alias("high")).withColumn("width", F.floor((F.col("high") - F.col("low")) / ranges) + 1)
    placed = keys.join(F.broadcast(span)).select(key, F.floor((F.col(key) - F.col("low")) / F.col("width")).alias("_range"))  # one row of bounds
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # at most ranges + 1 rows
    before = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key)) + F.col("before")
    ranked = placed.join(F.broadcast(before), "_range").select(key, rank.alias("rank"))
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size))


def hash_buckets(df: DataFrame, key: str, buckets: int = 100) -> DataFrame:
    return df.groupBy(F.pmod(F.col(key), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"))
