"""Claims-like views over the driver tables: fills, code maps, claims, enrollment, demographics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import starts_with_any, zero_filled

QUERY_BRANDS = ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5")
DIAGNOSIS_TYPES = (17, 18, 22, 23, 24)
#: (order, prefix, description): the first that matches names a code.
EVENT_CODES = ((0, "T40", "Poisoning"), (1, "F11", "Dependence"), (2, "T887", "Unspecified drug effect"), (3, "L27", "Dermatitis"), (4, "L270", "Generalised eruption"))
CLAIM_CODES = ("T402X1A", "F1120", "T887XXA", "L270", "M545", "I10", "E11.9", "J189")


class Claims:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rx_fills(self) -> DataFrame:
        line, order, part = self.table("lineitem"), self.table("orders"), self.table("part")
        joined = line.join(order, line["l_orderkey"] == order["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"])
        return joined.select(
            F.col("o_custkey").alias("member_id"),
            F.to_date("l_shipdate").alias("filldate"),
            zero_filled(F.col("p_partkey").cast("string")).alias("ndc11code"),
            (F.col("l_quantity").cast("int") * F.when(F.col("p_partkey") % 10 == 0, 8).otherwise(2)).alias("supplydayscount"),
        )

    def ndc_to_atc(self, gaps: bool = False) -> DataFrame:
        part = self.table("part")
        if gaps:
            part = part.where(F.col("p_partkey") % 50 != 0)
        return part.select(F.col("p_partkey").cast("string").alias("ndc"), (F.col("p_partkey") + 1_000_000).cast("string").alias("rxcui"), F.col("p_name").alias("rxnorm_description"), F.col("p_brand").alias("atc_3_code"), F.concat(F.lit("CLASS "), "p_brand").alias("atc_3_name"))

    def query_drugs(self) -> DataFrame:
        return self.table("part").where(F.col("p_brand").isin(*QUERY_BRANDS)).select(zero_filled(F.col("p_partkey").cast("string")).alias("ndc11"))

    def claim(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("member_id"), F.to_date("o_orderdate").alias("service_date"))

    def claim_code(self) -> DataFrame:
        code = F.element_at(F.array(*map(F.lit, CLAIM_CODES)), (F.col("o_orderkey") % 8 + 1).cast("int"))
        return self.table("orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 11 == 0, 99).otherwise(17).alias("code_type"), code.alias("code_value"))

    def diagnoses(self) -> DataFrame:
        """member_id, service_date and code_value of diagnosis-type codes."""
        codes = self.claim_code().where(F.col("code_type").isin(*DIAGNOSIS_TYPES))
        return self.claim().join(codes, "claim_id").select("member_id", "service_date", "code_value")

    def adverse_events(self) -> DataFrame:
        return self.diagnoses().where(starts_with_any(F.col("code_value"), (p for _, p, _ in EVENT_CODES))).select("member_id", F.col("service_date").alias("event_date"), "code_value")

    def event_codes(self) -> DataFrame:
        return self.spark.createDataFrame(EVENT_CODES, "ord int, prefix string, description string")

    def enrollment(self) -> DataFrame:
        start = F.date_add(F.to_date(F.lit("1994-07-01")), (F.col("c_custkey") % 5 * 120).cast("int"))
        days = F.when(F.col("c_custkey") % 13 == 0, 200).otherwise(1800 + F.col("c_custkey") % 3 * 300).cast("int")
        first = self.table("customer").select(F.col("c_custkey").alias("member_id"), start.alias("effectivedate"), F.date_add(start, days).alias("terminationdate"))
        again = first.where(F.col("member_id") % 7 == 0).select("member_id", F.date_add("terminationdate", 60).alias("effectivedate"), F.date_add("terminationdate", 460).alias("terminationdate"))
        return first.unionByName(again)

    def demographics(self) -> DataFrame:
        c, n = self.table("customer"), self.table("nation")
        key = F.col("c_custkey")
        race = F.element_at(F.array(*map(F.lit, ("01", "02", "04", "06", "09", "11"))), F.col("c_nationkey") % 6 + 1)
        gender = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "M").when(F.col("c_mktsegment") != "FURNITURE", "F")
        return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
            key.alias("member_id"),
            F.when(key % 97 == 0, None).when(key % 89 == 0, 1850).otherwise(1930 + key % 70).cast("int").alias("birthyear"),
            gender.alias("gendercode"),
            race.alias("raceethnicitytypecode"),
            F.col("n_name").alias("statecode"),
        )

    def code_vectors(self, kind: str = "drug") -> DataFrame:
        """code and vec of drug classes, or of ICD clusters: the mean of all vectors whose number falls to the code."""
        if kind == "drug":
            code = F.concat(F.lit("Brand#"), (F.col("vec_id") % 25 + 1).cast("string"))
        else:
            code = F.element_at(F.array(*(F.lit(c[:3]) for c in CLAIM_CODES)), (F.col("vec_id") % len(CLAIM_CODES) + 1).cast("int"))
        cells = self.table("embeddings").select(code.alias("code"), F.posexplode("embedding").alias("dim", "x")).groupBy("code", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
        whole = cells.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))  # 64 cells a code
        return whole.select("code", F.col("v.x").alias("vec"))

    def scored(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("row_id"), F.round(F.col("value") / (1 + F.col("value")), 3).alias("score"), (F.col("event_type") == "error").cast("int").alias("y"))
