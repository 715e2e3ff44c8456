"""Readers and writers: Parquet, all-string CSV, nested JSON, partitioned JDBC, dataset checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return require_columns(df, *columns).select(*columns) if columns else df


def read_csv_strings(spark: SparkSession, path: str, columns: Sequence[str], use: Sequence[str] | None = None) -> DataFrame:
    """Every column as text, so that leading zeros of codes stay."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*use) if use else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share; in local mode without that setting a
    temporary one."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return folder or f"file://{tempfile.mkdtemp(prefix='spanwise-tables-')}"


def stored(df: DataFrame) -> DataFrame:
    """The frame's rows, written to the shared folder and read again: what follows is planned from there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_ranked_csv(df: DataFrame, path: str, *order) -> None:
    """A small ranked report as one CSV file."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: One product of the drug directory's JSON export.
PRODUCT = T.StructType([
    T.StructField("brand_name", T.StringType()),
    T.StructField("labeler_name", T.StringType()),
    T.StructField("route", T.ArrayType(T.StringType())),
    T.StructField("active_ingredients", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("strength", T.StringType())]))),
    T.StructField("pharm_class", T.ArrayType(T.StringType())),
    T.StructField("pharm_class_cs", T.ArrayType(T.StringType())),
    T.StructField("pharm_class_epc", T.ArrayType(T.StringType())),
    T.StructField("packaging", T.ArrayType(T.StructType([T.StructField("package_ndc", T.StringType())]))),
])


def products_of(texts: DataFrame) -> DataFrame:
    """One row per product of {"results": [...]} texts (column value)."""
    schema = T.StructType([T.StructField("results", T.ArrayType(PRODUCT))])
    return texts.select(F.explode(F.from_json("value", schema)["results"]).alias("p")).select("p.*")


def bracketed_records(spark: SparkSession, path: str, brackets: str = "{}", depth: int = 1) -> DataFrame:
    """file, number and value: what stands in ``depth`` nested pairs of brackets in large JSON files, and all before it since the last such record.

    Files are read in splits of any place, cut at the closing bracket, so one file gives many tasks and no row holds it.  Whether
    a piece starts inside a string, and how deep, follows from the pieces before: running sums inside a split, and one row for each split of
    the file.  Brackets inside strings and escaped quotes do not count; layout does not matter.  A record as long as several splits is put together from its pieces."""
    opener, closer = brackets
    here = F.col("_metadata")
    raw = spark.read.option("lineSep", closer).text(path).select(here["file_path"].alias("file"), here["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece"))
    bare = F.regexp_replace("piece", r"(?s)\\.", "")  # without escaped characters
    raw = raw.withColumn("bare", bare)

    def change(text: Column) -> Column:
        """Brackets opened less those closed in a text that starts outside strings; the piece's own end is not in it."""
        plain = F.regexp_replace(text, r'"[^"]*("|$)', "")
        return F.length(plain) - F.length(F.replace(plain, F.lit(opener), F.lit("")))

    quotes = F.length("bare") - F.length(F.replace("bare", F.lit('"'), F.lit("")))
    odd = quotes % 2
    pieces = raw.select("file", "block", "place", "piece", quotes.alias("quotes"), (change(F.col("bare")) - (1 - odd)).alias("outside"), (change(F.regexp_replace("bare", r'^[^"]*("|$)', "")) - odd).alias("inside"))
    of_split = Window.partitionBy("file", "block").orderBy("place")
    before, so_far = of_split.rowsBetween(Window.unboundedPreceding, -1), of_split.rowsBetween(Window.unboundedPreceding, 0)
    odd_before = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    # Both cases, by whether the split starts inside a string: the depth after each piece, counted from the split's start.
    deep = {0: F.sum(F.when(F.col("odd_before") == 0, F.col("outside")).otherwise(F.col("inside"))), 1: F.sum(F.when(F.col("odd_before") == 1, F.col("outside")).otherwise(F.col("inside")))}
    pieces = stored(pieces.withColumn("odd_before", odd_before).select("file", "block", "place", "piece", "quotes", "odd_before", *(f.over(so_far).alias(f"deep_{k}") for k, f in deep.items())))

    splits = pieces.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), *(F.max_by(f"deep_{k}", "place").alias(f"deep_{k}") for k in deep))
    of_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("odd", F.coalesce(F.sum("quotes").over(of_file), F.lit(0)) % 2)
    own = F.when(F.col("odd") == 0, F.col("deep_0")).otherwise(F.col("deep_1"))
    splits = splits.withColumn("own", own).select("file", "block", "odd", F.coalesce(F.sum("own").over(of_file), F.lit(0)).alias("start"))
    placed = pieces.join(splits, ["file", "block"])
    ends_outside = (F.col("odd") + F.col("odd_before") + F.col("quotes")) % 2 == 0
    after = F.col("start") + F.when(F.col("odd") == 0, F.col("deep_0")).otherwise(F.col("deep_1"))
    placed = placed.select("file", "block", "place", "piece", (ends_outside & (after == depth - 1)).cast("int").alias("closes"))
    totals = placed.groupBy("file", "block").agg(F.sum("closes").alias("n")).select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    number = F.coalesce(F.sum("closes").over(before), F.lit(0)) + F.col("earlier")
    numbered = placed.join(totals, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select("file", "block", "place", "piece", "closes", number.alias("number"))
    whole = numbered.groupBy("file", "number").agg(F.max("closes").alias("closed"), F.sort_array(F.collect_list(F.struct("block", "place", "piece"))).alias("parts")).where("closed = 1")
    return whole.select("file", "number", F.concat(F.array_join("parts.piece", closer), F.lit(closer)).alias("value"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """The products of files that hold {"results": [...]} objects of any size and layout, a record a row."""
    records = bracketed_records(spark, path, "{}", 2)
    plain = r'(?:[^"{}]++|"(?:[^"\\]++|\\.)*+")*+'  # text and strings outside braces
    # A file's first record comes after the outer object's brace; a later one may follow the end of one outer object and the start of the next.
    before = F.when(F.col("number") == 0, F.regexp_extract("value", rf"(?s)^{plain}\{{({plain})\{{", 1)).otherwise(F.regexp_extract("value", rf"(?s)^((?:{plain}\}}{plain}\{{)?{plain})\{{", 1))
    skipped = F.when(F.col("number") == 0, F.regexp_extract("value", rf"(?s)^({plain}\{{{plain})\{{", 1)).otherwise(before)
    # Members of the outer object that are objects themselves, such as a file's description, follow a colon.
    kept = records.where(~before.rlike(r":\s*$")).select(F.from_json(F.substr("value", F.length(skipped) + 1), PRODUCT).alias("p"))
    return kept.where("p is not null").select("p.*")


def read_code_vectors(spark: SparkSession, path: str) -> DataFrame:
    """code and vec of JSON objects that map codes to vectors, of any size and layout: a member a row."""
    records = bracketed_records(spark, path, "[]", 1)
    member = F.concat(F.lit("{"), F.regexp_replace("value", r"(?s)^[\s{},]*", ""), F.lit("}"))
    return records.select(F.explode(F.from_json(member, "map<string,array<float>>")).alias("code", "vec"))


def read_jdbc_ranges(spark: SparkSession, url: str, query: str, key: str, low: int, high: int, parts: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A query read in ``parts`` ranges of a numeric key at once; simple filters are pushed to the database."""
    return spark.read.jdbc(url, f"({query}) q", column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties or {})


def validate_dataset(df: DataFrame, expected: Sequence[str] = ()) -> DataFrame:
    """One row per check: rows, columns, null count of each column, and whether each expected column is there."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(df.columns)))
    values = {"rows": F.col("rows"), "columns": F.lit(len(df.columns))}
    values |= {f"nulls:{c}": F.col(f"nulls_{i}") for i, c in enumerate(df.columns)} | {f"has:{c}": F.lit(int(c in df.columns)) for c in expected}
    return counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check"), v.cast("long").alias("value")) for k, v in values.items()))))


def validate_path(spark: SparkSession, path: str, expected: Sequence[str] = ()) -> DataFrame:
    """The same for Parquet at a path, after one row each for whether it exists and whether it can be read."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = spark.createDataFrame([("exists", int(there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)))], "check string, value long")
    if not found.first()["value"]:
        return found
    try:
        df = spark.read.parquet(path)
        df.limit(1).collect()
    except (AnalysisException, Py4JJavaError):
        return found.union(spark.createDataFrame([("readable", 0)], "check string, value long"))
    return found.union(spark.createDataFrame([("readable", 1)], "check string, value long")).union(validate_dataset(df, expected))


def preview(spark: SparkSession, path: str, rows: int = 5) -> list[Row]:
    """The first rows of Parquet at a path."""
    return spark.read.parquet(path).limit(rows).collect()
