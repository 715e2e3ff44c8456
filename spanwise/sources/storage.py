"""Tables laid out by member: buckets that later joins and windows read without a shuffle, and batches that can be written again one by one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_folder


def bucketed(df: DataFrame, key: str, buckets: int, path: str | None = None, name: str | None = None) -> DataFrame:
    """df written in ``buckets`` buckets of ``key``, sorted by it, and read again as a table.

    Joins, windows and folds by the key (and others beside it) of tables with as many buckets start without an exchange.  Rows are
    dealt by the key first, so each bucket is one file.  The table is called ``name`` and lies in ``path`` (default: the shared folder)."""
    name = name or f"bucketed_{uuid.uuid4().hex}"
    path = path or f"{shared_folder(df.sparkSession)}/{name}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def buckets_for(rows: int, size: int, least: int = 16) -> int:
    """How many buckets hold ``rows`` rows at about ``size`` rows each, a power of two times ``least``: a task's share stays the same for any
    number of rows, and tables of like size get as many buckets."""
    buckets = least
    while buckets * size < rows:
        buckets *= 2
    return buckets


def write_batches(df: DataFrame, batches: DataFrame, key: str, path: str, only: list[int] | None = None, files: int = 1) -> None:
    """df's rows in one folder for each batch of keys; ``batches``: key and batch.

    A batch that is written again replaces its own folder and leaves the others; ``only`` names the batches to write, such as those that ``missing_batches`` finds.
    A batch goes to up to ``files`` files, more than one where a task should not write all of it."""
    wanted = batches.select(key, "batch")
    if only is not None:
        named = batches.sparkSession.createDataFrame([(b,) for b in only], "batch long")  # a row a batch
        wanted = wanted.join(named, "batch", "left_semi")
    rows = df.join(wanted, key).repartition("batch", F.pmod(F.xxhash64(key), F.lit(files)))
    rows.write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def missing_batches(spark: SparkSession, batches: DataFrame, path: str) -> list[int]:
    """The batches that no folder of ``path`` holds yet: where an extraction that stopped goes on."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    wanted = {r["batch"] for r in batches.select("batch").distinct().collect()}  # a row a batch
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(there):
        return sorted(wanted)
    have = {int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(there) if s.getPath().getName().startswith("batch=") and s.getPath().getName().removeprefix("batch=").isdigit()}
    return sorted(wanted - have)
