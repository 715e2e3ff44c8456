"""Running sums and minima in the order of a column, by value ranges: no task sees all rows.

Rows are cut into ranges at approximate quantiles.  A window runs inside each range; what lies before a range comes from one row of
totals for each range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 200


def with_range(df: DataFrame, column: str, ranges: int = RANGES) -> DataFrame:
    """_range: the number of the row's value range, in order of the column.  Reads df once for the quantiles."""
    cuts = sorted(set(df.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.5 / ranges)))  # fewer than ``ranges`` numbers
    if not cuts:
        return df.withColumn("_range", F.lit(0.0))
    splits = [-float("inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol="_range", handleInvalid="keep").transform(df)


def running(df: DataFrame, column: str, made: dict[str, tuple[Callable, str]], descending: bool = False, own: bool = True, ranges: int = RANGES) -> DataFrame:
    """df with F.sum or F.min of columns over all rows up to each one (itself included if ``own``), in order of ``column``, whose
    values are distinct.  A sum over no rows is 0, a minimum null.  A df that comes ``with_range`` keeps its ranges."""
    sort = F.desc if descending else F.asc
    inside = Window.partitionBy("_range").orderBy(sort(column)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    across = Window.orderBy(sort("_range")).rowsBetween(Window.unboundedPreceding, -1)
    placed = df if "_range" in df.columns else with_range(df, column, ranges)
    totals = placed.groupBy("_range").agg(*(f(c).alias(name) for name, (f, c) in made.items()))  # one row a range
    before = totals.select("_range", *(f(name).over(across).alias(f"_before_{name}") for name, (f, _) in made.items()))

    def both(name: str, f: Callable, c: str) -> Column:
        here, earlier = f(c).over(inside), F.col(f"_before_{name}")
        return F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0)) if f is F.sum else F.least(here, earlier)

    joined = placed.join(F.broadcast(before), "_range")
    return joined.select(*df.columns, *(both(name, f, c).alias(name) for name, (f, c) in made.items()))
