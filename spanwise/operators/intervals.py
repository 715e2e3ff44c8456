"""Generic interval operators: coalescing, concurrency, overlap and as-of joins.

All carry an entity key; frames that share it reuse one hash partitioning, since every window and join keys on it first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesce_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int, extras: Sequence[Column] = (), key_marks: Sequence[str] = ()) -> DataFrame:
    """Closed day intervals of one key joined while the next starts at most ``gap`` + 1 days after the end so far.

    ``extras``: aggregates over the joined rows.  ``key_marks``: columns whose largest value among all the key's rows each of its intervals gets.

    Without extras one sort does all: an interval is its first row, and its end is the end so far at the next interval's first row."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    made = {"_so_far": so_far, "_last": F.max(end).over(whole)} | {c: F.max(c).over(whole) for c in key_marks}
    marked = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumns(made)
    new = F.col("_so_far").isNull() | (F.col(start) > F.date_add("_so_far", 1 + gap))
    if extras:
        numbered = marked.withColumn("_island", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), *extras, *(F.max(c).alias(c) for c in key_marks)).drop("_island")
    upto = F.coalesce(F.lead("_so_far").over(order), "_last")
    # A first row that ends before the end so far also ends before its own start; what follows it starts anew, so it stands alone.
    stop = F.when(F.col("_so_far").isNull() | (upto > F.col("_so_far")), upto).otherwise(F.col(end))
    return marked.where(new).select(*keys, start, stop.alias(end), *key_marks)


def concurrency_sweep(df: DataFrame, entity: str, start: str, end: str, flag: str) -> DataFrame:
    """Change points per entity and day: n open intervals and n_flagged of them, after the day's changes.

    One sort by entity and day: running sums take in all rows of a day, and the last row of a day stays."""
    changes = F.array(
        F.struct(F.col(start).alias("day"), F.lit(1).alias("d"), F.col(flag).cast("int").alias("dq")),
        F.struct(F.date_add(end, 1).alias("day"), F.lit(-1).alias("d"), (-F.col(flag).cast("int")).alias("dq")),
    )
    order = Window.partitionBy(entity).orderBy("day")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    points = df.select(entity, F.inline(changes)).select(entity, "day", F.sum("d").over(upto).alias("n"), F.sum("dq").over(upto).alias("n_flagged"), F.lead(F.struct("day")).over(order).alias("_next"))
    return points.where(F.col("_next").isNull() | ~F.col("_next.day").eqNullSafe(F.col("day"))).drop("_next")


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str | Column, str | Column], right_span: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows of one key whose closed spans overlap; the key is always an equi-join key."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in left_span)
    cond = (left[key] == right[key]) & (right[right_span[0]] <= b) & (right[right_span[1]] >= a)
    joined = left.join(right, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(right[key])


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: Sequence[str]) -> DataFrame:
    """Each null of ``columns`` takes the last value before it among the rows of its keys, in ``order``; nulls before any value stay."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns})


def _merged(probes: DataFrame, changes: DataFrame, keys: Sequence[str], probe_date: str, change_date: str, **kept: Column) -> DataFrame:
    """Probes (packed in _own) and changes in one frame that sorts by keys, _at and _probe: changes come before probes of their date."""
    packed = F.struct(*(F.col(c) for c in probes.columns))
    left = probes.select(*keys, F.col(probe_date).alias("_at"), F.lit(1).alias("_probe"), packed.alias("_own"))
    return left.unionByName(changes.select(*keys, F.col(change_date).alias("_at"), F.lit(0).alias("_probe"), *(v.alias(c) for c, v in kept.items())), allowMissingColumns=True)


def latest_on_or_before(probes: DataFrame, changes: DataFrame, keys: Sequence[str], probe_date: str, change_date: str, values: Sequence[str]) -> DataFrame:
    """As-of join by merge: each probe row with the values of its keys' latest change on or before its date, nulls where there is none.

    Probes and changes are sorted together and filled forward, so a key's rows are read once, however many there are of each.  Of
    changes on one date the larger values win."""
    rows = _merged(probes, changes, keys, probe_date, change_date, _values=F.struct(*values))
    filled = forward_fill(rows, keys, ["_at", "_probe", "_values"], ["_values"]).where("_probe = 1")
    return filled.select(*(F.col("_own").getField(c).alias(c) for c in probes.columns), *(F.col("_values").getField(c).alias(c) for c in values))


def _held(probes: DataFrame, changes: DataFrame, keys: Sequence[str], probe_date: str, change_date: str, item: str, on: str) -> tuple[DataFrame, Window]:
    """Probes (_own) and the changes (_item, _on) that hold at them, a row for each, and the window of the rows that meet at one probe.

    One merge of probes and changes: the probes of a key are numbered by date, and a change holds for those from its date to the item's next change,
    which the running number of probes tells.  So the work is that of sorting, and of the items that are found.  Changes that no probe of
    their key follows go before the second sort: they hold nowhere, and what holds before them holds to the last probe.  Of an item's changes
    on one date, one that turns it on wins: the others end where they start."""
    rows = _merged(probes, changes, keys, probe_date, change_date, _item=F.col(item), _on=F.col(on).cast("int"))
    order = Window.partitionBy(*keys).orderBy("_at", "_probe")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_n": F.sum("_probe").over(so_far), "_all": F.sum("_probe").over(whole)}).where((F.col("_probe") == 1) | (F.col("_n") < F.col("_all")))
    until = F.coalesce(F.lead("_n").over(Window.partitionBy(*keys, "_item", "_probe").orderBy("_at", "_on")), F.col("_all"))
    numbers = F.when(F.col("_probe") == 1, F.array("_n")).when(F.col("_until") > F.col("_n"), F.sequence(F.col("_n") + 1, "_until"))
    return rows.withColumn("_until", until).select(*keys, "_own", "_item", "_on", F.explode(numbers).alias("_n")), Window.partitionBy(*keys, "_n")


def active_at(probes: DataFrame, changes: DataFrame, keys: Sequence[str], probe_date: str, change_date: str, item: str, on: str, name: str) -> DataFrame:
    """Each probe row with ``name``: the sorted items of its keys whose latest change on or before its date turned them on."""
    held, at_probe = _held(probes, changes, keys, probe_date, change_date, item, on)
    met = held.where("_own is not null or _on = 1").withColumn("_items", F.collect_list("_item").over(at_probe)).where("_own is not null")
    return met.select(*(F.col("_own").getField(c).alias(c) for c in probes.columns), F.sort_array("_items").alias(name))


def status_at(probes: DataFrame, changes: DataFrame, keys: Sequence[str], probe_date: str, change_date: str, item: str, on: str) -> DataFrame:
    """Each probe row with each item of its keys that has a change on or before its date, and ``on`` (0 or 1) of the latest."""
    held, at_probe = _held(probes, changes, keys, probe_date, change_date, item, on)
    met = held.withColumn("_probe", F.first("_own", ignorenulls=True).over(at_probe.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("_own is null")
    return met.select(*(F.col("_probe").getField(c).alias(c) for c in probes.columns), F.col("_item").alias(item), F.col("_on").alias(on))
