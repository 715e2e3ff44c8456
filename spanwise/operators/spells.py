"""Spells of concurrent use: detection, changes, censoring, labels, segments and combinations.

A fill covers [filldate, filldate + supplydayscount - 1].  Every step's join and window keys start with member_id, so one hash
partitioning by member serves the whole chain: rows of one spell are found among the member's by ``same_spell``, which is no join key of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import active_at, coalesce_intervals, concurrency_sweep

#: Spells of one member that a spell_id can number.
SPELLS_PER_MEMBER = 1000


def same_spell(left: str, right: str) -> Column:
    """Equality of spell ids, written so that Spark does not take it for a join key, which would shuffle both sides anew."""
    return (F.col(left) >= F.col(right)) & (F.col(left) <= F.col(right))


def drug_intervals(fills: DataFrame, grace: int = 21, placed: bool = False) -> DataFrame:
    """member_id, atc_3_code, start, end, is_op: fills of one drug joined over gaps of up to ``grace`` days.

    is_op: any fill of the member's drug is from the query list.  ``placed``: the fills come in buckets of member_id, so nothing is moved."""
    end = F.date_add("filldate", F.col("supplydayscount").cast("int") - 1)
    whole = fills.where(F.col("member_id").isNotNull() & F.col("atc_3_code").isNotNull()).select("member_id", "atc_3_code", F.col("filldate").alias("start"), end.alias("end"), F.col("is_query_drug").cast("int").alias("is_op"))
    return coalesce_intervals(whole if placed else whole.repartition("member_id"), ["member_id", "atc_3_code"], "start", "end", grace, key_marks=["is_op"])


def detect_spells(intervals: DataFrame, k: int = 3, grace: int = 21, min_len: int = 30) -> DataFrame:
    """Spells with at least ``k`` concurrent drugs, one of them from the query list.

    A spell starts on the first day with k drugs and one listed, and goes on until that is false for ``grace`` days: raw_exit is
    the day before those days.  A spell still open at the member's last change exits there.  extended_exit adds the grace days.
    Spells shorter than ``min_len`` days (before grace) are dropped before numbering; a member's spell_id is
    member_id * 1000 + number.

    Two levels of gaps and islands: runs of days above and below, then spells of runs whose gaps are below ``grace``."""
    points = concurrency_sweep(intervals, "member_id", "start", "end", "is_op")
    member = Window.partitionBy("member_id")
    order = member.orderBy("day")
    points = points.withColumn("up", (F.col("n") >= k) & (F.col("n_flagged") > 0)).withColumn("last_day", F.max("day").over(member))
    turned = points.withColumn("before", F.lag("up").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("up")))
    length = F.coalesce(F.date_diff(F.lead("day").over(order), F.col("day")), F.date_diff(F.col("last_day"), F.col("day")) + 1)
    runs = turned.select("member_id", "day", "up", "last_day", length.alias("length"))
    ups_before = F.coalesce(F.sum(F.col("up").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.col("up") & ((ups_before == 0) | (F.lag("length").over(order) >= grace))
    grouped = runs.withColumn("new", new.cast("int")).withColumn("spell", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("spell > 0")
    last = F.max_by(F.struct("up", "day", "length"), "day").alias("last")
    spells = grouped.groupBy("member_id", "spell").agg(F.min("day").alias("entry_date"), last, F.max("last_day").alias("last_day"))
    raw = F.when(~F.col("last.up") & (F.col("last.length") >= grace), F.date_sub("last.day", 1)).otherwise(F.col("last_day"))
    dated = spells.select("member_id", "entry_date", raw.alias("raw_exit_date")).withColumn("extended_exit_date", F.date_add("raw_exit_date", grace))
    days = F.date_diff(F.col("extended_exit_date"), F.col("entry_date")) + 1
    kept = dated.withColumn("spell_length_days", days).where(F.col("spell_length_days") >= min_len + grace)
    number = F.row_number().over(member.orderBy("entry_date"))
    numbered = F.when(number < SPELLS_PER_MEMBER, F.col("member_id") * SPELLS_PER_MEMBER + number).otherwise(F.raise_error(F.lit("a member has too many spells to number")).cast("long"))
    return kept.withColumn("spell_id", numbered).select("member_id", "spell_id", "entry_date", "raw_exit_date", "extended_exit_date", "spell_length_days")


def drug_changes(spells: DataFrame, intervals: DataFrame, lookback: int = 180) -> DataFrame:
    """add at an interval's start and drop on the day after its end, where that day is in [entry - lookback, extended exit] of a spell."""
    window = F.date_sub("entry_date", lookback)
    met = spells.select("member_id", "spell_id", "entry_date", "extended_exit_date").join(intervals, "member_id").where((F.col("end") >= window) & (F.col("start") <= F.col("extended_exit_date")))
    events = F.array(F.struct(F.col("start").alias("date"), F.lit("add").alias("change_type")), F.struct(F.date_add("end", 1).alias("date"), F.lit("drop").alias("change_type")))
    inside = F.filter(events, lambda e: (e["date"] >= window) & (e["date"] <= F.col("extended_exit_date")))
    return met.select("member_id", "spell_id", F.inline(inside), "atc_3_code", "is_op")


def censor_enrollment(spells: DataFrame, enrollment: DataFrame) -> DataFrame:
    """followup_end_date: the latest enrolled day of the spell; spells that no enrollment row overlaps go, as do rows that end before they start."""
    sane = enrollment.where("terminationdate >= effectivedate")
    met = spells.join(sane, "member_id").where((F.col("effectivedate") <= F.col("extended_exit_date")) & (F.col("terminationdate") >= F.col("entry_date")))
    return met.groupBy(*spells.columns).agg(F.max(F.least("terminationdate", "extended_exit_date")).alias("followup_end_date"))


def require_washout(spells: DataFrame, enrollment: DataFrame, days: int = 180, bridge: bool = False) -> DataFrame:
    """Spells whose ``days`` before entry one enrollment row covers; ``bridge`` joins adjacent rows first."""
    rows = enrollment.select("member_id", "effectivedate", "terminationdate")
    if bridge:
        rows = coalesce_intervals(rows, ["member_id"], "effectivedate", "terminationdate", 0)
    rows = rows.withColumnRenamed("member_id", "_member")
    cond = (F.col("member_id") == F.col("_member")) & (F.col("effectivedate") <= F.date_sub("entry_date", days)) & (F.col("terminationdate") >= F.col("entry_date"))
    return spells.join(rows, cond, "left_semi")


def label_first_event(spells: DataFrame, events: DataFrame, shift_days: int = -1) -> DataFrame:
    """had_ae, first_ae_date, first_ae_code and ae_codes from events in [entry, followup end], dates moved by ``shift_days`` first.

    The first code is that of the earliest day (the smallest code on ties).  A spell whose first code the member already had before
    entry is dropped; from ae_codes such codes are left out."""
    moved = events.select("member_id", F.date_add("event_date", shift_days).alias("ae_date"), F.col("code_value").alias("ae_code"))
    dated = moved.groupBy("member_id", "ae_date", "ae_code").agg(F.count(F.lit(1)).alias("_n"))
    since = dated.withColumn("first_seen", F.min("ae_date").over(Window.partitionBy("member_id", "ae_code")))
    since = since.withColumnRenamed("member_id", "_member").drop("_n")
    inside = (F.col("member_id") == F.col("_member")) & (F.col("ae_date") >= F.col("entry_date")) & (F.col("ae_date") <= F.col("followup_end_date"))
    known = F.col("first_seen") < F.col("entry_date")
    first = F.min(F.when(F.col("ae_date").isNotNull(), F.struct("ae_date", "ae_code", known.alias("known"))))
    found = spells.join(since, inside, "left").groupBy(*spells.columns).agg(first.alias("f"), F.array_sort(F.collect_set(F.when(~known, F.col("ae_code")))).alias("ae_codes"))
    kept = found.where(~F.coalesce(F.col("f.known"), F.lit(False)))
    return kept.select(*spells.columns, F.col("f").isNotNull().alias("had_ae"), F.col("f.ae_date").alias("first_ae_date"), "ae_codes", F.col("f.ae_code").alias("first_ae_code"))


def split_at_adds(spells: DataFrame, changes: DataFrame) -> DataFrame:
    """One segment from each day with an add to the day before the next, up to the first event, else the end of follow-up.

    A spell without adds in its window stays one row (no_adds).  The event stays on the segment that ends with it; first_ae_code,
    ae_codes and followup_end_date stay on every segment."""
    cutoff = F.coalesce("first_ae_date", "followup_end_date", "extended_exit_date")
    ended = spells.withColumn("_end", F.least("extended_exit_date", cutoff))
    adds = changes.where(F.lower("change_type") == "add").select(F.col("member_id").alias("_member"), F.col("spell_id").alias("_spell"), F.to_date("date").alias("_add"))
    order = Window.partitionBy("member_id", "spell_id").orderBy("_add")
    inside = (F.col("member_id") == F.col("_member")) & same_spell("spell_id", "_spell") & (F.col("_add") >= F.col("entry_date")) & (F.col("_add") <= F.col("_end"))
    met = ended.join(adds, inside, "left").withColumn("_again", F.lag("_add").over(order) == F.col("_add"))
    met = met.where(~F.coalesce("_again", F.lit(False))).drop("_again").withColumns({"_next": F.lead("_add").over(order), "_seq": F.row_number().over(order)})  # one add a day
    stop = F.greatest(F.least(F.coalesce(F.date_sub("_next", 1), F.col("_end")), F.col("_end")), F.col("_add"))
    split = F.col("_add").isNotNull()
    at_event = F.coalesce(F.col("_stop") == F.col("first_ae_date"), F.lit(False))
    reason = F.when(~split, "no_adds").when(F.col("_next").isNotNull(), "next_add").when(F.coalesce(F.col("_end") == F.col("first_ae_date"), F.lit(False)), "ae").otherwise("followup_end")
    new = {
        "entry_date": F.col("_add"), "raw_exit_date": F.col("_stop"), "extended_exit_date": F.col("_stop"), "spell_length_days": F.date_diff(F.col("_stop"), F.col("_add")) + 1, "had_ae": at_event, "first_ae_date": F.when(at_event, F.col("first_ae_date")),
    }
    return met.withColumn("_stop", F.when(split, stop)).select(
        *(F.when(split, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in spells.columns), F.col("_seq").alias("split_seq"), reason.alias("segment_end_reason")
    )


def label_combo(segments: DataFrame, changes: DataFrame, exact: bool = False, intervals: DataFrame | None = None) -> DataFrame:
    """drug_combo: sorted drugs active on each segment's first day.

    By default a drug is active when its latest recorded change by then is an add, so one held since before the look-back is missed;
    ``exact`` compares the drugs' intervals with the day instead."""
    if exact:
        turns = F.array(F.struct(F.col("start").alias("date"), F.lit(1).alias("on")), F.struct(F.date_add("end", 1).alias("date"), F.lit(0).alias("on")))
        held = intervals.select("member_id", "atc_3_code", F.inline(turns))
        return active_at(segments, held, ["member_id"], "entry_date", "date", "atc_3_code", "on", "drug_combo")
    kind = F.lower("change_type")
    status = changes.where(kind.isin("add", "drop")).select("member_id", "spell_id", F.to_date("date").alias("date"), "atc_3_code", (kind == "add").alias("on"))
    return active_at(segments, status, ["member_id", "spell_id"], "entry_date", "date", "atc_3_code", "on", "drug_combo")


def diagnosis_windows(segments: DataFrame, diagnoses: DataFrame, lookback: int = 180) -> DataFrame:
    """Distinct codes of each segment's member in [entry - lookback, entry - 1]."""
    met = segments.select("member_id", "spell_id", "split_seq", "entry_date").join(diagnoses, "member_id")
    seen = met.where((F.col("service_date") >= F.date_sub("entry_date", lookback)) & (F.col("service_date") < F.col("entry_date")))
    return seen.select("member_id", "spell_id", "split_seq", "code_value").distinct()


def spell_gaps(spells: DataFrame) -> DataFrame:
    """Days from a spell's raw exit to the member's next entry."""
    order = Window.partitionBy("member_id").orderBy("entry_date", "spell_id")
    gap = F.date_diff(F.col("entry_date"), F.lag("raw_exit_date").over(order))
    return spells.withColumn("gap_days", gap).where(F.col("gap_days").isNotNull()).select("member_id", "spell_id", "gap_days")
