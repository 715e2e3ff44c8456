"""How quality filters interact: what each removes, repeats or alone catches, in every order they can be applied in.

Five filters judge a document by its whole text (words: maximal runs of bytes outside 0x20 and 0x09-0x0D, case-sensitive).  It fails

- A with under 50 words,
- B if fewer than 65 in 100 of its words are distinct,
- C if more than 5 in 100 of its code points are A-Z,
- D if it holds any of ``#$%&*|``,
- E if its text is identical to that of any smaller doc_id, in the whole table.

1. Every document folds to a mask of the filters it fails; documents of one part and mask fold to a *cell* of three counts (all, labelled
   good, labelled toxic), 32 cells a part.  E needs no window over equal texts: all rows count as failing it, and the rows of each text's
   smallest doc_id, found by a fold and a join on (text digest, doc_id), are moved to the cell without it.
2. A recursive common table expression enumerates the orders: each level extends the prefixes with every unused letter, joins the part's
   cells and carries the applied filters' bits; each level's row holds that step's counts.
3. Full orders are cut into their steps; a filter's removals over all orders are summed for its Shapley value.

The result's size is 600 rows a part; the fold before it is the only work that grows with the documents.

Null texts count as empty, null sources as the part ``''``.  A null doc_id comes after all others, so its document fails E where any document
with an id has the same text.  Rows that repeat a doc_id and a text are documents of the same rank: none makes the other fail E.  A document counts
as good (toxic) if any of its label rows says so.  A text of any length is one row.  Extra columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import read_table, scratch, stored

#: Fixed values of the five filters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
LETTERS = "ABCDE"
_SPACE = " \t\n\x0b\f\r"
_BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}
#: Rows that the recursion makes for a part: its prefixes of 0 to 5 letters.
PREFIXES = 326


def words_of(text: Column) -> Column:
    """The words of a text that is not null."""
    inside = F.btrim(text, F.lit(_SPACE))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, "[ \\t-\\r]+"))


def failures(text: Column, words: Column) -> Column:
    """The bits of filters A to D that a text (not null) with these words fails."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = {
        "A": n < MIN_WORDS,
        "B": F.lit(100) * distinct < F.lit(MIN_DISTINCT) * n,
        "C": F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > F.lit(MAX_CAPITALS) * F.char_length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }
    return sum((F.when(cond, _BIT[letter]).otherwise(0) for letter, cond in fails.items()), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and cells: 32 counts (n, good, toxic), by the mask of failed filters."""
    text = F.coalesce("text", F.lit(""))
    with scratch(docs.sparkSession) as keep:
        cut = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words_of(text).alias("words"))  # cut once, read three times
        judged = cut.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), failures(F.col("text"), F.col("words")).alias("mask"))
        marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        judged = judged.join(marks, F.col("doc_id") == F.col("label_id"), "left").withColumn("good", F.coalesce("good", F.lit(0))).withColumn("toxic", F.coalesce("toxic", F.lit(0)))
        rows = keep(judged.groupBy("digest", "doc_id", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n")))
        first = rows.groupBy(F.col("digest").alias("of"), F.lit(True).alias("one")).agg(F.min("doc_id").alias("first"))
        own = rows.join(first, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first")))
        e = F.lit(_BIT["E"])
        moved = own.select("part", F.explode(F.array(F.struct("mask", F.col("n").alias("n")), F.struct((F.col("mask") + e).alias("mask"), (-F.col("n")).alias("n")))).alias("c"), "good", "toxic")
        counted = rows.select("part", (F.col("mask") + e).alias("mask"), "n", "good", "toxic").unionByName(moved.select("part", "c.mask", "c.n", "good", "toxic"))
        cells = counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
        zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")))
        by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # at most 32
        every = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda m: F.coalesce(F.element_at("found", m), zero))
        return stored(cells.groupBy("part").agg(by_mask.alias("found")).select("part", every.alias("cells")))


def _total(count: str, condition: str) -> str:
    """SQL: the sum of a count over the cells whose mask meets the condition; ``a`` stands for applied bits, ``b`` for the step's own."""
    condition = condition.replace("a", "s.applied").replace("b", "f.bit")
    return f"aggregate(sequence(0, 31), 0L, (t, m) -> t + IF({condition}, c.cells[m].{count}, 0L))"


_STEP = f"""named_struct(
  'kept', {_total("n", "m & (a | b) = 0")},
  'removed', {_total("n", "m & a = 0 AND m & b != 0")},
  'redundant', {_total("n", "m & a != 0 AND m & b != 0")},
  'unique_fails', {_total("n", "m = b")},
  'good_lost', {_total("good", "m & a = 0 AND m & b != 0")},
  'toxic_lost', {_total("toxic", "m & a = 0 AND m & b != 0")})"""
_KIND = "array<struct<kept: bigint, removed: bigint, redundant: bigint, unique_fails: bigint, good_lost: bigint, toxic_lost: bigint>>"


def audit_orders(cells: DataFrame) -> DataFrame:
    """One row per part, order and step: the counts of that step, and its filter's removals over all orders (shapley)."""
    spark = cells.sparkSession
    limit = int(spark.conf.get("spark.sql.cteRecursionRowLimit", "1000000"))
    if 0 <= limit < (need := PREFIXES * cells.count() + 1):  # the recursion ends below its limit only
        spark.conf.set("spark.sql.cteRecursionRowLimit", str(need))
    view = f"mask_cells_{uuid.uuid4().hex}"
    cells.createOrReplaceTempView(view)
    filters = ", ".join(f"('{letter}', {bit})" for letter, bit in _BIT.items())
    orders = spark.sql(f"""
        WITH RECURSIVE prefixes AS (
          SELECT part, 0 AS applied, '' AS filter_order, CAST(array() AS {_KIND}) AS steps FROM {view}
          UNION ALL
          SELECT s.part, s.applied | f.bit, concat(s.filter_order, f.letter), concat(s.steps, array({_STEP}))
          FROM prefixes s JOIN {view} c ON s.part = c.part JOIN (VALUES {filters}) f(letter, bit) ON s.applied & f.bit = 0)
        SELECT part, filter_order, posexplode(steps) AS (at, k) FROM prefixes WHERE length(filter_order) = {len(LETTERS)}""")
    rows = orders.select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "k.*")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    met = rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))  # 120 rows each
    return met.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_orders(mask_cells(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


SQL = r"""
WITH RECURSIVE marks AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN marks USING (doc_id)),
m AS (
  SELECT part, good, toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, b)),
prefixes AS (
  SELECT CAST('' AS VARCHAR) AS p, 0 AS a, CAST('' AS VARCHAR) AS letter, 0 AS b, 0 AS before
  UNION ALL SELECT p || f.letter, prefixes.a | f.b, f.letter, f.b, prefixes.a FROM prefixes, f WHERE prefixes.a & f.b = 0),
s AS (
  SELECT part, p, letter,
    sum(CASE WHEN mask & a = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & b != 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before != 0 AND mask & b != 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & b != 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & b != 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM prefixes, cells WHERE p != '' GROUP BY part, p, letter),
r AS (SELECT o.p AS filter_order, s.* FROM (SELECT p FROM prefixes WHERE length(p) = 5) o JOIN s ON s.p = left(o.p, length(s.p)))
SELECT part, filter_order, CAST(length(p) AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
