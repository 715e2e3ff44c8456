"""Line dedup over line hashes, in DataFrame functions only.

A text is cut into lines at line feeds and, so that a passage inside a paragraph is found too, after sentence ends followed
by a space.  Lines are compared after lower-casing and trimming spaces; tabs and carriage returns count as spaces, and a line has one
word more than spaces.  Order is by doc_id, then by place in the text.

Two neighbouring lines *repeat* when the same two stand next to each other at an earlier place, in an earlier document or before it in the same
text; a line of ``min_words`` words or more repeats when an equal one stands earlier.  A run is a longest sequence of lines that repeating pairs link, or that
such a line makes alone; runs of ``min_words`` words or more are deleted.  So lines that stood earlier only apart from each other stay, and all that a plain
search for sequences of ``min_words`` words that start earlier finds is deleted.  (A sequence whose pairs stand earlier, but at different places, goes as well.)

Blank lines have no words: they are passed over, so lines that only blank lines part are neighbours, and blank lines inside a
deleted run go with it.

1. Every line with a word is hashed, and so is every pair of neighbours.  None is left to a choice by winnowing: a pair that its neighbours crowd out at one place may
   be kept at another, so a choice can miss the equal pair that stands earlier.
2. Pairs (and long lines) are folded to hash, number and first place; those that occur once go.  The rest are joined to
   their places, the very frequent ones through a bounded broadcast.
3. A pair repeats if its place comes after the first.  So it is compared with all earlier places at once.
4. Repeating pairs that share a line make runs; the runs' words decide.
5. Texts with runs meet them by a shuffle.  A bitmap of fixed size over the hashes of those texts lets nearly all others pass without one.

Rows that share a doc_id have the same place in the order, so equal sequences at the same position of such rows are
both first.  Their texts are told apart by hash.  A doc_id can be of any type that sorts.  Null doc_ids come last; null texts stay null and have no lines, empty
texts stay empty.  A text of any length is one row; its lines are rows of their own.  An empty table gives an empty
table.  Extra columns come through under any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import has_bit, hot_join, packed, read_table, scratch, stored

#: Words from which a run is deleted.  A passage of 50 words may lose its first and last sentence to
#: the sentences around it, so the bound on whole repeated lines is half of that.
MIN_WORDS = 25
_LAST = (1 << 63) - 1
#: Bits of the bitmap of texts with runs (2 MB); a bit that several texts share only sends more of them through the shuffle.
BITS = 1 << 24
#: The character that ends a line, and the place after it.  Both test one character before they look behind.
_END, _CUT = r"[\n ](?<=\n|[.!?] )", r"(?<=[\n ])(?<=\n|[.!?] )"


def lines_of(text: Column) -> Column:
    """The lines of a text; each keeps the line feed or space that ends it."""
    return F.split(text, _CUT)


def n_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_END)) + 1


def _spaced(text: Column) -> Column:
    other = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r"))
    return F.when(other, F.translate(text, "\t\r", "  ")).otherwise(text)


def _words(trimmed: Column) -> Column:
    """Pieces between spaces of a line that is not empty."""
    return F.octet_length(trimmed) - F.octet_length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1


def _in_order(df: DataFrame, keep: Callable[[DataFrame], DataFrame], doc_id: str) -> DataFrame:
    """df with ``place``: a whole number in the order of the column, null ones last.  Whole numbers stand for themselves."""
    kind = df.select(doc_id).schema[0].dataType
    if isinstance(kind, T.IntegralType):
        return df.withColumn("place", F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)))
    ids = df.select(F.col(doc_id).alias("_id")).where("_id is not null").distinct()
    ranks = keep(ids.repartitionByRange("_id").sortWithinPartitions("_id").select("_id", F.monotonically_increasing_id().alias("_place")))
    return df.join(ranks, F.col(doc_id) == F.col("_id"), "left").withColumn("place", F.coalesce("_place", F.lit(_LAST))).drop("_id", "_place")


def line_places(df: DataFrame, min_words: int) -> DataFrame:
    """Every line with a word: place and body (hash) of its document, number among the text's lines with words (pos) and among all (line), words (w), the
    same of the next one (next_line, next_w), and the hashes of both (pair) and of the line alone if it has ``min_words`` words (alone)."""
    text = F.col("text")
    lines = F.filter(F.transform(F.split(_spaced(F.lower(text)), _END), lambda s, i: F.struct(i.alias("line"), F.trim(s).alias("s"))), lambda x: x["s"] != "")
    made = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["s"]).alias("print"), _words(x["s"]).alias("w")))

    def with_next(x: Column, i: Column) -> Column:
        then = F.get("l", i + 1)
        return F.struct(x["line"].alias("line"), x["w"].alias("w"), then["line"].alias("next_line"), then["w"].alias("next_w"), F.when(then.isNotNull(), F.xxhash64(x["print"], then["print"])).alias("pair"), F.when(x["w"] >= min_words, x["print"]).alias("alone"))

    rows = df.where(text.isNotNull()).select("place", F.xxhash64(text).alias("body"), made.alias("l")).select("place", "body", F.transform("l", with_next).alias("l"))
    # The outer form: Spark puts a filter on the size of the lines before the other one, which would cut every text twice.
    return rows.select("place", "body", F.posexplode_outer("l").alias("pos", "k")).where("pos is not null").select("place", "body", "pos", "k.*")


def _order() -> Column:
    """One number that sorts by document, then by place in it: a fixed-width buffer for aggregates."""
    return F.col("place").cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("pos")


def repeated_runs(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The runs to delete, as a stored table: place and body of the document, and runs: array of (first, last, words).  df: place and text."""
    with scratch(df.sparkSession) as kept:
        lines = kept(line_places(df, min_words))
        pairs = lines.where("pair is not null").withColumnRenamed("pair", "key").drop("alone")
        alone = lines.where("alone is not null").select("place", "body", "pos", "line", "w", F.lit(None).cast("int").alias("next_line"), F.lit(None).cast("int").alias("next_w"), F.xxhash64("alone").alias("key"))
        places = pairs.unionByName(alone)
        first = kept(places.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(_order()).alias("first")).where("rows > 1"))
        later = hot_join(places, first, "key").where(_order() > F.col("first"))
        # One row a line: of rows that share doc_id and text, and of a long line and its pair.
        marked = later.groupBy("place", "body", "pos", "line", "w").agg(F.max("next_line").alias("next_line"), F.max("next_w").alias("next_w"))
        order = Window.partitionBy("place", "body").orderBy("pos")
        last_pair, last_pos = F.lag("next_line").over(order), F.lag("pos").over(order)
        new = F.when(last_pair.isNotNull() & (last_pos == F.col("pos") - 1), 0).otherwise(1)
        numbered = marked.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        words = F.sum("w") + F.max_by(F.coalesce("next_w", F.lit(0)), "pos")
        runs = numbered.groupBy("place", "body", "run").agg(F.min("line").alias("first"), F.max(F.coalesce("next_line", "line")).alias("last"), words.alias("words")).where(F.col("words") >= min_words)
        return stored(runs.groupBy("place", "body").agg(F.array_sort(F.collect_list(F.struct("first", "last", "words"))).alias("runs")))


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """The documents without later repeated runs; all columns stay, and n_chars, if there, follows the text.

    ``report``: n_lines, n_deleted and words_deleted are added; input columns of these names give way to them.
    """
    row, found = F.col("row"), F.col("runs")
    text = row["text"]
    with scratch(df.sparkSession) as kept:
        keyed = _in_order(packed(df).withColumn("doc", row["doc_id"]), kept, "doc").select("row", "place", F.xxhash64(text).alias("body"))
        if not isinstance(df.schema["doc_id"].dataType, T.IntegralType):
            keyed = stored(keyed)
    runs = repeated_runs(keyed.select("place", text.alias("text")), min_words)
    bit = F.pmod("body", F.lit(BITS))
    bitmap = runs.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    keyed = keyed.withColumn("bit", bit)
    keyed = keyed.withColumn("bucket", F.bitmap_bucket_number("bit")).join(F.broadcast(bitmap), "bucket", "left")  # BITS / 32768 rows
    may = has_bit(F.col("bits"), F.col("bit"))
    through = keyed.where(may).select("row", "place", "body").join(runs, ["place", "body"], "left").select("row", "runs")
    met = keyed.where(~may).select("row", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs")).unionByName(through)
    left = F.array_join(F.filter(lines_of(text), lambda s, i: ~F.exists(found, lambda r: i.between(r["first"], r["last"]))), "")
    met = met.withColumn("left", F.when(found.isNotNull(), left))
    new = {"text": F.coalesce("left", text)}
    if "n_chars" in df.columns:
        new["n_chars"] = F.when(found.isNull(), row["n_chars"]).otherwise(F.char_length("left").cast(df.schema["n_chars"].dataType))
    made = []
    if report:
        total = lambda f: F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + f(r)), F.lit(0).cast("long"))
        made = [F.when(text.isNull(), 0).otherwise(n_lines(text)).cast("long").alias("n_lines"), total(lambda r: r["last"] - r["first"] + 1).alias("n_deleted"), total(lambda r: r["words"]).alias("words_deleted")]
    own = ("n_lines", "n_deleted", "words_deleted") if report else ()
    return met.select(*(new.get(c, row.getField(c)).alias(c) for c in df.columns if c not in own), *made)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted, words_deleted and the SHA-256 of the text that stays."""
    done = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return done.select("doc_id", "n_lines", "n_deleted", "words_deleted", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
