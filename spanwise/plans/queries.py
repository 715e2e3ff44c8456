"""Named queries over the driver tables: name -> f(spark, sf_dir).

All chain the same lazy steps: fills, drug intervals, spells, changes, censoring, labels, segments, combinations, cohort."""

from __future__ import annotations

import uuid
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import AGE_BUCKETS, RACE_LABELS, YOUNGEST, age_bucket, race_label, starts_with_any
from ..operators import boosting, codes, cohort, combos, features, intervals, metrics, models, perceptrons, spells, summary
from ..sources.claims import DIAGNOSIS_TYPES, EVENT_CODES, Claims
from ..sources.storage import bucketed, buckets_for, missing_batches, write_batches
from ..sources.tables import products_of, read_code_vectors, read_products, shared_folder, stored, validate_dataset

K, GRACE, MIN_LEN, LOOKBACK, WINDOW, MIN_N = 3, 15, 7, 180, 30, 20
#: Least support of trios and whole sets: they are rarer than pairs.
MIN_LARGER = 3
#: Drugs and diagnoses of a sequence, and numbers of a code's vector.
MAX_DRUGS, MAX_CODES, DIM = 15, 50, 64
#: Fills in a bucket of members, which one task reads.
ROWS_A_BUCKET = 500_000
#: Hidden layers and iterations over pooled vectors; those over flattened vectors are cut (production: layers of 512 and 256, 100 iterations).
POOLED, FLAT = ((256, 128), 100), ((32,), 30)


class Chain:
    """The steps over one data folder, each built once.

    Steps that several later ones read are persisted (memory, then disk): Spark computes them once, again only where an
    executor is lost, and other queries of the session over the same folder find them by their plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.claims = spark, Claims(spark, sf_dir)

    @cached_property
    def fills(self) -> DataFrame:
        return codes.flag_listed(codes.enrich_classes(self.claims.rx_fills(), self.claims.ndc_to_atc(), check=False), self.claims.query_drugs())

    @cached_property
    def intervals(self) -> DataFrame:
        return spells.drug_intervals(self.fills, GRACE).persist()

    @cached_property
    def spells(self) -> DataFrame:
        return spells.detect_spells(self.intervals, K, GRACE, MIN_LEN).persist()

    @cached_property
    def changes(self) -> DataFrame:
        return spells.drug_changes(self.spells, self.intervals, LOOKBACK)

    @cached_property
    def censored(self) -> DataFrame:
        return spells.censor_enrollment(self.spells, self.claims.enrollment())

    @cached_property
    def labelled(self) -> DataFrame:
        return spells.label_first_event(spells.require_washout(self.censored, self.claims.enrollment()), self.claims.adverse_events())

    @cached_property
    def segments(self) -> DataFrame:
        return spells.split_at_adds(self.labelled, self.changes).persist()

    @cached_property
    def combos(self) -> DataFrame:
        return spells.label_combo(self.segments, self.changes)

    @cached_property
    def icd(self) -> DataFrame:
        return codes.cluster_codes(spells.diagnosis_windows(self.segments, self.claims.diagnoses(), LOOKBACK), ("member_id", "spell_id", "split_seq"))

    @cached_property
    def steps(self) -> dict[str, DataFrame]:
        return cohort.cohort_steps(self.combos, self.claims.demographics(), self.icd, WINDOW)

    @cached_property
    def cohort(self) -> DataFrame:
        return self.steps["gender"].persist()

    @cached_property
    def names(self) -> DataFrame:
        return self.claims.ndc_to_atc().select(F.col("atc_3_code").alias("code"), F.col("atc_3_name").alias("name")).distinct()


def joined(column: str, name: str | None = None):
    return F.array_join(column, "+").alias(name or column)


def flat_segments(df: DataFrame) -> DataFrame:
    out = df.withColumn("ae_codes", F.array_join("ae_codes", "+"))
    return out.withColumn("drug_combo", F.array_join("drug_combo", "+")) if "drug_combo" in df.columns else out


def mined(c: Chain, size: int | None, **options) -> DataFrame:
    found = combos.mine_combinations(c.cohort, size, MIN_N if size == 2 else MIN_LARGER, names=None if size is None else c.names, **options)
    rounds = {"rate": 6, "chi2": 4}
    logs = F.round(-F.log10(F.greatest("p_value", F.lit(1e-300))), 4)
    kept = [F.round(n, rounds[n]).alias(n) if n in rounds else F.col(n) for n in found.columns if n not in ("p_value", "p_adj")]
    return found.select(*kept, logs.alias("log_p"), F.round("p_adj", 5).alias("p_adj"))


def top_mined(c: Chain, size: int, by: str) -> DataFrame:
    """The ten combinations with the largest rate, or among signals the ten with the most events."""
    found = combos.mine_combinations(c.cohort, size, MIN_N if size == 2 else MIN_LARGER)
    return combos.top_mined(found, by, 10, signals=by == "n_ae").select(*(f"item{i + 1}" for i in range(size)), "n_total", "n_ae", F.round("rate", 6).alias("rate"))


def eligible_members(c: Chain) -> DataFrame:
    return codes.eligible_members(c.claims.rx_fills(), c.claims.query_drugs())


def semi_join_members(c: Chain) -> DataFrame:
    kept = codes.restrict_to_members(c.claims.claim(), eligible_members(c))
    return kept.groupBy("member_id").agg(F.count(F.lit(1)).alias("n_claims"), F.min("service_date").alias("first_date"))


def clean_map(c: Chain) -> DataFrame:
    raw = c.claims.ndc_to_atc().unionByName(c.claims.ndc_to_atc().select(F.concat(F.lit(" "), "ndc").alias("ndc"), "rxcui", F.lit("zz").alias("rxnorm_description"), "atc_3_code", "atc_3_name"))
    return codes.clean_map(raw)


def enrich_atc(c: Chain) -> DataFrame:
    return codes.enrich_classes(c.claims.rx_fills(), c.claims.ndc_to_atc(gaps=True))


def ae_prefix_filter(c: Chain) -> DataFrame:
    return c.claims.claim_code().where(starts_with_any(F.col("code_value"), (p for _, p, _ in EVENT_CODES))).groupBy("code_value").agg(F.count(F.lit(1)).alias("n"))


def code_type_filter(c: Chain) -> DataFrame:
    return c.claims.claim_code().where(F.col("code_type").isin(*DIAGNOSIS_TYPES)).groupBy("code_type").agg(F.count(F.lit(1)).alias("n"))


def concurrency_sweep(c: Chain) -> DataFrame:
    return intervals.concurrency_sweep(c.intervals, "member_id", "start", "end", "is_op")


def washout(c: Chain) -> DataFrame:
    return spells.require_washout(c.censored, c.claims.enrollment())


def washout_bridged(c: Chain) -> DataFrame:
    return spells.require_washout(c.censored, c.claims.enrollment(), bridge=True)


def diagnosis_windows(c: Chain) -> DataFrame:
    return spells.diagnosis_windows(c.segments, c.claims.diagnoses(), LOOKBACK)


def finalize(c: Chain) -> DataFrame:
    return c.cohort.select("member_id", "spell_id", "split_seq", "entry_date", "spell_length_days", "had_ae", "first_ae_date", joined("drug_combo"), joined("icd10_codes"), "y", "age", "gendercode", "raceethnicitytypecode", "statecode")


def latest_change(c: Chain) -> DataFrame:
    """The last change that each segment's spell recorded on or before the segment's first day."""
    probes = c.segments.select("member_id", "spell_id", "split_seq", "entry_date")
    return intervals.latest_on_or_before(probes, c.changes, ["member_id", "spell_id"], "entry_date", "date", ["date", "change_type", "atc_3_code"]).drop("member_id", "entry_date")


def filled_status(c: Chain) -> DataFrame:
    """Whether each drug of a spell is on at the first day of each segment, by its last change; drugs without a change by then are left out."""
    probes = c.segments.select("member_id", "spell_id", "split_seq", "entry_date")
    status = c.changes.select("member_id", "spell_id", "atc_3_code", "date", (F.col("change_type") == "add").cast("int").alias("is_on"))
    return intervals.status_at(probes, status, ["member_id", "spell_id"], "entry_date", "date", "atc_3_code", "is_on").select("spell_id", "split_seq", "atc_3_code", "is_on")


def spell_gaps(c: Chain) -> DataFrame:
    return spells.spell_gaps(c.spells)


def top_ae_codes(c: Chain) -> DataFrame:
    return summary.frequency_table(c.labelled, "first_ae_code", 10)


def ae_by_description(c: Chain) -> DataFrame:
    events = c.claims.diagnoses()
    counted = events.groupBy("code_value").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(codes.describe_codes(counted, c.claims.event_codes()), "code_value").groupBy("description").agg(F.sum("n").alias("n"))


def top_combos(c: Chain, size: int) -> DataFrame:
    return combos.top_combos(c.combos, size, 10, c.names).select(joined("drug_combo"), "n", "names")


def category_shares(c: Chain) -> DataFrame:
    people = c.claims.demographics()
    with_event = people.join(c.segments.where("had_ae").select("member_id"), "member_id", "left_semi")
    without = people.join(cohort.members_without_event(c.segments), "member_id", "left_semi")
    return summary.aligned_distributions(with_event, without, "statecode", ("ae_pct", "non_ae_pct"))


def days_into_spell(c: Chain) -> DataFrame:
    return c.labelled.where("had_ae").select("spell_id", F.date_diff("first_ae_date", "entry_date").alias("days"))


def hist_ae_timing(c: Chain) -> DataFrame:
    grouped = summary.top_or_other(c.labelled.where("had_ae").withColumn("days", F.date_diff("first_ae_date", "entry_date")), "first_ae_code", 2, "grp")
    return summary.histogram(grouped, "days", 0, 60, 60, "grp")


def top_other_bucket(c: Chain) -> DataFrame:
    pool = c.labelled.select("first_ae_code").unionByName(c.segments.where("had_ae").select("first_ae_code"))
    return summary.top_or_other(c.labelled.where("had_ae"), "first_ae_code", 2, "grp", pool).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def sketched_lengths(c: Chain) -> DataFrame:
    """Members and length quartiles by end reason from sketches kept by month, and whether they lie within five standard errors of the exact ones."""
    by = "segment_end_reason"
    rows = c.segments.withColumn("month", F.trunc("entry_date", "month"))
    parts = stored(summary.sketch_parts(rows, ["month", by], "member_id", "spell_length_days"))
    found = summary.from_sketches(parts, [by])
    exact = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("member_id").alias("n_members"))
    ranked = rows.join(F.broadcast(found), by).groupBy(by).agg(*(F.avg((F.col("spell_length_days") < F.col(f"p{p}")).cast("int")).alias(f"below_{p}") for p in (25, 50, 75)), *(F.avg((F.col("spell_length_days") <= F.col(f"p{p}")).cast("int")).alias(f"upto_{p}") for p in (25, 50, 75)))
    close = [F.col(f"below_{p}") <= p / 100 + 0.02 for p in (25, 50, 75)] + [F.col(f"upto_{p}") >= p / 100 - 0.02 for p in (25, 50, 75)]
    met = exact.join(found.drop("n"), by).join(ranked, by)
    within = F.abs(F.col("n_entities") - F.col("n_members")) <= F.greatest(F.lit(2.0), 5 * 1.04 / 2 ** (summary.LG_K / 2) * F.col("n_members"))
    return met.select(by, "n_rows", "n_members", within.alias("close_members"), reduce(and_, close).alias("close_quartiles"))


def table1(c: Chain) -> DataFrame:
    return summary.baseline_table(c.cohort, "y", race_label(F.col("raceethnicitytypecode")))


def age_buckets(c: Chain) -> DataFrame:
    return c.cohort.groupBy(age_bucket(F.col("age")).alias("bucket"), race_label(F.col("raceethnicitytypecode")).alias("race")).agg(F.count(F.lit(1)).alias("n"))


KEYS = ["spell_id", "split_seq"]


def encode_sequence(c: Chain) -> DataFrame:
    vocab = features.vocabulary(c.cohort, "drug_combo").where("code <> 'Brand#7'")  # one code left out: it comes back as unknown
    return features.encode_sequence(c.cohort, KEYS, "drug_combo", vocab, MAX_DRUGS).select(*KEYS, F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def pooled_embedding(c: Chain, items: str = "drug_combo", kind: str = "drug") -> DataFrame:
    rows = c.cohort.where(F.size(items) > 0)
    return features.pooled_vectors(rows, KEYS, items, c.claims.code_vectors(kind), DIM).select(*KEYS, F.posexplode("pooled").alias("dim", "value")).withColumn("value", F.round("value", 5))


def flattened(c: Chain) -> DataFrame:
    """keys and flat: the vectors of up to MAX_CODES diagnoses, then of up to MAX_DRUGS drugs."""
    codes_flat = features.flattened_vectors(c.cohort, KEYS, "icd10_codes", c.claims.code_vectors("icd"), MAX_CODES, DIM).withColumnRenamed("flat", "_codes")
    drugs_flat = features.flattened_vectors(c.cohort, KEYS, "drug_combo", c.claims.code_vectors(), MAX_DRUGS, DIM)
    return codes_flat.join(drugs_flat, KEYS).select(*KEYS, F.concat("_codes", "flat").alias("flat"))


def flattened_embedding(c: Chain) -> DataFrame:
    """The sum of each place's vector, where there is one."""
    place = F.transform(F.sequence(F.lit(0), F.lit(MAX_CODES + MAX_DRUGS - 1)), lambda i: F.aggregate(F.slice("flat", i * DIM + 1, DIM), F.lit(0.0), lambda a, x: a + x))
    return flattened(c).select(*KEYS, F.posexplode(place).alias("place", "total")).where("total <> 0").withColumn("total", F.round("total", 4))


def exported_products(c: Chain) -> DataFrame:
    """The part table as the drug directory's nested JSON records: a package, two ingredients and up to two routes each."""
    named = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("OXYCODONE "), "p_name")).otherwise(F.col("p_name"))
    ingredients = F.array(F.struct(named.alias("name"), F.col("p_type").alias("strength")), F.struct(F.lit("ACETAMINOPHEN").alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(" mg")).alias("strength")))
    routes = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("ORAL"), F.lit("RECTAL"))).otherwise(F.array(F.lit("ORAL")))
    digits = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    code = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 4), F.substring(digits, 9, 2))
    empty = F.array().cast("array<string>")
    record = F.struct(
        F.col("p_name").alias("brand_name"), F.col("p_brand").alias("labeler_name"), routes.alias("route"), ingredients.alias("active_ingredients"),
        empty.alias("pharm_class"), empty.alias("pharm_class_cs"), empty.alias("pharm_class_epc"), F.array(F.struct(code.alias("package_ndc"))).alias("packaging"),
    )
    return products_of(c.claims.table("part").select(F.to_json(F.struct(F.array(record).alias("results"))).alias("value")))


def json_explode(c: Chain) -> DataFrame:
    return ingredients_of(exported_products(c))


def ingredients_of(products: DataFrame) -> DataFrame:
    rows = products.select(F.col("packaging")[0]["package_ndc"].alias("package_ndc"), F.posexplode("active_ingredients").alias("place", "i"))
    return rows.select("package_ndc", "place", F.col("i.name").alias("ingredient"), F.col("i.strength").alias("strength"))


def json_file_products(c: Chain) -> DataFrame:
    """The same from JSON files in the shared folder, laid out over many lines with up to fifty products an object."""
    path = f"{shared_folder(c.spark)}/products-{uuid.uuid4().hex}"
    objects = exported_products(c).withColumn("k", F.floor(F.regexp_replace(F.col("packaging")[0]["package_ndc"], "-", "").cast("long") / 50))
    grouped = objects.groupBy("k").agg(F.collect_list(F.struct(*(x for x in objects.columns if x != "k"))).alias("results"))
    grouped.select(F.to_json(F.struct("results"), {"pretty": "true"}).alias("value")).write.text(path)
    return ingredients_of(read_products(c.spark, path))


def json_file_vectors(c: Chain) -> DataFrame:
    """Codes with the length and total of their vectors, from JSON files that map codes to vectors."""
    path = f"{shared_folder(c.spark)}/vectors-{uuid.uuid4().hex}"
    grouped = c.claims.code_vectors().groupBy(F.pmod(F.xxhash64("code"), F.lit(4)).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("code", "vec"))).alias("m"))
    grouped.select(F.to_json("m", {"pretty": "true"}).alias("value")).write.text(path)
    read = read_code_vectors(c.spark, path)
    return read.select("code", F.size("vec").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


def bucketed_spells(c: Chain) -> DataFrame:
    """The spells again, from fills stored in buckets of members, as many as keep a bucket at ROWS_A_BUCKET fills."""
    buckets = buckets_for(c.claims.table("lineitem").count(), ROWS_A_BUCKET)  # each fill is a line; Parquet's footers count them
    kept = bucketed(c.fills.select("member_id", "atc_3_code", "filldate", "supplydayscount", "is_query_drug"), "member_id", buckets)
    return spells.detect_spells(spells.drug_intervals(kept, GRACE, placed=True), K, GRACE, MIN_LEN)


def batched_extract(c: Chain) -> DataFrame:
    """Fills written in batches of 200 members, the first of them once more as after a failure: rows and members by batch."""
    path = f"{shared_folder(c.spark)}/batches-{uuid.uuid4().hex}"
    fills = stored(c.claims.rx_fills())  # read by each of the writes below
    batches = stored(codes.key_range_batches(fills, "member_id", 200))
    first = batches.agg(F.min("batch")).first()[0]
    if first is not None:
        write_batches(fills, batches, "member_id", path, [first])
        write_batches(fills, batches, "member_id", path, missing_batches(c.spark, batches, path) or None)
        write_batches(fills, batches, "member_id", path, [first])
    done = c.spark.read.schema(fills.schema.add("batch", "long")).parquet(path)
    return done.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("member_id").alias("n_members"))


def opioid_products(c: Chain) -> DataFrame:
    return codes.opioid_products(exported_products(c))


def keyed_rows(c: Chain) -> DataFrame:
    return c.cohort.select("*", (F.col("spell_id") * 100 + F.col("split_seq")).alias("row_id")).withColumn("y", F.col("had_ae").cast("int"))


def model_frame(c: Chain) -> tuple[DataFrame, list[str]]:
    kept = keyed_rows(c).select("row_id", *KEYS, "drug_combo", "icd10_codes", "age", "gendercode", "raceethnicitytypecode", "y")
    frame, names = features.design_matrix(stored(kept), ["age"], ["gendercode", "raceethnicitytypecode"], icd_floor=MIN_N)
    return stored(features.split_rows(frame.select("row_id", *KEYS, "y", "features"), *KEYS)), names


def quality_of(scores: DataFrame) -> DataFrame:
    scores = stored(scores)
    return metrics.average_precision(scores).join(F.broadcast(metrics.roc_auc(scores)))


def logistic_odds_ratios(c: Chain) -> DataFrame:
    frame, names = model_frame(c)
    return models.top_and_bottom(models.odds_ratios(c.spark, models.fit_logistic(frame.where("is_train")), names), "odds_ratio", 30)


def bootstrap_intervals(c: Chain) -> DataFrame:
    frame, names = model_frame(c)
    return models.bootstrap_odds_ratios(frame.where("is_train").select("row_id", "features", "y"), names)


def logistic_quality(c: Chain) -> DataFrame:
    frame, _ = model_frame(c)
    return quality_of(models.scored_rows(models.fit_logistic(frame.where("is_train")), frame.where("not is_train")))


def tree_search(c: Chain, full: bool = False) -> DataFrame:
    """Validation quality of each setting, with all the operator's rounds."""
    frame, _ = model_frame(c)
    train = frame.where("is_train")
    return boosting.tree_grid(train, frame.where("not is_train"), models.tree_settings(train, full))


def tree_best(c: Chain) -> DataFrame:
    return metrics.best_run(tree_search(c))


def tree_quality(c: Chain) -> DataFrame:
    """Validation quality of boosted trees at the operator's own settings."""
    frame, _ = model_frame(c)
    train = frame.where("is_train").persist()
    trees = boosting.fit_trees(train)
    train.unpersist()
    return quality_of(trees.scored_rows(frame.where("not is_train")))


def _tokens() -> list[tuple[str, list[str]]]:
    return [("bucket", [YOUNGEST, *(name for _, name in AGE_BUCKETS)]), ("raceethnicitytypecode", sorted(RACE_LABELS)), ("gendercode", ["F", "M"])]


def _perceptron(c: Chain, settings: tuple[tuple[int, ...], int], made) -> DataFrame:
    """Validation quality of a perceptron over age, race and gender tokens and what ``made`` adds of the codes' vectors.

    Rows stay at their codes: the draws of equal rows are folded to a number, and only the codes' vectors are as wide as the input."""
    rows = keyed_rows(c).select("row_id", *KEYS, "y", age_bucket(F.col("age")).alias("bucket"), "raceethnicitytypecode", "gendercode", F.col("drug_combo").alias("drugs"), F.col("icd10_codes").alias("codes"))
    split = stored(features.split_rows(rows, *KEYS))
    drawn = features.resample_balanced(split.where("is_train"), "y", *KEYS)
    folded = drawn.groupBy("bucket", "raceethnicitytypecode", "gendercode", "drugs", "codes", "y").agg(F.count(F.lit(1)).alias("n"))
    vectors = [("codes", c.claims.code_vectors("icd"), MAX_CODES), ("drugs", c.claims.code_vectors(), MAX_DRUGS)]
    build, table = features.table_features(split, _tokens(), vectors, DIM, made)
    model = perceptrons.fit_perceptron(build(folded), table, *settings)
    return quality_of(model.scored_rows(build(split.where("not is_train"))))


def perceptron_quality(c: Chain) -> DataFrame:
    """Over the pooled vectors of diagnoses and drugs."""
    return _perceptron(c, POOLED, features.mean_codes)


def sequence_quality(c: Chain) -> DataFrame:
    """Over the flattened vectors of diagnoses and drugs."""
    return _perceptron(c, FLAT, features.placed_codes)


def saved_model_quality(c: Chain) -> DataFrame:
    """A logistic model written to the session's shared folder, read again and used."""
    frame, names = model_frame(c)
    path = f"{shared_folder(c.spark)}/model-{uuid.uuid4().hex}"
    models.save_model(models.fit_logistic(frame.where("is_train")), names, path)
    model, _ = models.load_model(path)
    return quality_of(models.scored_rows(model, frame.where("not is_train")))


_STEPS = {
    "view_rx_fills": lambda c: c.claims.rx_fills(),
    "view_enrollment": lambda c: c.claims.enrollment(),
    "view_demographics": lambda c: c.claims.demographics(),
    "eligible_members": eligible_members,
    "semi_join_members": semi_join_members,
    "distinct_query_drugs": lambda c: c.claims.query_drugs().distinct(),
    "clean_map": clean_map,
    "enrich_atc": enrich_atc,
    "match_rate": lambda c: codes.match_rate(enrich_atc(c)),
    "ae_prefix_filter": ae_prefix_filter,
    "code_type_filter": code_type_filter,
    "opioid_products": opioid_products,
    "coalesce_intervals": lambda c: c.intervals,
    "concurrency_sweep": concurrency_sweep,
    "detect_spells": lambda c: c.spells,
    "drug_changes": lambda c: c.changes,
    "censor_enrollment": lambda c: c.censored,
    "washout": washout,
    "washout_bridged": washout_bridged,
    "label_first_event": lambda c: flat_segments(c.labelled),
    "split_at_adds": lambda c: flat_segments(c.segments),
    "label_combo": lambda c: c.combos.select("spell_id", "split_seq", joined("drug_combo")),
    "label_combo_exact": lambda c: spells.label_combo(c.segments, c.changes, True, c.intervals).select("spell_id", "split_seq", joined("drug_combo")),
    "latest_change": latest_change,
    "filled_status": filled_status,
    "diagnosis_windows": diagnosis_windows,
    "cluster_codes": lambda c: c.icd.select("member_id", "spell_id", "split_seq", joined("icd10_codes")),
    "finalize_cohort": finalize,
    "attrition": lambda c: cohort.attrition(c.combos, c.claims.demographics(), c.icd, WINDOW),
    "combo_pairs": lambda c: mined(c, 2),
    "combo_pairs_containing": lambda c: mined(c, 2, must_contain="Brand#7"),
    "combo_trios": lambda c: mined(c, 3),
    "combo_sets": lambda c: mined(c, None),
    "bh_forward_cummin": lambda c: combos.bh_adjust(combos.mine_combinations(c.cohort, 2, MIN_N).select("item1", "item2", "p_value"), "p_value", ["item1", "item2"], "forward_cummin").select("item1", "item2", F.round("p_adj", 5).alias("p_adj")),
    "top_pairs_by_rate": lambda c: top_mined(c, 2, "rate"),
    "top_pairs_by_count": lambda c: top_mined(c, 2, "n_ae"),
    "top_trios_by_rate": lambda c: top_mined(c, 3, "rate"),
    "top_trios_by_count": lambda c: top_mined(c, 3, "n_ae"),
    "spell_gaps": spell_gaps,
    "describe_gaps": lambda c: summary.describe(spell_gaps(c), "gap_days"),
    "describe_lengths": lambda c: summary.describe(c.segments, "spell_length_days", "segment_end_reason"),
    "hist_gaps": lambda c: summary.histogram(spell_gaps(c), "gap_days", 0, 200, 60),
    "hist_ae_timing": hist_ae_timing,
    "top_ae_codes": top_ae_codes,
    "ae_by_description": ae_by_description,
    "top_combos_k3": lambda c: top_combos(c, 3),
    "top_combos_k4": lambda c: top_combos(c, 4),
    "category_shares": category_shares,
    "sketched_lengths": sketched_lengths,
    "table1": table1,
    "total_and_members": lambda c: summary.total_and_members(c.segments),
    "non_event_members": lambda c: cohort.members_without_event(c.segments),
    "member_code_counts": lambda c: summary.member_code_counts(c.icd, "icd10_codes"),
    "top_member_codes_20": lambda c: summary.top_member_codes(c.icd, "icd10_codes", 20),
    "top_member_codes_500": lambda c: summary.top_member_codes(c.icd, "icd10_codes", 500),
    "adds_per_spell": lambda c: summary.count_of_counts(c.changes.where("change_type = 'add'"), "spell_id"),
    "ae_by_split_seq": lambda c: c.segments.where("had_ae").groupBy("split_seq").agg(F.count(F.lit(1)).alias("n")),
    "days_into_spell": days_into_spell,
    "top_other_bucket": top_other_bucket,
    "multi_hot_long": lambda c: features.multi_hot_long(c.cohort, ["spell_id", "split_seq"], "drug_combo", "DRUG_").unionByName(features.multi_hot_long(c.cohort, ["spell_id", "split_seq"], "icd10_codes", "ICD_", 50)),
    "one_hot_long": lambda c: features.one_hot_long(c.claims.demographics(), ["member_id"], ["gendercode", "raceethnicitytypecode"]),
    "age_buckets": age_buckets,
    "vocab_index": lambda c: features.vocabulary(c.cohort, "drug_combo"),
    "encode_sequence": encode_sequence,
    "pooled_embedding": pooled_embedding,
    "pooled_icd_embedding": lambda c: pooled_embedding(c, "icd10_codes", "icd"),
    "flattened_embedding": flattened_embedding,
    "stratified_split": lambda c: features.split_rows(c.cohort, "spell_id", "split_seq").groupBy("y", "is_train").agg(F.count(F.lit(1)).alias("n")),
    "class_weights": lambda c: features.class_weights(c.claims.scored(), "y"),
    "median_age": lambda c: features.median_of(c.cohort, "age"),
    "average_precision": lambda c: metrics.average_precision(c.claims.scored()),
    "roc_auc": lambda c: metrics.roc_auc(c.claims.scored()),
    "precision_at_fraction": lambda c: metrics.precision_at_fraction(c.claims.scored()),
    "pr_curve": lambda c: metrics.pr_curve(c.claims.scored()),
    "best_f1": lambda c: metrics.best_f1(c.claims.scored()),
    "threshold_for_precision": lambda c: metrics.threshold_for_precision(c.claims.scored()),
    "f1_sweep": lambda c: metrics.f1_sweep(c.claims.scored()),
    "class_report": lambda c: metrics.class_report(c.claims.scored()),
    "key_range_batches": lambda c: codes.key_range_batches(c.claims.rx_fills(), "member_id", 200),
    "hash_buckets": lambda c: codes.hash_buckets(c.claims.rx_fills(), "member_id"),
    "json_explode": json_explode,
    "json_file_products": json_file_products,
    "json_file_vectors": json_file_vectors,
    "bucketed_spells": bucketed_spells,
    "batched_extract": batched_extract,
    "validate_dataset": lambda c: validate_dataset(c.claims.demographics(), ("member_id", "zip3value")),
    "logistic_odds_ratios": logistic_odds_ratios,
    "logistic_quality": logistic_quality,
    "bootstrap_intervals": bootstrap_intervals,
    "tree_search": tree_search,
    "tree_full_search": lambda c: tree_search(c, True),
    "tree_best": tree_best,
    "tree_quality": tree_quality,
    "perceptron_quality": perceptron_quality,
    "sequence_quality": sequence_quality,
    "saved_model_quality": saved_model_quality,
}


def _over(step):
    return lambda spark, sf_dir: step(Chain(spark, sf_dir))


QUERIES = {name: _over(step) for name, step in _STEPS.items()}
