"""Five stages from raw documents to token ids.  Each takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs; all but the last return the columns of documents.

Rows are judged each by itself, repeated ones too.  Null texts count as empty: the classifier scores them like any empty text, line dedup
leaves them null, of several null or empty texts the near-copy stage keeps those of the smallest doc_id, no benchmark window stands in
them, and they have no tokens.  A null doc_id comes last in line dedup's order, and its documents are no near copies of any.  Texts of any
length are worked on whole; an empty table stays empty.  Columns beside those of documents come through under any name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanwise.llm import bpe, decontam, line_dedup, near, quality
from spanwise.llm.text import discard, ensure_checkpoint_dir, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this input's labelled documents, accepts."""
    return quality.keep_good(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without runs of lines that stand in an earlier one."""
    return line_dedup.dedup_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not near copies (five-word shingles, similarity 0.8 or more) of an earlier one that stays."""
    return near.keep_first_of_near(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontam.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the text that they decode to."""
    import public_tokenizers

    return bpe.bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", token_stage),
]

#: A trained network and hashes of a fixed kind decide: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stands between them is written to the shared checkpoint folder, where the last stage's input stays."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
    raise ValueError("STAGES is empty")
