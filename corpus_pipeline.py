"""The corpus pipeline: STAGES over `documents`, each written as Parquet and read again.

quality      rejects documents of low quality (hierarchical empirical Bayes)
line_dedup   cuts lines that stand earlier in the corpus, also with an edit or two,
             and drops documents of which it leaves no word
near_dedup   keeps one document of each near-duplicate class
decontaminate  drops documents that hold a benchmark window
tokenize     encodes what is left; each row carries its ids

Every stage takes (spark, docs, sf_dir) and keeps all rows and columns of documents
that it doesn't decide against; the last returns doc_id, n_chars, n_tokens, ids and
round_trip. Documents that had no text or no word to begin with lose their row to
line_dedup only if nothing but white space is left of what they had.

Defined cases: null and empty texts go through all stages and have no ids; rows with one doc_id,
or none, and different texts are documents of their own; of rows that repeat both, and of other ties,
near_dedup leaves one; very long texts are read whole; empty tables give an empty result; columns of
other names pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import decontaminate, line_dedup, near_dedup, quality, sentencepiece_codec
from furrow.llm.common import discard, save

#: A character of a word, as in common.WORD_BYTE.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs.withColumn("__word", F.col("text").rlike(WORD)))
    # without this, a copy whose lines all stand earlier would go on as a row of its own with an empty text
    nothing = ~F.col("text").rlike(WORD) & (F.col("__word") | ~F.col("text").rlike(r"\S"))
    out = out.where(~F.coalesce((F.col("__gone") > 0) & nothing, F.lit(False)))
    return out.withColumn("n_chars", F.when(F.col("__gone") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = sentencepiece_codec.encode(docs.select("doc_id", "n_chars", "text"), check="round_trip")
    n = F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("bigint")
    return rows.select("doc_id", "n_chars", n.alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("tokenize", stage_tokenize),
]

#: The logistic model, the signatures and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage returned is deleted when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
