"""Queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import decontaminate, exact_dedup, filter_audit, langid, lexical_search, license_scan, line_dedup, lm_scoring, near_dedup, quality, sentencepiece_codec, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, a digest of the ids, and whether decoding gives the whole text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sentencepiece_codec.encode(docs, check="round_trip")
    return rows.select("doc_id", F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "round_trip")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_quality_classifier, op3_exact_dedup, op4_line_dedup, op5_sentencepiece, op6_language_id, op7_license_scan, op8_warc, op9_decontamination, op10_near_dedup, op11_filter_audit, op12_lexical_search, op13_lm_scoring)
}

ORACLE_SQL = {"op1_url_filter": url_filter.report_sql(), "op3_exact_dedup": exact_dedup.REPORT_SQL, "op4_line_dedup": line_dedup.report_sql(), "op8_warc": warc.REPORT_SQL, "op9_decontamination": decontaminate.report_sql(), "op11_filter_audit": filter_audit.REPORT_SQL, "op12_lexical_search": lexical_search.report_sql()}
