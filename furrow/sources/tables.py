"""Canonical tables from the star schema: label panels and indicator series.

labels: adm_id, crop, year, area, production, yield. Units are nations, crops part
types (or brands, which leaves natural gaps), areas quantities and production prices.
indicators: adm_id, variable_name, date (first day of a dekad), mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import dekad

VARIABLES = ("rainfall", "temperature", "FPAR")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("adm_id"))
    return read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.to_date("l_shipdate").alias("day")).join(supplier, "l_suppkey")


def labels(spark: SparkSession, sf_dir: str, crop: str = "p_type", by: str = "year") -> DataFrame:
    """by: year, or month for series that are long enough for outlier rules (year is then the month's number)."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(crop).alias("crop"))
    year = F.year("day") if by == "year" else F.year("day") * 12 + F.month("day")
    sums = _sales(spark, sf_dir).join(part, "l_partkey").groupBy("adm_id", "crop", year.cast("int").alias("year")).agg(F.sum("l_quantity").alias("area"), F.round(F.sum("l_extendedprice"), 2).alias("production"))
    return sums.withColumn("yield", F.col("production") / F.col("area"))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variables per unit and dekad, unpivoted from one pass of sums."""
    d = _sales(spark, sf_dir).groupBy("adm_id", dekad.from_date(F.col("day")).alias("dekad")).agg(
        F.sum("l_quantity").alias("rainfall"), F.round(F.avg("l_discount") * 100, 6).alias("temperature"), F.round(F.avg("l_tax") * 100, 6).alias("FPAR")
    )
    return d.unpivot(["adm_id", "dekad"], list(VARIABLES), "variable_name", "mean").select("adm_id", "variable_name", dekad.start(F.col("dekad")).alias("date"), "mean")


def crops(spark: SparkSession, sf_dir: str) -> list[str]:
    """The crops that there are, in order: an axis of the task tables."""
    return sorted(r.p_type for r in read(spark, sf_dir, "part").where("p_type IS NOT NULL").select("p_type").distinct().collect())
