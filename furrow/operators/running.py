"""Running sums over groups of any size: a window over a whole group would be one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.sources import files

#: The range of the sort order that a row was dealt to.
RANGE = "__range"


def dealt(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with RANGE: dealt out over ranges of `order` and written down, since the bounds come from a sample. Rows that are equal in `order` share a range."""
    path = files.scratch(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def matched(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left with the columns of right, joined on `by`; nulls match nulls."""
    other = right.toDF(*(f"__of_{c}" if c in by else c for c in right.columns))
    j = left.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by]), how)
    return j.drop(*(f"__of_{c}" for c in by))


def before(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """RANGE, by, sums: of what stands in earlier ranges than each one that the group has a part in. A row per group and range."""
    totals = rows.groupBy(RANGE, *by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(RANGE, *by, *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in sums))


def position(rows: DataFrame, by: list[str], order: list[Column], into: str) -> DataFrame:
    """rows that were dealt out by (by, order) with their place in the order of their group, from 1."""
    starts = before(rows, by, {into: F.lit(1)})
    own = Window.partitionBy(RANGE, *by).orderBy(*order)
    j = matched(rows.withColumn("__own", F.row_number().over(own)), starts, [RANGE, *by])
    return j.withColumn(into, F.col(into) + F.col("__own")).drop("__own")
