"""Queries of the remaining joins and conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import forecast, panel
from furrow.plans.register import LABELS, SPARSE, query
from furrow.sources import tables


_CUSTOMER_YEARS = "f AS (SELECT CAST(c_nationkey AS INT) AS adm_id, CAST(year(o_orderdate) AS INT) AS year, round(avg(o_totalprice), 4) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query("operational_join", f"WITH {SPARSE}, {_CUSTOMER_YEARS} SELECT coalesce(l.adm_id, f.adm_id) AS adm_id, crop, coalesce(l.year, f.year) AS year, yield, x FROM labels l FULL JOIN f ON l.adm_id = f.adm_id AND l.year = f.year WHERE coalesce(l.year, f.year) <= 2000")
def operational_join(spark, sf):
    customer = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("adm_id"))
    orders = tables.read(spark, sf, "orders").join(customer, "o_custkey").groupBy("adm_id", F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("x"))
    return panel.with_features(tables.labels(spark, sf, crop="p_brand").select("adm_id", "crop", "year", "yield"), orders, 2000)


_CUSTOMER_ORDERS = "r AS (SELECT CAST(c_nationkey AS INT) AS adm_id, c_mktsegment AS shape, CAST(year(o_orderdate) AS INT) AS year, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("latest_boundary_set", f"WITH {_CUSTOMER_ORDERS} SELECT adm_id, count(*) AS n FROM r WHERE shape = (SELECT shape FROM r ORDER BY year DESC, o_orderkey DESC LIMIT 1) GROUP BY 1")
def latest_boundary_set(spark, sf):
    customer = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("adm_id"), F.col("c_mktsegment").alias("shape"))
    rows = tables.read(spark, sf, "orders").join(customer, "o_custkey").select("adm_id", "shape", F.year("o_orderdate").alias("year"), "o_orderkey")
    return panel.latest_set(rows, "shape", ["year", "o_orderkey"]).groupBy("adm_id").agg(F.count("*").alias("n"))


@query("subset_by_attribute", f"WITH {LABELS}, a AS (SELECT CAST(s_nationkey AS INT) AS adm_id, avg(s_acctbal) AS m FROM supplier GROUP BY 1) SELECT crop, count(*) AS n, count(DISTINCT adm_id) AS units FROM labels WHERE adm_id IN (SELECT adm_id FROM a WHERE m > 4500) GROUP BY 1")
def subset_by_attribute(spark, sf):
    a = tables.read(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("adm_id")).agg(F.avg("s_acctbal").alias("m"))
    return panel.subset_by(tables.labels(spark, sf), a, "m > 4500").groupBy("crop").agg(F.count("*").alias("n"), F.countDistinct("adm_id").alias("units"))


@query("unit_conversion", "SELECT p_partkey, unit, CASE unit WHEN 'kt' THEN p_retailprice * 1000.0 WHEN 'kg' THEN p_retailprice * 0.001 WHEN 'q' THEN p_retailprice * 0.1 WHEN 't' THEN p_retailprice END AS tonnes FROM (SELECT p_partkey, p_retailprice, ['t', 'kt', 'kg', 'q', 'bags'][p_size % 5 + 1] AS unit FROM part)")
def unit_conversion(spark, sf):
    units = F.array(*map(F.lit, ("t", "kt", "kg", "q", "bags")))
    p = tables.read(spark, sf, "part").select("p_partkey", F.element_at(units, (F.col("p_size") % 5 + 1).cast("int")).alias("unit"), "p_retailprice")
    return p.select("p_partkey", "unit", forecast.to_tonnes(F.col("p_retailprice"), F.col("unit")).alias("tonnes"))
