"""The register of queries: each has a name, a plan over the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}

SALES = "sales AS (SELECT CAST(s_nationkey AS INT) AS adm_id, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def _labels(crop: str, year: str, name: str) -> str:
    return f"""{name} AS (SELECT *, production / area AS yield FROM (SELECT adm_id, {crop} AS crop, CAST({year} AS INT) AS year, sum(l_quantity) AS area, round(sum(l_extendedprice), 2) AS production
    FROM sales JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3))"""


LABELS = SALES + ",\n" + _labels("p_type", "year(day)", "labels")
SPARSE = SALES + ",\n" + _labels("p_brand", "year(day)", "labels")
MONTHLY = SALES + ",\n" + _labels("p_type", "year(day) * 12 + month(day)", "labels")
KK = "CAST((month({d}) - 1) * 3 + least(3, (day({d}) - 1) // 10 + 1) AS INT)"
START = "make_date(CAST({k} // 100 AS INT), CAST(({k} % 100 + 2) // 3 AS INT), CAST(({k} % 100 - 1) % 3 * 10 + 1 AS INT))"
FROM_RAW = "CAST(((({r}) - 1) // 36 + 1900) * 100 + (({r}) - 1) % 36 + 1 AS INT)"


def kk(d: str) -> str:
    return KK.format(d=d)


def dekad_of(d: str) -> str:
    return f"CAST(year({d}) * 100 + {kk(d)} AS INT)"


def raw_of(d: str) -> str:
    return f"CAST((year({d}) - 1900) * 36 + {kk(d)} AS INT)"


def start_of(k: str) -> str:
    return START.format(k=f"({k})")


def from_raw(r: str) -> str:
    return FROM_RAW.format(r=r)


_PER_DEKAD = f"per_dekad AS (SELECT adm_id, {dekad_of('day')} AS dekad, sum(l_quantity) AS rainfall, round(avg(l_discount) * 100, 6) AS temperature, round(avg(l_tax) * 100, 6) AS fpar FROM sales GROUP BY 1, 2)"
INDICATORS = f"""{SALES},
{_PER_DEKAD},
ind AS (SELECT adm_id, 'rainfall' AS variable_name, {start_of('dekad')} AS date, rainfall AS mean FROM per_dekad
    UNION ALL SELECT adm_id, 'temperature', {start_of('dekad')}, temperature FROM per_dekad UNION ALL SELECT adm_id, 'FPAR', {start_of('dekad')}, fpar FROM per_dekad)"""
MONTHS = f"""{INDICATORS},
months AS (SELECT adm_id, variable_name, CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS first_date, count(mean) AS n, avg(mean) AS mean, min(mean) AS min, max(mean) AS max, coalesce(sum(mean), 0) AS sum FROM ind GROUP BY 1, 2, 3)"""


def query(name: str, sql: str | None = None):
    """Register a plan under a name; sql may begin with common table expressions."""

    def of(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return of
