"""Queries of label panels: completion, quality control, statistics and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import panel, trend
from furrow.plans.register import LABELS, MONTHLY, SPARSE, query
from furrow.sources import tables

EXCLUDED = {"Brand#11": [1, 2, 3], "Brand#12": [4], "Brand#23": [7, 9]}


def _p(spark, sf):
    return tables.labels(spark, sf)


def _ps(spark, sf):
    return tables.labels(spark, sf, crop="p_brand")


def _pm(spark, sf):
    return tables.labels(spark, sf, by="month")


_GRID = f"""{SPARSE},
grid AS (SELECT u.adm_id, c.crop, CAST(y.year AS INT) AS year, l.area, l.production, l.yield FROM (SELECT DISTINCT adm_id FROM labels) u CROSS JOIN (SELECT DISTINCT crop FROM labels) c
    CROSS JOIN (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM labels) y LEFT JOIN labels l ON l.adm_id = u.adm_id AND l.crop = c.crop AND l.year = y.year)"""


@query("grid_completion", f"WITH {_GRID} SELECT * FROM grid")
def grid_completion(spark, sf):
    return panel.complete_grid(_ps(spark, sf))


@query("series_with_data", f"WITH {_GRID} SELECT adm_id, crop, count(*) AS n, count(yield) AS n_obs FROM grid GROUP BY 1, 2 HAVING count(yield) > 0")
def series_with_data(spark, sf):
    return panel.with_data(panel.complete_grid(_ps(spark, sf))).groupBy("adm_id", "crop").agg(F.count("*").alias("n"), F.count("yield").alias("n_obs"))


@query("min_obs_series", f"WITH {SPARSE} SELECT adm_id, crop, year, yield, n_obs FROM (SELECT *, count(yield) OVER (PARTITION BY adm_id, crop) AS n_obs FROM labels) WHERE n_obs >= 7")
def min_obs_series(spark, sf):
    return panel.at_least(_ps(spark, sf), 7).select("adm_id", "crop", "year", "yield", "n_obs")


@query("exclude_pairs", f"WITH {SPARSE} SELECT adm_id, crop, year, yield FROM labels WHERE NOT (" + " OR ".join(f"(crop = '{c}' AND adm_id IN ({', '.join(map(str, i))}))" for c, i in EXCLUDED.items()) + ")")
def exclude_pairs(spark, sf):
    return panel.exclude(_ps(spark, sf), EXCLUDED).select("adm_id", "crop", "year", "yield")


@query(
    "ffill_bfill",
    f"""WITH {_GRID} SELECT adm_id, crop, year, coalesce(last_value(yield IGNORE NULLS) OVER (PARTITION BY adm_id, crop ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(yield IGNORE NULLS) OVER (PARTITION BY adm_id, crop ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS yield_filled FROM grid""",
)
def ffill_bfill(spark, sf):
    return panel.fill(panel.complete_grid(_ps(spark, sf)), "yield").select("adm_id", "crop", "year", "yield_filled")


_SYSTEMS = "sys AS (SELECT DISTINCT CAST(s_nationkey AS INT) AS adm_id, p_brand AS crop, CAST(year(l_shipdate) AS INT) AS year, l_returnflag AS system FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"


@query(
    "system_disambiguation",
    f"""WITH {_SYSTEMS}, w AS (SELECT adm_id, crop, count(DISTINCT system) AS n_systems, max(CASE WHEN system = 'N' THEN 1 ELSE 0 END) AS has, min(system) AS lowest FROM sys GROUP BY 1, 2)
SELECT sys.adm_id, sys.crop, year, system, n_systems FROM sys JOIN w USING (adm_id, crop) WHERE system = CASE WHEN n_systems = 1 THEN system WHEN has = 1 THEN 'N' ELSE lowest END""",
)
def system_disambiguation(spark, sf):
    supplier = tables.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("adm_id"))
    part = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("crop"))
    rows = tables.read(spark, sf, "lineitem").join(supplier, "l_suppkey").join(part, "l_partkey").select("adm_id", "crop", F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("system")).distinct()
    return panel.choose_system(rows, "system", "N")


_FLAGGED = """dup AS (SELECT *, coalesce(yield = lag(yield) OVER (PARTITION BY adm_id, crop ORDER BY year), false) AS duplicate FROM labels),
st AS (SELECT adm_id, crop, avg(yield) AS m, stddev_pop(yield) AS s FROM dup WHERE NOT duplicate GROUP BY 1, 2),
z AS (SELECT dup.*, CASE WHEN NOT duplicate THEN (yield - m) / nullif(s, 0) END AS z, CASE WHEN NOT duplicate THEN (yield - m) / nullif(m, 0) * 100 END AS diff_prct FROM dup JOIN st USING (adm_id, crop)),
flagged AS (SELECT *, CASE WHEN abs(z) > 3 AND abs(diff_prct) >= 75 AND z > 0 THEN 'Removed' WHEN abs(z) > 3 AND abs(diff_prct) >= 75 THEN 'Flagged' END AS outlier, CASE WHEN yield = 0 AND production / nullif(area, 0) >= 0.5 THEN 'Removed' END AS low_yield FROM z)"""


def _uneven(df):
    """Labels with planted findings: yields multiplied in some months, zeros, and repeats."""
    k = (F.col("adm_id") * 31 + F.col("year") * 17) % 97
    y = F.when(k == 1, F.col("yield") * 9).when(k == 2, 0.0).when(k.isin(3, 4), 777.25).otherwise(F.col("yield"))
    return df.withColumn("yield", y)


_UNEVEN = f"""{MONTHLY.replace('labels AS', 'raw_labels AS')},
labels AS (SELECT adm_id, crop, year, area, production, CASE (adm_id * 31 + year * 17) % 97 WHEN 1 THEN yield * 9 WHEN 2 THEN 0.0 WHEN 3 THEN 777.25 WHEN 4 THEN 777.25 ELSE yield END AS yield FROM raw_labels)"""


@query("qc_duplicates", f"WITH {_UNEVEN}, {_FLAGGED} SELECT adm_id, crop, year, duplicate FROM flagged")
def qc_duplicates(spark, sf):
    return panel.flag_duplicates(_uneven(_pm(spark, sf))).select("adm_id", "crop", "year", "duplicate")


@query("qc_outliers", f"WITH {_UNEVEN}, {_FLAGGED} SELECT adm_id, crop, year, round(z, 5) AS z, round(diff_prct, 4) AS diff_prct, outlier FROM flagged")
def qc_outliers(spark, sf):
    return panel.flagged(_uneven(_pm(spark, sf))).select("adm_id", "crop", "year", F.round("z", 5).alias("z"), F.round("diff_prct", 4).alias("diff_prct"), "outlier")


@query("qc_low_yield", f"WITH {_UNEVEN}, {_FLAGGED} SELECT adm_id, crop, year, low_yield FROM flagged WHERE low_yield IS NOT NULL")
def qc_low_yield(spark, sf):
    return panel.flag_low_yield(_uneven(_pm(spark, sf))).where("low_yield IS NOT NULL").select("adm_id", "crop", "year", "low_yield")


@query("clean_labels", f"WITH {_UNEVEN}, {_FLAGGED} SELECT adm_id, crop, year, area, production, yield FROM flagged WHERE coalesce(outlier, '') <> 'Removed' AND coalesce(low_yield, '') <> 'Removed' AND NOT duplicate")
def clean_labels(spark, sf):
    return panel.cleaned(_uneven(_pm(spark, sf))).select("adm_id", "crop", "year", "area", "production", "yield")


@query(
    "qc_summary",
    f"""WITH {_UNEVEN}, {_FLAGGED}, y AS (SELECT crop, string_agg(CAST(year AS VARCHAR), '|' ORDER BY year) AS removed_years FROM (SELECT DISTINCT crop, year FROM flagged WHERE outlier = 'Removed') GROUP BY 1)
SELECT crop, count(*) AS n, count(CASE WHEN duplicate THEN 1 END) AS n_duplicate, count(CASE WHEN outlier = 'Removed' THEN 1 END) AS n_removed, count(CASE WHEN outlier = 'Flagged' THEN 1 END) AS n_flagged, count(low_yield) AS n_low, coalesce(any_value(removed_years), '') AS removed_years
FROM flagged LEFT JOIN y USING (crop) GROUP BY crop""",
)
def qc_summary(spark, sf):
    return panel.qc_summary(_uneven(_pm(spark, sf)))


def _stats_sql(source: str) -> str:
    return f"""us AS (SELECT adm_id, crop, avg(production) AS production_mean, stddev_samp(production) AS production_std, avg(yield) AS yield_mean, stddev_samp(yield) AS yield_std, count(yield) AS n, round(avg(area), 6) AS area_mean, stddev_samp(area) AS area_std FROM {source} GROUP BY 1, 2),
us2 AS (SELECT *, sum(area_mean) OVER (PARTITION BY crop) AS crop_total_area, sum(area_mean) OVER (PARTITION BY crop ORDER BY area_mean DESC, adm_id ROWS UNBOUNDED PRECEDING) AS cum_area FROM us),
us3 AS (SELECT *, area_mean / crop_total_area * 100 AS area_prct, cum_area / crop_total_area * 100 AS cum_area_prct FROM us2)"""


_STATS_OUT = ["production_mean", "production_std", "yield_mean", "yield_std", "area_mean", "area_std", "area_prct", "cum_area_prct"]
_STATS_SELECT = "SELECT adm_id, crop, n, " + ", ".join(f"round({c}, 4) AS {c}" for c in _STATS_OUT)


def _stats_out(df):
    return df.select("adm_id", "crop", "n", *(F.round(c, 4).alias(c) for c in _STATS_OUT))


@query("unit_stats_lt", f"WITH {LABELS}, {_stats_sql('labels')} {_STATS_SELECT} FROM us3")
def unit_stats_lt(spark, sf):
    return _stats_out(panel.unit_statistics(_p(spark, sf)))


_LAST5 = "last5 AS (SELECT adm_id, crop, year, area, production, yield FROM (SELECT *, max(year) OVER (PARTITION BY adm_id, crop) AS ly FROM labels) WHERE year > ly - 5)"


@query("unit_stats_last5", f"WITH {LABELS}, {_LAST5}, {_stats_sql('last5')} {_STATS_SELECT} FROM us3")
def unit_stats_last5(spark, sf):
    return _stats_out(panel.unit_statistics(panel.last_years(_p(spark, sf))))


@query("retain_top_area", f"WITH {LABELS}, {_LAST5}, {_stats_sql('last5')} SELECT adm_id, crop, round(cum_area_prct, 4) AS cum_area_prct FROM us3 WHERE round(cum_area_prct - area_prct, 9) < 80")
def retain_top_area(spark, sf):
    return panel.retain(panel.unit_statistics(panel.last_years(_p(spark, sf))), 80).select("adm_id", "crop", F.round("cum_area_prct", 4).alias("cum_area_prct"))


@query("crop_area_rank", f"WITH {SPARSE} SELECT crop, area, round(area / sum(area) OVER () * 100, 6) AS area_prct, 0.0 AS missing_prct FROM (SELECT crop, sum(area) AS area FROM labels GROUP BY 1) ORDER BY area DESC, crop LIMIT 10")
def crop_area_rank(spark, sf):
    c = panel.crop_areas(_ps(spark, sf))
    return c.select("crop", "area", F.round("area_prct", 6).alias("area_prct"), "missing_prct").orderBy(F.desc("area"), "crop").limit(10)


_PAIR = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


@query(
    "crop_yield_corr",
    f"""WITH {LABELS} SELECT a.crop AS crop_a, b.crop AS crop_b, round({_PAIR.format(a='a.yield', b='b.yield')}, 6) + 0.0 AS r, count(*) AS n FROM labels a JOIN labels b ON a.adm_id = b.adm_id AND a.year = b.year AND a.crop < b.crop GROUP BY 1, 2""",
)
def crop_yield_corr(spark, sf):
    return panel.crop_correlation(_p(spark, sf)).withColumn("r", F.round("r", 6) + F.lit(0.0))


_THEIL = """pairs AS (SELECT a.adm_id, a.crop, (b.yield - a.yield) / (b.year - a.year) AS s FROM labels a JOIN labels b ON a.adm_id = b.adm_id AND a.crop = b.crop AND b.year > a.year),
sl AS (SELECT adm_id, crop, quantile_cont(s, 0.5) AS slope FROM pairs GROUP BY 1, 2), md AS (SELECT adm_id, crop, count(*) AS n, quantile_cont(yield, 0.5) AS my, quantile_cont(year, 0.5) AS mx FROM labels GROUP BY 1, 2)"""


@query("theil_sen", f"WITH {LABELS}, {_THEIL} SELECT adm_id, crop, CAST(n AS INT) AS n, round(slope, 6) + 0.0 AS slope, round(my - slope * mx, 3) + 0.0 AS intercept FROM md LEFT JOIN sl USING (adm_id, crop)")
def theil_sen(spark, sf):
    return trend.theil_sen(_p(spark, sf)).withColumns({"slope": F.round("slope", 6) + F.lit(0.0), "intercept": F.round("intercept", 3) + F.lit(0.0)})


@query(
    "mann_kendall",
    f"""WITH {LABELS}, s AS (SELECT a.adm_id, a.crop, sum(sign(b.yield - a.yield)) AS s FROM labels a JOIN labels b ON a.adm_id = b.adm_id AND a.crop = b.crop AND b.year > a.year GROUP BY 1, 2),
t AS (SELECT adm_id, crop, sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS tied FROM (SELECT adm_id, crop, yield, count(*) AS t FROM labels GROUP BY 1, 2, 3) GROUP BY 1, 2),
v AS (SELECT t.adm_id, t.crop, CAST(n AS INT) AS n, CAST(coalesce(s, 0) AS INT) AS s, (n * (n - 1) * (2 * n + 5) - tied) / 18.0 AS var_s FROM t LEFT JOIN s USING (adm_id, crop)),
z AS (SELECT *, CASE WHEN var_s <= 0 THEN 0.0 WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0.0 END AS z FROM v)
SELECT adm_id, crop, n, s, round(var_s, 6) AS var_s, round(z, 6) + 0.0 AS z, CASE WHEN abs(z) > 1.959964 AND z > 0 THEN 'increasing' WHEN abs(z) > 1.959964 THEN 'decreasing' ELSE 'no trend' END AS trend FROM z""",
)
def mann_kendall(spark, sf):
    return trend.mann_kendall(_p(spark, sf)).withColumns({"var_s": F.round("var_s", 6), "z": F.round("z", 6) + F.lit(0.0)})


FIRST_YEAR = 1997
_TREND = f"""grid AS (SELECT *, avg(yield) OVER (PARTITION BY adm_id, crop) AS mean, min(CASE WHEN yield IS NOT NULL THEN year END) OVER (PARTITION BY adm_id, crop) AS first_label FROM labels),
arms AS (SELECT t.adm_id, t.crop, t.year AS target, t.mean, p.year, p.yield, ({FIRST_YEAR} - t.first_label > 12
      OR (SELECT count(*) FROM grid x WHERE x.adm_id = t.adm_id AND x.crop = t.crop AND x.year < t.year) >= (SELECT count(*) FROM grid x WHERE x.adm_id = t.adm_id AND x.crop = t.crop AND x.year > t.year)) AS back
    FROM grid t JOIN grid p ON p.adm_id = t.adm_id AND p.crop = t.crop AND p.year <> t.year AND abs(p.year - t.year) <= 12),
arm AS (SELECT * FROM arms WHERE (back AND year < target) OR (NOT back AND year > target)),
q AS (SELECT adm_id, crop, target, any_value(mean) AS mean, count(*) AS n, count(yield) AS nv, quantile_cont(year, 0.5) AS q2, abs(min(year) - target) <= abs(max(year) - target) AS first_near FROM arm GROUP BY 1, 2, 3),
near AS (SELECT adm_id, crop, target, count(CASE WHEN yield IS NOT NULL AND ((first_near AND year <= q2) OR (NOT first_near AND year > q2)) THEN 1 END) AS k FROM arm JOIN q USING (adm_id, crop, target) GROUP BY 1, 2, 3),
sl AS (SELECT a.adm_id, a.crop, a.target, quantile_cont((b.yield - a.yield) / (b.year - a.year), 0.5) AS slope FROM arm a JOIN arm b ON a.adm_id = b.adm_id AND a.crop = b.crop AND a.target = b.target AND b.year > a.year WHERE a.yield IS NOT NULL AND b.yield IS NOT NULL GROUP BY 1, 2, 3),
md AS (SELECT adm_id, crop, target, quantile_cont(yield, 0.5) AS my, quantile_cont(year, 0.5) AS mx FROM arm WHERE yield IS NOT NULL GROUP BY 1, 2, 3),
tf AS (SELECT g.adm_id, g.crop, g.year, g.yield, g.area, g.mean, coalesce(q.n > 4 AND q.nv >= 4 AND near.k >= 2, false) AS accepted,
    least(greatest(slope * g.year + (my - slope * mx), g.mean * 0.25), g.mean * 1.75) AS estimate FROM grid g LEFT JOIN q ON q.adm_id = g.adm_id AND q.crop = g.crop AND q.target = g.year
    LEFT JOIN near ON near.adm_id = g.adm_id AND near.crop = g.crop AND near.target = g.year LEFT JOIN sl ON sl.adm_id = g.adm_id AND sl.crop = g.crop AND sl.target = g.year LEFT JOIN md ON md.adm_id = g.adm_id AND md.crop = g.crop AND md.target = g.year),
trend AS (SELECT *, CASE WHEN year >= {FIRST_YEAR} THEN CASE WHEN accepted THEN coalesce(estimate, mean) ELSE mean END END AS trend FROM tf)"""


@query("trend_feature", f"WITH {LABELS}, {_TREND} SELECT adm_id, crop, year, accepted, round(trend, 4) AS trend FROM trend")
def trend_feature(spark, sf):
    return trend.trend_feature(_p(spark, sf), FIRST_YEAR).select("adm_id", "crop", "year", "accepted", F.round("trend", 4).alias("trend"))
