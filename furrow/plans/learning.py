"""Queries of scaling, encoding, feature selection, task bookkeeping and model kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import compare, learn, paired, ranking, scaling, selection, specs
from furrow.plans.register import LABELS, SPARSE, query
from furrow.sources import tables

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _p(spark, sf):
    return tables.labels(spark, sf)


@query("scale_global", f"WITH {LABELS}, s AS (SELECT avg(yield) AS my, stddev_pop(yield) AS sy, avg(area) AS ma, stddev_pop(area) AS sa FROM labels) SELECT adm_id, crop, year, round((yield - my) / coalesce(nullif(sy, 0), 1), 6) + 0.0 AS yield_z, round((area - ma) / coalesce(nullif(sa, 0), 1), 6) + 0.0 AS area_z FROM labels, s")
def scale_global(spark, sf):
    return scaling.scale_global(_p(spark, sf), ["yield", "area"]).select("adm_id", "crop", "year", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("yield_z", "area_z")))


@query("scale_by_unit", f"WITH {LABELS} SELECT adm_id, crop, year, round((yield - avg(yield) OVER w) / nullif(stddev_samp(yield) OVER w, 0), 6) + 0.0 AS yield_z FROM labels WINDOW w AS (PARTITION BY adm_id)")
def scale_by_unit(spark, sf):
    return scaling.scale_by(_p(spark, sf), ["adm_id"], ["yield"]).select("adm_id", "crop", "year", (F.round("yield_z", 6) + F.lit(0.0)).alias("yield_z"))


@query("one_hot_units", f"WITH {LABELS} SELECT adm_id, crop, year, " + ", ".join(f"CAST(adm_id = {i} AS DOUBLE) AS adm_id_{i}" for i in range(25)) + " FROM labels")
def one_hot_units(spark, sf):
    return scaling.one_hot(_p(spark, sf).select("adm_id", "crop", "year"), "adm_id", list(range(25)))


@query("loo_target_encoding", f"WITH {LABELS} SELECT adm_id, crop, year, round(coalesce((sum(yield) OVER w - yield) / nullif(count(yield) OVER w - 1, 0), (SELECT avg(yield) FROM labels)), 4) AS crop_loo FROM labels WINDOW w AS (PARTITION BY crop)")
def loo_target_encoding(spark, sf):
    return scaling.leave_one_out(_p(spark, sf), "crop", "yield").select("adm_id", "crop", "year", F.round("crop_loo", 4).alias("crop_loo"))


@query("shrunk_target_encoding", f"WITH {LABELS} SELECT adm_id, crop, year, round((sum(yield) OVER w + (SELECT avg(yield) FROM labels) * 10) / (count(yield) OVER w + 10), 4) AS adm_id_mean FROM labels WINDOW w AS (PARTITION BY adm_id)")
def shrunk_target_encoding(spark, sf):
    return scaling.shrunk_mean(_p(spark, sf), "adm_id", "yield").select("adm_id", "crop", "year", F.round("adm_id_mean", 4).alias("adm_id_mean"))


def _rows(spark, sf):
    return tables.read(spark, sf, "lineitem").select(*FEATURES, "l_returnflag", F.dayofyear("l_shipdate").cast("double").alias("target"))


_ROWS = f"WITH x AS (SELECT {', '.join(FEATURES)}, l_returnflag, CAST(dayofyear(CAST(l_shipdate AS DATE)) AS DOUBLE) AS target FROM lineitem)"


def _corr(a: str, b: str) -> str:
    return f"(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0))"


@query("mrmr_relevance_regression", f"{_ROWS} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n, round({_corr(f, 'target')} ^ 2 / nullif(1 - {_corr(f, 'target')} ^ 2, 0) * (count(*) - 2), 6) AS f FROM x" for f in FEATURES))
def mrmr_relevance_regression(spark, sf):
    return selection.relevance_regression(_rows(spark, sf), FEATURES, "target").withColumn("f", F.round("f", 6))


@query("mrmr_relevance_classif", f"{_ROWS}, u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, l_returnflag AS k, {f} AS v FROM x" for f in FEATURES) + """), g AS (SELECT feature, k, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM u GROUP BY 1, 2), a AS (SELECT feature, count(*) AS kk, sum(n) AS n, sum(n * m) / sum(n) AS mean, sum(n * m * m) AS nmm, sum(n * s) AS w FROM g GROUP BY 1)
SELECT feature, round(((nmm - n * mean * mean) / (kk - 1)) / (w / (n - kk)), 4) AS f FROM a""")
def mrmr_relevance_classif(spark, sf):
    return selection.relevance_classes(_rows(spark, sf), FEATURES, "l_returnflag").withColumn("f", F.round("f", 4))


@query("mrmr_redundancy", f"{_ROWS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_corr(a, b)}, 6) + 0.0 AS r FROM x" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]))
def mrmr_redundancy(spark, sf):
    return selection.correlations(_rows(spark, sf), FEATURES).withColumn("r", F.round("r", 6) + F.lit(0.0))


@query("ks_relevance", f"{_ROWS}, u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, l_returnflag AS k, {f} AS v FROM x" for f in FEATURES) + """), vals AS (SELECT feature, v, count(*) AS nv FROM u GROUP BY 1, 2), kc AS (SELECT feature, k, count(*) AS nk FROM u GROUP BY 1, 2), na AS (SELECT feature, count(*) AS n FROM u GROUP BY 1),
own AS (SELECT feature, k, v, count(*) AS n FROM u GROUP BY 1, 2, 3), grid AS (SELECT vals.feature, kc.k, vals.v, sum(coalesce(own.n, 0)) OVER w AS o, sum(nv) OVER w AS e, nk, na.n AS n FROM vals JOIN kc USING (feature) JOIN na USING (feature) LEFT JOIN own ON own.feature = vals.feature AND own.k = kc.k AND own.v = vals.v WINDOW w AS (PARTITION BY vals.feature, kc.k ORDER BY vals.v ROWS UNBOUNDED PRECEDING)),
d AS (SELECT feature, k, max(abs(o / nk - (e - o) / (n - nk))) AS d FROM grid GROUP BY 1, 2) SELECT feature, round(avg(d), 6) AS ks FROM d GROUP BY 1""")
def ks_relevance(spark, sf):
    return selection.relevance_ks(_rows(spark, sf), FEATURES, "l_returnflag").withColumn("ks", F.round("ks", 6))


# --- task tables

_AXES = """c AS (SELECT DISTINCT p_type AS crop FROM part), a AS (SELECT unnest(['Lasso', 'SVR_linear', 'GPR']) AS algorithm), s AS (SELECT unnest(['rs', 'rs_reduced', 'met']) AS feature_set), r AS (SELECT unnest(['none', 'PCA']) AS reduction), k AS (SELECT unnest(['none', 'MRMR']) AS selection), o AS (SELECT unnest([true, false]) AS one_hot), t AS (SELECT unnest([1, 4]) AS lead_time),
specs AS (SELECT crop, algorithm, feature_set, reduction, selection, one_hot, CAST(lead_time AS INT) AS lead_time FROM c, a, s, r, k, o, t WHERE NOT (reduction = 'PCA' AND lead_time = 1) AND NOT (reduction = 'PCA' AND selection = 'MRMR')),
num AS (SELECT CAST(row_number() OVER (ORDER BY lead_time, crop, algorithm, feature_set, reduction, selection, one_hot) AS INT) AS run_id, * FROM specs)"""


def _axes(spark, sf):
    return {"crop": tables.crops(spark, sf)} | specs.AXES


@query("spec_grid", f"WITH {_AXES} SELECT * FROM num")
def spec_grid(spark, sf):
    return specs.grid(spark, _axes(spark, sf))


@query("spec_grid_reduced", f"WITH {_AXES} SELECT algorithm, lead_time, count(*) AS n FROM specs WHERE algorithm = 'Lasso' AND feature_set IN ('rs') GROUP BY 1, 2")
def spec_grid_reduced(spark, sf):
    return specs.grid(spark, specs.narrow(_axes(spark, sf), {"algorithm": ["Lasso"], "feature_set": ["rs"]})).groupBy("algorithm", "lead_time").agg(F.count("*").alias("n"))


@query("model_description", f"WITH {_AXES} SELECT run_id, concat_ws(', ', algorithm, CASE WHEN one_hot THEN 'one-hot units' END, CASE WHEN lead_time > 1 THEN 'trend' END, feature_set, CASE WHEN reduction <> 'none' THEN reduction END, CASE WHEN selection <> 'none' THEN selection || ' 50%' END) AS description FROM num")
def model_description(spark, sf):
    g = specs.grid(spark, _axes(spark, sf)).withColumns({"trend": F.col("lead_time") > 1, "prct": F.lit(50)})
    return ranking.describe(g).select("run_id", "description")


@query("slow_first", f"WITH {_AXES} SELECT run_id, CAST(row_number() OVER (ORDER BY CASE WHEN selection <> 'none' THEN 0 ELSE 1 END, run_id) AS INT) AS run_order FROM num")
def slow_first(spark, sf):
    return ranking.slow_first(specs.grid(spark, _axes(spark, sf))).select("run_id", "run_order")


@query("missing_runs", f"WITH {_AXES} SELECT run_id, algorithm FROM num WHERE run_id % 5 = 0 OR run_id BETWEEN 20 AND 23")
def missing_runs(spark, sf):
    g = specs.grid(spark, _axes(spark, sf))
    done = g.where("NOT (run_id % 5 = 0 OR run_id BETWEEN 20 AND 23)").select("run_id")
    return compare.missing(g, done, "run_id").select("run_id", "algorithm")


@query("run_id_gaps", f"WITH {_AXES}, done AS (SELECT run_id FROM num WHERE NOT (run_id % 5 = 0 OR run_id BETWEEN 20 AND 23)) SELECT run_id FROM num WHERE run_id NOT IN (SELECT run_id FROM done) AND run_id BETWEEN (SELECT min(run_id) FROM done) AND (SELECT max(run_id) FROM done)")
def run_id_gaps(spark, sf):
    return compare.id_gaps(specs.grid(spark, _axes(spark, sf)).where("NOT (run_id % 5 = 0 OR run_id BETWEEN 20 AND 23)"), "run_id")


@query("table_diff", f"WITH {SPARSE}, l AS (SELECT adm_id, crop, year, round(yield, 3) AS yield FROM labels), r AS (SELECT adm_id, crop, year, round(CASE WHEN adm_id = 3 AND year = 1998 THEN yield + 1 ELSE yield END, 3) AS yield FROM labels WHERE NOT (adm_id = 5 AND year = 1999)) SELECT *, 'left_only' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right_only' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)")
def table_diff(spark, sf):
    left = tables.labels(spark, sf, crop="p_brand").select("adm_id", "crop", "year", "yield")
    right = left.where("NOT (adm_id = 5 AND year = 1999)").withColumn("yield", F.when((F.col("adm_id") == 3) & (F.col("year") == 1998), F.col("yield") + 1).otherwise(F.col("yield")))
    return compare.table_diff(left, right, 3)


@query("coverage_both_ways", "WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS k FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS k FROM lineitem) SELECT coalesce(a.k, b.k) AS day, CASE WHEN a.k IS NULL THEN 'right_only' ELSE 'left_only' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def coverage_both_ways(spark, sf):
    ordered = tables.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return compare.coverage(ordered, tables.read(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")), "day")


# --- model kernels: one group per (crop, held-out year) task, no SQL form


def _model_table(spark, sf):
    ind = tables.indicators(spark, sf)
    x = ind.groupBy("adm_id", F.year("date").alias("year")).pivot("variable_name", list(tables.VARIABLES)).agg(F.avg("mean"))
    return _p(spark, sf).join(x, ["adm_id", "year"]).select("adm_id", "crop", "year", "yield", *tables.VARIABLES)


def _nested(kind: str):
    def plan(spark, sf):
        return learn.nested_cv(_model_table(spark, sf), kind, list(tables.VARIABLES))

    return plan


for _kind in ("svr", "gpr", "mlp"):
    query(f"{_kind}_nested_cv")(_nested(_kind))


@query("forest_forecast")
def forest_forecast(spark, sf):
    return learn.trees(_model_table(spark, sf), list(tables.VARIABLES), "forest", 2001)


@query("boosted_forecast")
def boosted_forecast(spark, sf):
    return learn.trees(_model_table(spark, sf), list(tables.VARIABLES), "boosted", 2001)




@query("paired_test_pvalue")
def paired_test_pvalue(spark, sf):
    from furrow.plans.models import _runs

    r = _runs(spark, sf)
    e = lambda m, c: r.where(F.col("model") == m).select("crop", "adm_id", "year", F.pow(F.col("y_true") - F.col("y_pred"), 2).alias(c))
    t = paired.paired_tests(e("Null_model", "x").join(e("Trend", "y"), ["crop", "adm_id", "year"]), ["crop"], "x", "y", ["adm_id", "year"])
    return t.select("crop", "n", "shapiro_w", "shapiro_p", "w_plus", "wilcoxon_p", "t", "t_p", "inverted_p", "standard_p")
