"""Queries of linear models, components, tuning records and selection options."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from furrow.operators import metrics, selection, tuning
from furrow.plans.learning import _ROWS, FEATURES, _corr, _model_table, _rows
from furrow.plans.register import LABELS, MONTHS, query
from furrow.sources import tables

INPUTS = list(tables.VARIABLES)
_X = f"""x AS (SELECT adm_id, CAST(year(date) AS INT) AS year, avg(CASE WHEN variable_name = 'rainfall' THEN mean END) AS rainfall, avg(CASE WHEN variable_name = 'temperature' THEN mean END) AS temperature, avg(CASE WHEN variable_name = 'FPAR' THEN mean END) AS FPAR FROM ind GROUP BY 1, 2),
{LABELS[LABELS.index("labels AS"):]},
t AS (SELECT labels.adm_id, crop, labels.year, yield, rainfall, temperature, FPAR FROM labels JOIN x USING (adm_id, year))"""


@query("year_moments", f"WITH {MONTHS}, {_X} SELECT crop, year, count(*) AS n, round(sum(rainfall), 2) AS s_rainfall, round(sum(temperature), 4) AS s_temperature, round(sum(yield), 2) AS s_yield, round(sum(temperature * FPAR), 3) AS s_temperature_fpar, round(sum(temperature * yield), 1) AS s_temperature_yield FROM t GROUP BY 1, 2")
def year_moments(spark, sf):
    m = tuning.moments(_model_table(spark, sf), ["crop", "year"], INPUTS, "yield")
    at = {f: i for i, f in enumerate(INPUTS)}
    product = F.col("sxx")[at["temperature"] * len(INPUTS) + at["FPAR"]]
    return m.select("crop", "year", "n", F.round(F.col("sx")[at["rainfall"]], 2).alias("s_rainfall"), F.round(F.col("sx")[at["temperature"]], 4).alias("s_temperature"), F.round("sy", 2).alias("s_yield"), F.round(product, 3).alias("s_temperature_fpar"), F.round(F.col("sxy")[at["temperature"]], 1).alias("s_temperature_yield"))


def _folds(spark, sf, alphas=tuning.LASSO_ALPHAS):
    return tuning.lasso(_model_table(spark, sf), INPUTS, alphas)


@query("lasso_nested_cv")
def lasso_nested_cv(spark, sf):
    return tuning.held_out_predictions(_model_table(spark, sf), _folds(spark, sf), INPUTS)


@query("lasso_cv_path")
def lasso_cv_path(spark, sf):
    return _folds(spark, sf, None).select("crop", "held", F.round("alpha", 6).alias("alpha"), F.round("rmse_val", 6).alias("rmse_val"))


@query("lasso_fast")
def lasso_fast(spark, sf):
    f = tuning.lasso(_model_table(spark, sf), INPUTS, nested=False)
    grid = ",".join(str(round(a, 6)) for a in tuning.LASSO_ALPHAS)
    return f.select("crop", F.round("rmse_val", 6).alias("rmse_val"), tuning.hyper_text("alpha", F.col("alpha")).alias("hyper_params"), F.lit(f"alpha:{grid}").alias("hyper_grid"), tuning.coefficients(INPUTS).alias("coefficients"))


@query("pegging_rate")
def pegging_rate(spark, sf):
    return tuning.pegged(_folds(spark, sf), "alpha", "alpha", F.col("first"), F.col("last"))


@query("lasso_forecast")
def lasso_forecast(spark, sf):
    """The fit over all years before the last, applied to the last."""
    t = _model_table(spark, sf)
    return tuning.forecasts(t.where("year = 2001"), tuning.lasso(t.where("year < 2001"), INPUTS, nested=False), INPUTS)


@query("result_row")
def result_row(spark, sf):
    """One row per run: its settings, the choice of hyper-parameters, how often they were at an end of their grid, and its errors."""
    t, folds = _model_table(spark, sf), _folds(spark, sf)
    res = tuning.held_out_predictions(t, folds, INPUTS).join(tables.labels(spark, sf).select("adm_id", "crop", "year", "area"), ["adm_id", "crop", "year"]).withColumns({"run_id": F.lit(1), "model": F.lit("Lasso")})
    error = lambda df, *names, tag="": df.select("crop", *(F.round(c, 5).alias(c + tag) for c in names))
    out = error(metrics.overall(res), "rmse", "rrmse_prct", "mae", "me", "r2")
    out = out.join(error(metrics.averaged(res, "year"), "rmse", "r2", tag="_spatial"), "crop").join(error(metrics.averaged(res, "adm_id"), "r2", tag="_temporal"), "crop")
    out = out.join(error(metrics.country_summary(res), "rmse", "rrmse_prct", "r2", tag="_country"), "crop").join(error(metrics.lowest_quartile(res), "rmse", tag="_low_quartile"), "crop")
    out = out.join(folds.groupBy("crop").agg(F.round(F.avg("rmse_val"), 5).alias("rmse_val")), "crop").join(pegging_rate(spark, sf), "crop").join(lasso_fast(spark, sf).drop("rmse_val"), "crop")
    names = F.array(*map(F.lit, INPUTS))
    return out.select(F.lpad(F.lit("1"), 6, "0").alias("run_id"), F.lit("Lasso").alias("estimator"), F.size(names).alias("n_features"), F.concat_ws(",", names).alias("features"), *out.columns)


SEASON_MONTHS = [f"{v}M{m}" for v in ("temperature", "FPAR") for m in range(1, 5)]


@query("pca_features")
def pca_features(spark, sf):
    """Components of each variable's first four months; rain is left as it is."""
    month = F.month("month")
    m = _monthly(spark, sf).where(month <= 4)
    wide = m.groupBy("adm_id", F.year("month").alias("year")).pivot("name", SEASON_MONTHS).agg(F.first("mean"))
    table = tables.labels(spark, sf).select("crop", "adm_id", "year").join(wide, ["adm_id", "year"])
    return tuning.component_scores(table, ["crop"], {v: [c for c in SEASON_MONTHS if c.startswith(v)] for v in ("temperature", "FPAR")}, 0.9)


def _monthly(spark, sf):
    from furrow.operators import features

    return features.monthly(tables.indicators(spark, sf).where("variable_name <> 'rainfall'")).withColumn("name", F.concat("variable_name", F.lit("M"), F.month("month").cast("string")))


# --- selection

_RELEVANCE = "rel AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {i} AS ord, {_corr(f, 'target')} ^ 2 / nullif(1 - {_corr(f, 'target')} ^ 2, 0) * (count(*) - 2) AS f FROM x" for i, f in enumerate(FEATURES)) + ")"
_COR = "cor AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, greatest(abs({_corr(a, b)}), 0.001) AS r FROM x" for a in FEATURES for b in FEATURES if a != b) + ")"


@query(
    "mrmr_select",
    f"""{_ROWS}, {_RELEVANCE}, {_COR},
c1 AS (SELECT feature, f AS score FROM rel WHERE f > 0 ORDER BY f DESC, ord LIMIT 1),
s2 AS (SELECT rel.feature, ord, f, r FROM rel JOIN cor ON cor.feature = rel.feature JOIN c1 ON c1.feature = cor.other WHERE f > 0),
c2 AS (SELECT feature, CASE WHEN r = 1 THEN 0 ELSE f / r END AS score FROM s2 ORDER BY 2 DESC, ord LIMIT 1),
s3 AS (SELECT rel.feature, ord, f, avg(r) AS r FROM rel JOIN cor ON cor.feature = rel.feature WHERE f > 0 AND other IN (SELECT feature FROM c1 UNION ALL SELECT feature FROM c2) AND rel.feature NOT IN (SELECT feature FROM c1 UNION ALL SELECT feature FROM c2) GROUP BY 1, 2, 3),
c3 AS (SELECT feature, CASE WHEN r = 1 THEN 0 ELSE f / r END AS score FROM s3 ORDER BY 2 DESC, ord LIMIT 1)
SELECT CAST(rank AS INT) AS rank, feature, round(score, 3) AS score FROM (SELECT 1 AS rank, * FROM c1 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3)""",
)
def mrmr_select(spark, sf):
    return selection.mrmr_regression(_rows(spark, sf), FEATURES, "target", 3).withColumn("score", F.round("score", 3))


_DOMAINS = {"rs_quantity": "l_quantity", "rs_price": "l_extendedprice", "met_discount": "l_discount", "met_tax": "l_tax"}
_DOMAIN_REL = "rel AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {i} AS ord, {_corr(c, 'target')} ^ 2 / nullif(1 - {_corr(c, 'target')} ^ 2, 0) * (count(*) - 2) AS f FROM x" for i, (f, c) in enumerate(_DOMAINS.items())) + ")"
_DOMAIN_COR = "cor AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, greatest(abs({_corr(ca, cb)}), 0.001) AS r FROM x" if a.split("_")[0] == b.split("_")[0] else f"SELECT '{a}', '{b}', 0.001" for a, ca in _DOMAINS.items() for b, cb in _DOMAINS.items() if a != b) + ")"


@query(
    "mrmr_same_domain",
    f"""{_ROWS}, {_DOMAIN_REL}, {_DOMAIN_COR},
c1 AS (SELECT feature, f AS score FROM rel WHERE f > 0 ORDER BY f DESC, ord LIMIT 1),
s2 AS (SELECT rel.feature, ord, f, r FROM rel JOIN cor ON cor.feature = rel.feature JOIN c1 ON c1.feature = cor.other WHERE f > 0),
c2 AS (SELECT feature, CASE WHEN r = 1 THEN 0 ELSE f / r END AS score FROM s2 ORDER BY 2 DESC, ord LIMIT 1),
s3 AS (SELECT rel.feature, ord, f, max(r) AS r FROM rel JOIN cor ON cor.feature = rel.feature WHERE f > 0 AND other IN (SELECT feature FROM c1 UNION ALL SELECT feature FROM c2) AND rel.feature NOT IN (SELECT feature FROM c1 UNION ALL SELECT feature FROM c2) GROUP BY 1, 2, 3),
c3 AS (SELECT feature, CASE WHEN r = 1 THEN 0 ELSE f / r END AS score FROM s3 ORDER BY 2 DESC, ord LIMIT 1)
SELECT CAST(rank AS INT) AS rank, feature, round(score, 3) AS score FROM (SELECT 1 AS rank, * FROM c1 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3)""",
)
def mrmr_same_domain(spark, sf):
    """Redundancy within a domain only (the name's first part), and the largest one as denominator."""
    rows = _rows(spark, sf).select(*(F.col(c).alias(f) for f, c in _DOMAINS.items()), "target")
    return selection.mrmr_regression(rows, list(_DOMAINS), "target", 3, mean=False, same_domain=True).withColumn("score", F.round("score", 3))


@query("mrmr_classif")
def mrmr_classif(spark, sf):
    return selection.mrmr_classif(_rows(spark, sf), FEATURES, "l_returnflag", 3, mean=False)


@query("mrmr_by_ks")
def mrmr_by_ks(spark, sf):
    """The selection with a relevance of its own."""
    return selection.mrmr_classif(_rows(spark, sf), FEATURES, "l_returnflag", 2, relevance=lambda df, fs, y: selection.relevance_ks(df, fs, y).withColumnRenamed("ks", "f"))


@query("forest_importance")
def forest_importance(spark, sf):
    return selection.forest_importance(_rows(spark, sf), FEATURES, "target")


@query("best_feature_count")
def best_feature_count(spark, sf):
    """Of the numbers of features that a grid of percentages stands for, the one with the best validation error, per crop."""
    t = _model_table(spark, sf)
    ranked = [r.feature for r in selection.mrmr_regression(t, INPUTS, "yield", len(INPUTS)).orderBy("rank").collect()]
    scores = None
    for percent, n in selection.percent_grid(len(ranked), [5, 25, 50, 75, 100]):
        one = tuning.lasso(t, ranked[:n], nested=False).select("crop", F.lit(percent).alias("percent"), F.lit(n).alias("n_features"), F.round(-F.col("rmse_val"), 6).alias("score"))
        scores = one if scores is None else scores.unionByName(one)
    return selection.best_count(scores)


@query(
    "james_stein_encoding",
    f"""WITH {LABELS}, w AS (SELECT var_samp(yield) AS v, avg(yield) AS m FROM labels), c AS (SELECT crop, avg(yield) AS cm, var_samp(yield) / count(yield) AS noise FROM labels GROUP BY 1)
SELECT adm_id, labels.crop, year, round((1 - b) * cm + b * m, 4) AS crop_js FROM labels JOIN (SELECT crop, cm, m, coalesce(noise / nullif(noise + v, 0), 1.0) AS b FROM c, w) USING (crop)""",
)
def james_stein_encoding(spark, sf):
    from furrow.operators import scaling

    return scaling.james_stein(tables.labels(spark, sf), "crop", "yield").select("adm_id", "crop", "year", F.round("crop_js", 4).alias("crop_js"))


@query("label_scaling", f"WITH {LABELS}, z AS (SELECT adm_id, crop, year, yield, (yield - avg(yield) OVER ()) / stddev_pop(yield) OVER () AS z, avg(yield) OVER () AS m, stddev_pop(yield) OVER () AS s FROM labels) SELECT adm_id, crop, year, round(z, 6) + 0.0 AS yield_z, round(z * s + m, 4) AS yield_back FROM z")
def label_scaling(spark, sf):
    """Labels scaled like features, and predictions in their scale turned back."""
    from furrow.operators import scaling

    labels = tables.labels(spark, sf)
    s = labels.agg(F.avg("yield").alias("m"), F.stddev_pop("yield").alias("s"))
    z = scaling.scale_global(labels, ["yield"]).crossJoin(F.broadcast(s))
    return z.select("adm_id", "crop", "year", (F.round("yield_z", 6) + F.lit(0.0)).alias("yield_z"), F.round(F.col("yield_z") * F.col("s") + F.col("m"), 4).alias("yield_back"))


@query("finite_correlation", f"WITH {LABELS} SELECT adm_id, year, count(yield) AS n, CASE WHEN count(yield) >= 2 THEN round(covar_pop(area, yield) / nullif(stddev_pop(area) * stddev_pop(yield), 0), 6) + 0.0 END AS r FROM labels GROUP BY 1, 2")
def finite_correlation(spark, sf):
    from furrow.functions import stats

    g = tables.labels(spark, sf).groupBy("adm_id", "year").agg(stats.pairs(F.col("area"), F.col("yield")).alias("n"), stats.pearson_finite(F.col("area"), F.col("yield")).alias("r"))
    return g.withColumn("r", F.round("r", 6) + F.lit(0.0))


_R = "covar_pop(area, yield) / nullif(stddev_pop(area) * stddev_pop(yield), 0)"


@query("pearson_t", f"WITH {LABELS}, g AS (SELECT crop, count(*) AS n, {_R} AS r FROM labels GROUP BY 1) SELECT crop, n, round(r, 6) + 0.0 AS r, round(r * sqrt((n - 2) / (1 - r * r)), 5) + 0.0 AS t FROM g")
def pearson_t(spark, sf):
    return pearson_pvalue(spark, sf).select("crop", "n", (F.round("r", 6) + F.lit(0.0)).alias("r"), (F.round("t", 5) + F.lit(0.0)).alias("t"))


@query("pearson_pvalue")
def pearson_pvalue(spark, sf):
    from furrow.functions import stats

    g = tables.labels(spark, sf).groupBy("crop").agg(stats.pairs(F.col("area"), F.col("yield")).alias("n"), stats.pearson_finite(F.col("area"), F.col("yield")).alias("r"))
    g = g.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0))))
    return g.withColumn("p", stats.t_two_sided(F.col("t"), F.col("n") - 2))


_TRUE_PRED = f"WITH {LABELS}, p AS (SELECT crop, yield AS t, lag(yield) OVER (PARTITION BY adm_id, crop ORDER BY year) AS p FROM labels), q AS (SELECT * FROM p WHERE p IS NOT NULL)"


@query("taylor_statistics", f"{_TRUE_PRED} SELECT crop, count(*) AS n, round(stddev_pop(t), 5) AS sd_true, round(stddev_pop(p), 5) AS sd_pred, round(sqrt(var_pop(p - t)), 5) AS centred_rmsd, round(covar_pop(p, t) / nullif(stddev_pop(p) * stddev_pop(t), 0), 6) + 0.0 AS r FROM q GROUP BY 1")
def taylor_statistics(spark, sf):
    """Of the persistence forecast: last year's yield."""
    from furrow.functions import stats

    w = Window.partitionBy("adm_id", "crop").orderBy("year")
    p = tables.labels(spark, sf).select("crop", F.col("yield").alias("t"), F.lag("yield").over(w).alias("p"))
    g = p.groupBy("crop").agg(*(c.alias(k) for k, c in stats.taylor(F.col("p"), F.col("t")).items()))
    return g.select("crop", "n", *(F.round(c, 5).alias(c) for c in ("sd_true", "sd_pred", "centred_rmsd")), (F.round("r", 6) + F.lit(0.0)).alias("r"))
