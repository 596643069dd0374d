"""Queries of benchmark models, their errors, rankings and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import benchmarks, compare, exchange, features, forecast, metrics, paired, panel, ranking, results, seasonal
from furrow.plans.panels import _TREND, FIRST_YEAR
from furrow.plans.register import LABELS, MONTHS, query
from furrow.sources import tables

R6 = lambda c: F.round(c, 6) + F.lit(0.0)


def _peaks(spark, sf):
    m = features.monthly(tables.indicators(spark, sf).where("variable_name = 'FPAR'"))
    return m.groupBy("adm_id", F.year("month").alias("year")).agg(F.round(F.max("max"), 6).alias("peak"))


def _runs(spark, sf):
    return benchmarks.runs(tables.labels(spark, sf), _peaks(spark, sf), FIRST_YEAR)


_PEAKS = "peaks AS (SELECT adm_id, CAST(year(month) AS INT) AS year, round(max(max), 6) AS peak FROM months WHERE variable_name = 'FPAR' GROUP BY 1, 2)"
_LABELS_ONLY = LABELS[LABELS.index("labels AS") :]
_NULL = "nullm AS (SELECT *, (sum(yield) OVER w - yield) / nullif(count(yield) OVER w - 1, 0) AS predicted FROM labels WINDOW w AS (PARTITION BY adm_id, crop))"
_PEAK = """px AS (SELECT l.*, peak FROM labels l LEFT JOIN peaks USING (adm_id, year)),
tot AS (SELECT *, CASE WHEN peak IS NULL THEN 0.0 ELSE 1.0 END AS u, count(peak) OVER w AS tn, sum(peak) OVER w AS tx, sum(CASE WHEN peak IS NOT NULL THEN yield END) OVER w AS ty, sum(peak * yield) OVER w AS txy, sum(peak * peak) OVER w AS txx FROM px WINDOW w AS (PARTITION BY adm_id, crop)),
own AS (SELECT *, tn - u AS n, tx - coalesce(peak, 0) AS x, ty - u * yield AS y, txy - coalesce(peak, 0) * yield AS xy, txx - coalesce(peak, 0) * coalesce(peak, 0) AS xx FROM tot),
sl AS (SELECT *, CASE WHEN abs(n * xx - x * x) > 1e-9 THEN (n * xy - x * y) / (n * xx - x * x) END AS slope FROM own),
peakm AS (SELECT *, slope * peak + (y - slope * x) / nullif(n, 0) AS predicted FROM sl)"""
_BOUND = lambda c: f"CASE WHEN {c} IS NOT NULL THEN round(greatest({c}, 0.0), 6) END"
RES = f"""WITH {MONTHS},
{_PEAKS},
{_LABELS_ONLY},
{_NULL},
{_PEAK.replace('sl AS', 'psl AS').replace('FROM sl)', 'FROM psl)')},
{_TREND},
res AS (SELECT 1 AS run_id, 'Null_model' AS model, adm_id, crop, year, yield AS y_true, {_BOUND('predicted')} AS y_pred, area FROM nullm
    UNION ALL SELECT 2, 'Trend', adm_id, crop, year, yield, {_BOUND('trend')}, area FROM trend UNION ALL SELECT 3, 'PeakModel', adm_id, crop, year, yield, {_BOUND('predicted')}, area FROM peakm)"""


@query("null_loyo", f"WITH {LABELS}, {_NULL} SELECT adm_id, crop, year, round(predicted, 4) AS predicted FROM nullm")
def null_loyo(spark, sf):
    return benchmarks.null_model(tables.labels(spark, sf)).select("adm_id", "crop", "year", F.round("predicted", 4).alias("predicted"))


@query("trend_loyo", f"WITH {LABELS}, {_TREND} SELECT adm_id, crop, year, round(greatest(trend, 0), 4) AS predicted FROM trend WHERE trend IS NOT NULL")
def trend_loyo(spark, sf):
    return benchmarks.not_negative(benchmarks.trend_model(tables.labels(spark, sf), FIRST_YEAR)).where("predicted IS NOT NULL").select("adm_id", "crop", "year", F.round("predicted", 4).alias("predicted"))


@query("peak_loyo", f"WITH {MONTHS}, {_PEAKS}, {_LABELS_ONLY}, {_PEAK} SELECT adm_id, crop, year, round(predicted, 3) AS predicted FROM peakm")
def peak_loyo(spark, sf):
    p = benchmarks.peak_model(tables.labels(spark, sf).join(_peaks(spark, sf), ["adm_id", "year"], "left"), "peak")
    return p.select("adm_id", "crop", "year", F.round("predicted", 3).alias("predicted"))


_OK = "y_pred IS NOT NULL AND y_true IS NOT NULL"
_SUMMARY = {
    "me": "avg(y_pred - y_true)", "mae": "avg(abs(y_true - y_pred))", "rmse": "sqrt(avg((y_true - y_pred) ^ 2))", "rmae_prct": "avg(abs(y_true - y_pred)) / nullif(avg(y_true), 0) * 100", "rrmse_prct": "sqrt(avg((y_true - y_pred) ^ 2)) / nullif(avg(y_true), 0) * 100",
    "r2": f"1 - sum((y_true - y_pred) ^ 2) / nullif(var_pop(CASE WHEN {_OK} THEN y_true END) * count(CASE WHEN {_OK} THEN 1 END), 0)",
    "r2_pearson": f"(covar_pop(CASE WHEN {_OK} THEN y_pred END, CASE WHEN {_OK} THEN y_true END) / nullif(stddev_pop(CASE WHEN {_OK} THEN y_pred END) * stddev_pop(CASE WHEN {_OK} THEN y_true END), 0)) ^ 2",
}


def _summary_sql(source: str, by: str, names=tuple(_SUMMARY), digits: int = 5) -> str:
    return f"SELECT {by}, count(CASE WHEN {_OK} THEN 1 END) AS n, " + ", ".join(f"round({_SUMMARY[k]}, {digits}) + 0.0 AS {k}" for k in names) + f" FROM {source} GROUP BY {by}"


def _out(df, by, names=tuple(_SUMMARY), digits=5):
    return df.select(*by, "n", *((F.round(c, digits) + F.lit(0.0)).alias(c) for c in names))


@query("metrics_overall", f"{RES} {_summary_sql('res', 'run_id, model, crop')}")
def metrics_overall(spark, sf):
    return _out(metrics.overall(_runs(spark, sf)), metrics.RUN)


@query("metrics_by_unit", f"{RES} {_summary_sql('res', 'run_id, model, crop, adm_id')}")
def metrics_by_unit(spark, sf):
    return _out(metrics.by_unit(_runs(spark, sf)), [*metrics.RUN, "adm_id"])


def _averaged_sql(over: str) -> str:
    inner = f"SELECT run_id, model, crop, {over}, " + ", ".join(f"{_SUMMARY[k]} AS {k}" for k in ("mae", "me", "rmse", "r2")) + f" FROM res GROUP BY 1, 2, 3, 4"
    return f"{RES} SELECT run_id, model, crop, count(*) AS n_groups, " + ", ".join(f"round(avg({k}), 5) + 0.0 AS {k}" for k in ("mae", "me", "rmse", "r2")) + f" FROM ({inner}) GROUP BY 1, 2, 3"


@query("metrics_spatial", _averaged_sql("year"))
def metrics_spatial(spark, sf):
    a = metrics.averaged(_runs(spark, sf), "year")
    return a.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("mae", "me", "rmse", "r2")})


@query("metrics_temporal", _averaged_sql("adm_id"))
def metrics_temporal(spark, sf):
    a = metrics.averaged(_runs(spark, sf), "adm_id")
    return a.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("mae", "me", "rmse", "r2")})


_COUNTRY = "country AS (SELECT run_id, model, crop, year, sum(y_true * area) / nullif(sum(area), 0) AS y_true, sum(y_pred * area) / nullif(sum(area), 0) AS y_pred FROM res GROUP BY 1, 2, 3, 4)"


@query("metrics_country_year", f"{RES}, {_COUNTRY} SELECT run_id, model, crop, year, round(y_true, 5) AS y_true, round(y_pred, 5) AS y_pred FROM country")
def metrics_country_year(spark, sf):
    return metrics.country(_runs(spark, sf)).select(*metrics.RUN, "year", F.round("y_true", 5).alias("y_true"), F.round("y_pred", 5).alias("y_pred"))


@query("metrics_country", f"{RES}, {_COUNTRY} {_summary_sql('country', 'run_id, model, crop')}")
def metrics_country(spark, sf):
    return _out(metrics.country_summary(_runs(spark, sf)), metrics.RUN)


@query("metrics_lowest_quartile", f"{RES}, {_COUNTRY}, qq AS (SELECT run_id, crop, quantile_cont(y_true, 0.25) AS q1 FROM country GROUP BY 1, 2), low AS (SELECT country.* FROM country JOIN qq USING (run_id, crop) WHERE y_true <= q1 + 1e-9) {_summary_sql('low', 'run_id, model, crop', ('rmse', 'rrmse_prct'))}")
def metrics_lowest_quartile(spark, sf):
    return _out(metrics.lowest_quartile(_runs(spark, sf)), metrics.RUN, ("rmse", "rrmse_prct"))


_WEIGHTS = "weights AS (SELECT adm_id, crop, round(avg(area), 6) AS weight FROM labels GROUP BY 1, 2)"


def _weights(spark, sf):
    return tables.labels(spark, sf).groupBy("adm_id", "crop").agg(F.round(F.avg("area"), 6).alias("weight"))


@query(
    "metrics_weighted",
    f"{RES}, {_WEIGHTS} SELECT run_id, model, crop, round(sqrt(sum(weight * (y_true - y_pred) ^ 2) / nullif(sum(CASE WHEN {_OK} THEN weight END), 0)), 5) AS wrmse, round(sqrt(sum(weight * (y_true - y_pred) ^ 2) / nullif(sum(CASE WHEN {_OK} THEN weight END), 0)) / nullif(avg(y_true), 0) * 100, 5) AS wrrmse_prct FROM res LEFT JOIN weights USING (adm_id, crop) GROUP BY 1, 2, 3",
)
def metrics_weighted(spark, sf):
    return metrics.weighted(_runs(spark, sf), _weights(spark, sf)).withColumns({c: F.round(c, 5) for c in ("wrmse", "wrrmse_prct")})


_UNITS = f"units AS (SELECT run_id, model, crop, adm_id, round({_SUMMARY['rmse']}, 6) AS rmse, {_SUMMARY['rrmse_prct']} AS rrmse_prct FROM res GROUP BY 1, 2, 3, 4)"
_ALL = f"summ AS (SELECT run_id, model, crop, round({_SUMMARY['rrmse_prct']}, 6) AS rrmse_prct, round({_SUMMARY['r2']}, 6) AS r2 FROM res GROUP BY 1, 2, 3)"


def _summ(spark, sf):
    return metrics.overall(_runs(spark, sf)).withColumns({c: F.round(c, 6) for c in ("rrmse_prct", "r2")})


@query("top_n_models", f"{RES}, {_ALL} SELECT crop, run_id, model, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY rrmse_prct NULLS LAST, run_id) AS k FROM summ) WHERE k <= 2")
def top_n_models(spark, sf):
    return ranking.top(_summ(spark, sf), ["crop"], "rrmse_prct", 2).select("crop", "run_id", "model", "rank")


@query("top_n_by_r2", f"{RES}, {_ALL} SELECT crop, run_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY r2 DESC NULLS LAST, run_id) AS k FROM summ) WHERE k <= 2")
def top_n_by_r2(spark, sf):
    return ranking.top(_summ(spark, sf), ["crop"], "r2", 2).select("crop", "run_id", "rank")


@query("best_and_benchmarks", f"{RES}, {_ALL} SELECT crop, run_id, model FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY rrmse_prct, run_id) AS k FROM summ WHERE model <> 'Null_model') WHERE k <= 1 UNION ALL SELECT crop, run_id, model FROM summ WHERE model = 'Null_model'")
def best_and_benchmarks(spark, sf):
    return ranking.best_and_benchmarks(_summ(spark, sf), ["crop"], "rrmse_prct", 1, ["Null_model"]).select("crop", "run_id", "model")


_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crop, adm_id ORDER BY rmse, run_id) AS k FROM units WHERE rmse IS NOT NULL) WHERE k = 1)"


@query("best_by_unit", f"{RES}, {_UNITS}, {_BEST} SELECT crop, adm_id, run_id, model, rmse, round(rrmse_prct, 5) AS rrmse_prct FROM best")
def best_by_unit(spark, sf):
    u = metrics.by_unit(_runs(spark, sf)).withColumn("rmse", F.round("rmse", 6))
    return ranking.best(u, ["crop", "adm_id"], "rmse").select("crop", "adm_id", "run_id", "model", "rmse", F.round("rrmse_prct", 5).alias("rrmse_prct"))


_HYBRID = "hyb AS (SELECT -1 AS run_id, 'BestByAdmin' AS model, r.adm_id, r.crop, r.year, y_true, y_pred, area FROM res r JOIN best b ON r.crop = b.crop AND r.adm_id = b.adm_id AND r.run_id = b.run_id)"


@query("hybrid_best", f"{RES}, {_UNITS}, {_BEST}, {_HYBRID} {_summary_sql('hyb', 'run_id, model, crop')}")
def hybrid_best(spark, sf):
    return _out(metrics.overall(ranking.hybrid(_runs(spark, sf))), metrics.RUN)


@query("national_hindcast", f"{RES}, {_UNITS}, {_BEST}, {_HYBRID}, c AS (SELECT run_id, model, crop, year, sum(CASE WHEN {_OK} THEN y_true * area END) / nullif(sum(CASE WHEN {_OK} THEN area END), 0) AS y_true, sum(CASE WHEN {_OK} THEN y_pred * area END) / nullif(sum(CASE WHEN {_OK} THEN area END), 0) AS y_pred FROM hyb GROUP BY 1, 2, 3, 4) {_summary_sql('c', 'run_id, model, crop', ('rmse', 'r2'))}")
def national_hindcast(spark, sf):
    h = ranking.hybrid(_runs(spark, sf)).where("y_true IS NOT NULL AND y_pred IS NOT NULL")
    return _out(metrics.overall(metrics.country(h, strict=False)), metrics.RUN, ("rmse", "r2"))


@query("exclusion_list", f"{RES}, {_UNITS} SELECT crop, count(*) AS n_units, string_agg(CAST(adm_id AS VARCHAR), ',' ORDER BY adm_id) AS units FROM units WHERE model = 'PeakModel' AND round(rrmse_prct, 6) > 12 GROUP BY 1")
def exclusion_list(spark, sf):
    return ranking.exclusions(_runs(spark, sf), "PeakModel", 12)


@query("performance_summary", f"{RES}, {_ALL} SELECT crop, (SELECT model FROM summ s WHERE s.crop = summ.crop ORDER BY rrmse_prct, run_id LIMIT 1) AS best_model, min(rrmse_prct) AS best_value, max(rrmse_prct) AS worst_value, count(*) AS n_runs FROM summ GROUP BY crop")
def performance_summary(spark, sf):
    return ranking.performance(metrics.overall(_runs(spark, sf)))


@query("benchmarks_better", f"{RES}, {_ALL} SELECT a.crop, string_agg(a.model, ',' ORDER BY a.model) AS better FROM summ a JOIN summ b ON a.crop = b.crop AND b.model = 'PeakModel' WHERE a.model <> 'PeakModel' AND a.rrmse_prct < b.rrmse_prct GROUP BY 1")
def benchmarks_better(spark, sf):
    return ranking.better_benchmarks(metrics.overall(_runs(spark, sf)), "PeakModel")


@query("unit_error_table", f"{RES}, {_UNITS}, {_WEIGHTS} SELECT run_id, crop, adm_id, n_name AS adm_name, round(rrmse_prct, 5) AS rrmse_prct, round(weight / sum(weight) OVER w * 100, 5) AS weight_prct, round(rrmse_prct * weight / sum(weight) OVER w, 5) AS weighted_rrmse FROM units LEFT JOIN nation ON n_nationkey = adm_id LEFT JOIN weights USING (adm_id, crop) WINDOW w AS (PARTITION BY run_id, crop)")
def unit_error_table(spark, sf):
    names = tables.read(spark, sf, "nation").select(F.col("n_nationkey").alias("adm_id"), F.col("n_name").alias("adm_name"))
    t = ranking.unit_errors(_runs(spark, sf), _weights(spark, sf), names)
    return t.select("run_id", "crop", "adm_id", "adm_name", *(F.round(c, 5).alias(c) for c in ("rrmse_prct", "weight_prct", "weighted_rrmse")))


@query("run_consistency", f"{RES}, {_ALL}, u AS (SELECT * FROM summ UNION ALL SELECT run_id + 10, model, crop, rrmse_prct + CASE WHEN model = 'Trend' THEN 1 ELSE 0 END, r2 FROM summ) SELECT model, crop, count(DISTINCT round(rrmse_prct, 2)) AS n_values, count(DISTINCT round(rrmse_prct, 2)) <= 1 AS agrees FROM u GROUP BY 1, 2")
def run_consistency(spark, sf):
    s = _summ(spark, sf).select("run_id", "model", "crop", "rrmse_prct")
    return ranking.consistent(s.unionByName(s.withColumns({"run_id": F.col("run_id") + 10, "rrmse_prct": F.col("rrmse_prct") + F.when(F.col("model") == "Trend", 1).otherwise(0)})), "rrmse_prct")


@query("paired_error_gain", f"{RES}, j AS (SELECT a.crop, (a.y_true - a.y_pred) ^ 2 AS x, (b.y_true - b.y_pred) ^ 2 AS y FROM res a JOIN res b USING (crop, adm_id, year) WHERE a.model = 'Null_model' AND b.model = 'Trend') SELECT crop, count(*) AS n, round(avg(x), 3) AS mse_base, round(avg(y), 3) AS mse_other, round(avg(CASE WHEN y < x THEN 1.0 ELSE 0.0 END), 6) AS better FROM j WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1")
def paired_error_gain(spark, sf):
    g = compare.error_gain(_runs(spark, sf), "Null_model", "Trend")
    return g.select("crop", "n", F.round("mse_base", 3).alias("mse_base"), F.round("mse_other", 3).alias("mse_other"), F.round("better", 6).alias("better"))


@query(
    "wilcoxon_statistic",
    f"""{RES}, d AS (SELECT a.crop, round(abs(a.y_true - a.y_pred) - abs(b.y_true - b.y_pred), 6) AS d FROM res a JOIN res b USING (crop, adm_id, year) WHERE a.model = 'Null_model' AND b.model = 'Trend'),
r AS (SELECT crop, d, rank() OVER (PARTITION BY crop ORDER BY abs(d)) + (count(*) OVER (PARTITION BY crop, abs(d)) - 1) / 2.0 AS k FROM d WHERE d IS NOT NULL AND d <> 0)
SELECT crop, count(*) AS n, round(sum(CASE WHEN d > 0 THEN k ELSE 0 END), 1) AS w_plus, round(sum(CASE WHEN d < 0 THEN k ELSE 0 END), 1) AS w_minus FROM r GROUP BY 1""",
)
def wilcoxon_statistic(spark, sf):
    r = _runs(spark, sf)
    e = lambda m, c: r.where(F.col("model") == m).select("crop", "adm_id", "year", F.abs(F.col("y_true") - F.col("y_pred")).alias(c))
    return paired.signed_ranks(e("Null_model", "x").join(e("Trend", "y"), ["crop", "adm_id", "year"]), ["crop"], "x", "y").drop("tied").withColumns({c: F.round(c, 1) for c in ("w_plus", "w_minus")})


_MONTHS_OF = """mv AS (SELECT adm_id, CAST(year(month) AS INT) AS year, CAST(month(month) AS INT) AS month, round(mean, 6) AS value FROM months WHERE variable_name = 'FPAR'),
mu AS (SELECT *, avg(value) OVER (PARTITION BY adm_id, month ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usual FROM mv),
pr AS (""" + " UNION ALL ".join(f"""SELECT adm_id, year, '{run}' AS run, {seasonal.SEASON - n} AS lead_time, round({x}, 8) AS x FROM mu GROUP BY 1, 2""" for n in seasonal.OBSERVED for run, x in (
    ("noSF", f"avg(CASE WHEN month <= {n} THEN value END)"), ("ObsAsSF", f"avg(CASE WHEN month <= {n + seasonal.AHEAD} THEN value END)"),
    ("SF", f"CASE WHEN count(CASE WHEN month BETWEEN {n + 1} AND {n + seasonal.AHEAD} THEN usual END) = {seasonal.AHEAD} THEN avg(CASE WHEN month <= {n} THEN value WHEN month <= {n + seasonal.AHEAD} THEN usual END) END"),
)) + ")"
_SEASONAL = f"""WITH {MONTHS},
{_LABELS_ONLY},
{_MONTHS_OF},
sx AS (SELECT l.*, run, lead_time, x AS peak FROM labels l JOIN pr USING (adm_id, year)),
{_PEAK[_PEAK.index("tot AS"):].replace("FROM px", "FROM sx").replace("PARTITION BY adm_id, crop", "PARTITION BY run, lead_time, adm_id, crop")},
seas AS (SELECT run, lead_time, adm_id, crop, year, yield AS y_true, {_BOUND("predicted")} AS y_pred FROM peakm)"""


def _seasonal(spark, sf):
    m = features.monthly(tables.indicators(spark, sf).where("variable_name = 'FPAR'"))
    months = m.select("adm_id", F.year("month").alias("year"), F.month("month").alias("month"), F.round("mean", 6).alias("value"))
    return seasonal.runs(tables.labels(spark, sf), months)


@query("seasonal_runs", f"{_SEASONAL} SELECT run, CAST(lead_time AS INT) AS lead_time, adm_id, crop, year, round(y_true, 4) AS y_true, round(y_pred, 3) AS y_pred FROM seas")
def seasonal_runs(spark, sf):
    return _seasonal(spark, sf).withColumns({"y_true": F.round("y_true", 4), "y_pred": F.round("y_pred", 3)})


_SEASONAL_TESTS = f"""{_SEASONAL},
d AS (SELECT a.crop, a.lead_time, b.run AS other, (a.y_true - a.y_pred) ^ 2 AS a, (b.y_true - b.y_pred) ^ 2 AS b, round((a.y_true - a.y_pred) ^ 2 - (b.y_true - b.y_pred) ^ 2, 6) AS d FROM seas a JOIN seas b USING (crop, lead_time, adm_id, year) WHERE a.run = 'noSF' AND b.run <> 'noSF' AND a.y_pred IS NOT NULL AND b.y_pred IS NOT NULL),
k AS (SELECT *, CASE WHEN d <> 0 THEN rank() OVER (PARTITION BY crop, lead_time, other, d <> 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY crop, lead_time, other, abs(d)) - 1) / 2.0 END AS k FROM d)
SELECT crop, CAST(lead_time AS INT) AS lead_time, other, count(*) AS n, round(avg(a)) AS mse_base, round(avg(b)) AS mse_other, round(avg(CASE WHEN b < a THEN 1.0 ELSE 0.0 END), 6) AS better, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 4) + 0.0 AS t,
    round(sum(CASE WHEN d > 0 THEN k ELSE 0 END), 1) AS w_plus, round(sum(CASE WHEN d < 0 THEN k ELSE 0 END), 1) AS w_minus FROM k GROUP BY 1, 2, 3"""


@query("seasonal_run_comparison", _SEASONAL_TESTS)
def seasonal_run_comparison(spark, sf):
    """Three runs by lead time: errors of the other two against the one without seasonal forecasts, and what the paired tests are made of."""
    t = paired.against_base(_seasonal(spark, sf), "noSF", ["ObsAsSF", "SF"], ["crop", "lead_time"])
    digits = {"mse_base": 0, "mse_other": 0, "better": 6, "t": 4, "w_plus": 1, "w_minus": 1}
    return t.select("crop", "lead_time", "other", "n", *((F.round(c, k) + F.lit(0.0)).alias(c) for c, k in digits.items()))


@query("seasonal_run_pvalues")
def seasonal_run_pvalues(spark, sf):
    """The p-values of these tests, and the one that applies."""
    t = paired.against_base(_seasonal(spark, sf), "noSF", ["ObsAsSF", "SF"], ["crop", "lead_time"])
    return t.select("crop", "lead_time", "other", "n", *(F.round(c, 6).alias(c) for c in ("shapiro_w", "shapiro_p", "t_p", "wilcoxon_p", "inverted_p", "standard_p")))


# --- result rows

_ERR = lambda k, p="y_pred", t="y_true": _SUMMARY[k].replace("y_pred", p).replace("y_true", t)
_ERRORS_SQL = f"""
w AS (SELECT adm_id, crop, round(avg(area), 6) AS weight FROM labels GROUP BY 1, 2),
rw AS (SELECT run_id, model, crop, adm_id, year, y_true, y_pred, weight FROM res JOIN w USING (adm_id, crop)),
o AS (SELECT run_id, model, crop, avg(y_true) AS m, {", ".join(f"{_ERR(k)} AS {k}" for k in ("r2", "mae", "me", "rmse"))} FROM rw GROUP BY 1, 2, 3),
ye AS (SELECT run_id, model, crop, year, {_ERR("r2")} AS r2, {_ERR("rmse")} AS rmse, sum(weight * y_true) / sum(weight) AS ct, sum(weight * y_pred) / sum(weight) AS cp FROM rw GROUP BY 1, 2, 3, 4),
un AS (SELECT run_id, model, crop, adm_id, {_ERR("r2")} AS r2 FROM rw GROUP BY 1, 2, 3, 4),
ys AS (SELECT run_id, model, crop, avg(r2) AS r2_spatial, avg(rmse) AS rmse_spatial, avg(ct) AS cm, quantile_cont(ct, 0.25) AS q, {", ".join(f"{_ERR(k, 'cp', 'ct')} AS country_{k}" for k in ("r2", "mae", "me", "rmse"))} FROM ye GROUP BY 1, 2, 3),
us AS (SELECT run_id, model, crop, avg(r2) AS r2_temporal FROM un GROUP BY 1, 2, 3),
fq AS (SELECT run_id, model, crop, sqrt(avg((ct - cp) ^ 2)) AS country_fq_rmse FROM ye JOIN ys USING (run_id, model, crop) WHERE ct <= q + 1e-9 GROUP BY 1, 2, 3),
er AS (SELECT run_id, model, crop, r2 AS r2_overall, r2_spatial, r2_temporal, mae, mae / m * 100 AS rmae_prct, me, rmse, rmse / m * 100 AS rrmse_prct, rmse_spatial, rmse_spatial / m * 100 AS rrmse_spatial_prct,
    country_r2, country_mae, country_me, country_rmse, country_rmse / cm * 100 AS country_rrmse_prct, country_fq_rmse, country_fq_rmse / cm * 100 AS country_fq_rrmse_prct
    FROM o JOIN ys USING (run_id, model, crop) JOIN us USING (run_id, model, crop) LEFT JOIN fq USING (run_id, model, crop))"""


def weighted_runs(spark, sf, res):
    return res.join(_weights(spark, sf), ["adm_id", "crop"])


@query("result_errors", f"{RES}, {_ERRORS_SQL} SELECT run_id, model, crop, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in results.ERRORS)} FROM er")
def result_errors(spark, sf):
    """Every error column of the benchmarks' result rows, from one pass over their predictions."""
    return results.errors(weighted_runs(spark, sf, _runs(spark, sf))).select(*results.RUN, *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in results.ERRORS))


# --- forecasts: the labels up to 2000 are history, each unit's forecast for 2001 is its 1999-2000 mean times a factor

_FORECAST = f"""{LABELS},
hist AS (SELECT * FROM labels WHERE year <= 2000),
fc AS (SELECT adm_id, crop, avg(yield) * (1 + (adm_id % 7 - 3) / 20.0) AS fyield FROM hist WHERE year >= 1999 GROUP BY 1, 2),
h AS (SELECT adm_id, crop, min(yield) AS yield_min, max(yield) AS yield_max, avg(yield) AS yield_mean, quantile_cont(yield, 0.1) AS p10, quantile_cont(yield, 0.9) AS p90, quantile_cont(yield, [x / 100.0 for x in range(101)]) AS yg, quantile_cont(production, [x / 100.0 for x in range(101)]) AS pg FROM hist GROUP BY 1, 2),
l5 AS (SELECT adm_id, crop, avg(yield) AS yield_last5, avg(area) AS area_last5 FROM (SELECT *, row_number() OVER (PARTITION BY adm_id, crop ORDER BY year DESC) AS k FROM hist) WHERE k <= 5 GROUP BY 1, 2),
ft0 AS (SELECT fc.adm_id, fc.crop, fyield, yield_min, yield_max, yield_mean, p10, p90, yg, pg, yield_last5, area_last5, fyield * area_last5 AS fproduction, (fyield - yield_last5) / yield_last5 * 100 AS diff_prct FROM fc JOIN h USING (adm_id, crop) JOIN l5 USING (adm_id, crop)),
ft AS (SELECT *, coalesce((list_position([fyield < x for x in yg], true) - 1) / 100.0, 1.0) AS fyield_position, coalesce((list_position([fproduction < x for x in pg], true) - 1) / 100.0, 1.0) AS fproduction_position FROM ft0)"""


def _forecast(spark, sf):
    hist = tables.labels(spark, sf).where("year <= 2000")
    fc = hist.where("year >= 1999").groupBy("adm_id", "crop").agg((F.avg("yield") * (1 + (F.col("adm_id") % 7 - 3) / 20.0)).alias("fyield"))
    return forecast.table(fc, hist), hist


_FT = {"fyield": 4, "yield_min": 4, "yield_max": 4, "yield_mean": 4, "p10": 4, "p90": 4, "yield_last5": 4, "area_last5": 4, "fproduction": 2, "diff_prct": 4}


@query("forecast_table", f"WITH {_FORECAST} SELECT adm_id, crop, " + ", ".join(f"round({c}, {d}) AS {c}" for c, d in _FT.items()) + ", fyield_position, fproduction_position FROM ft")
def forecast_table(spark, sf):
    t, _ = _forecast(spark, sf)
    return t.select("adm_id", "crop", *(F.round(c, d).alias(c) for c, d in _FT.items()), "fyield_position", "fproduction_position")


@query("percentile_position", f"WITH {LABELS}, g AS (SELECT adm_id, crop, quantile_cont(yield, [x / 100.0 for x in range(101)]) AS g FROM labels GROUP BY 1, 2) SELECT adm_id, crop, year, coalesce((list_position([yield < x for x in g], true) - 1) / 100.0, 1.0) AS position FROM labels JOIN g USING (adm_id, crop)")
def percentile_position(spark, sf):
    from furrow.functions import stats

    labels = tables.labels(spark, sf)
    g = labels.groupBy("adm_id", "crop").agg(stats.percentile_grid(F.col("yield")).alias("g"))
    return labels.join(g, ["adm_id", "crop"]).select("adm_id", "crop", "year", stats.percentile_position(F.col("g"), F.col("yield")).alias("position"))


_CLAMP = """cl0 AS (SELECT *, CASE WHEN fyield < p10 THEN p10 WHEN fyield > p90 THEN p90 END AS bound FROM ft),
cl1 AS (SELECT adm_id, crop, p10, p90, pg, area_last5, yield_last5, coalesce(bound, fyield) AS fyield, coalesce(bound, fyield) * area_last5 AS fproduction, (coalesce(bound, fyield) - yield_last5) / yield_last5 * 100 AS diff_prct, bound IS NOT NULL AS clamped,
    CASE WHEN bound IS NOT NULL THEN bound ELSE fyield_position END AS fyield_position, CASE WHEN bound IS NULL THEN fproduction_position END AS pos0 FROM cl0),
cl AS (SELECT *, coalesce(pos0, (list_position([fproduction < x for x in pg], true) - 1) / 100.0, 1.0) AS fproduction_position FROM cl1)"""


@query("clamp_to_band", f"WITH {_FORECAST}, {_CLAMP} SELECT adm_id, crop, clamped, round(fyield, 4) AS fyield, round(fproduction, 2) AS fproduction, round(diff_prct, 4) AS diff_prct, round(fyield_position, 4) AS fyield_position, fproduction_position FROM cl")
def clamp_to_band(spark, sf):
    c = forecast.fill_positions(forecast.clamp(_forecast(spark, sf)[0]))
    return c.select("adm_id", "crop", F.col("note").isNotNull().alias("clamped"), F.round("fyield", 4).alias("fyield"), F.round("fproduction", 2).alias("fproduction"), F.round("diff_prct", 4).alias("diff_prct"), F.round("fyield_position", 4).alias("fyield_position"), "fproduction_position")


@query(
    "national_forecast",
    f"""WITH {_FORECAST}, {_CLAMP}, now AS (SELECT crop, sum(fproduction) AS fproduction, sum(fyield * area_last5) / sum(area_last5) AS fyield FROM cl GROUP BY 1),
ny AS (SELECT crop, year, sum(production) AS production, sum(production) / sum(area) AS yield, row_number() OVER (PARTITION BY crop ORDER BY year DESC) AS k FROM hist GROUP BY 1, 2),
past AS (SELECT crop, avg(CASE WHEN k <= 5 THEN yield END) AS yield_last, quantile_cont(production, [x / 100.0 for x in range(101)]) AS g FROM ny GROUP BY 1)
SELECT crop, round(fyield, 4) AS fyield, round((fyield - yield_last) / yield_last * 100, 4) AS yield_diff_pct, round(fproduction, 1) AS fproduction, coalesce((list_position([fproduction < x for x in g], true) - 1) / 100.0, 1.0) AS fproduction_percentile FROM now JOIN past USING (crop)""",
)
def national_forecast(spark, sf):
    t, hist = _forecast(spark, sf)
    n = forecast.national(forecast.fill_positions(forecast.clamp(t)), hist)
    return n.select("crop", F.round("fyield", 4).alias("fyield"), F.round("yield_diff_pct", 4).alias("yield_diff_pct"), F.round("fproduction", 1).alias("fproduction"), "fproduction_percentile")


@query("exchange_forecast", f"WITH {_FORECAST}, {_CLAMP} SELECT r_name AS region, n_name AS adm_name, adm_id, CASE crop WHEN 'PROMO' THEN 'Maize' ELSE crop END AS crop_name, 'yield' AS variable, round(fyield, 3) AS value, 't/ha' AS unit, round(p10, 3) AS low, round(p90, 3) AS high, 'forecast' AS status FROM cl JOIN nation ON n_nationkey = adm_id JOIN region ON r_regionkey = n_regionkey")
def exchange_forecast(spark, sf):
    nation, region = tables.read(spark, sf, "nation"), tables.read(spark, sf, "region")
    names = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("r_name").alias("region"), F.col("n_name").alias("adm_name"), F.col("n_nationkey").alias("adm_id"))
    return forecast.exchange(forecast.clamp(_forecast(spark, sf)[0]), names, {"PROMO": "Maize"})


_FORM = exchange.Settings(country="Everywhere", source="STATS_v1", sos=11, eos=5, harvest_year=2001, group="furrow", issued="2001-03-01", run="2001-02-15", version="furrow", planting_delta=-1, recode={"PROMO": "Maize"})
_FORM_SQL = {
    "source_id": "adm_id", "source_name_version": "'STATS_v1'", "admin_0": "'Everywhere'", "admin_1": "r_name", "admin_2": "n_name", "admin_3": "''", "planted_year": "2000", "approx_planted_month": "11", "harvest_year": "2001", "approx_harvest_month": "5",
    "crop": "CASE crop WHEN 'PROMO' THEN 'Maize' ELSE crop END", "crop_season": "'n.a.'", "season": "'n.a.'", "forecast_issue_date (yyyy-mm-dd)": "'2001-03-01'", "date_model_run (yyyy-mm-dd)": "'2001-02-15'", "input_croptype_product": "'n.a.'", "group": "'furrow'", "model_version": "'furrow_2001-02-15'",
    "is_final": "'n.a.'", "notes": "''", "yield_fcst (tn_ha)": "round(fyield, 3)", "cross_validation": "0", "metric_years": "'" + ",".join(map(str, range(1995, 2002))) + "'",
    **{c: f"round({_SUMMARY[e]}, 4) + 0.0" for c, e in {"yield_mae": "mae", "yield_rmse": "rmse", "yield_rrmse": "rrmse_prct", "yield_mape": "rmae_prct", "yield_r2_pearson": "r2_pearson", "yield_r2_true": "r2"}.items()},
}


def _form_sql(columns: list[str]) -> str:
    cast = {"planted_year", "approx_planted_month", "harvest_year", "approx_harvest_month", "cross_validation"}
    return ", ".join((f"CAST({_FORM_SQL[c]} AS INT)" if c in cast else _FORM_SQL[c]) + f' AS "{c}"' for c in columns)


def _form_regions(spark, sf):
    nation, region = tables.read(spark, sf, "nation"), tables.read(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("adm_id"), F.col("r_name").alias("admin_1"), F.col("n_name").alias("admin_2"))


@query("exchange_forecast_form", f"WITH {_FORECAST}, {_CLAMP} SELECT {_form_sql(exchange.FORECAST)} FROM cl JOIN nation ON n_nationkey = adm_id JOIN region ON r_regionkey = n_regionkey")
def exchange_forecast_form(spark, sf):
    """All columns of the template, for the clamped forecasts."""
    return exchange.forecast_form(forecast.clamp(_forecast(spark, sf)[0]), _form_regions(spark, sf), _FORM, 3)


@query("exchange_accuracy_form", f"{RES} SELECT {_form_sql(exchange.ACCURACY)} FROM res JOIN nation ON n_nationkey = adm_id JOIN region ON r_regionkey = n_regionkey WHERE model = 'Trend' GROUP BY adm_id, crop, r_name, n_name")
def exchange_accuracy_form(spark, sf):
    """All columns of the template, for the trend model's hindcasts by unit and crop."""
    errors = metrics.by_unit(_runs(spark, sf).where("model = 'Trend'"))
    return exchange.accuracy_form(errors, _form_regions(spark, sf), _FORM, list(range(1995, 2002)), 4)
