"""Queries of the execute phase: batches of runs, the result store, prepared tables, trees under nested validation, result rows."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from furrow.functions import stats
from furrow.operators import benchmarks, compare, execute, results, selection, specs, trees, tuning
from furrow.plans.learning import _ROWS, FEATURES, _corr, _model_table, _rows
from furrow.plans.models import _LABELS_ONLY, _PEAKS, RES, _peaks, _runs, weighted_runs
from furrow.plans.panels import FIRST_YEAR
from furrow.plans.register import LABELS, MONTHS, query
from furrow.sources import files, tables

INPUTS = list(tables.VARIABLES)
MODELS = ["Null_model", "Trend", "PeakModel"]


def _batch_specs(spark, sf):
    """A spec for each crop of the label panel and each benchmark."""
    crops = sorted(r.crop for r in tables.labels(spark, sf).select("crop").distinct().collect())
    return specs.grid(spark, {"crop": crops, "model": MODELS, "lead_time": [1]}, skip="false")


def _executed(spark, sf, leave_out: str = "false"):
    """(specs, fingerprint of the input, store) after a batch over the prepared panel; leave_out says which specs stay undone."""
    panel = tables.labels(spark, sf).join(_peaks(spark, sf), ["adm_id", "year"], "left")
    path = files.scratch(spark)
    panel.write.parquet(f"{path}/panel")
    panel = spark.read.parquet(f"{path}/panel")
    store, source = execute.Store(spark, f"{path}/store"), execute.input_fingerprint(panel)

    def run(settings: dict):
        mine = panel.where(F.col("crop") == settings["crop"])
        of_crop = benchmarks.runs(mine.drop("peak"), mine.select("adm_id", "year", "peak").distinct(), FIRST_YEAR)
        return of_crop.where(F.col("model") == settings["model"]).drop("run_id")

    todo = _batch_specs(spark, sf)
    execute.batch(todo.where(f"NOT ({leave_out})"), run, source, store)
    return todo, source, store, run


@query("executed_runs", f"{RES} SELECT model, crop, adm_id, year, y_true, y_pred, area FROM res")
def executed_runs(spark, sf):
    """Runs are numbered by crop, then by model in alphabetical order. Every (crop, benchmark) as a run of its own, read back from the store."""
    *_, store, _ = _executed(spark, sf)
    return store.predictions().select("model", "crop", "adm_id", "year", "y_true", "y_pred", "area")


@query("cached_runs", f"WITH {LABELS} SELECT CAST(row_number() OVER (ORDER BY crop, m) AS INT) AS run_id, CASE WHEN m = 3 THEN 'done' ELSE 'cached' END AS status FROM (SELECT DISTINCT crop FROM labels), (SELECT unnest([1, 2, 3]) AS m)")
def cached_runs(spark, sf):
    """A second batch makes only what the first left out."""
    todo, source, store, run = _executed(spark, sf, leave_out="model = 'Trend'")
    return execute.batch(todo, run, source, store).select("run_id", "status")


@query("runs_to_repeat", f"WITH {LABELS} SELECT CAST(row_number() OVER (ORDER BY crop) * 3 AS INT) AS run_id, crop, 'Trend' AS model FROM (SELECT DISTINCT crop FROM labels)")
def runs_to_repeat(spark, sf):
    """What is missing from the store's files."""
    todo, source, store, _ = _executed(spark, sf, leave_out="model = 'Trend'")
    return execute.missing(execute.status(todo, source, store)).select("run_id", "crop", "model")


@query("run_times", f"WITH {LABELS}, n AS (SELECT crop, count(*) AS rows FROM labels GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY crop, m) AS INT) AS run_id, rows, true AS timed FROM n, (SELECT unnest([1, 2, 3]) AS m)")
def run_times(spark, sf):
    """Rows and real run time of every run of a batch; none of them counts as slow that is as fast as all others."""
    todo, source, store, _ = _executed(spark, sf)
    state = execute.status(todo, source, store)
    slow = execute.slow(state, 1e6).select("run_id", F.lit(True).alias("slow"))
    return state.join(slow, "run_id", "left").select("run_id", "rows", ((F.col("seconds") > 0) & F.col("slow").isNull()).alias("timed"))


@query("prepared_join", f"WITH {MONTHS}, {_PEAKS}, {_LABELS_ONLY} SELECT adm_id, crop, year, round(yield, 6) AS yield, peak FROM labels JOIN peaks USING (adm_id, year)")
def prepared_join(spark, sf):
    """Label panel and features from tables in buckets of (unit, year): the join needs no exchange."""
    path = files.scratch(spark)
    tag = path.rsplit("/", 1)[-1]
    panel = execute.prepare(tables.labels(spark, sf), f"prepared_labels_{tag}", ["adm_id", "year"], 8, f"{path}/labels")
    peaks = execute.prepare(_peaks(spark, sf), f"prepared_peaks_{tag}", ["adm_id", "year"], 8, f"{path}/peaks")
    return panel.hint("merge").join(peaks, ["adm_id", "year"]).select("adm_id", "crop", "year", F.round("yield", 6).alias("yield"), "peak")


@query("relevance_by_name", f"{_ROWS} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n, round({_corr(f, 'target')} ^ 2 / nullif(1 - {_corr(f, 'target')} ^ 2, 0) * (count(*) - 2), 6) AS f FROM x" for f in FEATURES))
def relevance_by_name(spark, sf):
    """Relevance of all numeric columns of a registered table that is known by its name only."""
    _rows(spark, sf).createOrReplaceTempView("selection_rows")
    return selection.relevance_by_name(spark, "selection_rows", "target").withColumn("f", F.round("f", 6))


@query("table_diff_types", f"WITH {LABELS}, l AS (SELECT adm_id, crop, CAST(year AS BIGINT) AS year, round(yield, 3) AS yield, CAST(round(production) AS DECIMAL(21, 0)) AS tons FROM labels), r AS (SELECT adm_id, crop, year, CASE WHEN adm_id = 3 AND year = 1998 THEN yield + 1 ELSE yield END AS yield, tons FROM l WHERE NOT (adm_id = 5 AND year = 1999)) SELECT *, 'left_only' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right_only' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)")
def table_diff_types(spark, sf):
    """A table against its copy from a text file, in which years are longs, yields text and tons decimals."""
    left = tables.labels(spark, sf).select("adm_id", "crop", "year", F.round("yield", 3).alias("yield"), F.round("production").cast("bigint").alias("tons"))
    changed = left.where("NOT (adm_id = 5 AND year = 1999)").withColumn("yield", F.when((F.col("adm_id") == 3) & (F.col("year") == 1998), F.col("yield") + 1).otherwise(F.col("yield")))
    path = files.overwrite_csv(changed, files.scratch(spark))
    right = files.csv(spark, path, "adm_id int, crop string, year bigint, yield string, tons decimal(21, 0)")
    return compare.table_diff(left, right, 3)


# --- trees, refits and result rows

FOREST = {"depth": [3, 6], "subset": ["sqrt"], "trees": [5, 10, 20]}
BOOSTED = {"rate": [0.1, 0.3], "depth": [3], "share": [0.1], "trees": [5, 10]}


def _complete(spark, sf):
    """The model table, written down: many fits read it."""
    path = files.scratch(spark)
    _model_table(spark, sf).dropna().repartition(1).write.parquet(path)  # thousands of rows
    return spark.read.parquet(path)


@query("forest_nested_cv")
def forest_nested_cv(spark, sf):
    return trees.nested(_complete(spark, sf), INPUTS, "forest", FOREST)


@query("boosted_nested_cv")
def boosted_nested_cv(spark, sf):
    return trees.nested(_complete(spark, sf), INPUTS, "boosted", BOOSTED)


@query("refit_forecasts")
def refit_forecasts(spark, sf):
    """Forecasts of the last year by two families, each from a model of the years before that was written and read again."""
    t = _complete(spark, sf)
    last = t.agg(F.max("year")).first()[0]
    past, now = t.where(F.col("year") < last), t.where(F.col("year") == last).drop("yield")
    path = files.scratch(spark)
    tuning.lasso(past, INPUTS, nested=False).write.parquet(f"{path}/lasso")
    linear = tuning.forecasts(now, spark.read.parquet(f"{path}/lasso"), INPUTS).withColumn("model", F.lit("Lasso"))
    kept = trees.keep(trees.pipeline("forest", INPUTS, {"depth": 6, "subset": "sqrt", "trees": 20}).fit(past), f"{path}/forest")
    return linear.unionByName(trees.forecast(spark, kept, now).withColumn("model", F.lit("RandomForest")))


def _info(crops, **columns):
    """A row of settings for each crop of a run."""
    return crops.select("crop", *(F.lit(v).alias(k) for k, v in columns.items()))


@query("result_rows")
def result_rows(spark, sf):
    """The result row of every (crop, model): the three benchmarks, Lasso and a random forest. Predictions of all families are written down
    once, and all error columns come from one pass over them."""
    began = time.time()
    t, path = _complete(spark, sf), files.scratch(spark)
    tuning.lasso(t, INPUTS).write.parquet(f"{path}/folds")
    folds, whole = spark.read.parquet(f"{path}/folds"), tuning.lasso(t, INPUTS, nested=False)
    lasso = tuning.held_out_predictions(t, folds, INPUTS).withColumns({"run_id": F.lit(4), "model": F.lit("Lasso")})
    forest = trees.nested(t, INPUTS, "forest", {"depth": [4], "subset": ["sqrt"], "trees": [5, 10]}).withColumns({"run_id": F.lit(5), "model": F.lit("RandomForest")})
    keep = ["run_id", "model", "crop", "adm_id", "year", "y_true", "y_pred"]
    res = _runs(spark, sf).select(keep).unionByName(lasso.select(keep)).unionByName(forest.select(keep))
    weighted_runs(spark, sf, res).write.parquet(f"{path}/predictions")
    errors = results.errors(spark.read.parquet(f"{path}/predictions"))
    hours = (time.time() - began) / 3600
    crops = t.select("crop").distinct()
    common = {"lead_time": 0, "jobs": trees.at_a_time(spark), "scoring": "root_mean_squared_error", "time": time.strftime("%m/%d/%Y, %H:%M:%S"), "hours": hours, "one_hot": "none", "yield_trend": "False", "reduction": "none", "selection": "none"}
    inputs = {"n_features": len(INPUTS), "features": ",".join(INPUTS), "feature_set": "season_means", "n_selected": len(INPUTS), "prct_selected": 100, "selected": ",".join(INPUTS)}
    names = dict(_runs(spark, sf).select("run_id", "model").distinct().collect())
    infos = [_info(crops, run_id=k, estimator=m, data_scaling="none", n_features=0, **common) for k, m in sorted(names.items())]
    fitted = whole.select("crop", tuning.hyper_text("alpha", F.col("alpha")).alias("hyper_params"), F.lit("alpha:" + ",".join(str(round(a, 6)) for a in tuning.LASSO_ALPHAS)).alias("hyper_grid"), tuning.coefficients(INPUTS).alias("coefficients"))
    fit = t.join(whole, "crop").groupBy("crop").agg(stats.r2(F.greatest(tuning.linear(INPUTS), F.lit(0.0)), F.col("yield")).alias("r2_fit"))
    val = folds.groupBy("crop").agg(F.avg("rmse_val").alias("rmse_val"))
    own = _info(crops, run_id=4, estimator="Lasso", data_scaling="z_f", **common, **inputs)
    for more in (fitted, fit, val, tuning.pegged(folds, "alpha", "alpha", F.col("first"), F.col("last")).drop("n_folds")):
        own = own.join(more, "crop")
    infos.append(own)
    chosen = spark.read.parquet(f"{path}/predictions").where("run_id = 5").select("crop").distinct()
    infos.append(_info(chosen, run_id=5, estimator="RandomForest", data_scaling="none", hyper_grid="depth:4; subset:sqrt; trees:5,10", **common, **inputs))
    info = infos[0]
    for i in infos[1:]:
        info = info.unionByName(i, allowMissingColumns=True)
    return results.rows(errors, info.drop("estimator"))
