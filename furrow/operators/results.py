"""The result row of a run: its settings, what its tuning chose, and its errors at every level.

All error statistics come from one pass over the predictions: grouping sets give the sums of each run, of each of its years and of each of its
units in one aggregate, and a second one over these few rows makes the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import stats

RUN = ["run_id", "model", "crop"]
#: Error columns, by what they are taken over: all rows; years, then averaged; units, then averaged; the yearly weighted means of the
#: country, and of these the years with the lowest quarter of true yields.
ERRORS = [
    "r2_overall", "r2_spatial", "r2_temporal", "mae", "rmae_prct", "me", "rmse", "rrmse_prct", "rmse_spatial", "rrmse_spatial_prct",
    "country_r2", "country_mae", "country_me", "country_rmse", "country_rrmse_prct", "country_fq_rmse", "country_fq_rrmse_prct",
]
#: The columns of a result row, in the order of the output.
COLUMNS = [
    "run_id", "data_scaling", "one_hot", "yield_trend", "scoring", "jobs", "time", "lead_time", "n_features", "reduction", "feature_set", "features", "selection", "n_selected", "prct_selected", "selected", "crop", "estimator", "rmse_val", "r2_fit",
    *ERRORS[:10], "hyper_grid", "hyper_params", *ERRORS[10:], "coefficients", "pegged_left", "pegged_right", "hours",
]


def errors(res: DataFrame) -> DataFrame:
    """RUN and ERRORS of res: RUN, adm_id, year, y_true, y_pred, weight (of the unit in the country's mean, which keeps
    the weight of units without a value in its denominator)."""
    p, t, w = F.col("y_pred"), F.col("y_true"), F.col("weight")
    level = F.grouping_id(*RUN, "year", "adm_id")
    sums = {k: v for k, v in stats.summary(p, t).items() if k in ("mae", "me", "rmse", "r2")}
    one = res.groupingSets([[F.col(c) for c in (*RUN, *more)] for more in ([], ["year"], ["adm_id"])], *RUN, "year", "adm_id").agg(
        level.alias("level"), *(c.alias(k) for k, c in sums.items()), F.avg(t).alias("mean_true"), stats.weighted_mean(t, w, True).alias("country_true"), stats.weighted_mean(p, w, True).alias("country_pred")
    )
    run, year, unit = (F.col("level") == k for k in (3, 1, 2))  # bits of year and adm_id are set where they are summed over
    only = lambda at, c: F.max(F.when(at, F.col(c)))
    mean = lambda at, c: F.avg(F.when(at, F.col(c)))
    series = F.collect_list(F.when(year, F.struct(F.col("country_true").alias("t"), F.col("country_pred").alias("p"))))  # a row a year
    ct, cp = F.when(year, F.col("country_true")), F.when(year, F.col("country_pred"))
    g = one.groupBy(*RUN).agg(
        *(only(run, c).alias(c) for c in ("r2", "mae", "me", "rmse", "mean_true")), mean(year, "r2").alias("r2_spatial"), mean(year, "rmse").alias("rmse_spatial"), mean(unit, "r2").alias("r2_temporal"),
        *(c.alias(f"country_{k}") for k, c in stats.summary(cp, ct).items() if k in ("r2", "mae", "me", "rmse")), F.avg(ct).alias("country_mean"), F.percentile(ct, 0.25).alias("quarter"), series.alias("series"),
    )
    poor = F.filter("series", lambda x: (x["t"] <= F.col("quarter") + 1e-9) & x["p"].isNotNull())
    fq = F.sqrt(F.aggregate(poor, F.lit(0.0), lambda s, x: s + F.pow(x["t"] - x["p"], 2)) / F.nullif(F.size(poor), F.lit(0)))
    percent = lambda a, b: a / F.nullif(F.col(b), F.lit(0.0)) * 100
    columns: dict[str, Column] = {
        "r2_overall": F.col("r2"), "rmae_prct": percent(F.col("mae"), "mean_true"), "rrmse_prct": percent(F.col("rmse"), "mean_true"), "rrmse_spatial_prct": percent(F.col("rmse_spatial"), "mean_true"),
        "country_rrmse_prct": percent(F.col("country_rmse"), "country_mean"), "country_fq_rmse": fq, "country_fq_rrmse_prct": percent(fq, "country_mean"),
    }
    return g.select(*RUN, *(columns.get(c, F.col(c)).alias(c) for c in ERRORS))


def rows(errors: DataFrame, info: DataFrame) -> DataFrame:
    """COLUMNS of every run: errors joined with info (run_id, crop and any of the other columns; what it lacks is null)."""
    j = info.join(errors.withColumnRenamed("model", "estimator"), ["run_id", "crop"], "left")
    text = {"run_id": F.lpad(F.col("run_id").cast("string"), 6, "0")}
    return j.select(*(text.get(c, F.col(c) if c in j.columns else F.lit(None).cast("string")).alias(c) for c in COLUMNS))
