"""Ranking, selection and combination of model runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators import metrics

#: Metrics of which more is better; of all others less is.
HIGHER_IS_BETTER = ("r2", "r2_pearson")


def direction(metric: str) -> Column:
    return F.col(metric).desc_nulls_last() if metric in HIGHER_IS_BETTER else F.col(metric).asc_nulls_last()


def top(runs: DataFrame, by: list[str], metric: str, n: int) -> DataFrame:
    """The n best runs of each group; equal metrics by run_id."""
    w = Window.partitionBy(*by).orderBy(direction(metric), "run_id")
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    return top(runs.where(F.col(metric).isNotNull()), by, metric, 1).drop("rank")


def best_and_benchmarks(runs: DataFrame, by: list[str], metric: str, n: int, benchmarks: list[str]) -> DataFrame:
    """The n best models of each group together with all benchmarks, each run once."""
    models = top(runs.where(~F.col("model").isin(benchmarks)), by, metric, n).drop("rank")
    both = models.unionByName(runs.where(F.col("model").isin(benchmarks)))
    w = Window.partitionBy(*by, "run_id").orderBy("model")
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def ties_of_best(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    """All runs that share the group's best value."""
    w = Window.partitionBy(*by).orderBy(direction(metric))
    return runs.withColumn("__k", F.rank().over(w)).where("__k = 1").drop("__k")


def hybrid(res: DataFrame, metric: str = "rmse") -> DataFrame:
    """A pseudo-run per crop that takes each unit's best run: its predictions, under run_id -1. The runs' errors
    and the choice are windows over the series that the rows are grouped by already, not a join with them."""
    w, gap = Window.partitionBy("crop", "adm_id", "run_id"), F.col("y_true") - F.col("y_pred")
    error = {"rmse": F.sqrt(F.avg(gap * gap).over(w)), "mae": F.avg(F.abs(gap)).over(w), "rrmse_prct": F.sqrt(F.avg(gap * gap).over(w)) / F.nullif(F.avg("y_true").over(w), F.lit(0.0)) * 100}[metric]
    own = res.withColumn("__error", F.round(error, 6))
    chosen = F.min(F.when(F.col("__error").isNotNull(), F.struct("__error", "run_id"))).over(Window.partitionBy("crop", "adm_id"))
    picked = own.withColumn("__chosen", chosen["run_id"]).where(F.col("run_id") == F.col("__chosen")).drop("__error", "__chosen")
    return picked.withColumns({"run_id": F.lit(-1), "model": F.lit("BestByAdmin")})


def exclusions(res: DataFrame, model: str, limit: float) -> DataFrame:
    """Per crop the units whose relative error passes the limit, in order, and as text."""
    bad = metrics.by_unit(res).where((F.col("model") == model) & (F.round("rrmse_prct", 6) > limit))
    return bad.groupBy("crop").agg(F.array_sort(F.collect_set("adm_id")).alias("ids")).select("crop", F.size("ids").cast("bigint").alias("n_units"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("units"))


def performance(summary: DataFrame, metric: str = "rrmse_prct") -> DataFrame:
    """Per crop the best run, its metric, and the best value of every model family."""
    s = summary.withColumn(metric, F.round(metric, 6))
    return s.groupBy("crop").agg(F.min_by("model", F.struct(metric, "run_id")).alias("best_model"), F.min(metric).alias("best_value"), F.max(metric).alias("worst_value"), F.count("*").alias("n_runs"))


def better_benchmarks(summary: DataFrame, model: str, metric: str = "rrmse_prct") -> DataFrame:
    """Per crop the benchmarks that do better than the model, joined by commas."""
    own = summary.where(F.col("model") == model).select("crop", F.round(metric, 6).alias("own"))
    j = summary.where(F.col("model") != model).join(own, "crop").where(F.round(metric, 6) < F.col("own"))
    return j.groupBy("crop").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("better"))


def unit_errors(res: DataFrame, weights: DataFrame, names: DataFrame) -> DataFrame:
    """Per run and unit its errors, name, weight and share of the crop's weight."""
    w = Window.partitionBy("run_id", "crop")
    j = metrics.by_unit(res).join(names, "adm_id", "left").join(weights, ["adm_id", "crop"], "left")
    return j.withColumns({"weight_prct": F.col("weight") / F.sum("weight").over(w) * 100, "weighted_rrmse": F.col("rrmse_prct") * F.col("weight") / F.sum("weight").over(w)})


def describe(specs: DataFrame) -> DataFrame:
    """A run's settings as one text; settings that are blank or off are left out."""
    part = lambda c, text: F.when(c, text)
    text = F.concat_ws(
        ", ", F.col("algorithm"), part(F.col("one_hot"), F.lit("one-hot units")), part(F.col("trend"), F.lit("trend")), F.nullif(F.col("feature_set"), F.lit("")),
        part(F.col("reduction") != "none", F.col("reduction")), part(F.col("selection") != "none", F.concat("selection", F.lit(" "), F.col("prct").cast("string"), F.lit("%"))),
    )
    return specs.withColumn("description", text)


def consistent(runs: DataFrame, metric: str) -> DataFrame:
    """Per model and crop, whether the metric agrees to two decimals wherever the model was run."""
    return runs.groupBy("model", "crop").agg(F.countDistinct(F.round(metric, 2)).alias("n_values")).withColumn("agrees", F.col("n_values") <= 1)


def slow_first(specs: DataFrame) -> DataFrame:
    """The order in which specs run: those with feature selection first, then by id."""
    return specs.withColumn("run_order", F.row_number().over(Window.orderBy(F.when(F.col("selection") != "none", 0).otherwise(1), "run_id")))
