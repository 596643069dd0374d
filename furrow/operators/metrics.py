"""Error statistics of predictions (run_id, model, adm_id, crop, year, y_true, y_pred, area), each level in one or two aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import stats

RUN = ["run_id", "model", "crop"]


def _p() -> tuple[Column, Column]:
    return F.col("y_pred"), F.col("y_true")


def overall(res: DataFrame, by: list[str] = RUN) -> DataFrame:
    return res.groupBy(*by).agg(*(c.alias(k) for k, c in stats.summary(*_p()).items()))


def by_unit(res: DataFrame) -> DataFrame:
    return overall(res, [*RUN, "adm_id"])


def averaged(res: DataFrame, over: str) -> DataFrame:
    """Statistics within each value of `over` (year: spatial, adm_id: temporal), then their mean."""
    inner = overall(res, [*RUN, over])
    return inner.groupBy(*RUN).agg(F.count("*").alias("n_groups"), *(F.avg(c).alias(c) for c in ("mae", "me", "rmse", "r2")))


def country(res: DataFrame, strict: bool = True) -> DataFrame:
    """Area-weighted yearly means of truth and prediction. strict keeps the area of units without a value in the denominator."""
    w = F.col("area")
    return res.groupBy(*RUN, "year").agg(stats.weighted_mean(F.col("y_true"), w, strict).alias("y_true"), stats.weighted_mean(F.col("y_pred"), w, strict).alias("y_pred"))


def country_summary(res: DataFrame) -> DataFrame:
    return overall(country(res))


def lowest_quartile(res: DataFrame) -> DataFrame:
    """Errors of the national series in the years whose truth is in the lowest quartile."""
    c = country(res)
    q = c.groupBy(*RUN).agg(F.percentile("y_true", 0.25).alias("q1"))
    return overall(c.join(q, RUN).where(F.col("y_true") <= F.col("q1") + 1e-9)).select(*RUN, "n", "rmse", "rrmse_prct")


def weighted(res: DataFrame, weights: DataFrame) -> DataFrame:
    """RMSE with a weight per unit and crop; the relative value divides by the unweighted mean truth."""
    p, t = _p()
    j = res.join(weights, ["adm_id", "crop"], "left")
    r = stats.weighted_rmse(p, t, F.col("weight"))
    return j.groupBy(*RUN).agg(r.alias("wrmse"), stats.relative(r, t).alias("wrrmse_prct"))
