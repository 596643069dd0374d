"""Benchmark models under leave-one-year-out validation, in closed form over windows: no fit per fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.panel import SERIES
from furrow.operators.trend import trend_feature


def null_prediction() -> Column:
    """The mean of the unit's other years. A null label is predicted but not trained on."""
    w = Window.partitionBy(*SERIES)
    own = F.coalesce(F.col("yield"), F.lit(0.0))
    n = F.count("yield").over(w) - F.col("yield").isNotNull().cast("int")
    return (F.sum("yield").over(w) - own) / F.nullif(n, F.lit(0))


def peak_prediction(x: str, by: list[str] = SERIES) -> Column:
    """The regression of yield on x over the other years of each `by`, from totals less the row's own terms."""
    w = Window.partitionBy(*by)
    use = F.col("yield").isNotNull() & F.col(x).isNotNull()
    terms = {"n": F.lit(1.0), "x": F.col(x), "y": F.col("yield"), "xy": F.col(x) * F.col("yield"), "xx": F.col(x) * F.col(x)}
    total = {k: F.sum(F.when(use, v)).over(w) - F.when(use, v).otherwise(0.0) for k, v in terms.items()}
    det = total["n"] * total["xx"] - total["x"] * total["x"]
    slope = (total["n"] * total["xy"] - total["x"] * total["y"]) / F.nullif(F.when(F.abs(det) > 1e-9, det), F.lit(0.0))
    intercept = (total["y"] - slope * total["x"]) / F.nullif(total["n"], F.lit(0.0))
    return slope * F.col(x) + intercept


def null_model(labels: DataFrame) -> DataFrame:
    return labels.withColumn("predicted", null_prediction())


def trend_model(labels: DataFrame, first_year: int) -> DataFrame:
    return trend_feature(labels, first_year).withColumnRenamed("trend", "predicted").drop("mean", "accepted")


def peak_model(labels: DataFrame, x: str) -> DataFrame:
    return labels.withColumn("predicted", peak_prediction(x))


def at_least_zero(value: Column) -> Column:
    """Negative predictions become 0; nulls stay."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def not_negative(rows: DataFrame, column: str = "predicted") -> DataFrame:
    return rows.withColumn(column, at_least_zero(F.col(column)))


def runs(labels: DataFrame, peaks: DataFrame, first_year: int) -> DataFrame:
    """run_id, model, adm_id, crop, year, y_true, y_pred, area of the three benchmarks. peaks: adm_id, year, peak.
    One panel: the three predictions are columns of one pass of windows over the series, and then become rows."""
    panel = trend_feature(labels.join(peaks, ["adm_id", "year"], "left"), first_year).withColumns({"__null": null_prediction(), "__peak": peak_prediction("peak")})
    models = [("Null_model", "__null"), ("Trend", "trend"), ("PeakModel", "__peak")]
    rows = [F.struct(F.lit(k).alias("run_id"), F.lit(name).alias("model"), F.round(at_least_zero(F.col(c)), 6).alias("y_pred")) for k, (name, c) in enumerate(models, 1)]
    each = panel.select(F.inline(F.array(*rows)), *SERIES, "year", F.col("yield").alias("y_true"), "area")
    return each.select("run_id", "model", *SERIES, "year", "y_true", "y_pred", "area")
