"""Robust trends of yearly series: Theil-Sen, Mann-Kendall, and the guarded trend feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.panel import SERIES

#: Two-sided critical values of the standard normal distribution.
Z_CRITICAL = {0.05: 1.959964, 0.01: 2.575829}


def _points(x: str, y: str) -> Column:
    return F.filter(F.collect_list(F.when(F.col(y).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y")))), lambda p: p.isNotNull())


def slopes(points: Column) -> Column:
    """Slopes of all pairs of points with different x. A series has one point a year, so the array stays small."""
    return F.flatten(F.transform(points, lambda a: F.transform(F.filter(points, lambda b: b["x"] > a["x"]), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]))))


def median(values: Column) -> Column:
    """Median of an array; null if it is empty."""
    s = F.array_sort(values)
    n = F.size(s)
    low, high = F.try_element_at(s, F.floor((n + 1) / 2).cast("int")), F.try_element_at(s, F.floor(n / 2 + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def line(points: Column) -> tuple[Column, Column]:
    """Theil-Sen slope, and the intercept from the medians."""
    slope = median(slopes(points))
    return slope, median(F.transform(points, lambda p: p["y"])) - slope * median(F.transform(points, lambda p: p["x"]))


def theil_sen(labels: DataFrame) -> DataFrame:
    g = labels.groupBy(*SERIES).agg(F.array_sort(_points("year", "yield")).alias("p"))
    slope, intercept = line(F.col("p"))
    return g.select(*SERIES, F.size("p").alias("n"), slope.alias("slope"), intercept.alias("intercept"))


def mann_kendall(labels: DataFrame, alpha: float = 0.05) -> DataFrame:
    """s, its variance with ties taken out, z, and the trend at alpha. Ties are counted in their own
    grouping; signs come from the series' sorted points."""
    g = labels.where("yield IS NOT NULL").groupBy(*SERIES).agg(F.array_sort(_points("year", "yield")).alias("p"))
    sign = lambda d: F.when(d > 0, 1).when(d < 0, -1).otherwise(0)
    pair_sum = F.aggregate(F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b["x"] > a["x"]), lambda b: sign(b["y"] - a["y"])))), F.lit(0), lambda acc, v: acc + v)
    ties = labels.where("yield IS NOT NULL").groupBy(*SERIES, "yield").agg(F.count("*").alias("t")).groupBy(*SERIES).agg(F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("tied"))
    n = F.size("p")
    m = g.join(ties, SERIES).select(*SERIES, n.alias("n"), pair_sum.alias("s"), ((n * (n - 1) * (2 * n + 5) - F.col("tied")) / 18).alias("var_s"))
    z = F.when(F.col("var_s") <= 0, 0.0).when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("var_s")).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("var_s")).otherwise(0.0)
    m = m.withColumn("z", z)
    far = F.abs("z") > Z_CRITICAL[alpha]
    return m.withColumn("trend", F.when(far & (F.col("z") > 0), "increasing").when(far, "decreasing").otherwise("no trend"))


def trend_feature(labels: DataFrame, first_year: int, window: int = 12) -> DataFrame:
    """trend: for every (unit, crop, year) of a completed grid, the Theil-Sen estimate from a look-back
    arm, or the mean of the series where the arm is too thin.

    The arm is the last `window` years before, or if there are fewer of those than years after, the first
    `window` years after. It is accepted with at least 4 values, 2 of them in the half (two quartile bins
    of the arm's years) nearest to the target. Estimates are kept within 0.25 and 1.75 of the mean, which
    includes the target year. Years before first_year have no trend. If the labels start more than `window`
    years before first_year, the look-back arm is always taken."""
    w = Window.partitionBy(*SERIES).orderBy("year")
    point = F.struct(F.col("year").cast("double").alias("x"), F.col("yield").alias("y"))
    whole = Window.partitionBy(*SERIES)
    g = labels.withColumns(
        {
            "mean": F.avg("yield").over(whole),
            "first_label": F.min(F.when(F.col("yield").isNotNull(), F.col("year"))).over(whole),
            "n_before": F.count("year").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "n_after": F.count("year").over(w.rowsBetween(1, Window.unboundedFollowing)),
            "before": F.collect_list(point).over(w.rowsBetween(-window, -1)),
            "after": F.collect_list(point).over(w.rowsBetween(1, window)),
        }
    )
    back = (F.lit(first_year) - F.col("first_label") > window) | (F.col("n_before") >= F.col("n_after"))
    g = g.withColumn("arm", F.when(back, F.col("before")).otherwise(F.col("after")))
    years = F.transform("arm", lambda p: p["x"])
    n = F.size("arm")

    def quantile(q: float) -> Column:
        at = (n - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.try_element_at(years, low + 1), F.try_element_at(years, F.least(low + 2, n))
        return a + (b - a) * (at - low)

    g = g.withColumns({"q2": quantile(0.5)})
    first_near = F.abs(F.element_at("arm", 1)["x"] - F.col("year")) <= F.abs(F.element_at("arm", -1)["x"] - F.col("year"))
    valued = F.filter("arm", lambda p: p["y"].isNotNull())
    near = F.size(F.filter(valued, lambda p: F.when(first_near, p["x"] <= F.col("q2")).otherwise(p["x"] > F.col("q2"))))
    ok = F.when(n > 4, (F.size(valued) >= 4) & (near >= 2)).otherwise(F.lit(False))
    slope, intercept = line(valued)
    estimate = F.least(F.greatest(slope * F.col("year") + intercept, F.col("mean") * 0.25), F.col("mean") * 1.75)
    trend = F.when(F.col("year") >= first_year, F.when(ok, F.coalesce(estimate, F.col("mean"))).otherwise(F.col("mean")))
    return g.withColumns({"accepted": ok, "trend": trend}).drop("n_before", "n_after", "before", "after", "arm", "q2", "first_label")
