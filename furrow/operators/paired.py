"""Paired tests of groups of any size: ranks come from ranges of the sort order, and everything else from sums.

What is left for Python is one small function a group: the exact distribution of the signed-rank sum, areas of Student's t, and
Royston's approximation of Shapiro and Wilk's test."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators import learn, running

#: Up to so many differences without ties or zeros the signed-rank sum has its exact distribution.
EXACT = 50


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile (Acklam's rational approximation, relative error below 1.2e-9)."""
    # fixed values of the published approximation
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)

    def horner(coefficients: tuple, x: Column) -> Column:
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + F.lit(k)
        return out

    low = 0.02425
    tail = lambda q: horner(c, F.sqrt(-2 * F.ln(q))) / horner(d, F.sqrt(-2 * F.ln(q)))
    q = p - 0.5
    return F.when(p < low, tail(p)).when(p > 1 - low, -tail(1 - p)).otherwise(horner(a, q * q) * q / horner(b, q * q))


def signed_ranks(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, w_plus, w_minus, tied (sum of t^3 - t over ties of t): differences of zero are dropped, ties take their mean rank.

    Equal differences are one row, so that what is ranked is no larger than the values there are; ranks within a range
    and counts of the ranges before it make the rank in the group."""
    d = F.round(F.col(x) - F.col(y), 6)
    values = pairs.withColumn("d", d).where("d IS NOT NULL AND d <> 0").groupBy(*by, F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count(F.when(F.col("d") > 0, 1)).alias("up"))
    rows = running.dealt(values, [*map(F.col, by), F.col("size")])
    starts = running.before(rows, by, {"begin": F.col("n")})
    own = Window.partitionBy(running.RANGE, *by).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = running.matched(rows.withColumn("less", F.coalesce(F.sum("n").over(own), F.lit(0))), starts, [running.RANGE, *by])
    ranked = ranked.withColumn("rank", F.col("begin") + F.col("less") + (F.col("n") + 1) / 2)
    return ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("tied"))


@lru_cache(maxsize=EXACT)
def signed_rank_counts(n: int) -> np.ndarray:
    """How many of the 2^n signs of the ranks 1..n give each sum of positive ranks."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1
    for k in range(1, n + 1):
        counts[k:] = counts[k:] + counts[:-k]
    return counts


def signed_rank_p(n: int, w: float, tied: float, zeros: int) -> float:
    """P(W+ >= w) under symmetry: exact for few differences without ties and zeros, else normal with ties corrected."""
    if not n:
        return math.nan
    if n <= EXACT and not tied and not zeros:
        counts = signed_rank_counts(n)
        return float(counts[math.ceil(w - 1e-9) :].sum() / counts.sum())
    variance = n * (n + 1) * (2 * n + 1) / 24 - tied / 48
    return learn.normal_sf((w - n * (n + 1) / 4) / math.sqrt(variance)) if variance > 0 else 1.0


def shapiro_sums(pairs: DataFrame, by: list[str], d: str, order: list[str]) -> DataFrame:
    """by and what Shapiro and Wilk's W is made of: n, sums over the sorted differences and their expected normal scores, and the two
    differences and scores at either end. order tells equal differences apart."""
    rows = running.dealt(pairs.where(F.col(d).isNotNull()).select(*by, d, *order), [*map(F.col, (*by, d, *order))])
    placed = running.position(rows, by, [*map(F.col, (d, *order))], "place")
    sizes = pairs.where(F.col(d).isNotNull()).groupBy(*by).agg(F.count("*").alias("size"), F.avg(d).alias("mean"))
    j = running.matched(placed, sizes, by).withColumnRenamed(d, "d").withColumn("m", normal_quantile((F.col("place") - 0.375) / (F.col("size") + 0.25)))
    at = lambda i, c: F.max(F.when(F.col("place") == i, F.col(c)))
    n = F.col("size")
    return j.groupBy(*by).agg(
        F.max("size").alias("size"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("d")).alias("md"), F.sum(F.pow(F.col("d") - F.col("mean"), 2)).alias("squares"),
        at(F.lit(1), "d").alias("d1"), at(F.lit(2), "d").alias("d2"), at(n - 1, "d").alias("d3"), at(n, "d").alias("d4"), at(n - 1, "m").alias("m3"), at(n, "m").alias("m4"),
    )


_SHAPIRO = ("size", "mm", "md", "squares", "d1", "d2", "d3", "d4", "m3", "m4")


def shapiro_of(size, mm, md, squares, d1, d2, d3, d4, m3, m4) -> tuple[float, float]:
    """(W, p) from the sums of `shapiro_sums`."""
    n = int(size)
    if n < 3 or d1 == d4:
        return math.nan, math.nan
    ends, inner = d4 - d1, d3 - d2
    if n == 3:
        total = math.sqrt(0.5) * ends
    else:
        last, second = learn.royston_ends(n, m4 / math.sqrt(mm), m3 / math.sqrt(mm))
        if n > 5:
            phi = (mm - 2 * m4**2 - 2 * m3**2) / (1 - 2 * last**2 - 2 * second**2)
            total = (md - m4 * ends - m3 * inner) / math.sqrt(phi) + last * ends + second * inner
        else:
            phi = (mm - 2 * m4**2) / (1 - 2 * last**2)
            total = (md - m4 * ends) / math.sqrt(phi) + last * ends
    w = min(total**2 / squares, 1.0)
    return w, learn.shapiro_p(n, w)


_RESULT = ("shapiro_w", "shapiro_p", "wilcoxon_p", "t_p", "inverted_p", "standard_p")


def _tests(alpha: float):
    def of(*columns: pa.Array) -> pa.Array:
        out = []
        for r in zip(*(c.to_pylist() for c in columns), strict=True):
            n, t, ranked, w, tied, *sums = (math.nan if x is None else x for x in r)
            s, p_s = shapiro_of(*sums) if sums[0] == sums[0] else (math.nan, math.nan)
            ranked = 0 if ranked != ranked else int(ranked)
            p_w = signed_rank_p(ranked, w, tied, int(n) - ranked) if ranked else math.nan
            half = math.nan if t != t or n < 2 else learn.t_density_area(abs(t), n - 1)
            p_t = 0.5 - half if t > 0 else 0.5 + half
            chosen = (math.nan, math.nan) if p_s != p_s else (p_t, p_w) if p_s <= alpha else (p_w, p_t)
            out.append({k: None if v != v else float(v) for k, v in zip(_RESULT, (s, p_s, p_w, p_t, *chosen), strict=True)})
        return pa.array(out, pa.struct([(k, pa.float64()) for k in _RESULT]))

    return F.arrow_udf(of, "struct<" + ", ".join(f"{k}: double" for k in _RESULT) + ">")


def paired_tests(pairs: DataFrame, by: list[str], x: str, y: str, order: list[str], alpha: float = 0.05) -> DataFrame:
    """Per group of pairs that have both values: n, mean_x, mean_y, better (how often y is below x), t, w_plus, w_minus, and
    p-values of x above y. `inverted_p` takes the signed-rank test where normality of the differences is not rejected and the t test where
    it is, as the analysis that this reproduces; `standard_p` chooses the other way round. Both are null where
    normality can't be tested. order: columns that tell the pairs of a group apart."""
    ok = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__d", F.round(F.col(x) - F.col(y), 6))
    sums = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.avg((F.col(y) < F.col(x)).cast("double")).alias("better"), (F.avg("__d") / F.nullif(F.stddev_samp("__d") / F.sqrt(F.count("*")), F.lit(0.0))).alias("t"))
    ranks = signed_ranks(ok, by, x, y).withColumnRenamed("n", "ranked")
    j = sums
    for other in (ranks, shapiro_sums(ok, by, "__d", order)):
        j = running.matched(j, other, by, "left")
    tests = _tests(alpha)(*(F.col(c).cast("double") for c in ("n", "t", "ranked", "w_plus", "tied", *_SHAPIRO)))
    none = F.lit(0.0)
    return j.withColumn("__p", tests).select(*by, "n", "mean_x", "mean_y", "better", "t", F.coalesce("w_plus", none).alias("w_plus"), F.coalesce("w_minus", none).alias("w_minus"), "__p.*")


def against_base(res: DataFrame, base: str, others: list[str], by: list[str]) -> DataFrame:
    """paired_tests of the squared errors of run `base` against those of each other run of res (run, adm_id, year, y_true, y_pred and by),
    paired over (unit, year) where both predict. One pass over res: the errors of all runs of a pair become columns of one row."""
    runs = [base, *others]
    e = F.pow(F.col("y_true") - F.col("y_pred"), 2)
    wide = res.groupBy(*by, "adm_id", "year").agg(*(F.max(F.when(F.col("run") == r, e)).alias(f"__{k}") for k, r in enumerate(runs)))
    pairs = F.array(*(F.struct(F.lit(r).alias("other"), F.col("__0").alias("base_error"), F.col(f"__{k}").alias("other_error")) for k, r in enumerate(others, 1)))
    return paired_tests(wide.select(*by, "adm_id", "year", F.inline(pairs)), [*by, "other"], "base_error", "other_error", ["adm_id", "year"]).withColumnsRenamed({"mean_x": "mse_base", "mean_y": "mse_other"})
