"""Statistics as Column builders. p and t are prediction and truth; rows where either is null take no part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def both(p: Column, t: Column, value: Column) -> Column:
    return F.when(p.isNotNull() & t.isNotNull(), value)


def mean_error(p: Column, t: Column) -> Column:
    return F.avg(p - t)


def mae(p: Column, t: Column) -> Column:
    return F.avg(F.abs(t - p))


def rmse(p: Column, t: Column) -> Column:
    return F.sqrt(F.avg((t - p) * (t - p)))


def r2(p: Column, t: Column) -> Column:
    """Coefficient of determination; null for constant truth and single pairs."""
    x = both(p, t, t)
    return 1 - F.sum((t - p) * (t - p)) / F.nullif(F.var_pop(x) * F.count(x), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; null where either is constant."""
    a, b = both(x, y, x), both(x, y, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def slope(y: Column, x: Column) -> Column:
    a, b = both(x, y, x), both(x, y, y)
    return F.covar_pop(a, b) / F.nullif(F.var_pop(a), F.lit(0.0))


def relative(metric: Column, t: Column) -> Column:
    """Percent of the mean truth."""
    return metric / F.nullif(F.avg(t), F.lit(0.0)) * 100


def weighted_mean(v: Column, w: Column, strict: bool = False) -> Column:
    """Mean of v with weights w. strict keeps the weight of rows without a value in the denominator."""
    return F.sum(v * w) / F.nullif(F.sum(w if strict else F.when(v.isNotNull(), w)), F.lit(0.0))


def weighted_rmse(p: Column, t: Column, w: Column) -> Column:
    return F.sqrt(F.sum(w * (t - p) * (t - p)) / F.nullif(F.sum(both(p, t, w)), F.lit(0.0)))


def summary(p: Column, t: Column) -> dict[str, Column]:
    """All error statistics, for one agg()."""
    return {
        "n": F.count(both(p, t, t)),
        "me": mean_error(p, t),
        "mae": mae(p, t),
        "rmse": rmse(p, t),
        "rmae_prct": relative(mae(p, t), t),
        "rrmse_prct": relative(rmse(p, t), t),
        "r2": r2(p, t),
        "r2_pearson": F.pow(pearson(p, t), 2),
    }


def rounded(columns: dict[str, Column], digits: int = 6) -> list[Column]:
    return [c.alias(k) if k == "n" else (F.round(c, digits) + F.lit(0.0)).alias(k) for k, c in columns.items()]


def percentile_position(grid: Column, value: Column) -> Column:
    """The place of value in an array of 101 percentiles: the first percentile above it, from 0 to 1; 1 at the maximum and beyond."""
    first = F.array_min(F.transform(grid, lambda x, i: F.when(value < x, i)))
    return F.when(value.isNull() | grid.isNull(), None).otherwise(F.coalesce(first / 100.0, F.lit(1.0)))



def percentile_grid(value: Column) -> Column:
    return F.percentile(value, [i / 100 for i in range(101)])


def pairs(x: Column, y: Column) -> Column:
    return F.count(both(x, y, F.lit(1)))


def pearson_finite(x: Column, y: Column) -> Column:
    """Correlation over pairs that are both finite numbers; null for fewer than two of them."""
    finite = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)
    x, y = finite(x), finite(y)
    return F.when(pairs(x, y) >= 2, pearson(x, y))


def taylor(p: Column, t: Column) -> dict[str, Column]:
    """What a Taylor diagram shows, for one agg(): spreads, centred root mean square difference, correlation."""
    a, b = both(p, t, p), both(p, t, t)
    return {"n": pairs(p, t), "sd_true": F.stddev_pop(b), "sd_pred": F.stddev_pop(a), "centred_rmsd": F.sqrt(F.var_pop(a - b)), "r": pearson(p, t)}


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t, by an Arrow function over what are few rows after an aggregate."""
    def of(t: pa.Array, df: pa.Array) -> pa.Array:
        from furrow.operators.learn import t_density_area

        ts, dfs = np.array(t.to_pylist(), float), np.array(df.to_pylist(), float)
        return pa.array([None if np.isnan(a) or not n >= 1 else max(1 - 2 * t_density_area(abs(a), n), 0.0) for a, n in zip(ts, dfs, strict=True)], pa.float64())

    return F.arrow_udf(of, "double")(t, df.cast("double"))
