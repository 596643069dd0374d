"""Kernel and network regressions under nested leave-one-year-out validation, trees of Spark ML, and paired tests.
Spark deals out one task per (crop, held-out year); inside a task numpy fits small matrices. Linear models and
components need no such tasks: see `tuning`."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fit = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]]


def _rbf(a, b, gamma):
    return np.exp(-gamma * ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def svr(c: float, gamma: float, epsilon: float = 0.1, steps: int = 60) -> Fit:
    """Epsilon-insensitive regression with an RBF kernel: coordinate descent on the box-bounded dual; the bias is in the kernel."""

    def fit(x, y):
        my, sy = y.mean(), y.std() + 1e-12
        t = (y - my) / sy
        k = _rbf(x, x, gamma) + 1.0
        beta, f = np.zeros(len(t)), np.zeros(len(t))
        for _ in range(steps):
            most = 0.0
            for i in range(len(t)):
                g = t[i] - f[i] + k[i, i] * beta[i]
                new = math.copysign(max(abs(g) - epsilon, 0.0), g) / k[i, i]
                new = min(max(new, -c), c)
                if new != beta[i]:
                    f += k[:, i] * (new - beta[i])
                    most, beta[i] = max(most, abs(new - beta[i])), new
            if most < 1e-6:
                break
        return lambda q: ((_rbf(q, x, gamma) + 1.0) @ beta) * sy + my

    return fit


def gaussian_process(gamma: float, noise: float) -> Fit:
    def fit(x, y):
        my, sy = y.mean(), y.std() + 1e-12
        chol = np.linalg.cholesky(_rbf(x, x, gamma) + noise * np.eye(len(x)))
        a = np.linalg.solve(chol.T, np.linalg.solve(chol, (y - my) / sy))
        return lambda q: (_rbf(q, x, gamma) @ a) * sy + my

    return fit


def mlp(hidden: int, l2: float, steps: int = 300, rate: float = 0.05) -> Fit:
    """One hidden layer of tanh units, full-batch Adam from a fixed start."""

    def fit(x, y):
        my, sy = y.mean(), y.std() + 1e-12
        t = (y - my) / sy
        rng = np.random.default_rng(0)
        p = [rng.normal(0, 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.5, hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for s in range(1, steps + 1):
            h = np.tanh(x @ p[0] + p[1])
            e = (h @ p[2] + p[3] - t) / len(t)
            back = np.outer(e, p[2]) * (1 - h * h)
            for i, g in enumerate((x.T @ back + l2 * p[0], back.sum(axis=0), h.T @ e + l2 * p[2], np.array([e.sum()]))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**s)) / (np.sqrt(v[i] / (1 - 0.999**s)) + 1e-8)
        return lambda q: (np.tanh(q @ p[0] + p[1]) @ p[2] + p[3]) * sy + my

    return fit


GRIDS: dict[str, dict[str, Fit]] = {
    "svr": {f"c={c},gamma={g}": svr(c, g) for c in (1.0, 10.0) for g in (0.1,)},
    "gpr": {f"gamma={g},noise={n}": gaussian_process(g, n) for g in (0.05, 0.5) for n in (0.1, 1.0)},
    "mlp": {f"hidden={h},l2={p}": mlp(h, p) for h in (4,) for p in (0.001, 0.1)},
}


def choose(grid: dict[str, Fit], x: np.ndarray, y: np.ndarray, years: np.ndarray) -> str:
    """The setting with the best mean of minus RMSE over held-out years; the first of equal ones."""
    best, score = "", -np.inf
    for name, fit in grid.items():
        s = np.mean([-np.sqrt(np.mean((fit(x[years != h], y[years != h])(x[years == h]) - y[years == h]) ** 2)) for h in np.unique(years)])
        if s > score + 1e-12:
            best, score = name, s
    return best


def nested_cv(table: DataFrame, kind: str, features: list[str]) -> DataFrame:
    """crop, year (held out), adm_id, setting, y_true, y_pred. Inputs are scaled with the training years only."""
    years = table.select(F.col("year").alias("held")).distinct()
    tasks = table.join(F.broadcast(years))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf["held"].iloc[0]
        pdf = pdf.sort_values(["year", "adm_id"])
        ok = pdf[features].notna().all(axis=1)
        train, test = pdf[ok & (pdf["year"] != held) & pdf["yield"].notna()], pdf[ok & (pdf["year"] == held)]
        out = test[["crop", "year", "adm_id"]].assign(setting="", y_true=test["yield"], y_pred=np.nan)
        if train["year"].nunique() >= 2 and len(test):
            m, s = train[features].mean(), train[features].std(ddof=0).replace(0, 1)
            x, q = ((train[features] - m) / s).to_numpy(), ((test[features] - m) / s).to_numpy()
            y = train["yield"].to_numpy()
            name = choose(GRIDS[kind], x, y, train["year"].to_numpy())
            out = out.assign(setting=name, y_pred=np.round(np.maximum(GRIDS[kind][name](x, y)(q), 0), 6))
        return out

    return tasks.groupBy("crop", "held").applyInPandas(run, "crop string, year int, adm_id int, setting string, y_true double, y_pred double")


def trees(table: DataFrame, features: list[str], kind: str, year: int) -> DataFrame:
    """crop, adm_id, year, y_pred: trees of Spark ML trained on the other years over all crops, with the crop as an input."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    t = table.dropna(subset=[*features, "yield"])
    t = StringIndexer(inputCol="crop", outputCol="__crop", stringOrderType="alphabetAsc").fit(t).transform(t)
    t = VectorAssembler(inputCols=[*features, "__crop", "adm_id"], outputCol="__x").transform(t)
    model = (RandomForestRegressor if kind == "forest" else GBTRegressor)(featuresCol="__x", labelCol="yield", predictionCol="y_pred", maxDepth=5, seed=1)
    if kind == "boosted":
        model = model.setMaxIter(10)
    return model.fit(t.where(F.col("year") != year)).transform(t.where(F.col("year") == year)).select("crop", "adm_id", "year", F.round("y_pred", 4).alias("y_pred"))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def wilcoxon(d: np.ndarray) -> tuple[float, float]:
    """(W+, one-sided p of d > 0) with the normal approximation, ties corrected; (0, 1) without differences."""
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    a = np.abs(d)
    u, inv, count = np.unique(a, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inv]
    w = float(rank[d > 0].sum())
    var = n * (n + 1) * (2 * n + 1) / 24 - (count**3 - count).sum() / 48
    return w, normal_sf((w - n * (n + 1) / 4) / math.sqrt(var)) if var > 0 else 1.0


def royston_ends(n: int, last: float, second: float) -> tuple[float, float]:
    """The weights of the largest and the second largest of n values in Shapiro and Wilk's W, from their normalised expected scores.
    The coefficients here and in `shapiro_p` are fixed values of the published approximation (Royston 1995)."""
    u = 1 / math.sqrt(n)
    return last + float(np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)), second + float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """(W, p) of one small sample by Royston's approximation, for 3 values and more; (nan, nan) for fewer and for constants."""
    x = np.sort(x[~np.isnan(x)])
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return math.nan, math.nan
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = np.array([_normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        mm = float(m @ m)
        last, second = royston_ends(n, m[-1] / math.sqrt(mm), m[-2] / math.sqrt(mm))
        if n > 5:
            a = m / math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
            a[-2], a[1] = second, -second
        else:
            a = m / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = min(float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()), 1.0)
    return w, shapiro_p(n, w)


def shapiro_p(n: int, w: float) -> float:
    if n == 3:
        return max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    if w == 1.0:
        return 1.0
    ln = math.log(n)
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if math.log(1 - w) >= gamma:
            return 0.0
        y, mu = -math.log(gamma - math.log(1 - w)), np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, mu = math.log(1 - w), np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return normal_sf((y - mu) / sigma)


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def t_density_area(t: float, df: float) -> float:
    """P(0 < T < t) of Student's t; the substitution t = sqrt(df) tan(a) bounds what is integrated."""
    a = np.linspace(0, math.atan(t / math.sqrt(df)), 4001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return float(np.trapezoid(c * np.cos(a) ** (df - 1), a))


def t_test(d: np.ndarray) -> tuple[float, float]:
    """(t, one-sided p of a mean above 0)."""
    n = len(d)
    if n < 2 or d.std(ddof=1) == 0:
        return math.nan, math.nan
    t = float(d.mean() / (d.std(ddof=1) / math.sqrt(n)))
    half = t_density_area(abs(t), n - 1)
    return t, 0.5 - half if t > 0 else 0.5 + half
