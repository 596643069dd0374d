"""Linear models and components from sums.

Rows are summed up once in Spark: counts, sums and products of the inputs per (crop, year). Every
training set of nested leave-one-year-out validation is a difference of such sums, so that what is
solved afterwards is a small matrix per crop, however many rows there are. Predictions and component scores
are expressions over the rows again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grid of the penalty, 15 steps of equal ratio from 10^-3 to 10^0.5.
LASSO_ALPHAS = [10 ** (-3 + 3.5 * k / 14) for k in range(15)]


def moments(rows: DataFrame, by: list[str], features: list[str], target: str | None = None, center: dict[str, float] | None = None) -> DataFrame:
    """Per group n, sx, sxx (all products, row by row) and, with a target, sy, sxy, syy. Inputs are taken less `center`, which keeps digits."""
    x = [F.col(f) - F.lit((center or {}).get(f, 0.0)) for f in features]
    sums = [F.count("*").alias("n"), F.array(*map(F.sum, x)).alias("sx"), F.array(*(F.sum(a * b) for a in x for b in x)).alias("sxx")]
    if target:
        y = F.col(target)
        sums += [F.sum(y).alias("sy"), F.array(*(F.sum(a * y) for a in x)).alias("sxy"), F.sum(y * y).alias("syy")]
    return rows.groupBy(*by).agg(*sums)


def solve_lasso(c: np.ndarray, r: np.ndarray, alpha: float, steps: int = 1000) -> np.ndarray:
    """Weights that minimise w'Cw / 2 - r'w + alpha |w| for the covariances C of the inputs and r with the target, by coordinate descent."""
    w, g = np.zeros(len(r)), np.zeros(len(r))
    for _ in range(steps):
        most = 0.0
        for j in np.flatnonzero(np.diag(c) > 1e-12):
            rho = r[j] - g[j] + c[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / c[j, j]
            if new != w[j]:
                g += c[:, j] * (new - w[j])
                most, w[j] = max(most, abs(new - w[j])), new
        if most < 1e-10:
            break
    return w


class Sums:
    """Sums of one set of rows; sets that hold each other are added and subtracted."""

    def __init__(self, n, sx, sxx, sy, sxy, syy):
        self.parts = (n, np.asarray(sx, float), np.asarray(sxx, float).reshape(len(sx), len(sx)), sy, np.asarray(sxy, float), syy)

    def __add__(self, other: Sums) -> Sums:
        return Sums(*(a + b for a, b in zip(self.parts, other.parts, strict=True)))

    def __sub__(self, other: Sums) -> Sums:
        return Sums(*(a - b for a, b in zip(self.parts, other.parts, strict=True)))

    def fit(self, alpha: float, scale: np.ndarray) -> tuple[np.ndarray, float]:
        """(weights of the scaled inputs, intercept)."""
        n, sx, sxx, sy, sxy, _ = self.parts
        m, my = sx / n, sy / n
        w = solve_lasso((sxx / n - np.outer(m, m)) / np.outer(scale, scale), (sxy / n - m * my) / scale, alpha)
        return w, my - float(w / scale @ m)

    def rmse(self, w: np.ndarray, intercept: float) -> float:
        """Of predictions w'x + intercept over these rows."""
        n, sx, sxx, sy, sxy, syy = self.parts
        squares = syy - 2 * (w @ sxy + intercept * sy) + w @ sxx @ w + 2 * intercept * (w @ sx) + n * intercept * intercept
        return float(np.sqrt(max(squares, 0.0) / n))

    def scale(self) -> np.ndarray:
        """Population spread of the inputs; 1 where there is none."""
        n, sx, sxx = self.parts[:3]
        s = np.sqrt(np.maximum(np.diag(sxx) / n - (sx / n) ** 2, 0))
        return np.where(s > 1e-12, s, 1.0)

    def path(self, scale: np.ndarray, steps: int = 100, ratio: float = 1e-3) -> list[float]:
        """Penalties from the smallest one that sets all weights to zero down to its thousandth."""
        n, sx, _, sy, sxy, _ = self.parts
        top = float(np.abs((sxy / n - sx / n * sy / n) / scale).max())
        return [max(top, 1e-12) * ratio ** (k / (steps - 1)) for k in range(steps)]


def choose(total: Sums, years: dict[int, Sums], alphas: list[float], scale: np.ndarray) -> tuple[float, float]:
    """(penalty, mean RMSE over held-out years) with the smallest mean; the first of equal ones."""
    best = (alphas[0], np.inf)
    for alpha in alphas:
        errors = []
        for one in years.values():
            w, b = (total - one).fit(alpha, scale)
            errors.append(one.rmse(w / scale, b))
        if np.mean(errors) < best[1] - 1e-12:
            best = (alpha, float(np.mean(errors)))
    return best


def _center(rows: DataFrame, features: list[str]) -> dict[str, float]:
    one = rows.agg(*(F.avg(f).alias(f) for f in features)).first()
    return {f: one[f] or 0.0 for f in features}


FITTED = "crop string, held int, alpha double, first double, last double, rmse_val double, weights array<double>, intercept double"


def lasso(table: DataFrame, features: list[str], alphas: list[float] | None = LASSO_ALPHAS, nested: bool = True) -> DataFrame:
    """One row per crop and held-out year (nested), or per crop over all years (held is null; a tuning of the setting alone, and the fit
    that a forecast takes): alpha, the first and last of its grid, the validation RMSE, weights of the inputs as they are, and the intercept.
    alphas None is a path that follows from the data. Crops with fewer than two training years have no row."""
    ok = table.where(" AND ".join(f"`{f}` IS NOT NULL" for f in [*features, "yield"]))
    center = _center(ok, features)
    m0 = np.array([center[f] for f in features])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        years = {int(r.year): Sums(int(r.n), r.sx, r.sxx, float(r.sy), r.sxy, float(r.syy)) for r in pdf.sort_values("year").itertuples()}
        total = None
        for s in years.values():
            total = s if total is None else total + s
        out = []
        for held in years if nested else [None]:
            inner = {k: v for k, v in years.items() if k != held}
            if len(inner) < 2:
                continue
            train = total - years[held] if nested else total
            scale = train.scale()
            grid = alphas or train.path(scale)
            alpha, error = choose(train, inner, grid, scale)
            w, b = train.fit(alpha, scale)
            out.append((pdf["crop"].iloc[0], held, alpha, grid[0], grid[-1], error, (w / scale).tolist(), b - float(w / scale @ m0)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FITTED.split(", ")]).astype({"held": "Int32"})

    return moments(ok, ["crop", "year"], features, "yield", center).groupBy("crop").applyInPandas(fit, FITTED)


def linear(features: list[str]) -> Column:
    """The prediction of a row that carries weights and intercept."""
    out = F.col("intercept")
    for k, f in enumerate(features):
        out = out + F.col("weights")[k] * F.col(f)
    return out


def held_out_predictions(table: DataFrame, fitted: DataFrame, features: list[str]) -> DataFrame:
    """crop, year, adm_id, setting, y_true, y_pred of every row with all inputs, from the fit that its year was held out of; not below 0."""
    ok = table.where(" AND ".join(f"`{f}` IS NOT NULL" for f in features))
    j = ok.join(fitted.withColumnRenamed("held", "year"), ["crop", "year"], "left")
    setting = F.coalesce(hyper_text("alpha", F.col("alpha")), F.lit(""))
    return j.select("crop", "year", "adm_id", setting.alias("setting"), F.col("yield").alias("y_true"), F.round(F.when(F.col("intercept").isNotNull(), F.greatest(linear(features), F.lit(0.0))), 6).alias("y_pred"))


def forecasts(rows: DataFrame, fitted: DataFrame, features: list[str]) -> DataFrame:
    """crop, adm_id, year, y_pred of rows without a yet known yield, from the fit over all years."""
    return rows.join(fitted.drop("held"), "crop").select("crop", "adm_id", "year", F.round(F.greatest(linear(features), F.lit(0.0)), 6).alias("y_pred"))


def hyper_text(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}:"), F.round(value, 6).cast("string"))


def coefficients(features: list[str]) -> Column:
    """The intercept, then the weights as text: name:value, three decimals."""
    return F.concat_ws(",", F.concat(F.lit("Intercept: "), F.col("intercept").cast("string")), *(F.concat(F.lit(f"{f}:"), F.format_string("%.3f", F.col("weights")[k])) for k, f in enumerate(features)))


def pegged(folds: DataFrame, name: str, value: str, first: Column, last: Column) -> DataFrame:
    """Per crop the percentage of held-out years whose setting is at either end of its grid, as text; blank where it never is."""
    rate = lambda edge: F.round(F.avg((F.col(value) == edge).cast("double")) * 100).cast("int")
    text = lambda edge: F.when(rate(edge) > 0, F.concat(F.lit(f"{name}:"), rate(edge).cast("string"), F.lit(";"))).otherwise(F.lit(""))
    return folds.groupBy("crop").agg(F.count("*").alias("n_folds"), text(first).alias("pegged_left"), text(last).alias("pegged_right"))


def components(table: DataFrame, by: list[str], variables: dict[str, list[str]], keep: float) -> DataFrame:
    """by, variable, loadings (one array per kept component, largest variance first), mean: the components of each variable's monthly
    columns within each group, through the first that brings the explained variance above `keep`, and one fewer than there are columns
    at most. Of a component's two directions, its largest loading is positive."""
    columns = [c for cs in variables.values() for c in cs]
    ok = table.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    center = _center(ok, columns)
    schema = ", ".join(f"{c} {dict(table.dtypes)[c]}" for c in by)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            m = np.asarray(r.sx) / r.n
            cov = np.asarray(r.sxx).reshape(len(columns), -1) / r.n - np.outer(m, m)
            for name, cs in variables.items():
                at = [columns.index(c) for c in cs]
                value, vector = np.linalg.eigh(cov[np.ix_(at, at)])
                value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
                most = max(len(cs) - 1, 1)
                above = np.flatnonzero(np.cumsum(value)[:most] > keep * max(value.sum(), 1e-300))
                n = int(above[0]) + 1 if len(above) else most
                v = vector[:, :n].T
                v = v * np.where(v[np.arange(n), np.abs(v).argmax(axis=1)] < 0, -1, 1)[:, None]
                out.append((*(getattr(r, c) for c in by), name, v.tolist(), [float(m[k]) + center[columns[k]] for k in at]))
        return pd.DataFrame(out, columns=[*by, "variable", "loadings", "mean"])

    return moments(ok, by, columns, center=center).groupBy(*by).applyInPandas(of, f"{schema}, variable string, loadings array<array<double>>, mean array<double>")


def component_scores(table: DataFrame, by: list[str], variables: dict[str, list[str]], keep: float) -> DataFrame:
    """by, adm_id, year, feature (variable_PCA1...), value. Variables that are not named, as rain and soil moisture, keep their columns elsewhere."""
    found = components(table, by, variables, keep)
    inputs = F.array(*(F.struct(F.lit(name).alias("variable"), F.array(*map(F.col, cs)).alias("x")) for name, cs in variables.items()))
    rows = table.where(" AND ".join(f"`{c}` IS NOT NULL" for cs in variables.values() for c in cs)).select(*by, "adm_id", "year", F.inline(inputs))
    j = rows.join(found, [*by, "variable"]).select(*by, "adm_id", "year", "variable", "x", "mean", F.posexplode("loadings").alias("k", "v"))
    centered = F.zip_with("x", "mean", lambda a, b: a - b)
    score = F.aggregate(F.zip_with(centered, "v", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return j.select(*by, "adm_id", "year", F.concat("variable", F.lit("_PCA"), (F.col("k") + 1).cast("string")).alias("feature"), F.round(score, 6).alias("value"))
