"""Forests and boosted trees of Spark ML under nested leave-one-year-out validation, and models kept as files.

A model is fitted over all crops, with crop and unit as inputs, and its setting is chosen for each crop. The fit that leaves out two years
validates either of them for the other, so that nested validation of n years takes n (n - 1) / 2 fits a setting and not
n (n - 1). Numbers of trees cost nothing: smaller models are the first trees of the largest one. Fits run side by side from a bounded pool."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations, product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The settings of the whole grids. Trees of Spark have 30 levels at most, which the deeper ones are.
FOREST = {"depth": [10, 15, 20, 25, 30], "subset": ["1", "sqrt"], "trees": [50, 100, 250, 500]}
BOOSTED = {"rate": [0.01, 0.05, 0.1], "depth": [10, 20, 30], "share": [0.1, 0.24, 0.38, 0.52, 0.66, 0.8], "trees": [100, 250, 500]}

#: Fits that run at a time, at most. Each is a row of small jobs, between which its core waits for the driver.
PARALLEL = 32


def settings(grid: dict[str, list]) -> Iterator[dict]:
    """What is fitted: every setting but the number of trees, which is the largest."""
    names = [k for k in grid if k != "trees"]
    for values in product(*(grid[k] for k in names)):
        yield dict(zip(names, values, strict=True)) | {"trees": max(grid["trees"])}


def pipeline(kind: str, features: list[str], setting: dict) -> Pipeline:
    inputs = VectorAssembler(inputCols=[*features, "__crop", "adm_id"], outputCol="__x", handleInvalid="skip")
    common = {"featuresCol": "__x", "labelCol": "yield", "predictionCol": "__p", "maxDepth": setting["depth"], "seed": 1}
    if kind == "forest":
        model = RandomForestRegressor(**common, numTrees=setting["trees"], featureSubsetStrategy=setting["subset"])
    else:
        model = GBTRegressor(**common, maxIter=setting["trees"], stepSize=setting["rate"], minWeightFractionPerNode=setting.get("share", 0.0) / 2)
    return Pipeline(stages=[StringIndexer(inputCol="crop", outputCol="__crop", stringOrderType="alphabetAsc", handleInvalid="keep"), inputs, model])


def predictions(fitted: PipelineModel, rows: DataFrame, counts: list[int]) -> tuple[DataFrame, dict[int, Column]]:
    """rows with a column for every tree, and by number of trees the prediction of that many."""
    model = fitted.stages[-1]
    for stage in fitted.stages[:-1]:
        rows = stage.transform(rows)
    for k, tree in enumerate(model.trees):
        rows = tree.setPredictionCol(f"__t{k}").setFeaturesCol("__x").transform(rows)
    boosted = type(model).__name__.startswith("GBT")
    weights = list(model.treeWeights)

    def first(n: int) -> Column:
        terms = [F.col(f"__t{k}") * weights[k] for k in range(min(n, len(weights)))]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return F.greatest(total if boosted else total / len(terms), F.lit(0.0))

    return rows, {n: first(n) for n in counts}


def at_a_time(spark: SparkSession) -> int:
    """Fits that run at a time: two for each core, so that none is idle."""
    return max(1, min(PARALLEL, 2 * spark.sparkContext.defaultParallelism))


def side_by_side(jobs: list, parallel: int = PARALLEL) -> list:
    """Results of functions without arguments, at most `parallel` at a time."""
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(lambda job: job(), jobs))


def nested(table: DataFrame, features: list[str], kind: str, grid: dict[str, list], parallel: int | None = None) -> DataFrame:
    """crop, adm_id, year, setting, y_true, y_pred: each year predicted from the others, with the setting that has the smallest mean
    RMSE over these years when each of them is held out too. table: adm_id, crop, year, yield and features, without nulls.
    Only errors by crop, year and setting go to the driver."""
    parallel = parallel or at_a_time(table.sparkSession)
    years = sorted(r.year for r in table.select("year").distinct().collect())
    counts = sorted(grid["trees"])
    errors: dict[tuple, float] = {}

    def validate(pair: tuple[int, int], setting: dict) -> None:
        fitted = pipeline(kind, features, setting).fit(table.where(~F.col("year").isin(*pair)))
        rows, by_count = predictions(fitted, table.where(F.col("year").isin(*pair)), counts)
        for r in rows.groupBy("crop", "year").agg(*(F.sqrt(F.avg(F.pow(F.col("yield") - p, 2))).alias(str(n)) for n, p in by_count.items())).collect():
            held = pair[0] if r.year == pair[1] else pair[1]  # validates the choice for the other year
            for n in counts:
                errors[r.crop, held, r.year, name(setting | {"trees": n})] = r[str(n)]

    side_by_side([lambda p=p, s=s: validate(p, s) for p in combinations(years, 2) for s in settings(grid)], parallel)
    chosen = choose(errors)

    def refit(year: int, text: str, setting: dict) -> DataFrame:
        fitted = pipeline(kind, features, setting).fit(table.where(F.col("year") != year))
        crops = [c for (c, y), t in chosen.items() if y == year and t == text]
        rows, by_count = predictions(fitted, table.where((F.col("year") == year) & F.col("crop").isin(crops)), [setting["trees"]])
        return rows.select("crop", "adm_id", "year", F.lit(text).alias("setting"), F.col("yield").alias("y_true"), F.round(by_count[setting["trees"]], 4).alias("y_pred"))

    by_name = {name(s | {"trees": n}): s | {"trees": n} for s in settings(grid) for n in counts}
    parts = side_by_side([lambda y=y, t=t: refit(y, t, by_name[t]) for y, t in sorted({(y, t) for (_, y), t in chosen.items()})], parallel)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def name(setting: dict) -> str:
    return "; ".join(f"{k}:{v}" for k, v in sorted(setting.items()))


def choose(errors: dict[tuple, float]) -> dict[tuple, str]:
    """By (crop, held-out year) the setting with the smallest mean error over the other years, the first by name of equal ones."""
    means: dict[tuple, dict[str, list[float]]] = {}
    for (crop, held, _, text), e in errors.items():
        means.setdefault((crop, held), {}).setdefault(text, []).append(e)
    return {k: min(sorted(v), key=lambda t: sum(v[t]) / len(v[t])) for k, v in means.items()}


# --- models as files


def keep(fitted: PipelineModel, path: str) -> str:
    fitted.write().overwrite().save(path)
    return path


def forecast(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """crop, adm_id, year, y_pred of rows without a known yield, from a model that was kept as files."""
    out = PipelineModel.load(path).transform(rows)
    return out.select("crop", "adm_id", "year", F.round(F.greatest("__p", F.lit(0.0)), 4).alias("y_pred"))
