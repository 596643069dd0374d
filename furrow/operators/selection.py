"""Minimum-redundancy maximum-relevance feature selection.

All relevances and all pairwise correlations come from one aggregate each; the greedy
choice runs on the driver over a matrix whose size is the number of features squared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions import stats
from furrow.operators import running

FLOOR = 0.001


def relevance_regression(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, n, f: r^2 / (1 - r^2) (n - 2)."""
    y = F.col(target)
    one = df.agg(F.array(*(F.struct(F.lit(f).alias("feature"), stats.pearson(F.col(f), y).alias("r"), F.count(stats.both(F.col(f), y, y)).alias("n")) for f in features)).alias("a"))
    r2 = F.col("r") * F.col("r")
    return one.select(F.inline("a")).select("feature", "n", (r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2)).alias("f"))


def relevance_by_name(spark: SparkSession, table: str, target: str, leave_out: list[str] = ()) -> DataFrame:
    """relevance_regression of all numeric columns of a catalog table, by its name. The list of columns comes from the catalog, and the names
    of table and columns are bound as identifiers, so that what stands in them is never read as SQL."""
    scanned = spark.sql("SELECT * FROM IDENTIFIER(:table)", {"table": table})
    names = [f.name for f in scanned.schema if isinstance(f.dataType, T.NumericType) and f.name not in (target, *leave_out)]
    if target not in scanned.columns:
        raise ValueError(f"{table} has no column {target}")
    bound = {f"c{i}": f"`{c.replace('`', '``')}`" for i, c in enumerate([*names, target])}
    columns = ", ".join(f"CAST(IDENTIFIER(:{k}) AS DOUBLE) AS {k}" for k in bound)
    rows = spark.sql(f"SELECT {columns} FROM IDENTIFIER(:table)", bound | {"table": table})
    shown = F.create_map(*(F.lit(x) for i, c in enumerate(names) for x in (f"c{i}", c)))
    return relevance_regression(rows, [f"c{i}" for i in range(len(names))], f"c{len(names)}").withColumn("feature", shown[F.col("feature")])


def relevance_classes(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, f: between over within variance of the target's groups, from group counts, means and variances."""
    long = df.where(F.col(target).isNotNull()).unpivot([target], features, "feature", "value").where("value IS NOT NULL")
    g = long.groupBy("feature", target).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    a = g.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("nmm") - F.col("n") * F.col("mean") * F.col("mean")
    return a.select("feature", ((between / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(F.col("within") / F.nullif(F.col("n") - F.col("k"), F.lit(0)), F.lit(0.0))).alias("f"))


#: Ranges that a feature's values are cut into for running sums.
def relevance_ks(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, ks: the Kolmogorov-Smirnov distance of each class from the rest, averaged over classes.

    Counts per (feature, value, class) are dealt out over ranges of (feature, value) and written down, so that df is read once and no
    feature is one task. Between two values of a class its own share stands still while that of the rest rises, so that
    the largest distance is at one of its values or just before it: no class meets the values of others."""
    long = df.where(F.col(target).isNotNull()).unpivot([target], features, "feature", "value").where("value IS NOT NULL")
    counts = long.groupBy("feature", "value", F.col(target).alias("class")).agg(F.count("*").alias("n"))
    rows = running.dealt(counts, [F.col("feature"), F.col("value")])
    own0, all0 = running.before(rows, ["feature", "class"], {"own0": F.col("n")}), running.before(rows, ["feature"], {"all0": F.col("n")})
    sizes = rows.groupBy("feature", "class").agg(F.sum("n").alias("n_class"))
    sizes = sizes.withColumn("n_all", F.sum("n_class").over(Window.partitionBy("feature")))
    upto = Window.partitionBy(running.RANGE, "feature").orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(running.RANGE, "feature", "class").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumns({"every": F.sum("n").over(upto), "here": F.sum("n").over(Window.partitionBy(running.RANGE, "feature", "value")), "own": F.sum("n").over(own)})
    at = at.join(own0, [running.RANGE, "feature", "class"]).join(all0, [running.RANGE, "feature"]).join(sizes, ["feature", "class"])
    own, every = F.col("own0") + F.col("own"), F.col("all0") + F.col("every")

    def gap(own, every):
        return F.abs(own / F.col("n_class") - (every - own) / F.nullif(F.col("n_all") - F.col("n_class"), F.lit(0)))

    far = F.greatest(gap(own, every), gap(own - F.col("n"), every - F.col("here")))
    return at.groupBy("feature", "class").agg(F.max(far).alias("d")).groupBy("feature").agg(F.avg("d").alias("ks"))


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """a, b, r of all pairs of features."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    one = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), stats.pearson(F.col(a), F.col(b)).alias("r")) for a, b in pairs)).alias("p"))
    return one.select(F.inline("p"))


def greedy(relevance: dict[str, float | None], r: dict[tuple[str, str], float | None], k: int, mean: bool = True, same_domain: bool = False) -> list[tuple[str, float]]:
    """Features in the order of choice with their scores: relevance over the mean (or largest) |r| to those
    chosen, floored; a redundancy of exactly 1 counts as infinite; the first of equal scores wins."""
    left = [f for f, v in relevance.items() if v is not None and v > 0]
    chosen: list[tuple[str, float]] = []
    domain = lambda f: f.split("_")[0]
    while left and len(chosen) < k:
        scores = []
        for f in left:
            # with same_domain, features of other domains count as unrelated
            red = [max(abs(r.get((f, c), r.get((c, f))) or 0.0), FLOOR) if not same_domain or domain(c) == domain(f) else FLOOR for c, _ in chosen]
            d = (sum(red) / len(red) if mean else max(red)) if red else 1.0
            scores.append(0.0 if chosen and d == 1.0 else relevance[f] / d)
        at = max(range(len(left)), key=lambda i: (scores[i], -i))
        chosen.append((left.pop(at), scores[at]))
    return chosen


def mrmr(df: DataFrame, features: list[str], target: str, k: int, task: str = "regression", relevance: Callable | None = None, redundancy: Callable | None = None, **options) -> DataFrame:
    """rank, feature, score of the k chosen features. relevance(df, features, target) gives (feature, f), redundancy(df, features)
    gives (a, b, r); by default they are the F statistic and Pearson's correlation. options are those of `greedy`."""
    relevance = relevance or (relevance_regression if task == "regression" else relevance_classes)
    of = {x.feature: x.f for x in relevance(df, features, target).select("feature", "f").collect()}
    cors = {(x.a, x.b): x.r for x in (redundancy or correlations)(df, features).collect()}
    rows = [(i + 1, f, float(s)) for i, (f, s) in enumerate(greedy({f: of.get(f) for f in features}, cors, k, **options))]
    return df.sparkSession.createDataFrame(rows, "rank int, feature string, score double")


def mrmr_regression(df: DataFrame, features: list[str], target: str, k: int, **options) -> DataFrame:
    return mrmr(df, features, target, k, "regression", **options)


def mrmr_classif(df: DataFrame, features: list[str], target: str, k: int, **options) -> DataFrame:
    return mrmr(df, features, target, k, "classification", **options)


#: Rows of a forest's task. Each keeps its bins and its count in every tree, about 250 bytes.
FOREST_ROWS = 1_000_000


def forest_rows(df: DataFrame, columns: list[str], rows: int = FOREST_ROWS) -> DataFrame:
    """df without rows that lack a value, in tasks of about `rows` rows each, however the files are cut; as it is if one task can hold it all."""
    tasks = -(-df.count() // rows)
    t = df.select(columns).dropna()
    return t.repartition(tasks).sortWithinPartitions(columns) if tasks > 1 else t


def forest_importance(df: DataFrame, features: list[str], target: str, classes: bool = False, depth: int = 5, seed: int = 0) -> DataFrame:
    """feature, f: importances of a random forest of Spark ML."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    t = forest_rows(df, list(dict.fromkeys([*features, target])))
    if classes:
        t = StringIndexer(inputCol=target, outputCol="__y", stringOrderType="alphabetAsc").fit(t).transform(t)
    else:
        t = t.withColumn("__y", F.col(target).cast("double"))
    t = VectorAssembler(inputCols=features, outputCol="__x").transform(t)
    model = (RandomForestClassifier if classes else RandomForestRegressor)(featuresCol="__x", labelCol="__y", maxDepth=depth, seed=seed).fit(t)
    return df.sparkSession.createDataFrame(list(zip(features, map(float, model.featureImportances.toArray()), strict=True)), "feature string, f double")


def percent_grid(n_features: int, percents: list[int]) -> list[tuple[int, int]]:
    """(percent, number of features), rounded half to even, without numbers below 1 and repeated ones; of equal numbers the largest percent stays."""
    by_count = {round(n_features * p / 100): p for p in sorted(percents)}
    return sorted((p, n) for n, p in by_count.items() if n >= 1)


def best_count(scores: DataFrame) -> DataFrame:
    """Of rows (crop, percent, n_features, score) the best score of each crop; of equal ones the larger number of features."""
    w = Window.partitionBy("crop").orderBy(F.desc("score"), F.desc("n_features"))
    return scores.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
