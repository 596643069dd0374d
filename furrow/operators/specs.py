"""Task tables: the product of setting axes without the combinations that make no sense."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AXES = {
    "algorithm": ["Lasso", "SVR_linear", "GPR"], "feature_set": ["rs", "rs_reduced", "met"], "reduction": ["none", "PCA"],
    "selection": ["none", "MRMR"], "one_hot": [True, False], "lead_time": [1, 4],
}
#: No components of a single month, and no selection from components.
SKIP = "(reduction = 'PCA' AND lead_time = 1) OR (reduction = 'PCA' AND selection = 'MRMR')"


def narrow(axes: dict[str, list], keep: dict[str, list]) -> dict[str, list]:
    """The axes with only the wanted values."""
    return {k: [v for v in values if v in keep.get(k, values)] for k, values in axes.items()}


def grid(spark: SparkSession, axes: dict[str, list], skip: str = SKIP) -> DataFrame:
    """run_id and one column per axis. Axes are literal arrays; the product is exploded, not joined."""
    df = spark.range(1).select(*(F.explode(F.array(*map(F.lit, v))).alias(k) for k, v in list(axes.items())[:1]))
    for k, v in list(axes.items())[1:]:
        df = df.withColumn(k, F.explode(F.array(*map(F.lit, v))))
    df = df.where(f"NOT ({skip})")
    order = Window.orderBy("lead_time", *(c for c in axes if c != "lead_time"))  # a few hundred rows
    return df.select(F.row_number().over(order).alias("run_id"), *axes)


#: Benchmarks have no settings of their own; tuned models get all combinations. Feature-engineered variants (@PeakFPARAndLast3) take
#: the maximum of the satellite variable in place of its months, and have no form for the feature sets without it.
BENCHMARKS = ["Null_model", "PeakFPAR", "Trend"]
ENGINEERED = {"rs_met": "maxRS_met", "rs_met_reduced": "maxRS_met_reduced", "rs_met_sm_reduced": "maxRS_met_sm_reduced", "rs": "maxRS", "rs_sm_reduced": "maxRS_sm"}


def all_specs(spark: SparkSession, crops: list[str], axes: dict[str, list], engineered: str | None = "@PeakFPARAndLast3", benchmarks: list[str] = BENCHMARKS) -> DataFrame:
    """run_id, crop, algorithm and the axes: benchmarks of every crop and lead time first, then the tuned models with feature selection
    first, then plain and engineered ones without. Axes that a benchmark doesn't have are none."""
    each = lambda values: F.explode(F.array(*map(F.lit, values)))
    algorithms = axes["algorithm"] + ([a + engineered for a in axes["algorithm"]] if engineered else [])
    crop = spark.range(1).select(each(crops).alias("crop"))
    tuned = crop.withColumn("algorithm", each(algorithms))
    for k, v in axes.items():
        tuned = tuned if k == "algorithm" else tuned.withColumn(k, each(v))
    tuned = tuned.where(f"NOT ({SKIP})")
    if engineered:
        is_engineered = F.col("algorithm").endswith(engineered)
        name = F.create_map(*(F.lit(x) for kv in ENGINEERED.items() for x in kv))[F.col("feature_set")]
        tuned = tuned.withColumn("feature_set", F.when(is_engineered, name).otherwise(F.col("feature_set"))).where("feature_set IS NOT NULL")
    bench = crop.withColumn("algorithm", each(benchmarks)).withColumn("lead_time", each(axes["lead_time"]))
    bench = bench.select("crop", "algorithm", *(F.lit(False).alias(k) if isinstance(v[0], bool) else F.lit("none").alias(k) for k, v in axes.items() if k not in ("algorithm", "lead_time")), "lead_time")
    kind = F.when(F.col("algorithm").isin(benchmarks), 0).when(F.col("selection") != "none", 1).otherwise(2)
    order = Window.orderBy(kind, "crop", "algorithm", "lead_time", *(k for k in axes if k not in ("algorithm", "lead_time")))  # a few thousand rows
    both = bench.unionByName(tuned.select(bench.columns))
    return both.select(F.row_number().over(order).alias("run_id"), "*")
