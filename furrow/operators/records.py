"""Bookkeeping of tables, runs and reports: identifiers, duplicated keys, reconciliation, task lists, texts, exchange forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators import running

#: Tasks of one submission.
BATCH = 7500


def surrogate_ids(rows: DataFrame, name: str, into: str) -> DataFrame:
    """rows with a number from 1 for each name, in the order of names. The distinct names are numbered range by range."""
    names = running.dealt(rows.select(name).where(F.col(name).isNotNull()).distinct(), [F.col(name)])
    return rows.join(running.position(names, [], [F.col(name)], into).drop(running.RANGE), name, "left")


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key stands more than once. Keys are counted first, so that a hot key is no hot task."""
    many = rows.groupBy(*keys).count().where("count > 1").drop("count")
    return rows.join(many, keys, "left_semi")


def family(model: Column, benchmarks: list[str], run: Column | None = None) -> Column:
    """The benchmark's name, or ML for every other model, with the run's short name."""
    name = F.when(model.isin(benchmarks), model)
    return F.coalesce(name, F.lit("ML") if run is None else F.concat(F.lit("ML_"), run))


def for_every_crop(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of a unit repeated for each crop that the unit has; units without a crop keep one row."""
    return features.join(labels.select("adm_id", "crop").distinct(), "adm_id", "left")


def reconcile(left: DataFrame, right: DataFrame, keys: dict[str, str], measures: dict[str, str], tolerance: float = 1e-6) -> DataFrame:
    """Two sources of the same measures under differently named keys and columns, side by side: keys under the left names, both values,
    their difference, and status (both, differs, left_only, right_only)."""
    r = right.select(*(F.col(b).alias(f"__{a}") for a, b in (keys | measures).items()), F.lit(True).alias("__right"))
    j = left.select(*keys, *measures, F.lit(True).alias("__left")).join(r, reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(f"__{a}")) for a in keys]), "full_outer")
    close = reduce(Column.__and__, [(F.abs(F.col(m) - F.col(f"__{m}")) <= tolerance) | (F.col(m).isNull() & F.col(f"__{m}").isNull()) for m in measures])
    status = F.when(F.col("__right").isNull(), "left_only").when(F.col("__left").isNull(), "right_only").when(close, "both").otherwise("differs")
    values = [c for m in measures for c in (F.col(m).alias(f"{m}_left"), F.col(f"__{m}").alias(f"{m}_right"), (F.col(m) - F.col(f"__{m}")).alias(f"{m}_diff"))]
    return j.select(*(F.when(F.col("__left"), F.col(a)).otherwise(F.col(f"__{a}")).alias(a) for a in keys), *values, status.alias("status"))


def complete_years(rows: DataFrame, systems: tuple[str, str], none: str = "none") -> DataFrame:
    """rows (adm_id, adm_name, crop, year, system, area, production, yield) with a row for every year from a unit's first to its last.
    A unit that has both systems gets, in each year in which it has any row, the row of the system that is missing. New rows have no
    measures; names and crop are filled forward, then backward, in the order of years."""
    span = rows.groupBy("adm_id").agg(F.min("year").alias("a"), F.max("year").alias("b"), F.array_sort(F.collect_set(F.when(F.col("system") != none, F.col("system")))).alias("has"))
    years = span.select("adm_id", "has", F.explode(F.sequence("a", "b")).alias("year"))
    there = rows.groupBy("adm_id", "year").agg(F.collect_set("system").alias("seen"))
    both = F.array(*map(F.lit, sorted(systems)))
    lacking = F.when(F.col("seen").isNull(), F.array(F.lit(None).cast("string"))).when(F.array_except(both, "has") == F.array().cast("array<string>"), F.array_except(both, "seen")).otherwise(F.array().cast("array<string>"))
    new = years.join(there, ["adm_id", "year"], "left").select("adm_id", "year", F.explode(lacking).alias("system")).withColumn("added", F.lit(True))
    out = rows.withColumn("added", F.lit(False)).unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy("adm_id").orderBy("year", F.col("system").asc_nulls_last())
    fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return out.withColumns({c: fill(c) for c in ("adm_name", "crop")})


def season_bounds(rows: DataFrame, attributes: DataFrame, keep: str) -> DataFrame:
    """Per crop the mean start and stop, rounded, of the units that meet a condition, and how many they are."""
    kept = rows.join(attributes.where(keep).select("adm_id", "start", "stop"), "adm_id")
    return kept.groupBy("crop").agg(F.countDistinct("adm_id").alias("units"), F.bround(F.avg("start"), 0).cast("int").alias("start"), F.bround(F.avg("stop"), 0).cast("int").alias("stop"))


def task_batches(specs: DataFrame, size: int = BATCH) -> DataFrame:
    """specs with the submission that each belongs to, from 1, its padded id, and the name of its task file."""
    padded = F.lpad(F.col("run_id").cast("string"), 6, "0")
    return specs.withColumns({"batch": (F.floor((F.col("run_id") - 1) / size) + 1).cast("int"), "id": padded, "file": F.concat_ws("_", padded, F.lower("crop"), F.concat("algorithm", F.lit(".json")))})


def settings_text(settings: Column) -> Column:
    """A map of lists as text: name:v1,v2; name:v1."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(settings)), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ","))), "; ")


def from_downloads(parts: list[DataFrame]) -> DataFrame:
    """Downloads of one variable each as one long table: names and constants of the indicator series, dates from yyyyMMdd."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    #: fixed values: names of variables in downloads and in the series
    name = {"FPAR": "NDVI", "Solar Radiation": "rad", "Rainfall": "rainfall", "Temperature": "temperature"}
    variable = F.coalesce(F.create_map(*(F.lit(x) for kv in name.items() for x in kv))[F.col("variable_name")], F.col("variable_name"))
    return rows.select(
        F.col("region_name").alias("reg0_name"), F.col("region_id").alias("adm_id"), variable.alias("variable_name"), F.col("variable_id").alias("var_id"), F.lit("static masks").alias("classset_name"), F.lit(2).alias("classesset_id"),
        F.lower("class_name").alias("class_name"), "class_id", F.to_date(F.col("date").cast("string"), "yyyyMMdd").alias("date"), F.col("value").alias("mean"), F.lit(0).alias("stddev"),
    )


def to_thousand_tonnes(production: Column, area_unit: Column, yield_unit: Column) -> Column:
    """Production in kt by the pair of units that areas and yields are in; null for other pairs."""
    divider = F.when((area_unit == "ha") & (yield_unit == "t/ha"), 1e3).when((area_unit == "ha") & (yield_unit == "kg/ha"), 1e6).when(yield_unit == "100t", 10.0)
    return production / divider


def to_square_km(area: Column, unit: Column) -> Column:
    return area / F.when(unit == "ha", 100.0).when(unit == "km2", 1.0)


def exchange_accuracy(summary: DataFrame, names: DataFrame, recode: Column) -> DataFrame:
    """Accuracy of hindcasts in the exchange form: one row per unit, crop and measure."""
    measures = {"rmse": "t/ha", "rrmse_prct": "%", "mae": "t/ha", "r2": "1"}
    j = summary.join(names, "adm_id").withColumn("crop_name", recode)
    values = F.array(*(F.struct(F.lit(m).alias("variable"), F.round(m, 3).alias("value"), F.lit(u).alias("unit")) for m, u in measures.items()))
    return j.select("region", "adm_name", "adm_id", "crop_name", "model", F.inline(values), F.lit("accuracy").alias("status"))


def exchange_history(labels: DataFrame, names: DataFrame, recode: Column, digits: int = 3) -> DataFrame:
    """Observed areas, productions and yields in the exchange form; missing values have no row."""
    j = labels.join(names, "adm_id").withColumn("crop_name", recode)
    units = {"area": "ha", "production": "t", "yield": "t/ha"}
    values = F.array(*(F.struct(F.lit(m).alias("variable"), F.round(m, digits).alias("value"), F.lit(u).alias("unit")) for m, u in units.items()))
    return j.select("region", "adm_name", "adm_id", "crop_name", "year", F.inline(values), F.lit("observed").alias("status")).where("value IS NOT NULL")
