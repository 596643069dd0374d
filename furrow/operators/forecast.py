"""Operational forecasts: tables per unit, clamping to the historical band, national roll-up, exchange format."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import stats

KEYS = ["adm_id", "crop"]


def last_rows_mean(labels: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """Means over each series' last n rows by year."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("year"))
    last = labels.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n)
    return last.groupBy(*KEYS).agg(*(F.avg(c).alias(f"{c}_last{n}") for c in columns))


def history(labels: DataFrame) -> DataFrame:
    """Per series: minimum, maximum, mean, 10th and 90th percentile, and the percentile grids of yield and production."""
    return labels.groupBy(*KEYS).agg(
        F.min("yield").alias("yield_min"), F.max("yield").alias("yield_max"), F.avg("yield").alias("yield_mean"), F.percentile("yield", 0.1).alias("p10"), F.percentile("yield", 0.9).alias("p90"),
        stats.percentile_grid(F.col("yield")).alias("yield_grid"), stats.percentile_grid(F.col("production")).alias("production_grid"),
    )


def table(forecasts: DataFrame, labels: DataFrame) -> DataFrame:
    """forecasts (adm_id, crop, fyield) with the series' history, last-five means, relative differences, production and positions."""
    j = forecasts.join(history(labels), KEYS, "left").join(last_rows_mean(labels, ["yield", "area"]), KEYS, "left")
    j = j.withColumns({"fproduction": F.col("fyield") * F.col("area_last5"), "diff_prct": (F.col("fyield") - F.col("yield_last5")) / F.nullif(F.col("yield_last5"), F.lit(0.0)) * 100})
    return j.withColumns({"fyield_position": stats.percentile_position(F.col("yield_grid"), F.col("fyield")), "fproduction_position": stats.percentile_position(F.col("production_grid"), F.col("fproduction"))})


def clamp(rows: DataFrame) -> DataFrame:
    """Forecasts outside the 10th to 90th percentile take the bound; what depends on them is computed again.
    A clamped row's yield position is the bound's yield itself, and its production position is left to fill."""
    low, high = F.col("fyield") < F.col("p10"), F.col("fyield") > F.col("p90")
    bound = F.when(low, F.col("p10")).when(high, F.col("p90"))
    note = F.when(low, F.concat(F.lit("raised to p10 from "), F.format_string("%.3f", "fyield"))).when(high, F.concat(F.lit("lowered to p90 from "), F.format_string("%.3f", "fyield")))
    r = rows.withColumns({"note": note, "__bound": bound})
    clamped = F.col("__bound").isNotNull()
    value = F.coalesce("__bound", "fyield")
    return r.withColumns(
        {
            "fyield": value, "fproduction": value * F.col("area_last5"), "diff_prct": (value - F.col("yield_last5")) / F.nullif(F.col("yield_last5"), F.lit(0.0)) * 100,
            "fyield_position": F.when(clamped, F.col("__bound")).otherwise(F.col("fyield_position")), "fproduction_position": F.when(~clamped, F.col("fproduction_position")),
        }
    ).drop("__bound")


def fill_positions(rows: DataFrame) -> DataFrame:
    """Missing production positions from the series' production grid."""
    return rows.withColumn("fproduction_position", F.coalesce("fproduction_position", stats.percentile_position(F.col("production_grid"), F.col("fproduction"))))


def national(rows: DataFrame, labels: DataFrame, n: int = 5) -> DataFrame:
    """Per crop: area-weighted yield, production, difference to the last n national years, and the production's position."""
    now = rows.groupBy("crop").agg(F.sum("fproduction").alias("fproduction"), stats.weighted_mean(F.col("fyield"), F.col("area_last5")).alias("fyield"))
    years = labels.groupBy("crop", "year").agg(F.sum("production").alias("production"), (F.sum("production") / F.nullif(F.sum("area"), F.lit(0.0))).alias("yield"))
    w = Window.partitionBy("crop").orderBy(F.desc("year"))
    past = years.withColumn("k", F.row_number().over(w)).groupBy("crop").agg(F.avg(F.when(F.col("k") <= n, F.col("yield"))).alias("yield_last"), stats.percentile_grid(F.col("production")).alias("grid"))
    j = now.join(past, "crop", "left")
    return j.select("crop", "fyield", ((F.col("fyield") - F.col("yield_last")) / F.nullif(F.col("yield_last"), F.lit(0.0)) * 100).alias("yield_diff_pct"), "fproduction", stats.percentile_position(F.col("grid"), F.col("fproduction")).alias("fproduction_percentile"))


def exchange(rows: DataFrame, regions: DataFrame, recode: dict[str, str], unit: str = "t/ha") -> DataFrame:
    """The exchange format: region names joined, crops recoded, constants filled, columns in the template's order."""
    names = F.create_map(*(F.lit(x) for kv in recode.items() for x in kv)) if recode else None
    crop = F.coalesce(names[F.col("crop")], F.col("crop")) if recode else F.col("crop")
    j = rows.join(regions, "adm_id")
    return j.select("region", "adm_name", "adm_id", crop.alias("crop_name"), F.lit("yield").alias("variable"), F.round("fyield", 3).alias("value"), F.lit(unit).alias("unit"), F.round("p10", 3).alias("low"), F.round("p90", 3).alias("high"), F.lit("forecast").alias("status"))


def to_tonnes(value, unit) -> F.Column:
    """Yields and productions of several units in t/ha or t; others are null."""
    factor = F.when(unit.isin("t/ha", "t"), 1.0).when(unit.isin("kt"), 1000.0).when(unit.isin("kg/ha", "kg"), 0.001).when(unit.isin("q/ha", "q"), 0.1)
    return value * factor
