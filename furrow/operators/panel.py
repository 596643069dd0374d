"""Label panels (adm_id, crop, year, area, production, yield): completion, quality control, unit statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import stats

SERIES = ["adm_id", "crop"]


def complete_grid(labels: DataFrame) -> DataFrame:
    """All units x crops x years; missing cells have null measures. The axes are small distinct lists."""
    years = labels.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    axes = labels.select("adm_id").distinct().crossJoin(F.broadcast(labels.select("crop").distinct())).crossJoin(F.broadcast(years))
    return axes.join(labels, ["adm_id", "crop", "year"], "left")


def with_data(grid: DataFrame, value: str = "yield") -> DataFrame:
    """Series with any value."""
    return grid.withColumn("__n", F.count(value).over(Window.partitionBy(*SERIES))).where("__n > 0").drop("__n")


def at_least(labels: DataFrame, n: int, value: str = "yield") -> DataFrame:
    """Rows of series with n values or more."""
    return labels.withColumn("n_obs", F.count(value).over(Window.partitionBy(*SERIES))).where(F.col("n_obs") >= n)


def exclude(labels: DataFrame, pairs: dict[str, list[int]]) -> DataFrame:
    """Without the given units of each crop."""
    spark = labels.sparkSession
    listed = spark.createDataFrame([(list(pairs.items()) and dict(pairs),)], "m map<string, array<int>>").select(F.explode("m").alias("crop", "ids")).select("crop", F.explode("ids").alias("adm_id"))
    return labels.join(F.broadcast(listed), ["adm_id", "crop"], "left_anti")


def fill(series: DataFrame, value: str) -> DataFrame:
    """Forward, then backward fill in the order of years."""
    w = Window.partitionBy(*SERIES).orderBy("year")
    ahead = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return series.withColumn(f"{value}_filled", F.coalesce(ahead, behind))


def fill_with_first(series: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Nulls take the unit's first value in an order."""
    w = Window.partitionBy("adm_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return series.withColumn(value, F.coalesce(F.col(value), F.first(value, ignorenulls=True).over(w)))


def choose_system(rows: DataFrame, system: str, preferred: str) -> DataFrame:
    """Of series with several production systems keep the preferred one; with one system, that one."""
    w = Window.partitionBy(*SERIES)
    n = F.size(F.collect_set(system).over(w))
    has = F.max((F.col(system) == preferred).cast("int")).over(w) == 1
    lowest = F.min(system).over(w)
    chosen = F.when(n == 1, F.col(system)).when(has, F.lit(preferred)).otherwise(lowest)
    return rows.withColumns({"n_systems": n.cast("bigint"), "chosen": chosen}).where(F.col(system) == F.col("chosen")).drop("chosen")


def flag_duplicates(labels: DataFrame) -> DataFrame:
    """duplicate: the yield equals the one before it in the order of years."""
    before = F.lag("yield").over(Window.partitionBy(*SERIES).orderBy("year"))
    return labels.withColumn("duplicate", F.coalesce(F.col("yield") == before, F.lit(False)))


def flag_outliers(labels: DataFrame, min_change: float = 75, z_limit: float = 3, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """z (population) and percent difference from the series' mean over rows that are no duplicates; outlier is
    Removed above, Flagged below, where both limits are passed. Only rows from first_year to last_year are looked at."""
    w = Window.partitionBy(*SERIES)
    looked_at = ~F.col("duplicate")
    for year, ok in ((first_year, F.col("year") >= first_year), (last_year, F.col("year") <= last_year)):
        looked_at = looked_at if year is None else looked_at & ok
    v = F.when(looked_at, F.col("yield"))
    mean, sd = F.avg(v).over(w), F.stddev_pop(v).over(w)
    out = labels.withColumns({"z": (v - mean) / F.nullif(sd, F.lit(0.0)), "diff_prct": (v - mean) / F.nullif(mean, F.lit(0.0)) * 100})
    far = (F.abs("z") > z_limit) & (F.abs("diff_prct") >= min_change)
    return out.withColumn("outlier", F.when(far & (F.col("z") > 0), "Removed").when(far, "Flagged"))


def flag_low_yield(labels: DataFrame, least: float = 0.5) -> DataFrame:
    """low_yield: a yield of zero although production over area says otherwise."""
    ratio = F.col("production") / F.nullif(F.col("area"), F.lit(0.0))
    return labels.withColumn("low_yield", F.when((F.col("yield") == 0) & (ratio >= least), "Removed"))


def flagged(labels: DataFrame) -> DataFrame:
    return flag_low_yield(flag_outliers(flag_duplicates(labels)))


def cleaned(labels: DataFrame) -> DataFrame:
    """Rows with all measures that no rule removes; duplicates go too."""
    f = flagged(labels)
    removed = F.coalesce(F.col("outlier") == "Removed", F.lit(False)) | F.coalesce(F.col("low_yield") == "Removed", F.lit(False)) | F.col("duplicate")
    return f.where("area IS NOT NULL AND production IS NOT NULL AND yield IS NOT NULL").where(~removed)


def qc_summary(labels: DataFrame) -> DataFrame:
    """Per crop the number of rows of each finding and the years of removed outliers, joined."""
    f = flagged(labels)
    years = F.array_sort(F.collect_set(F.when(F.col("outlier") == "Removed", F.col("year"))))
    return f.groupBy("crop").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("duplicate"), 1)).alias("n_duplicate"), F.count(F.when(F.col("outlier") == "Removed", 1)).alias("n_removed"),
        F.count(F.when(F.col("outlier") == "Flagged", 1)).alias("n_flagged"), F.count("low_yield").alias("n_low"), F.array_join(F.transform(years, lambda y: y.cast("string")), "|").alias("removed_years"),
    )


def last_years(labels: DataFrame, n: int = 5) -> DataFrame:
    """The last n calendar years of each series."""
    last = F.max("year").over(Window.partitionBy(*SERIES))
    return labels.withColumn("__last", last).where(F.col("year") > F.col("__last") - n).drop("__last")


def unit_statistics(labels: DataFrame) -> DataFrame:
    """Per unit and crop: means, spreads and counts, and the unit's share and cumulative share of the crop's area."""
    s = labels.groupBy(*SERIES).agg(
        F.avg("production").alias("production_mean"), F.stddev_samp("production").alias("production_std"), F.avg("yield").alias("yield_mean"), F.stddev_samp("yield").alias("yield_std"),
        F.count("yield").alias("n"), F.round(F.avg("area"), 6).alias("area_mean"), F.stddev_samp("area").alias("area_std"),
    )
    whole = Window.partitionBy("crop")
    so_far = Window.partitionBy("crop").orderBy(F.desc("area_mean"), "adm_id").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("crop_total_area", F.sum("area_mean").over(whole))
    return s.withColumns({"area_prct": F.col("area_mean") / F.col("crop_total_area") * 100, "cum_area": F.sum("area_mean").over(so_far)}).withColumn("cum_area_prct", F.col("cum_area") / F.col("crop_total_area") * 100)


def retain(statistics: DataFrame, prct: float) -> DataFrame:
    """Units by falling area through the first that reaches prct percent of the crop's area; 100 keeps all."""
    before = F.col("cum_area_prct") - F.col("area_prct")
    return statistics if prct >= 100 else statistics.where(F.round(before, 9) < prct)


def crop_areas(labels: DataFrame) -> DataFrame:
    """Per crop its area, share of all area, and the share of rows without area."""
    c = labels.groupBy("crop").agg(F.sum("area").alias("area"), (F.count(F.when(F.col("area").isNull(), 1)) / F.count("*") * 100).alias("missing_prct"))
    total = c.agg(F.sum("area").alias("total"))
    return c.crossJoin(F.broadcast(total)).withColumn("area_prct", F.col("area") / F.col("total") * 100).drop("total")


def crop_correlation(labels: DataFrame) -> DataFrame:
    """Correlation of the yields of each pair of crops over units and years, from one row of all crops per unit and year."""
    cell = labels.where("yield IS NOT NULL").groupBy("adm_id", "year").agg(F.array_sort(F.collect_list(F.struct("crop", "yield"))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b["crop"] > a["crop"]), lambda b: F.struct(a["crop"].alias("crop_a"), b["crop"].alias("crop_b"), a["yield"].alias("x"), b["yield"].alias("y")))))
    return cell.select(F.inline(pairs)).groupBy("crop_a", "crop_b").agg(stats.pearson(F.col("x"), F.col("y")).alias("r"), F.count("*").alias("n"))


def with_features(labels: DataFrame, features: DataFrame, until: int) -> DataFrame:
    """Labels and features side by side, rows of either alone included, up to a year. Null keys match null keys."""
    f = features.withColumnsRenamed({"adm_id": "__a", "year": "__y"})
    j = labels.join(f, F.col("adm_id").eqNullSafe(F.col("__a")) & F.col("year").eqNullSafe(F.col("__y")), "full_outer")
    j = j.withColumns({"adm_id": F.coalesce("adm_id", "__a"), "year": F.coalesce("year", "__y")})
    return j.drop("__a", "__y").where(F.col("year") <= until)


def latest_set(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows of the boundary set that the latest row belongs to; the latest is one value, joined by broadcast."""
    last = rows.agg(F.max_by(name, F.struct(*order)).alias("__last"))
    return rows.join(F.broadcast(last), F.col(name) == F.col("__last")).drop("__last")


def subset_by(labels: DataFrame, attributes: DataFrame, keep: str) -> DataFrame:
    """Rows of units whose attributes meet a condition."""
    return labels.join(attributes.where(keep).select("adm_id").distinct(), "adm_id", "left_semi")
