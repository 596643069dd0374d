"""Monthly and seasonal features from dekadal indicator series (adm_id, variable_name, date, mean)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import dekad

#: Statistics of each variable in a season matrix; others get their mean.
STATISTICS = {"rainfall": ("sum",), "temperature": ("mean", "min", "max"), "FPAR": ("mean", "min", "max"), "NDVI": ("mean", "min", "max")}
_AFFIX = {"mean": "M", "sum": "SumM", "min": "minM", "max": "maxM"}


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def monthly(ind: DataFrame) -> DataFrame:
    """adm_id, variable_name, month (its first day), first_date, n, mean, min, max, sum; a sum over no value is 0."""
    v = F.col("mean")
    return ind.groupBy("adm_id", "variable_name", month_start(F.col("date")).alias("month")).agg(F.min("date").alias("first_date"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"))


def monthly_weighted(ind: DataFrame) -> DataFrame:
    """Mean over a month with the dekads' lengths as weights; the length of a dekad without value stays in the denominator."""
    d = dekad.days(dekad.from_date(F.col("date")))
    return ind.groupBy("adm_id", "variable_name", month_start(F.col("date")).alias("month")).agg((F.sum(F.col("mean") * d) / F.sum(d)).alias("mean"))


def complete_months(ind: DataFrame) -> DataFrame:
    """Months whose first observed day is the first."""
    return monthly(ind).where(F.dayofmonth("first_date") == 1)


def from_first_of(ind: DataFrame, variable: str) -> DataFrame:
    """Rows from the first date of one variable on; the date is one row, so the join is a broadcast."""
    first = ind.where(F.col("variable_name") == variable).agg(F.min("date").alias("__first"))
    return ind.join(F.broadcast(first), F.col("date") >= F.col("__first")).drop("__first")


def seasonal(ind: DataFrame, sos: int, eos: int) -> DataFrame:
    """Monthly rows within the season with season_year and month_index."""
    m = monthly(ind).where(dekad.in_season(F.month("month"), sos, eos))
    return m.withColumns({"season_year": dekad.season_year(F.col("month"), sos, eos), "month_index": dekad.season_index(F.month("month"), sos)})


def season_months(ind: DataFrame, sos: int, eos: int) -> DataFrame:
    """season_year, months (distinct months seen over all units and variables), dropped: whether a
    season among the first two is incomplete and therefore dropped."""
    s = seasonal(ind, sos, eos).groupBy("season_year").agg(F.countDistinct("month_index").alias("months"))
    first = F.array_sort(F.collect_list("season_year").over(Window.partitionBy(F.lit(0))))  # a row per season
    rank = F.array_position(first, F.col("season_year"))
    return s.withColumn("dropped", (rank <= 2) & (F.col("months") < dekad.season_length(sos, eos)))


def complete_seasons(ind: DataFrame, sos: int, eos: int) -> DataFrame:
    """Seasonal rows without those of the first two seasons if they are incomplete."""
    gone = season_months(ind, sos, eos).where("dropped").select("season_year")
    return seasonal(ind, sos, eos).join(gone, "season_year", "left_anti")


def issued_earlier(ind: DataFrame, prefix: str = "SF_") -> DataFrame:
    """Seasonal forecasts dated a month earlier: the month in which they are known."""
    return ind.withColumn("date", F.when(F.col("variable_name").contains(prefix), F.add_months("date", -1)).otherwise(F.col("date")))


def season_features(ind: DataFrame, sos: int, eos: int) -> DataFrame:
    """Long features: adm_id, season_year, variable_name, month_index, feature, value."""
    s = seasonal(ind, sos, eos)
    pairs = []
    for stat in ("mean", "sum", "min", "max"):
        takes = [v for v, stats in STATISTICS.items() if stat in stats]
        wanted = F.col("variable_name").isin(takes)
        if stat == "mean":
            wanted = wanted | ~F.col("variable_name").isin(list(STATISTICS))
        pairs.append(F.when(wanted, F.struct(F.lit(_AFFIX[stat]).alias("affix"), F.col(stat).alias("value"))))
    e = s.withColumn("p", F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull())))
    return e.select("adm_id", "season_year", "variable_name", "month_index", F.concat("variable_name", "p.affix", F.col("month_index").cast("string")).alias("feature"), F.col("p.value").alias("value"))


def season_matrix(ind: DataFrame, sos: int, eos: int, columns: list[str]) -> DataFrame:
    """One row per unit and season, the named features as columns."""
    return season_features(ind, sos, eos).groupBy("adm_id", "season_year").pivot("feature", columns).agg(F.first("value", ignorenulls=True))


def up_to(features: DataFrame, month: int) -> DataFrame:
    """Features known at a lead time."""
    return features.where(F.col("month_index") <= month)


def horizons(forecasts: DataFrame, month: int, season_months: int) -> DataFrame:
    """Forecast features issued in a month whose horizon still lies in the season."""
    return forecasts.where((F.col("month_index") == month) & F.col("horizon").between(1, season_months - 1 - month))


def group(features: DataFrame, variables: list[str]) -> DataFrame:
    return features.where(F.col("variable_name").isin(variables))


def peak_and_last(features: DataFrame, variable: str, month: int, last: int = 3) -> DataFrame:
    """adm_id, season_year, peak (largest maximum of a variable so far), and the other variables' means of the last months."""
    known = up_to(features, month)
    peak = F.max(F.when((F.col("variable_name") == variable) & F.col("feature").contains("max"), F.col("value")))
    tail = F.avg(F.when((F.col("variable_name") != variable) & (F.col("month_index") > month - last), F.col("value")))
    return known.groupBy("adm_id", "season_year").agg(peak.alias("peak"), tail.alias("tail_mean"), F.count(F.when((F.col("variable_name") != variable) & (F.col("month_index") > month - last), 1)).alias("n_tail"))


def peak_and_last_wide(matrix: DataFrame, variable: str, month: int, last: int = 3) -> DataFrame:
    """A season matrix as feature-engineered models take it: the monthly maxima of a variable up to a month become their largest, `peak`, and
    of the other variables the columns of the last months are kept as they are. Columns are known by the pattern of their names."""
    named = {c: re.fullmatch(r"(.+?)(Sum|min|max)?M([0-9]+)", c) for c in matrix.columns}
    parts = {c: (m[1], m[2], int(m[3])) for c, m in named.items() if m}
    peaks = [F.col(c) for c, (v, stat, k) in parts.items() if v == variable and stat == "max" and k <= month]
    kept = [c for c, (v, _, k) in parts.items() if v != variable and month - last < k <= month]
    if not peaks:
        raise ValueError(f"no column holds a monthly maximum of {variable}")
    peak = F.greatest(*peaks) if len(peaks) > 1 else peaks[0]
    return matrix.select(*(c for c in matrix.columns if c not in parts), peak.alias("peak"), *kept)


def perfect_forecast(ind: DataFrame, horizons: int = 7) -> DataFrame:
    """The observed monthly value as a forecast at every horizon, dated that many months earlier:
    sums for rainfall, day-weighted means otherwise, of complete months only."""
    total = monthly(ind).select("adm_id", "variable_name", "month", "first_date", "sum")
    both = total.join(monthly_weighted(ind), ["adm_id", "variable_name", "month"]).where(F.dayofmonth("first_date") == 1)
    value = F.when(F.col("variable_name") == "rainfall", F.col("sum")).otherwise(F.col("mean"))
    each = both.select("adm_id", "variable_name", "month", value.alias("mean"), F.explode(F.sequence(F.lit(0), F.lit(horizons - 1))).alias("h"))
    return each.select("adm_id", F.concat(F.lit("SF_"), F.substring("variable_name", 1, 1), F.lit("_"), (F.col("h") + 1).cast("string")).alias("variable_name"), F.add_months("month", -F.col("h")).alias("date"), "mean", "h")


def observed_vs_forecast(ind: DataFrame, forecast: DataFrame, variable: str, months: int = 3) -> DataFrame:
    """Per unit and start month the means of forecast and observation over the first horizons."""
    f = forecast.where(F.col("variable_name").startswith(f"SF_{variable[0]}_")).select("adm_id", F.col("date").alias("start"), "h", F.col("mean").alias("forecast")).where(F.col("h").between(0, months - 1))
    o = monthly(ind).where(F.col("variable_name") == variable).select("adm_id", "month", (F.col("sum") if variable == "rainfall" else F.col("mean")).alias("observed"))
    j = f.withColumn("month", F.add_months("start", F.col("h"))).join(o, ["adm_id", "month"])
    return j.groupBy("adm_id", "start").agg(F.count("*").alias("n"), F.avg("forecast").alias("forecast"), F.avg("observed").alias("observed"))


def persistence(ind: DataFrame) -> DataFrame:
    """The series with its last twelve months (after the group's maximum less a year) copied a year on."""
    last = F.max("date").over(Window.partitionBy("adm_id", "variable_name"))
    window = ind.withColumn("last", last).where(F.col("date") > F.add_months("last", -12))
    ahead = window.select("adm_id", "variable_name", F.add_months("date", 12).alias("date"), "mean", F.lit(True).alias("filled"))
    return ind.select("adm_id", "variable_name", "date", "mean", F.lit(False).alias("filled")).unionByName(ahead)


def on_full_calendar(ind: DataFrame) -> DataFrame:
    """Every dekad from a series' first to its last; missing ones have a null mean."""
    raw = dekad.raw_of_date(F.col("date"))
    span = ind.groupBy("adm_id", "variable_name").agg(F.min(raw).alias("a"), F.max(raw).alias("b"))
    grid = span.select("adm_id", "variable_name", F.explode(F.sequence("a", "b")).alias("raw"))
    return grid.join(ind.select("adm_id", "variable_name", raw.alias("raw"), "mean"), ["adm_id", "variable_name", "raw"], "left")


def interpolate(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Gaps filled linearly over row positions; trailing gaps take the last value, leading ones stay null."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v = F.col(value)
    s = series.withColumn("__n", F.row_number().over(w))
    at = F.when(v.isNotNull(), F.col("__n"))
    s = s.withColumns({"__a": F.last(v, ignorenulls=True).over(back), "__an": F.last(at, ignorenulls=True).over(back), "__b": F.first(v, ignorenulls=True).over(ahead), "__bn": F.first(at, ignorenulls=True).over(ahead)})
    line = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__n") - F.col("__an")) / F.nullif(F.col("__bn") - F.col("__an"), F.lit(0))
    return s.withColumn(f"{value}_filled", F.coalesce(v, F.when(F.col("__b").isNull(), F.col("__a")).otherwise(line))).drop("__n", "__a", "__an", "__b", "__bn")
