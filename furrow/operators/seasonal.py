"""Runs with and without what is known of the months to come, by lead time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators import benchmarks
from furrow.operators.panel import SERIES

#: Months of a season, months that a seasonal forecast looks ahead, and how many months have been observed when a run is made.
SEASON, AHEAD, OBSERVED = 6, 2, (2, 3, 4)
RUNS = ("noSF", "ObsAsSF", "SF")


def predictors(months: DataFrame) -> DataFrame:
    """adm_id, year, run, lead_time, x from months (adm_id, year, month, value).

    noSF takes the mean of the observed months; ObsAsSF also the AHEAD months to come, as they turned out; SF these as the
    mean of the same month in the unit's earlier years, which is what is known of them at that time. One aggregate makes
    all runs and lead times, which is the number of months to the season's end."""
    earlier = Window.partitionBy("adm_id", "month").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    m = months.withColumn("usual", F.avg("value").over(earlier))
    rows = []
    for n in OBSERVED:
        past, coming = F.col("month") <= n, (F.col("month") > n) & (F.col("month") <= n + AHEAD)
        whole = F.count(F.when(coming, F.col("usual"))) == AHEAD
        forecast = F.when(whole, F.avg(F.when(past, F.col("value")).when(coming, F.col("usual"))))
        for run, x in zip(RUNS, (F.avg(F.when(past, F.col("value"))), F.avg(F.when(past | coming, F.col("value"))), forecast), strict=True):
            rows.append((run, SEASON - n, x.alias(f"{run}_{n}")))
    wide = m.groupBy("adm_id", "year").agg(*(x for *_, x in rows))
    names = [f"{run}_{n}" for n in OBSERVED for run in RUNS]
    each = F.array(*(F.struct(F.lit(run).alias("run"), F.lit(lead).alias("lead_time"), F.round(c, 8).alias("x")) for (run, lead, _), c in zip(rows, names, strict=True)))
    return wide.select("adm_id", "year", F.inline(each))


def runs(labels: DataFrame, months: DataFrame) -> DataFrame:
    """run, lead_time, adm_id, crop, year, y_true, y_pred: each run's regression on its predictor, the year held out."""
    panel = labels.join(predictors(months), ["adm_id", "year"])
    p = benchmarks.at_least_zero(benchmarks.peak_prediction("x", ["run", "lead_time", *SERIES]))
    return panel.select("run", "lead_time", *SERIES, "year", F.col("yield").alias("y_true"), F.round(p, 6).alias("y_pred"))
