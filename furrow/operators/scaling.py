"""Scaling and encoding of model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scale_global(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the population spread of the whole table; a spread of zero divides by 1.
    The statistics are one row, joined by broadcast: no window over the whole table."""
    s = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    j = df.crossJoin(F.broadcast(s))
    return j.withColumns({f"{c}_z": (F.col(c) - F.col(f"__m_{c}")) / F.coalesce(F.nullif(F.col(f"__s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in columns}).drop(*s.columns)


def _with_totals(df: DataFrame, by: list[str], **totals) -> DataFrame:
    """df with aggregates of each group: counted map-side and joined back, so that a group with a third of the rows isn't one task."""
    return df.join(df.groupBy(*by).agg(*(v.alias(k) for k, v in totals.items())).withColumnsRenamed({c: f"__by_{c}" for c in by}), _and([F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]), "left").drop(*(f"__by_{c}" for c in by))


def _and(conditions: list) -> F.Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scale_by(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """z-scores with the sample spread of each group."""
    t = _with_totals(df, by, **{f"__m_{c}": F.avg(c) for c in columns}, **{f"__s_{c}": F.stddev_samp(c) for c in columns})
    out = t.withColumns({f"{c}_z": (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)) for c in columns})
    return out.drop(*(f"__{k}_{c}" for c in columns for k in "ms"))


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.select("*", *((F.col(column) == v).cast("double").alias(f"{column}_{v}") for v in values))


def _target_totals(df: DataFrame, category: str, target: str) -> DataFrame:
    t = _with_totals(df, [category], __n=F.count(target), __sum=F.sum(target), __var=F.var_samp(target))
    return t.crossJoin(F.broadcast(df.agg(F.avg(target).alias("__mean"), F.var_samp(target).alias("__whole"))))  # one row


def leave_one_out(df: DataFrame, category: str, target: str) -> DataFrame:
    """The mean target of the category's other rows; the table's mean for a category of one row."""
    t, own = _target_totals(df, category, target), F.col(target)
    value = (F.col("__sum") - F.coalesce(own, F.lit(0.0))) / F.nullif(F.col("__n") - own.isNotNull().cast("int"), F.lit(0))
    return t.withColumn(f"{category}_loo", F.coalesce(value, F.col("__mean"))).drop("__n", "__sum", "__var", "__mean", "__whole")


def shrunk_mean(df: DataFrame, category: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """The category's mean target shrunk to the table's mean."""
    value = (F.coalesce("__sum", F.lit(0.0)) + F.col("__mean") * smoothing) / (F.col("__n") + smoothing)
    return _target_totals(df, category, target).withColumn(f"{category}_mean", value).drop("__n", "__sum", "__var", "__mean", "__whole")


def james_stein(df: DataFrame, category: str, target: str) -> DataFrame:
    """The category's mean target pulled to the table's mean by B = (v / n) / (v / n + V), v being the category's
    sample variance and V the table's; a category of one row has the table's mean."""
    noise = F.col("__var") / F.col("__n")
    b = F.coalesce(noise / F.nullif(noise + F.col("__whole"), F.lit(0.0)), F.lit(1.0))
    value = (1 - b) * F.coalesce(F.col("__sum") / F.nullif(F.col("__n"), F.lit(0)), F.col("__mean")) + b * F.col("__mean")
    return _target_totals(df, category, target).withColumn(f"{category}_js", value).drop("__n", "__sum", "__var", "__mean", "__whole")
