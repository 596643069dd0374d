"""Comparison of tables, runs and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Numeric types from the narrowest to the widest; decimals widen by their digits, and against floats become doubles.
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def widest(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that values of both are compared in: the wider of two numbers or times, text against anything else the other's type (a
    copy that went through a text file), and for arrays, maps and structs that of their parts. Types that have none are an error."""
    if a == b:
        return a
    for x, y in ((a, b), (b, a)):
        if isinstance(x, T.NullType) or isinstance(x, T.StringType) and not isinstance(y, (T.ArrayType, T.MapType, T.StructType)):
            return y
        if isinstance(x, T.DateType) and isinstance(y, (T.TimestampType, T.TimestampNTZType)):
            return y
        if isinstance(x, T.BooleanType) and isinstance(y, T.NumericType):
            return y
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, _NUMBERS) and isinstance(b, _NUMBERS):
            return max(a, b, key=lambda t: _NUMBERS.index(type(t)))
        if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
        whole, scale = zip(*((t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (digits[type(t)], 0) for t in (a, b)), strict=True)
        return T.DecimalType(min(38, max(whole) + max(scale)), max(scale))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widest(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(widest(a.keyType, b.keyType), widest(a.valueType, b.valueType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and sorted(a.names) == sorted(b.names):
        return T.StructType([T.StructField(n, widest(a[n].dataType, b[n].dataType)) for n in a.names])
    raise TypeError(f"{a.simpleString()} and {b.simpleString()} have no common type")


def aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns of left, each in the type that both widen to. Text that is no value of that type becomes null."""
    kind = {c: widest(left.schema[c].dataType, right.schema[c].dataType) for c in left.columns}
    to = lambda df: df.select(*(F.col(c).try_cast(t).alias(c) if df.schema[c].dataType != t else F.col(c) for c, t in kind.items()))
    return to(left), to(right)


def table_diff(left: DataFrame, right: DataFrame, digits: int = 6) -> DataFrame:
    """Rows that only one side has, with `side`; types are aligned, floats are compared rounded, repeated rows by their number."""
    left, right = aligned(left, right)
    tidy = lambda df: df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    a, b = tidy(left), tidy(right.select(left.columns))
    return a.exceptAll(b).withColumn("side", F.lit("left_only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right_only")))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, both ways, in one full outer join of distinct keys."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    j = a.join(b, key, "full_outer")
    return j.where("l IS NULL OR r IS NULL").select(key, F.when(F.col("l").isNull(), "right_only").otherwise("left_only").alias("side"))


def missing(expected: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return expected.join(existing, key, "left_anti")


def id_gaps(ids: DataFrame, key: str) -> DataFrame:
    """Ids that are missing between the smallest and the largest."""
    span = ids.agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a IS NOT NULL")
    return span.select(F.explode(F.sequence("a", "b")).alias(key)).join(ids.select(key), key, "left_anti")


def error_gain(res: DataFrame, base: str, other: str) -> DataFrame:
    """Per crop: mean squared errors of two models over pairs that both predict, and how often the other is better."""
    se = lambda m, c: res.where(F.col("model") == m).select("crop", "adm_id", "year", F.pow(F.col("y_true") - F.col("y_pred"), 2).alias(c))
    j = se(base, "a").join(se(other, "b"), ["crop", "adm_id", "year"]).where("a IS NOT NULL AND b IS NOT NULL")
    return j.groupBy("crop").agg(F.count("*").alias("n"), F.avg("a").alias("mse_base"), F.avg("b").alias("mse_other"), F.avg((F.col("b") < F.col("a")).cast("double")).alias("better"))
