"""File sources and sinks at the edge of the engine; inside, tables are Parquet."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """CSV with a header and a declared schema; rows that don't fit become nulls."""
    return spark.read.schema(schema).options(header=True, mode="PERMISSIVE", **options).csv(path)


def number(text: Column) -> Column:
    """A number that may have thousands separators; null if it is none."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def csv_thousands(spark: SparkSession, path: str, schema: str, numbers: list[str], **options) -> DataFrame:
    raw = csv(spark, path, schema, **options)
    return raw.withColumns({c: number(F.col(c)) for c in numbers})


def csv_saved_index(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose first column is a saved row index."""
    df = spark.read.options(header=True, inferSchema=True).csv(path)
    return df.drop(df.columns[0])


def json_specs(spark: SparkSession, path: str, schema: str, one_per_file: bool = True) -> DataFrame:
    """One JSON document per task file, or one a line."""
    return spark.read.schema(schema).json(path, multiLine=one_per_file)


def union_with_rejects(spark: SparkSession, pattern: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): all files of a pattern as one table with the name of each row's file, and the lines that don't fit the schema with the file they stand in."""
    both = spark.read.schema(f"{schema}, _broken string").options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").csv(pattern).withColumn("file", F.col("_metadata.file_name"))
    # Spark knows a line to be broken only if it has to parse all its columns
    parsed = F.hash(*(c for c in both.columns if c not in ("_broken", "file"))) >= -(2**31)
    return both.where("_broken IS NULL").where(parsed).drop("_broken"), both.where("_broken IS NOT NULL").where(parsed).select("file", F.col("_broken").alias("line"))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")


def latest_version(spark: SparkSession, folder: str, pattern: str = "*") -> str | None:
    """The file with the highest _v number, then the newest."""
    f = files(spark, folder, pattern).withColumn("version", F.regexp_extract("path", r"_v(\d+)", 1).try_cast("int"))
    return f.agg(F.max_by("path", F.struct(F.coalesce("version", F.lit(-1)), "modificationTime", "path"))).first()[0]


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """df in the order of an existing table's columns; what it lacks is null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def append_csv(df: DataFrame, folder: str, columns: list[str]) -> None:
    """More rows for an existing folder, in the order of its columns and without a header."""
    aligned(df, columns).write.mode("append").csv(folder)


def overwrite_csv(df: DataFrame, folder: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(folder)
    return folder


def overwrite_json(df: DataFrame, folder: str) -> str:
    """One JSON object a line; a settings dump is a table of one row."""
    df.write.mode("overwrite").json(folder)
    return folder


def config(spark: SparkSession, path: str, schema: str, operational: bool = False) -> dict:
    """A run's settings from a JSON file, with those of its sibling ..._ope.json over them for an operational run."""
    read = lambda p: spark.read.schema(schema).json(p, multiLine=True).first().asDict(recursive=True)
    own = read(path)
    return own | {k: v for k, v in read(path.removesuffix(".json") + "_ope.json").items() if v is not None} if operational else own


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: under spark.checkpoint.dir, or a temporary one in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="furrow-")
    return f"{at.rstrip('/')}/furrow-files/{uuid.uuid4().hex}"


def fixed(df: DataFrame, digits: int = 3) -> DataFrame:
    """Floating-point columns as text with so many decimals."""
    return df.withColumns({c: F.format_string(f"%.{digits}f", F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def from_listing(spark: SparkSession, text: str, names: list[str]) -> DataFrame:
    """A table from the printed output of a command: fields between blanks, one row a line."""
    lines = spark.createDataFrame([(x,) for x in text.splitlines() if x.strip()], "line string")
    parts = F.split(F.trim("line"), r"\s+")
    return lines.select(*(F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the columns of any numeric type."""
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
