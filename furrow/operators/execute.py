"""The execute phase: a batch of runs as concurrent Spark jobs, with a store of what was computed.

A run is known by a fingerprint of its settings and of its input, so that a second batch plans no work for runs that
are there, and a changed input makes them new. A run's predictions and its record are written under its fingerprint; the
record comes last and is what counts as done, so that a run that broke off is made again."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs that are under way at a time.
PARALLEL = 4

RECORD = "run_id int, fingerprint string, settings string, rows bigint, seconds double"
OUTCOME = "run_id int, fingerprint string, status string, seconds double, error string"


def input_fingerprint(df: DataFrame) -> str:
    """Of all rows in any order: their number and the sums of two hashes of each."""
    row = F.struct(*map(F.col, sorted(df.columns)))
    h = lambda salt: F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(20,0)"))
    r = df.agg(F.count("*").alias("n"), h(1).alias("a"), h(2).alias("b")).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}|{r.n}|{r.a}|{r.b}".encode()).hexdigest()[:32]


def fingerprint(settings: dict, source: str) -> str:
    """Of a run's settings, but for its number, over an input."""
    own = {k: v for k, v in settings.items() if k != "run_id"}
    return hashlib.sha256((json.dumps(own, sort_keys=True, default=str) + source).encode()).hexdigest()[:32]


class Store:
    """Predictions and records of runs in a folder, by fingerprint."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, kind: str, key: str = "*") -> str:
        return f"{self.path}/{kind}/fingerprint={key}"

    def _there(self, kind: str) -> list[str]:
        """Folders that a writer finished; one that broke off has no _SUCCESS."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder(kind)}/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return [str(f.getPath().getParent().toString()) for f in found]

    def records(self) -> DataFrame:
        """RECORD of the runs that are done."""
        folders = self._there("records")
        return self.spark.read.schema(RECORD).parquet(*folders) if folders else self.spark.createDataFrame([], RECORD)

    def predictions(self, keys: DataFrame | None = None) -> DataFrame:
        """run columns of all done runs, or those whose fingerprint is in keys, with the fingerprint."""
        done = self.records().select("fingerprint")
        known = done if keys is None else done.join(keys.select("fingerprint"), "fingerprint", "left_semi")
        folders = [self._folder("predictions", r.fingerprint) for r in known.distinct().collect()]
        if not folders:
            raise ValueError("no run is done")
        return self.spark.read.option("basePath", f"{self.path}/predictions").parquet(*folders)

    def put(self, run_id: int, key: str, settings: dict, made: DataFrame, began: float) -> float:
        made.write.mode("overwrite").parquet(self._folder("predictions", key))
        rows = self.spark.read.parquet(self._folder("predictions", key)).count()
        seconds = time.time() - began
        record = self.spark.createDataFrame([(run_id, key, json.dumps(settings, sort_keys=True, default=str), rows, seconds)], RECORD)
        record.coalesce(1).write.mode("overwrite").parquet(self._folder("records", key))
        return seconds


def batch(specs: DataFrame, run: Callable[[dict], DataFrame], source: str, store: Store, parallel: int = PARALLEL) -> DataFrame:
    """OUTCOME of every spec (run_id and settings, a bounded list): done, cached (it was there already) or failed. run(settings) gives the predictions,
    as a plan; each is written by a job of a pool of its own, of which `parallel` are under way at a time. One failure doesn't stop the rest."""
    spark = specs.sparkSession
    known = {r.fingerprint for r in store.records().select("fingerprint").collect()}

    def one(settings: dict) -> tuple:
        key, began = fingerprint(settings, source), time.time()
        if key in known:
            return settings["run_id"], key, "cached", 0.0, None
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"run-{settings['run_id']}")
        try:
            return settings["run_id"], key, "done", store.put(settings["run_id"], key, settings, run(settings), began), None
        except Exception as e:  # noqa: BLE001  whatever broke this run is its outcome
            return settings["run_id"], key, "failed", time.time() - began, f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    todo = [r.asDict(recursive=True) for r in specs.orderBy("run_id").collect()]
    with ThreadPoolExecutor(parallel) as pool:
        return spark.createDataFrame(list(pool.map(one, todo)), OUTCOME)


def status(specs: DataFrame, source: str, store: Store) -> DataFrame:
    """specs with their fingerprint, done, seconds and rows: what is missing and what was slow."""
    keys = [(r.run_id, fingerprint(r.asDict(recursive=True), source)) for r in specs.collect()]
    of = specs.sparkSession.createDataFrame(keys, "run_id int, fingerprint string")
    done = store.records().select("fingerprint", "seconds", "rows")
    return specs.join(of, "run_id").join(done, "fingerprint", "left").withColumn("done", F.col("rows").isNotNull())


def missing(state: DataFrame) -> DataFrame:
    """What has to be run again."""
    return state.where("NOT done")


def slow(state: DataFrame, factor: float = 3.0) -> DataFrame:
    """Runs that took more than `factor` times the median of the runs that are done."""
    median = state.where("done").agg(F.percentile("seconds", 0.5).alias("median"))
    return state.where("done").join(F.broadcast(median)).where(F.col("seconds") > factor * F.col("median")).drop("median")  # one row


# --- prepared tables


def prepare(df: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> DataFrame:
    """df as a table in buckets of keys: tables with as many buckets of the same keys are joined without an exchange."""
    spark = df.sparkSession
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", {"name": name})
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)
