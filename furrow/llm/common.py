"""Helpers shared by the corpus operators: tables in the shared folder, joins
against a side of checked size, and word tokenisation over Arrow buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only up to this many rows of a few numbers each (16 MB or so).
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir,
    or the checkpoint folder already set; a folder of our own where neither is and
    driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="furrow-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/furrow/{tag}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, tag: str, by: str | list[str] | None = None, compression: str = "snappy", **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut
    and a lost executor costs nothing that was already computed. The shuffle files of the write go when it is done.
    Filters on the columns `by` then read only the files that they need. `discard` deletes the table."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).options(compression=compression, **options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete saved tables that no plan still to be run reads, or a part of them (`column=value` of a table saved by that column)."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{t.saved_at}/{part}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows, else df as it is,
    for a shuffled join whose skewed keys adaptive execution splits. df should be
    a saved table, so that counting it is cheap."""
    return F.broadcast(df) if df.count() <= max_rows else df


#: Whole texts are long: an Arrow batch ends after so many rows or bytes (or one longer text).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the memory that a batch of texts takes in the JVM and in Python. Plans are run after the
    operator returns, so that the settings stay with the session; smaller ones are left as they are."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(_BYTES).lower()).groups()
    if not 0 < int(number) << 10 * "bkmgtp".find((unit or "b")[0]) <= BATCH_BYTES:
        spark.conf.set(_BYTES, BATCH_BYTES)


def arrow_once(fn, returns: str):
    """An Arrow UDF that runs once a row: it is marked so that the optimizer
    doesn't repeat it in a filter and in a projection above."""
    small_batches(SparkSession.active())
    return F.arrow_udf(fn, returns).asNondeterministic()


# --- words over Arrow buffers -------------------------------------------------

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F] with A-Z lower-cased; 0 elsewhere.
WORD_BYTE = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    WORD_BYTE[_b] = _b
for _b in range(0x41, 0x5B):
    WORD_BYTE[_b] = _b + 0x20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier and of its inverse, mod 2**64."""
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _P), ("inv", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["inv"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_blocks(column: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive rows of a string column as (first row, offsets from 0, UTF-8
    bytes), each block of about `target` bytes or one longer row; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + target, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, offsets[row : end + 1] - offsets[row], raw[offsets[row] : offsets[end]]
        row = end


@dataclass
class Words:
    """Words of a block of texts: lower-cased bytes, byte spans, hashes, and each word's row."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray  # index of each row's first word, and the number of words at the end

    def joined(self, at: int, n: int) -> bytes:
        return b" ".join(self.text[self.start[i] : self.end[i]].tobytes() for i in range(at, at + n))


def words(offsets: np.ndarray, data: np.ndarray) -> Words:
    text = WORD_BYTE[data]
    n = len(text)
    inside = text != 0
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    p, inv = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(text.astype(np.uint64) * p[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inv[start])
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(text, start, end, hashes, row, first)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words; windows that cross rows are included."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out *= _P
        out += hashes[k : k + size]
    return mix(out)


def word_list(text: str | None) -> list[bytes]:
    """The words of one text, for small inputs."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w = words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
    return [w.text[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
