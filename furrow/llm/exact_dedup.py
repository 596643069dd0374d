"""Exact deduplication with counting quotient filters.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D];
null counts as empty. Of equal texts the row with the most code points in the
original text, then with the smallest doc_id, stays.

1. Every document gets a 64-bit fingerprint of its normalised text and, for the
   report, its SHA-256; these few bytes a document are written to the shared folder.
2. Every partition builds a counting quotient filter of its fingerprints, cut into slices by
   their first bits. Of the other bits the first q are the quotient and the last r the remainder; q
   follows from how many fingerprints there are. A filter holds an occupied bit for
   every quotient, the remainders sorted by quotient in r bits rounded up to bytes, a
   run-end bit for each of them, and counters for those that count more than once (see
   `encode`). Its slots stand without gaps, since it is only merged and not probed. Copies
   within a partition are one counter, so a fingerprint that a third of all rows share
   is no hot key.
3. Slices of one range from all partitions meet in one task, which merges their sorted
   remainders and adds the counters. Quotient and remainder together are the whole
   fingerprint, so that nothing is lost and there are no false positives on fingerprints.
4. Fingerprints with a count above one route to byte verification: only documents
   with such a fingerprint have their normalised texts grouped byte by byte.

Defined cases: null and empty texts, and texts of white space only, are one group;
a null doc_id counts as larger than any other; rows that repeat a doc_id are rows
of their own, and of those that tie for the place that stays one is kept = true; very long
texts are ordinary ones; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import save, sized

#: Fingerprints that one merging task is meant to hold.
SLICE = 1_000_000


def normalised(text: F.Column) -> F.Column:
    out = F.coalesce(text, F.lit(""))
    for c in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


FILTER = "slice bigint, q int, n bigint, occupied binary, run_ends binary, remainders binary, repeated binary, counters binary"


def encode(low: np.ndarray, counts: np.ndarray, bits: int, q: int | None = None) -> tuple:
    """A filter of sorted distinct numbers below 2**bits with counters: (q, n, occupied, run ends, remainders, repeated, counters)."""
    n = len(low)
    q = min(bits, max(0, (n - 1).bit_length())) if q is None else q
    r = bits - q
    quotient = (low >> np.uint64(r) if r < 64 else np.zeros(n, np.uint64)).astype(np.int64)
    remainder = low & np.uint64((1 << r) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    run_ends = np.append(quotient[1:] != quotient[:-1], True)[:n]
    many = counts > 1
    width = -(-r // 8)
    return q, n, np.packbits(occupied).tobytes(), np.packbits(run_ends).tobytes(), remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].tobytes(), np.packbits(many).tobytes(), counts[many].astype("<i8").tobytes()


def decode(bits: int, q: int, n: int, occupied: bytes, run_ends: bytes, remainders: bytes, repeated: bytes, counters: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted numbers and counters of a filter."""
    unpack = lambda raw, size: np.unpackbits(np.frombuffer(raw, np.uint8), count=size).astype(bool)
    r = bits - q
    width = -(-r // 8)
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = np.frombuffer(remainders, np.uint8).reshape(n, width)
    run = np.cumsum(np.append(False, unpack(run_ends, n))[:n])  # the run of a slot is the occupied quotient of that rank
    quotient = np.flatnonzero(unpack(occupied, 1 << q))[run].astype(np.uint64)
    counts = np.ones(n, np.int64)
    counts[unpack(repeated, n)] = np.frombuffer(counters, "<i8")
    return (quotient << np.uint64(r) if r < 64 else np.zeros(n, np.uint64)) | low.view("<u8").ravel().astype(np.uint64), counts


def build_filters(fingerprints: DataFrame, slices: int) -> DataFrame:
    """One row per partition and slice: its counting quotient filter."""
    top = max(0, (slices - 1).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            add_run(runs, np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True))
        keys, counts = merge_runs(runs)
        part = (keys >> np.uint64(64 - top) if top else np.zeros(len(keys), np.uint64)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]).tolist()
        mask = np.uint64((1 << (64 - top)) - 1)
        rows = [(int(part[a]), *encode(keys[a:b] & mask, counts[a:b], 64 - top)) for a, b in zip(cuts, [*cuts[1:], len(keys)] if cuts else [], strict=True)]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(_ARROW), _ARROW.types, strict=True)], schema=_ARROW)

    return fingerprints.mapInArrow(build, FILTER)


_ARROW = pa.schema([(f.split()[0], {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in FILTER.split(", ")])


def add_run(runs: list[tuple[np.ndarray, np.ndarray]], run: tuple[np.ndarray, np.ndarray]) -> None:
    """Append a run and merge runs of like size, so that each fingerprint is merged log2(runs) times."""
    runs.append(run)
    while len(runs) > 1 and len(runs[-2][0]) <= 2 * len(runs[-1][0]):
        runs[-2:] = [merge_runs(runs[-2:])]


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of sorted numbers with counters as one run; counters of equal numbers are added."""
    if not runs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in runs]), np.concatenate([c for _, c in runs])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def merged_filter(filters: DataFrame, slices: int) -> DataFrame:
    """(fp, n) of all fingerprints, merged slice by slice: a slice's filters come
    together sorted, and are merged one after the other as they stream in."""
    top = max(0, (slices - 1).bit_length())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = 0, []

        def out() -> pa.RecordBatch:
            low, counts = merge_runs(runs)
            return pa.record_batch({"fp": pa.array((low | np.uint64(now << (64 - top) if top else 0)).view(np.int64)), "n": pa.array(counts)})

        for b in batches:
            for s, *filtered in zip(*(b.column(i).to_pylist() for i in range(len(_ARROW))), strict=True):
                if s != now and runs:
                    yield out()
                    runs = []
                now = s
                add_run(runs, decode(64 - top, *filtered))
        yield out()

    return filters.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(merge, "fp bigint, n bigint")


def classes(docs: DataFrame, slice_rows: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(digests, groups): row (a number), doc_id, fp, text_sha256, chars of every row; and fp, text_sha256,
    keep_id, keep_chars, group_size of every verified group of two rows or more."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    norm = rows.select("doc_id", normalised(F.col("text")).alias("norm"), F.length("text").alias("chars"))
    digests = save(norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"), "chars"), "digests")
    slices = max(1, -(-digests.count() // slice_rows))
    slices = 1 << (slices - 1).bit_length()
    repeated = save(merged_filter(build_filters(digests.select("fp"), slices), slices).where("n > 1").select("fp"), "repeated")
    suspects = norm.withColumn("fp", F.xxhash64("norm")).join(sized(repeated), "fp", "left_semi")
    # Grouping by the text itself is the byte verification. Copies of one length are
    # counted map-side; what is left of a hot text is a row per task.
    sizes = suspects.groupBy("fp", "norm", "chars").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    groups = sizes.groupBy("fp", "norm").agg(F.sum("n").alias("group_size"), F.max_by(F.struct("doc_id", "chars"), "chars").alias("keep"))
    return digests, groups.where("group_size > 1").select("fp", F.sha2("norm", 256).alias("text_sha256"), F.col("keep.doc_id").alias("keep_id"), F.col("keep.chars").alias("keep_chars"), "group_size")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests, groups = classes(docs)
    d = digests.join(groups, ["fp", "text_sha256"], "left")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    if digests.groupBy("doc_id").count().where("count > 1").limit(1).count():
        # repeated ids can tie; of the rows that do, the one with the smallest number stays
        ties = save(d.where(F.col("group_size").isNotNull() & stays).groupBy("fp", "text_sha256").agg(F.min("row").alias("stays"), F.count("*").alias("n")).where("n > 1").drop("n"), "ties")
        d = d.join(sized(ties), ["fp", "text_sha256"], "left")
        stays &= F.col("stays").isNull() | (F.col("row") == F.col("stays"))
    return d.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("group_size").isNull() | stays).alias("kept"),
        "text_sha256",
    )


REPORT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
