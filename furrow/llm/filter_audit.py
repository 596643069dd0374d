"""Filter interaction audit: what five filters remove, alone, together and in every order.

A document fails A with under MIN_WORDS words, B if 100 * distinct words < 50 * words, C if 100 * characters A-Z >
3 * code points, D if it holds any of `#$%&*|`, E if its text is that of a smaller doc_id, removed or not. Words are maximal
runs of `[^\\x20\\x09-\\x0D]`, case-sensitive.

1. One pass over Arrow batches finds what each whole text fails of A to D, and two 64-bit hashes of it: a few bytes a
   document, written to the shared folder.
2. Fingerprint-routed RDD for E. Texts whose xxhash occurs more than once go through collision chains: under each
   fingerprint the different full texts, each with its minimum id. A chain emits an id as soon as it is known not to be
   the minimum of its text. Chains are built in every partition first, so that of a hot text one row a partition is
   routed, then by fingerprint over all.
3. What fails, and the two labels, are 7 bits a document. Tasks count these masks by part into vectors of 128 numbers,
   and combineByKey adds the vectors. All orders and steps follow from a part's vector.

Defined cases: a null text is the empty text; a null lang and an empty one are one part; a null doc_id is larger than any
other and has no label; rows that repeat a doc_id are documents of their own, and of one text, neither is a copy of the
other; of labels that repeat a doc_id any 1 counts; a null label is 0; very long texts are read whole; empty documents give an
empty result, empty labels no loss; other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import arrow_once, save, sized, small_batches, text_blocks

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Bits of a mask: 1 << place in FILTERS, and these two.
GOOD, TOXIC = 32, 64
#: Text that a task's chains hold at a time, and that one task of the routed chains is meant to get.
CHAIN_BYTES = 64 << 20

_UPPER = bytes(range(0x41, 0x5B))
_ODD = b"#$%&*|"
RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def fails(text: bytes) -> int:
    """The bits of A to D of a UTF-8 text. bytes.split() parts at [\\x20\\x09-\\x0D] and at nothing else."""
    words = text.split()
    n, points = len(words), len(text.translate(None, _CONTINUATION))
    return (n < MIN_WORDS) | (100 * len(set(words)) < 50 * n) << 1 | (100 * (len(text) - len(text.translate(None, _UPPER))) > 3 * points) << 2 | (len(text) != len(text.translate(None, _ODD))) << 3


#: Bytes of UTF-8 that begin no code point.
_CONTINUATION = bytes(range(0x80, 0xC0))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (A to D), fp and fp2 (hashes of the text), size (its bytes)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = [fails(raw[a:z]) for _, at, data in text_blocks(b.column("text")) for raw in [data.tobytes()] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("part"), pa.array(masks, pa.int32()), b.column("fp"), b.column("fp2"), b.column("size")], names=["doc_id", "part", "mask", "fp", "fp2", "size"])

    small_batches(docs.sparkSession)
    rows = _rows(docs).select("doc_id", "part", "text", "fp", "fp2", F.octet_length("text").cast("bigint").alias("size"))
    return rows.mapInArrow(of, "doc_id bigint, part string, mask int, fp bigint, fp2 bigint, size bigint")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("part"), text.alias("text"), F.xxhash64(text).alias("fp"), F.xxhash64(F.lit(1), text).alias("fp2"))


class Chains:
    """Under each fingerprint the texts that have it, each with the smallest id so far (null is the largest)."""

    def __init__(self):
        self.of: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, fp: int, fp2: int, doc_id: int | None, text: str) -> tuple | None:
        """Take a row in; (id, fp, fp2) of the one that is now known not to be its text's minimum, if any."""
        chain = self.of.setdefault(fp, [])
        for entry in chain:
            if entry[2] == text:
                old = entry[1]
                if old == doc_id:
                    return None
                if old is not None and (doc_id is None or doc_id > old):
                    return doc_id, fp, fp2
                entry[1] = doc_id
                return old, fp, fp2
        chain.append([fp2, doc_id, text])
        self.bytes += len(text)
        return None

    def heads(self) -> Iterator[tuple]:
        """What is left: (fp, fp2, minimum id, text) of each text."""
        for fp, chain in self.of.items():
            for entry in chain:
                yield fp, *entry


def non_minimum(rows: RDD, partitions: int, chain_bytes: int | None = None) -> RDD:
    """(id, fp, fp2) of rows (fp, fp2, id, text) that aren't the smallest id of their text. Fingerprints may collide:
    texts are told apart by themselves."""
    limit = chain_bytes or CHAIN_BYTES

    def local(part: Iterator[tuple]) -> Iterator[tuple]:
        chains = Chains()
        for fp, fp2, doc_id, text in part:
            if out := chains.add(fp, fp2, doc_id, text):
                yield out[1], ("out", out)
            if chains.bytes > limit:
                yield from ((head[0], head[1:]) for head in chains.heads())
                chains = Chains()
        yield from ((head[0], head[1:]) for head in chains.heads())

    def routed(part: Iterator[tuple]) -> Iterator[tuple]:
        chains = Chains()
        for fp, row in part:
            if row[0] == "out":
                yield row[1]
            elif out := chains.add(fp, *row):
                yield out

    return rows.mapPartitions(local).partitionBy(partitions, lambda fp: fp).mapPartitions(routed)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row: the bits of A to E, GOOD and TOXIC."""
    spark = docs.sparkSession
    rows = save(features(docs), "features")
    repeated = save(rows.groupBy("fp").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where("n > 1").drop("n"), "repeated")
    size = repeated.agg(F.sum("size")).first()[0] or 0
    suspects = _rows(docs).join(sized(repeated.select("fp")), "fp", "left_semi").select("fp", "fp2", "doc_id", "text")
    copies = non_minimum(suspects.rdd.map(tuple), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // CHAIN_BYTES)))
    copies = save(spark.createDataFrame(copies, "id bigint, copy_fp bigint, copy_fp2 bigint", verifySchema=False).distinct(), "copies")
    bit = lambda c, b: F.max(F.when(F.col(c) == 1, b).otherwise(0))
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg((bit("quality", GOOD) + bit("toxic", TOXIC)).alias("flags"))
    flags = sized(save(flags.where("flags > 0"), "flags"))
    rows = rows.join(flags, rows["doc_id"] == flags["id"], "left").drop("id")
    twin = rows["doc_id"].eqNullSafe(copies["id"]) & (rows["fp"] == copies["copy_fp"]) & (rows["fp2"] == copies["copy_fp2"])
    out = rows.join(sized(copies), twin, "left")
    return out.select("doc_id", "part", (F.col("mask") + F.coalesce("flags", F.lit(0)) + F.when(F.col("copy_fp").isNotNull(), 16).otherwise(0)).cast("int").alias("mask"))


def vectors(rows: DataFrame) -> RDD:
    """(part, vector): how many documents of the part have each of the 128 masks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            parts = b.column("part").dictionary_encode()
            both = np.asarray(parts.indices, np.int64) * 128 + np.asarray(b.column("mask"), np.int64)
            for name, vector in zip(parts.dictionary.to_pylist(), np.bincount(both, minlength=128 * len(parts.dictionary)).reshape(-1, 128), strict=True):
                seen[name] = seen.get(name, 0) + vector
        yield pa.record_batch({"part": pa.array(list(seen), pa.string()), "counts": pa.array([v.tolist() for v in seen.values()], pa.list_(pa.int64()))})

    counted = rows.select("part", "mask").mapInArrow(count, "part string, counts array<bigint>")
    add: Callable = lambda total, more: total + np.array(more, np.int64)
    return counted.rdd.map(tuple).combineByKey(lambda counts: np.array(counts, np.int64), add, add)


def effects(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """The rows of a part: every order, every step."""
    n = vector.reshape(2, 2, 32)
    everything, good, toxic = n.sum((0, 1)), n[:, 1].sum(0), n[1].sum(0)
    mask = np.arange(32)
    steps, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fail, gone = mask & bit > 0, mask & before > 0
            here = fail & ~gone
            removed = int(everything[here].sum())
            shapley[letter] += removed
            kept = int(everything[~fail & ~gone].sum())
            steps.append((letter, "".join(order), step, kept, removed, int(everything[fail & gone].sum()), int(everything[bit]), int(good[here].sum()), int(toxic[here].sum())))
            before |= bit
    for letter, *rest in steps:
        yield part, *rest, shapley[letter]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = vectors(masks(docs, labels)).flatMap(lambda kv: effects(*kv))
    return docs.sparkSession.createDataFrame(rows, RESULT, verifySchema=False)


def apply_filters(docs: DataFrame, letters: str = FILTERS) -> DataFrame:
    """The documents that fail none of the filters of A to D named in letters."""
    bits = sum(1 << FILTERS.index(x) for x in letters if x != "E")

    def of(column: pa.Array) -> pa.Array:
        return pa.array([fails(raw[a:z]) for _, at, data in text_blocks(column) for raw in [data.tobytes()] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int32())

    return docs.withColumn("__mask", arrow_once(of, "int")(F.col("text"))).where(F.col("__mask").bitwiseAND(bits) == 0).drop("__mask")


report = audit

REPORT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, left(filter_order, step - 1) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
e AS (SELECT part, filter_order, step, letter, mask, n, good, toxic, contains(mask, letter) AS fail, length(translate(mask, before, '')) < length(mask) AS gone FROM m, s),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (fail AND gone), 0) AS redundant, coalesce(sum(n) FILTER (mask = letter), 0) AS unique_fails, coalesce(sum(good) FILTER (fail AND NOT gone), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (fail AND NOT gone), 0) AS toxic_lost FROM e GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""
