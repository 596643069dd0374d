"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased.
A window is `n` consecutive words of an item; an item with fewer words, but not
none, is one window of all its words. Every word inside an occurrence of a window
is hit.

Defined cases: a null or empty text, or one without words, has no words, no hits
and is not contaminated; an item without words has no window; repeated items and
items with one id count once; an item whose id is null counts under the name
"null", as does an item that really has that name; an empty benchmark hits nothing; repeated
documents are scanned each for itself; very long texts and items are ordinary ones; an empty table
gives an empty result; other columns of either table are ignored, whatever their names, but that
`scan` replaces a column named like its result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import Words, arrow_once, save, sized, text_blocks, windows, word_list, words

WINDOW = 10
#: Text of the items of one broadcast block, or one longer item; its windows take some 40 times as much. A larger benchmark is scanned in blocks.
BLOCK_BYTES = 4 << 20

SCAN = "struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>>"


class WindowSet:
    """Windows of some items: by length, the sorted hashes and a bit table before them; by words, the items."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = WINDOW):
        found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            w = word_list(text)
            size = min(n, len(w))
            for at in range(len(w) - size + 1 if size else 0):
                found[size][b" ".join(w[at : at + size])].add(item)
        self.items = {size: dict(of) for size, of in found.items()}
        self.bits: dict[int, np.ndarray] = {}
        self.mask = np.uint64((1 << 21) - 1)
        for size, of in self.items.items():
            text = "\n".join(x.decode("utf-8", "surrogatepass") for x in of).encode("utf-8", "surrogatepass")
            w = words(np.array([0, len(text)]), np.frombuffer(text, np.uint8))
            table = np.zeros(1 << 21, bool)
            table[windows(w.hash, size)[::size] & self.mask] = True
            self.bits[size] = table

    def occurrences(self, w: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, number of words, items) of every window that occurs."""
        for size, of in self.items.items():
            g = windows(w.hash, size)
            if not len(g):
                continue
            at = np.flatnonzero(self.bits[size][g & self.mask])
            at = at[w.row[at] == w.row[at + size - 1]]
            for i in at.tolist():
                if (items := of.get(w.joined(i, size))) is not None:
                    yield i, size, items


def _scan(column: pa.Array, known: WindowSet) -> list[dict]:
    out: list[dict] = []
    for _, offsets, data in text_blocks(column):
        w = words(offsets, data)
        rows = [{"n_words": int(n), "spans": [], "items": set()} for n in np.diff(w.first)]
        change = np.zeros(len(w.start) + 1, np.int32)
        for at, size, items in known.occurrences(w):
            change[at] += 1
            change[at + size] -= 1
            rows[w.row[at]]["items"] |= items
        if change.any():
            hit = np.cumsum(change[:-1]) > 0
            # a run of hit words ends where its row does
            edge = hit.copy()
            edge[1:] &= ~(hit[:-1] & (w.row[1:] == w.row[:-1]))
            last = hit.copy()
            last[:-1] &= ~(hit[1:] & (w.row[1:] == w.row[:-1]))
            for a, b in zip(np.flatnonzero(edge).tolist(), np.flatnonzero(last).tolist(), strict=True):
                r = int(w.row[a])
                rows[r]["spans"].append({"start": a - int(w.first[r]), "end": b + 1 - int(w.first[r])})
        out += [r | {"items": sorted(r["items"])} for r in rows]
    return out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", into: str = "scan", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a column `into`: n_words, the hit spans [start, end) in words, and
    the ids of items with occurring windows, sorted as strings.

    The items are the stated query set, and go to the executors in blocks of `block_bytes`. A benchmark of one
    block is one pass over docs without a shuffle. Of a larger one, each block in turn scans all documents, writes down
    what it found, and leaves memory before the next comes; then every document takes up all that was found in its text."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").alias("words"))
    blocks = _blocks(items, block_bytes)
    block, later = next(blocks), next(blocks, None)
    if later is None:
        return docs.withColumn(into, _scanner(spark.sparkContext.broadcast(WindowSet(block, n)))(F.col(text)))
    key = [F.xxhash64(text).alias("__h1"), F.hash(text).alias("__h2"), F.octet_length(text).alias("__size")]
    found = []
    for block in chain([block, later], blocks):
        known = spark.sparkContext.broadcast(WindowSet(block, n))
        hits = docs.where(F.col(text).isNotNull()).select(*key, _scanner(known)(F.col(text)).alias("s")).where(F.size("s.spans") > 0)
        found.append(save(hits.dropDuplicates(["__h1", "__h2", "__size"]), "hits"))
        known.destroy()
    names = ["__h1", "__h2", "__size"]
    all_hits = reduce(DataFrame.union, found).groupBy(*names).agg(F.flatten(F.collect_list("s.spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s.items")))).alias("__items"))
    counted = _scanner(spark.sparkContext.broadcast(WindowSet([], n)))(F.col(text))
    out = docs.withColumns({c: k for c, k in zip(names, key, strict=True)} | {"__scan": counted}).join(sized(save(all_hits, "all_hits")), names, "left")
    scanned = F.struct(F.col("__scan.n_words").alias("n_words"), F.coalesce(_union("__spans"), F.col("__scan.spans")).alias("spans"), F.coalesce("__items", "__scan.items").alias("items"))
    return out.withColumn("__scan", scanned).select(*[F.col(c) for c in docs.columns if c != into], F.col("__scan").alias(into))


def _scanner(known):
    def of_block(column: pa.Array) -> pa.Array:
        return pa.array(_scan(column, known.value), _ARROW)

    return arrow_once(of_block, SCAN)


_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[str, str | None]]]:
    """Blocks of the items; one empty block if there are none. Only a block at a time is on the driver."""
    block: list[tuple[str, str | None]] = []
    none, held = True, 0
    for row in items.toLocalIterator():
        more = len((row["words"] or "").encode("utf-8", "surrogatepass"))
        if block and held + more > size:
            yield block
            block, none, held = [], False, 0
        block.append((row["item"], row["words"]))
        held += more
    if block or none:
        yield block


def _union(spans: str) -> F.Column:
    """Spans sorted, with overlapping and touching ones as one."""
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return F.aggregate(
        F.array_sort(spans),
        empty,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def n_hit(scanned) -> F.Column:
    return F.aggregate(scanned["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents without a hit."""
    return scan(docs, benchmark, n, into="__scan").where(F.size("__scan.spans") == 0).drop("__scan")


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """All documents, with the hit words, and what stands between the words of one span, cut out of text."""
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

    def cut(texts: pa.Array, scans: pa.Array) -> pa.Array:
        import re

        out = []
        for t, s in zip(texts.to_pylist(), scans.to_pylist(), strict=True):
            if s["spans"]:
                low = t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
                at = [m.span() for m in re.finditer(pattern, low)]
                for x in reversed(s["spans"]):
                    t = t[: at[x["start"]][0]] + t[at[x["end"] - 1][1] :]
            out.append(t)
        return pa.array(out, pa.string())

    return scan(docs, benchmark, n, into="__scan").withColumn("text", arrow_once(cut, "string")("text", "__scan")).drop("__scan")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    s = scan(docs.select("doc_id", "text"), benchmark)
    return s.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        n_hit(F.col("scan")).alias("n_hit"),
        F.size("scan.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("scan.items", ","), 256).alias("items_sha256"),
        (n_hit(F.col("scan")) > 0).alias("contaminated"),
    )


def report_sql(n: int = WINDOW) -> str:
    """The same rows in DuckDB: windows of both sides as strings, joined."""
    return f"""
WITH pattern AS (SELECT '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+' AS p),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) AS w FROM documents, pattern),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) AS w FROM benchmark, pattern),
bs AS (SELECT item, w, least(len(w), {n}) AS size, unnest(range(1, len(w) - least(len(w), {n}) + 2)) AS pos FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, size, array_to_string(w[pos : pos + size - 1], ' ') AS g FROM bs),
sizes AS (SELECT DISTINCT size FROM bw),
ds AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size),
hit AS (SELECT doc_id, pos, bw.size, item FROM (SELECT doc_id, pos, size, array_to_string(w[pos : pos + size - 1], ' ') AS g FROM ds) x JOIN bw ON x.g = bw.g AND x.size = bw.size),
spread AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM spread GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def brute(texts: dict[int, str | None], items: dict[int, str | None], n: int = WINDOW) -> dict[int, tuple]:
    """The same report by plain loops, for tests."""
    import re

    def split(t: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)

    of: dict[tuple, set[str]] = defaultdict(set)
    for i, t in items.items():
        w = split(t)
        for k in range(max(0, len(w) - n) + 1 if w else 0):
            of[tuple(w[k : k + n])].add(str(i))
    sizes = {len(k) for k in of}
    out = {}
    for d, t in texts.items():
        w, hit, got = split(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (x := of.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    got |= x
        out[d] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))
    return out
