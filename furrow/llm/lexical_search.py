"""Ranked lexical search: every benchmark item against all documents, by a blocked sparse matrix product.

Terms are the maximal runs of letters and digits `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z
lower-cased. With N documents that have a term, L terms in all of them, n terms in a document, df
documents with a term and tf occurrences of it in the document, the score of a document for an item is

    sum of w * ((1000000000 * tf) div (1000 * tf + 8 * m)) over the item's terms, repeats included,
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))),  m = 25 + (75 * n * N) div L,

in 64-bit integers but for the logarithm.

1. Postings. One pass over the documents cuts whole texts into terms over Arrow buffers, keeps those that an
   item has (by hash, then byte by byte), and writes down blocks of documents as sparse matrices, term by
   term: documents and tf. N, L and df are sums over these blocks.
2. Product. A = items x terms with multiplicities is broadcast; B = terms x documents with the impacts
   w * (...) is made of a block. Row by row of A (Gustavson), the rows of B that it names are merged, scaled,
   into one dense row of int64.
3. Top k. The k best of a block are merged into the task's k best of the item; the tasks' lists, k rows a task
   and item, are ranked by a window that drops all but k before its exchange.

The items are the stated query set. They go to the executors in blocks of BLOCK_BYTES of text; a larger
benchmark takes one such run for each block of items. Nothing of the documents is broadcast.

Defined cases: a null text, or one without terms, has none, and isn't counted in N; an item without terms, or
null, has no rows; rows that repeat an item_id are items of their own, ranked each; rows that repeat a doc_id are
documents of their own; equal scores stand by ascending doc_id, a null one last; very long texts are read whole;
empty tables give an empty result; other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from furrow.llm.common import Words, save, small_batches, text_blocks, word_list, words

K = 10
#: Text of the items of one broadcast block, or one longer item.
BLOCK_BYTES = 4 << 20
#: Text of a block of documents, or one longer document.
DOC_BYTES = 4 << 20

POSTINGS = "doc_ids array<bigint>, lengths array<bigint>, terms array<int>, ends array<int>, docs array<int>, tfs array<int>"


class Terms:
    """The terms of a block of items: numbered by hash, with what is needed to tell them from other words."""

    def __init__(self, items: list[Counter]):
        self.names = sorted({t for i in items for t in i})
        text = b" ".join(self.names)
        w = words(np.array([0, len(text)]), np.frombuffer(text, np.uint8))
        self.order = np.argsort(w.hash)
        self.hash = w.hash[self.order]
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two terms of the items have one hash")
        self.size = (w.end - w.start)[self.order]
        self.head, self.tail = (x[self.order] for x in _ends(w))
        self.mask = np.uint64((1 << 21) - 1)
        self.bits = np.zeros(1 << 21, bool)
        self.bits[self.hash & self.mask] = True

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(positions of words that are terms, numbers of these terms)."""
        if not len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[w.hash & self.mask])
        k = np.minimum(np.searchsorted(self.hash, w.hash[at]), len(self.hash) - 1)
        same = self.hash[k] == w.hash[at]
        at, k = at[same], k[same]
        head, tail = _ends(w, at)
        same = (self.size[k] == w.end[at] - w.start[at]) & (self.head[k] == head) & (self.tail[k] == tail)
        for i in np.flatnonzero(same & (self.size[k] > 16)).tolist():  # head and tail are all of a shorter word
            same[i] = w.joined(int(at[i]), 1) == self.names[self.order[k[i]]]
        return at[same], self.order[k[same]]


def _ends(w: Words, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of words, as numbers; of a shorter word all bytes."""
    raw = np.concatenate([np.zeros(8, np.uint8), w.text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    start, end = w.start[at] + 8, w.end[at] + 8
    unused = (8 - np.minimum(end - start, 8)).astype(np.uint64) * np.uint64(8)
    return (eight[start] << unused) >> unused, (eight[end - 8] >> unused) << unused


def postings(docs: DataFrame, terms) -> DataFrame:
    """One row per block of documents: ids and numbers of terms of its documents, and for every item term in it
    the documents (as places in the block) and tf; `ends` says where a term's part ends. terms: a broadcast Terms."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for b in batches:
            for first, offsets, data in text_blocks(b.column("text"), DOC_BYTES):
                w = words(offsets, data)
                rows = len(offsets) - 1
                at, term = known.find(w)
                cells, tf = np.unique(term * rows + w.row[at], return_counts=True)
                there, counts = np.unique(cells // rows, return_counts=True)
                columns = [b.column("doc_id").slice(first, rows).to_pylist(), np.diff(w.first), there, np.cumsum(counts), cells % rows, tf]
                yield pa.record_batch([pa.array([c], t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, POSTINGS)


_ARROW = pa.schema([(f.split()[0], pa.list_(pa.int64() if "bigint" in f else pa.int32())) for f in POSTINGS.split(", ")])


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, weight: np.ndarray, documents: int, total: int) -> np.ndarray:
    """w * ((1000000000 * tf) div (1000 * tf + 8 * m)) of each posting."""
    product = 75 * documents * int(length.max(initial=0))
    n = length.astype(object) if product >= 2**63 else length
    m = (25 + (75 * documents * n) // max(total, 1)).astype(np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def best(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores above 0, equal ones by ascending id, null last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], null[at], -scores[at]))][:k]


def product(blocks: DataFrame, factor, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of every task and item. factor: a broadcast (items, w by term, N, L)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, documents, total = factor.value
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        tops = [empty] * len(items)
        for b in batches:
            for r in range(b.num_rows):
                ids, n, there, ends, doc, tf = (b.column(name)[r].values for name in _ARROW.names)
                null, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0), np.int64)
                n, there, ends, doc, tf = (np.asarray(x, np.int64) for x in (n, there, ends, doc, tf))
                starts = np.append(0, ends[:-1])[: len(ends)]
                impact = impacts(tf, n[doc], np.repeat(weight[there], ends - starts), documents, total)
                place = np.full(len(weight), -1)
                place[there] = np.arange(len(there))
                for i, (term, times) in enumerate(items):
                    row = np.zeros(len(ids), np.int64)
                    at = place[term]
                    for p, q in zip(at[at >= 0].tolist(), times[at >= 0].tolist(), strict=True):
                        part = slice(starts[p], ends[p])
                        row[doc[part]] += q * impact[part]  # a document stands once in a row of B
                    found = best(row, ids, null, k)
                    if len(found):
                        scores, known, nulls = (np.concatenate(x) for x in zip(tops[i], (row[found], ids[found], null[found]), strict=True))
                        top = best(scores, known, nulls, k)
                        tops[i] = scores[top], known[top], nulls[top]
        for i, (scores, ids, null) in enumerate(tops):
            if len(scores):
                yield pa.record_batch({"item": pa.array(np.full(len(scores), i), pa.int32()), "doc_id": pa.array(ids, pa.int64(), mask=null), "score": pa.array(scores, pa.int64())})

    return blocks.mapInArrow(of, "item int, doc_id bigint, score bigint")


def _items(benchmark: DataFrame, size: int) -> Iterator[list[Row]]:
    """Blocks of the items; only one at a time is on the driver."""
    block: list[Row] = []
    held = 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        more = len((row.text or "").encode("utf-8", "surrogatepass"))
        if block and held + more > size:
            yield block
            block, held = [], 0
        block.append(row)
        held += more
    if block:
        yield block


def search(docs: DataFrame, benchmark: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every item."""
    context, spark = docs.sparkSession.sparkContext, docs.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    out = []
    for rows in _items(benchmark, block_bytes):
        counts = [Counter(word_list(r.text)) for r in rows]
        terms = Terms(counts)
        number = {t: i for i, t in enumerate(terms.names)}
        sent = context.broadcast(terms)
        blocks = save(postings(docs, sent), "postings")
        sent.destroy()
        documents, total = blocks.select(F.sum(F.size(F.filter("lengths", lambda n: n > 0))), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, n: s + n))).first()
        starts = F.concat(F.array(F.lit(0)), F.col("ends"))
        each = blocks.select(F.explode(F.zip_with("terms", F.zip_with("ends", starts, lambda e, s: e - s), lambda t, n: F.struct(t.alias("term"), n.alias("df")))).alias("x"))
        df = np.zeros(len(terms.names), np.int64)
        for term, n in each.where(F.col("x.term").isNotNull()).groupBy("x.term").agg(F.sum("x.df")).collect():  # a row per term of the items at most
            df[term] = n
        matrix = [(np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]
        factor = context.broadcast((matrix, weights(df, documents or 0), documents or 0, total or 0))
        tops = product(blocks, factor, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = save(tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")
        factor.destroy()
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        out.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # a block of items
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of the K best documents of every item."""
    return search(docs, benchmark)


def report_sql(k: int = K) -> str:
    """The same rows in DuckDB."""
    terms = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {terms} AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, unnest({terms}) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
tf AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM tf WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))) AS impact FROM p JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= {k}
"""
