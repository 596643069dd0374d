"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased; whatever is no letter becomes one blank. Every n-gram
of 1 to 3 characters is hashed to a bucket. Training counts buckets per language
over all training documents, task by task; the counts of the tasks are added in one
grouped aggregation, and the matrix of log-probabilities, buckets x languages, is
broadcast. Scoring gathers the matrix rows of a batch and sums them per document.
More than BLOCK languages are scored in blocks, one matrix in memory at a time, and the
blocks' best languages and sums of probabilities are put together.

Training uses documents with a language whose crc32(doc_id as text) mod 4 is not 2.

Defined cases: a text that is null or has no letters is `und` with score 0; without
any training row every document is `und`; a null doc_id is not held out and not
trained on; ties go to the language that sorts first; repeated rows count each; very
long texts are read whole; an empty table gives an empty result; a column named like the
result of `predict` is replaced by it, other columns are ignored or pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import arrow_once, discard, save, small_batches, text_blocks

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
SMOOTHING = 0.5
#: Languages of one matrix: 64 x 32,768 x 4 bytes.
BLOCK = 64


@cache
def fold_table() -> np.ndarray:
    """Code point of the lower-cased letter; a blank for everything else."""
    out = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(offsets: np.ndarray, data: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each n the bucket at every position of the block (BUCKETS where an n-gram
    would leave its row), the rows' offsets in positions, and each row's number of letters."""
    chars = data.tobytes().decode("utf-8", "replace")
    code = fold_table()[np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lead = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[offsets]
    letter = code != 0x20
    seen = np.zeros(len(code) + 1, np.int32)
    np.cumsum(letter, out=seen[1:])
    letters = np.diff(seen[at])
    # runs of blanks are one blank
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1][at[:-1] < len(code)]] = True
    np.cumsum(keep, out=seen[1:])
    at, code = seen[at], code[keep]
    buckets = []
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(SIZES) + 1):
        size = max(0, len(code) - n + 1)
        h = h[:size] ^ code[n - 1 : n - 1 + size]
        h *= np.uint32(0x01000193)
        h += np.uint32(n)
        if n in SIZES:
            g = h ^ (h >> np.uint32(15))
            g *= np.uint32(0x2C1B3C6D)
            g >>= np.uint32(17)
            out = np.full(len(code), BUCKETS, np.uint32)
            out[:size] = g
            for k in range(1, n):
                out[np.maximum(at[1:] - k, at[:-1])[at[1:] > at[:-1]]] = BUCKETS
            buckets.append(out)
    return buckets, at, letters


def train(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) of all languages, saved: how often each bucket occurs, and under bucket -1 the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in seen.items():
                at = np.flatnonzero(counts)
                yield pa.record_batch({"lang": pa.array([lang] * (len(at) + 1), pa.string()), "bucket": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(counts[at], n[lang]), pa.int64())})
            seen.clear(), n.clear()

        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for start, offsets, data in text_blocks(b.column("text")):
                buckets, at, _ = grams(offsets, data)
                own = langs[start : start + len(offsets) - 1]
                for lang in set(own):
                    mine = own == lang
                    n[lang] = n.get(lang, 0) + int(mine.sum())
                    mask = np.repeat(mine, np.diff(at))
                    seen[lang] = seen.get(lang, 0) + sum(np.bincount(b[mask], minlength=BUCKETS + 1)[:BUCKETS] for b in buckets)
                if len(seen) > BLOCK:  # a task holds the counts of so many languages at a time
                    yield from out()
        yield from out()

    small_batches(docs.sparkSession)
    counted = docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint")
    return save(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")


def matrices(counts: DataFrame, block: int | None = None) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(languages, log-probabilities [BUCKETS, languages], log-priors) of each block of languages; BUCKETS + 1 numbers a language at most."""
    block = block or BLOCK
    rows = sorted(tuple(r) for r in counts.where("bucket = -1").select("lang", "n").collect())  # a row per language
    documents = sum(n for _, n in rows)
    for a in range(0, max(len(rows), 1), block):
        languages = [lang for lang, _ in rows[a : a + block]]
        table = np.full((BUCKETS, len(languages)), SMOOTHING)
        if languages:
            part = counts.where(F.col("lang").isin(languages) & (F.col("bucket") >= 0)).toPandas()
            col = part["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(dtype=np.int64)
            table[part["bucket"].to_numpy(), col] += part["n"].to_numpy()
        yield languages, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(np.array([n for _, n in rows[a : a + block]], float) / max(1, documents))


_tables: dict[str, np.ndarray] = {}


def _rows_of(number: str, table: np.ndarray) -> np.ndarray:
    """A block's matrix by language, with a last bucket that counts nothing: made once in each worker, which keeps one at a time."""
    if number not in _tables:
        _tables.clear()
        _tables[number] = np.ascontiguousarray(np.vstack([table, np.zeros((1, table.shape[1]), np.float32)]).T, np.float64)
    return _tables[number]


def _scorer(known):
    number = uuid.uuid4().hex

    def of(column: pa.Array) -> pa.Array:
        languages, table, prior = known.value
        table = _rows_of(number, table)
        names, tops, rest = [], [], []
        for _, offsets, data in text_blocks(column):
            buckets, at, letters = grams(offsets, data)
            n = len(offsets) - 1
            total = np.tile(prior, (n, 1))
            full = np.flatnonzero(np.diff(at))
            for b in buckets:
                if len(full) and languages:
                    for k in range(len(languages)):
                        total[full, k] += np.add.reduceat(table[k].take(b), at[full])
            best = total.argmax(axis=1) if languages else None
            for i in range(n):
                ok = bool(languages) and letters[i] > 0
                names.append(languages[best[i]] if ok else None)
                tops.append(float(total[i, best[i]]) if ok else None)
                rest.append(float(np.exp(total[i] - total[i, best[i]]).sum()) if ok else None)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(tops, pa.float64()), pa.array(rest, pa.float64())], ["lang", "top", "sum"])

    return arrow_once(of, "struct<lang: string, top: double, sum: double>")


def predict(docs: DataFrame, counts: DataFrame, into: str = "language", block: int | None = None) -> DataFrame:
    """docs with a struct `into`: lang_pred and score, the posterior probability."""
    context, models = docs.sparkSession.sparkContext, matrices(counts, block)
    model, later = next(models), next(models, None)
    out = docs.withColumn("__best", _scorer(context.broadcast(model))(F.col("text")))
    if later is not None:
        # one matrix at a time: what a block found is written down before its matrix leaves memory and the next one comes
        scored = None
        for model in chain([model, later], models):
            known = context.broadcast(model)
            found = (docs if scored is None else scored).withColumn("__block", _scorer(known)(F.col("text")))
            found = found.withColumnRenamed("__block", "__best") if scored is None else found.withColumn("__best", _better(F.col("__best"), F.col("__block"))).drop("__block")
            done = save(found, "scored")
            if scored is not None:
                discard(scored)
            known.destroy()
            scored = done
        out = scored
    return out.withColumn(into, F.struct(F.coalesce("__best.lang", F.lit("und")).alias("lang_pred"), F.coalesce(1 / F.col("__best.sum"), F.lit(0.0)).alias("score"))).drop("__best")


def _better(a: Column, b: Column) -> Column:
    """The best of two blocks. sum is a block's probability in units of its best language's; the larger log-probability sets the unit."""
    total = lambda x, y: x["sum"] + y["sum"] * F.exp(y["top"] - x["top"])
    of = lambda x, y: F.struct(x["lang"].alias("lang"), x["top"].alias("top"), total(x, y).alias("sum"))
    return F.when(a["top"] >= b["top"], of(a, b)).otherwise(of(b, a))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    rows = docs.select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    scored = predict(rows.select("doc_id", "text"), train(rows.where(fold != 2)))
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")
