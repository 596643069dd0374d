"""Quality classifier with hierarchical empirical Bayes over sites.

1. Document evidence. A logistic model on character statistics of the whole text
   gives each document a log-odds. It is fitted on at most FIT_ROWS labelled
   documents, those with the smallest hashes of their ids.
2. Site posteriors. Labels are counted per path and per host in one grouped
   aggregation over all labelled documents. A host's rate is shrunk toward the global
   rate, and a path's toward its host's posterior, each with the beta prior strength
   that the spread of the observed rates supports (method of moments), so a site with
   few labels says little.
3. Both together. The document's log-odds gives up the global prior it was fitted
   under and takes its path's posterior instead (its host's, if the path has no
   label; the global rate, if the host has none).

documents have no URL: source is the host, source and lang together are the path.

Defined cases: null and empty texts have statistics of 0 and are scored like any
other; null hosts and paths are sites of their own; labels of unknown documents, with
null quality or a null doc_id, are ignored, and repeated labels of one document count
once (the smaller value); without labels of both kinds the document evidence is 0;
repeated documents are scored each for itself and count once in the fit; ids whose hashes tie in the order of the fit go by the
id itself; very long texts are read whole; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import arrow_once, save, text_blocks

FIT_ROWS = 20_000
#: A document is rejected below this posterior probability of good quality.
REJECT_BELOW = 0.5
SITE_ROWS = 200_000
#: Prior strength where the rates don't spread more than chance would have them, and the least.
STRONG, WEAK = 1000.0, 2.0

_CLASSES = {"letter": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "blank": " \t", "line": "\n", "stop": ".,;:", "shout": "!?", "table": "|", "mark": "#$%&*@^~<>{}[]\\/=+_"}
N_FEATURES = len(_CLASSES) + 6


def features(column: pa.Array) -> np.ndarray:
    """One row of statistics per text: shares of byte classes, words, line and text sizes, repeated words."""
    table = np.full(256, len(_CLASSES), np.uint8)
    for k, chars in enumerate(_CLASSES.values()):
        table[[ord(c) for c in chars]] = k
    out = []
    for _, offsets, data in text_blocks(column):
        rows, size = len(offsets) - 1, np.diff(offsets)
        kind = table[data]
        row = np.repeat(np.arange(rows, dtype=np.int64), size)
        counts = np.bincount(row * (len(_CLASSES) + 1) + kind, minlength=rows * (len(_CLASSES) + 1)).reshape(rows, -1)
        gap = (kind == 3) | (kind == 4)
        start = ~gap
        start[1:] &= gap[:-1] | (row[1:] != row[:-1])
        n_words = np.bincount(row[start], minlength=rows)
        # words that the next word repeats in length and first byte: what templates and shuffled junk differ in
        at = np.flatnonzero(start)
        sign = data[at].astype(np.int64) * 4096 + np.minimum(np.diff(np.append(at, len(data))), 4095)
        again = np.bincount(row[at[1:]][(sign[1:] == sign[:-1]) & (row[at[1:]] == row[at[:-1]])], minlength=rows)
        n, w = np.maximum(size, 1), np.maximum(n_words, 1)
        out.append(np.column_stack([counts / n[:, None], np.log1p(n_words), size / w / 10, np.log1p(size / (counts[:, 4] + 1)) / 10, again / w, counts[:, 8] / w]))
    return np.vstack(out) if out else np.zeros((0, N_FEATURES))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the intercept last, means, scales) by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def labelled(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The document model, or None without labels of both kinds. Only the chosen rows' statistics reach the driver."""
    chosen = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def of(column: pa.Array) -> pa.Array:
        f = features(column)
        return pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))

    # fit_rows bounds the broadcast side, and what is collected: of rows with one doc_id the one with the smallest hash
    rows = docs.select("doc_id", "text").join(F.broadcast(save(chosen, "chosen")), "doc_id").select("doc_id", "good", F.xxhash64("text").alias("hash"), arrow_once(of, "array<double>")(F.col("text")).alias("x"))
    rows = rows.groupBy("doc_id", "good").agg(F.min_by("x", "hash").alias("x")).toPandas().sort_values("doc_id")
    if rows["good"].nunique() < 2:
        return None
    return fit_logistic(np.vstack(rows["x"]), rows["good"].to_numpy())


def evidence(docs: DataFrame, model: tuple | None, into: str) -> DataFrame:
    """docs with the model's log-odds of each text, without its intercept's prior taken off."""
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def of(column: pa.Array) -> pa.Array:
        w, mean, scale = known.value
        return pa.array(np.clip((features(column) - mean) / scale, -8, 8) @ w[:-1] + w[-1])

    return docs.withColumn(into, arrow_once(of, "double")(F.col("text")))


def strength(groups: DataFrame, rate: float) -> float:
    """Beta prior strength of rates good / n around `rate`, by the method of moments over all groups."""
    m = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - rate, 2)).alias("s")).first()
    var = rate * (1 - rate)
    if not m.k or m.k < 2 or var <= 0 or m.n * m.n <= m.nn:
        return STRONG
    between = (m.s - (m.k - 1) * var) / (m.n - m.nn / m.n)
    return float(np.clip(var / between - 1, WEAK, STRONG)) if between > 0 else STRONG


def sites(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> tuple[DataFrame, float]:
    """(saved table: host, path, posterior; path is null and whole is true in a host's own row), global rate."""
    own = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path")).join(labelled(labels), "doc_id")
    paths = save(own.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("good").alias("good")), "paths")
    hosts = save(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (total.good + 1) / (total.n + 2) if total.n else 0.5
    of_host = hosts.withColumn("posterior", (F.col("good") + rate * strength(hosts, rate)) / (F.col("n") + strength(hosts, rate)))
    k = strength(paths, rate)
    up = of_host.select(F.col("host").alias("h"), F.col("posterior").alias("above"))
    of_path = paths.join(up, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", ((F.col("good") + F.col("above") * k) / (F.col("n") + k)).alias("posterior"))
    return save(of_path.withColumn("whole", F.lit(False)).unionByName(of_host.select("host", F.lit(None).cast("string").alias("path"), "posterior", F.lit(True).alias("whole"))), "sites"), rate


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs with __doc (log-odds of the text alone), __site (posterior of its site) and __quality (both together)."""
    model = fit(docs, labels, fit_rows)
    table, rate = sites(docs, labels, host, path)
    out = evidence(docs, model, "__doc").withColumns({"__host": host.cast("string"), "__path": path.cast("string")})
    for whole, name in ((False, "__at_path"), (True, "__at_host")):
        side = table.where(F.col("whole") == whole).select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("posterior").alias(name))
        side = F.broadcast(side) if side.count() <= SITE_ROWS else side
        on = F.col("__host").eqNullSafe(F.col("__h"))
        out = out.join(side, on if whole else on & F.col("__path").eqNullSafe(F.col("__p")), "left").drop("__h", "__p")
    out = out.withColumn("__site", F.coalesce("__at_path", "__at_host", F.lit(rate)))
    odds = F.col("__doc") - (logit(F.lit(rate)) if model is not None else 0.0) + logit(F.col("__site"))
    return out.withColumn("__quality", 1 / (1 + F.exp(-odds))).drop("__host", "__path", "__at_path", "__at_host")


def of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, doc_log_odds, site_posterior, quality, accepted."""
    q = of_documents(docs.select("doc_id", "text", "source", "lang"), labels)
    return q.select("doc_id", F.round("__doc", 6).alias("doc_log_odds"), F.round("__site", 6).alias("site_posterior"), F.round("__quality", 6).alias("quality"), (F.col("__quality") >= REJECT_BELOW).alias("accepted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    return of_documents(docs, labels).where(F.col("__quality") >= REJECT_BELOW).select(docs.columns)
