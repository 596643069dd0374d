"""Near-duplicate detection with BagMinHash signatures.

A document is the multiset of its shingles of five words (words as in `common`;
fewer words, but not none, make one shingle). Similarity is weighted Jaccard: the
sum of the smaller counts over the sum of the larger counts. Two documents are
linked at 0.8 or more; a class is a connected set of linked documents.

1. Signatures. Each shingle of weight w owns Poisson processes on the dyadic blocks
   (0,1], (1,2], (2,4], (4,8]... of the weight axis, seeded by shingle and block.
   A point has a time, one of the M components and a level inside its block; it
   counts if its level is at most w. Component i keeps the earliest of its points.
   Points come in the order of time, and a process stops once its time is past the
   document's largest component, so most shingles need a point or two. P(two
   components equal) is the weighted Jaccard similarity.
2. Documents with equal multisets (128-bit digest) are one content; the rest works
   on contents, so copies never meet each other in a join.
3. Bands. ROWS components make a band, BANDS bands a signature: at similarity 0.8 a
   link is missed with probability (1 - 0.8**6)**32 = 6e-5, at 0.85 2e-7.
4. Links. In every bucket each content is first compared with the bucket's leader (one
   pair a content and bucket, never all pairs of a group), and verified contents join
   their leader's class. Contents that share a bucket but are then still in different
   classes are compared too; in large buckets an exact filter on their differences
   from one of them (see `_rest`) first takes out the pairs that can't be similar.
   Verification counts the exact multiset overlap of both whole texts.

Contents are told apart by both halves of the digest; cid, a 64-bit number of each, is unique
(see `_contents`).

Defined cases: null and empty texts, and texts without words, have no shingles and
are in a class of their own row; class_id is the smallest doc_id of the class (null
only if all are null). Rows are told apart by doc_id and 64 bits of their text: rows with one doc_id, or none,
and different texts are documents of their own, of which one stays where they are near; rows
that repeat both are all kept = true in the report, and `keep_one` leaves one of them. Very long
texts are read whole, one at a time. An empty table gives an empty result. Columns of other
names pass through `keep_one`, which needs only doc_id and text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import arrow_once, mix, save, sized, text_blocks, windows, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
M = BANDS * ROWS
#: Buckets of so many contents are paired as they are.
SMALL_BUCKET = 8
#: Bits of parities of what a content differs by from its center.
SIGNATURE = 512
_T = (1 - SIMILARITY) / (1 + SIMILARITY)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count), sorted by row and hash."""
    w = words(offsets, data)
    g = windows(w.hash, SHINGLE)
    inside = w.row[: len(g)] == w.row[SHINGLE - 1 :][: len(g)]
    row, g = w.row[: len(g)][inside], g[inside]
    n = np.diff(w.first)
    for r in np.flatnonzero((n > 0) & (n < SHINGLE)):
        h = np.full(1, n[r], np.uint64)
        for i in range(w.first[r], w.first[r + 1]):
            h = mix(h * _GOLD + w.hash[i : i + 1])
        row, g = np.append(row, r), np.append(g, h)
    order = np.argsort(g, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, g = row[order], g[order]
    if not len(g):
        return row, g, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])]))
    return row[at], g[at], np.diff(np.append(at, len(g)))


def bag_minhash(rows: int, row: np.ndarray, shingle: np.ndarray, count: np.ndarray, m: int = M) -> np.ndarray:
    """Signatures [rows, m] as earliest times; infinite for rows without shingles."""
    sig = np.full(rows * m, np.inf)
    # one process for each shingle and dyadic block that its weight reaches
    blocks = np.ceil(np.log2(count)).astype(np.int64) + 1 if len(count) else count
    src = np.repeat(np.arange(len(count)), blocks)
    block = np.arange(len(src)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    length = np.where(block == 0, 1, np.maximum(low, 1))
    doc, weight = row[src], count[src]
    seed = mix(shingle[src] + block.astype(np.uint64) * _GOLD)
    time = np.zeros(len(src))
    plain = bool((blocks == 1).all()) if len(blocks) else True
    while len(seed):
        seed = seed + _GOLD
        a = mix(seed)
        # 53 bits of uniform time step, then component and level from a second mix
        time = time - np.log(((a >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / (m * length)
        b = mix(a)
        slot = doc * m + ((b >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        if plain:
            np.minimum.at(sig, slot, time)
        else:
            ok = low + ((b & np.uint64(0xFFFFFFFF)).astype(np.int64) * length >> 32) + 1 <= weight
            np.minimum.at(sig, slot[ok], time[ok])
        largest = sig.reshape(rows, m).max(axis=1)
        on = time < largest[doc]
        seed, time, doc, weight, low, length = seed[on], time[on], doc[on], weight[on], low[on], length[on]
    return sig.reshape(rows, m)


def _sketch(column: pa.Array) -> pa.Array:
    d1, d2, n, keys = [], [], [], []
    for _, offsets, data in text_blocks(column, 1 << 21):
        rows = len(offsets) - 1
        row, g, count = shingles(offsets, data)
        sig = bag_minhash(rows, row, g, count)
        c = count.astype(np.uint64)
        a, b = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
        if len(row):
            at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            a[row[at]] = np.add.reduceat(mix(g + _GOLD * c), at)
            b[row[at]] = np.add.reduceat(mix(mix(g) ^ c), at)
        bits = sig.view(np.uint64).reshape(rows, BANDS, ROWS)
        key = np.zeros((rows, BANDS), np.uint64)
        for k in range(ROWS):
            key = mix(key * _GOLD + bits[:, :, k])
        key = mix(key + np.arange(BANDS, dtype=np.uint64) * _GOLD)
        total = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
        d1.append(a), d2.append(b), n.append(total), keys.append(key.ravel())
    join = lambda x, kind: np.concatenate(x).view(np.int64) if x else np.zeros(0, kind)
    keys = join(keys, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
    return pa.StructArray.from_arrays([pa.array(join(d1, np.int64)), pa.array(join(d2, np.int64)), pa.array(join(n, np.int64)), lists], ["d1", "d2", "n", "bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, d1, d2 (digest of the multiset), n (its size), bands."""

    def of(column: pa.Array) -> pa.Array:
        return _sketch(column)

    s = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), arrow_once(of, "struct<d1: bigint, d2: bigint, n: bigint, bands: array<bigint>>")(F.col("text")).alias("s"))
    return s.select("doc_id", "text_hash", "s.*")


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in each row."""
    out = []
    for start, offsets, data in text_blocks(a, 1 << 20):
        rows = len(offsets) - 1
        ra, ga, ca = shingles(offsets, data)
        both = [shingles(o, d) + (s,) for s, o, d in text_blocks(b.slice(start, rows), 1 << 20)]
        rb, gb, cb = np.concatenate([r + s for r, _, _, s in both]), np.concatenate([g for _, g, _, _ in both]), np.concatenate([c for _, _, c, _ in both])
        row, g, c = np.concatenate([ra, rb]), np.concatenate([ga, gb]), np.concatenate([ca, cb])
        order = np.lexsort((g, row))
        row, g, c = row[order], g[order], c[order]
        same = (row[1:] == row[:-1]) & (g[1:] == g[:-1])
        common = np.bincount(row[1:][same], weights=np.minimum(c[1:], c[:-1])[same], minlength=rows)
        total = np.bincount(row, weights=c, minlength=rows)
        out.append(common / np.maximum(total - common, 1))
    return np.concatenate(out) if out else np.zeros(0)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose texts are similar enough."""

    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(overlap(a, b) >= SIMILARITY)

    ta, tb = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(ta, "a").join(tb, "b")
    return both.withColumn("ok", arrow_once(of, "boolean")("text_a", "text_b")).where("ok").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(cid, comp) of every end of an edge (a, b): the smallest cid of its connected
    set, by passing the smallest label on and halving label chains. Each round is
    written to the shared folder; only a count of changes reaches the driver."""
    e = save(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = save(e.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = e.join(labels.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "cid").select("cid", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("cid").alias("to"), F.col("comp").alias("hop"))
        new = save(step.join(jump, "to").select("cid", F.least("to", "hop").alias("comp"), (F.least("to", "hop") != F.col("was")).alias("moved")), "labels")
        if not new.where("moved").limit(1).count():
            return new.select("cid", "comp")
        labels = new.select("cid", "comp")


def _heads(bands: DataFrame) -> DataFrame:
    """key, leader, its class, and size of every bucket whose contents are in several classes. The leader is
    the member with the most company: what many copies were made from shares more bands with them than
    they do with each other."""
    first = F.max_by(F.struct("cid", "comp"), F.struct("company", "cid"))
    return bands.groupBy("key").agg(first.alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", F.col("l.cid").alias("leader"), F.col("l.comp").alias("leader_comp"), "size")


def _led(bands: DataFrame) -> DataFrame:
    """(a, b): every content with the leader of each of its buckets."""
    return bands.join(_heads(bands), "key").where("comp <> leader_comp").select(F.col("cid").alias("a"), F.col("leader").alias("b"))


def _rest(bands: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): contents that share a bucket but are still in different classes, without those that can't be similar.

    Small buckets are paired as they are. In a large one let c be the most connected content of the
    leader's class; x is c without its removed shingles R(x) and with its added ones A(x), as multisets.
    x and y are linked if they differ by at most t (|x| + |y|), t = (1 - s) / (1 + s) for similarity s. Take
    y that is not linked to c (one that is turns out a link itself), so |A(y)| + |R(y)| > t (|y| + |c|).
    Either x and y share an added shingle; those are found by a join on added shingles, of which unrelated
    edits have none in common. Or they share none, and then they differ by at least
    |A(x)| + |A(y)| + ||R(x)| - |R(y)||, which excludes all but shortened texts, and have at least
    (1 - t) (|A(x)| + |R(x)|) / 2 removed shingles in common, so that one of the first
    |R(x)| - that many + 1, in any fixed order, is removed from y too. What they differ by is what A(x) with R(x) and A(y)
    with R(y) differ by, and each such token flips one bit of SIGNATURE parities: pairs whose parities differ
    in more bits than the limit drop out in either join. No pair that could be linked is left out."""
    m = save(bands.join(_heads(bands), "key").select("key", "cid", "comp", "leader_comp", "size"), "mixed")
    small = m.where(F.col("size") <= SMALL_BUCKET)
    other = small.select("key", F.col("cid").alias("b"), F.col("comp").alias("cb"))
    pairs = small.join(other, "key").where("comp < cb").select(F.col("cid").alias("a"), "b")

    def of(whole: pa.Array, own: pa.Array) -> pa.Array:
        return differences(whole, own)

    center = bands.groupBy(F.col("comp").alias("leader_comp")).agg(F.max_by("cid", F.struct("company", "cid")).alias("c"))
    large = m.where(F.col("size") > SMALL_BUCKET).select("leader_comp", "cid", "comp").distinct().join(center, "leader_comp").where("cid <> c")
    if not large.limit(1).count():
        return pairs
    t = texts.toDF("cid", "text")
    d = large.join(t, "cid").join(t.toDF("c", "whole"), "c").withColumn("d", arrow_once(of, "struct<n: bigint, added: array<bigint>, removed: array<bigint>, parities: array<bigint>>")("whole", "text"))
    d = d.select("c", "cid", "comp", "leader_comp", "d.*", F.size("d.added").alias("na"), F.size("d.removed").alias("nr"))
    d = save(d.withColumn("far", F.col("na") + F.col("nr") > _T * (2 * F.col("n") - F.col("na") + F.col("nr"))), "differences")
    linked = d.where("not far and comp <> leader_comp").select(F.col("cid").alias("a"), F.col("c").alias("b"))
    mine = d.select("c", "cid", "comp", "n", "na", "nr", "added", "removed", "parities")
    far = d.where("far").select("c", F.col("cid").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("na").alias("nab"), F.col("nr").alias("nrb"), F.col("added").alias("added_b"), F.col("removed").alias("removed_b"), F.col("parities").alias("parities_b"))

    # Added shingles that the same contents share bring the same pairs; one of each such set is enough, and
    # shingles of a single content bring none. A change of one word adds five shingles.
    held = d.select("c", "cid", F.explode("added").alias("token")).groupBy("c", "token")
    held = held.agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.sum(F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(2**31))).alias("s")).where("k > 1")
    telling = sized(save(held.groupBy("c", "k", "x", "s").agg(F.min("token").alias("token")).select("c", "token"), "telling"))

    def on(y: str, first, fits, only: DataFrame | None = None) -> DataFrame:
        left = mine.select("c", "cid", "comp", "n", "na", "nr", "parities", F.explode(first).alias("token"))
        right = far.select("c", "b", "cb", "nb", "nab", "nrb", "parities_b", F.explode(y).alias("token"))
        if only is not None:
            left, right = left.join(only, ["c", "token"], "left_semi"), right.join(only, ["c", "token"], "left_semi")
        return left.join(right, ["c", "token"]).where((F.col("comp") != F.col("cb")) & fits & close).select(F.col("cid").alias("a"), "b")

    most = _T * (F.col("n") + F.col("nb")) + 1e-9
    flipped = [F.bit_count(F.col("parities")[i].bitwiseXOR(F.col("parities_b")[i])) for i in range(SIGNATURE // 64)]
    close = reduce(Column.__add__, flipped) <= most
    # what two must have in common can't be more than the smaller of their added and of their removed parts
    sizes = F.col("na") + F.col("nr") + F.col("nab") + F.col("nrb") - most <= 2 * (F.least("na", "nab") + F.least("nr", "nrb"))
    few = F.col("na") + F.col("nab") + F.abs(F.col("nr") - F.col("nrb")) <= most
    need = F.ceil((1 - _T) * (F.col("na") + F.col("nr")) / 2 - 1e-9).cast("int") - 1
    head = F.slice("removed", 1, F.greatest(F.col("nr") - need, F.lit(0)))
    return pairs.union(linked).union(on("added_b", F.col("added"), sizes, telling)).union(on("removed_b", head, few))


def differences(whole: pa.Array, own: pa.Array) -> pa.Array:
    """Per row the size of `own`, what it has over `whole` and lacks of it, as hashes of (shingle, level), and parities of both."""
    n, diffs, parities = [], {True: [], False: []}, []
    for start, offsets, data in text_blocks(own, 1 << 20):
        rows = len(offsets) - 1
        ro, go, co = shingles(offsets, data)
        parts = [shingles(o, d) + (s,) for s, o, d in text_blocks(whole.slice(start, rows), 1 << 20)]
        rw, gw, cw = np.concatenate([r + s for r, _, _, s in parts]), np.concatenate([g for _, g, _, _ in parts]), np.concatenate([c for _, _, c, _ in parts])
        row, g = np.concatenate([ro, rw]), np.concatenate([go, gw])
        count = np.concatenate([co, -cw])
        order = np.lexsort((g, row))
        row, g, count = row[order], g[order], count[order]
        twice = np.flatnonzero((row[1:] == row[:-1]) & (g[1:] == g[:-1]))
        size = np.abs(count)
        low = np.zeros(len(g), np.int64)
        low[twice] = np.minimum(size[twice], size[twice + 1])  # levels that both have
        top = size.copy()
        top[twice] = np.maximum(size[twice], size[twice + 1])
        added = count > 0
        added[twice] = np.where(size[twice] >= size[twice + 1], added[twice], added[twice + 1])
        keep = np.ones(len(g), bool)
        keep[twice + 1] = False
        row, g, low, top, added = row[keep], g[keep], low[keep], top[keep], added[keep]
        spread = np.repeat(np.arange(len(g)), top - low)
        level = np.arange(len(spread)) - np.repeat(np.cumsum(top - low) - (top - low), top - low) + low[spread] + 1
        token = mix(g[spread] + level.astype(np.uint64) * _GOLD)
        n.append(np.bincount(ro, weights=co, minlength=rows).astype(np.int64))
        bit, words = token % np.uint64(SIGNATURE), np.zeros(rows * (SIGNATURE // 64), np.uint64)
        np.bitwise_xor.at(words, row[spread] * (SIGNATURE // 64) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        parities += list(words.view(np.int64).reshape(rows, -1))
        for side, out in diffs.items():
            mine = added[spread] == side
            order = np.lexsort((token[mine], row[spread][mine]))
            cut = np.searchsorted(row[spread][mine][order], np.arange(rows + 1))
            own_tokens = token[mine][order].view(np.int64)
            out += [own_tokens[cut[k] : cut[k + 1]] for k in range(rows)]
    lists = [pa.array(out, pa.list_(pa.int64())) for out in (*diffs.values(), parities)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), *lists], ["n", "added", "removed", "parities"])


def _contents(s: DataFrame) -> DataFrame:
    """cid, d1, d2, doc_id and text_hash of a row of it (the first), copies: every different multiset, under a number of its own."""
    first = F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    c = s.where("n > 0").groupBy("d1", "d2").agg(first.alias("rep"), F.count("*").alias("copies"))
    # two multisets may share d1; the one with the larger d2 is numbered by both
    again = F.row_number().over(Window.partitionBy("d1").orderBy("d2")) > 1
    cid = F.when(again, F.xxhash64("d1", "d2")).otherwise(F.col("d1"))
    return save(c.select(cid.alias("cid"), "d1", "d2", "rep.doc_id", "rep.text_hash", "copies"), "contents")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class_id (smallest doc_id of the class), class_size, kept (the row with class_id; of several, the one with the smallest text_hash)."""
    s = save(sketches(docs), "sketches")
    contents = _contents(s)
    # bands of one row for each content; copies drop out before the rows spread
    own = s.where("n > 0").select("d1", "d2", F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), "bands")
    own = own.join(contents, ["d1", "d2"]).where(F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("text_hash")))
    keyed = own.select("cid", F.explode("bands").alias("key")).distinct()
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = save(keyed.join(buckets, "key").select("key", "cid", "size"), "met")
    company = met.groupBy("cid").agg(F.sum("size").alias("company"))
    bands = save(met.join(company, "cid").select("key", "cid", "company"), "bands")

    wanted = bands.select("cid").distinct().join(contents, "cid").select("cid", "doc_id", "text_hash")
    wanted = sized(save(wanted, "wanted").select("cid", F.col("doc_id").alias("id"), F.col("text_hash").alias("th")))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")))
    texts = save(texts.groupBy("cid").agg(F.min("text").alias("text")), "texts")

    led = save(_pairs(_led(bands.withColumn("comp", F.col("cid")))), "led")
    edges = save(_verified(led, texts), "links")
    labels = _labels(bands, edges)
    rest = save(_pairs(_rest(bands.join(labels, "cid"), texts)).join(led, ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        edges = edges.union(save(_verified(rest, texts), "links"))
        labels = _labels(bands, edges)

    # what a class is follows from its contents; rows only look theirs up
    member = contents.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    first = F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    sizes = save(member.groupBy("comp").agg(first.alias("rep"), F.sum("copies").alias("class_size")), "sizes")
    of = save(member.join(sizes, "comp").select("d1", "d2", F.col("rep.doc_id").alias("class_id"), F.col("rep.text_hash").alias("class_hash"), "class_size"), "classes")
    alone = F.col("n") == 0
    out = s.select("doc_id", "text_hash", "d1", "d2", "n").join(of, ["d1", "d2"], "left")
    return out.select(
        "doc_id",
        "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash")))).alias("kept"),
    )


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labels(bands: DataFrame, edges: DataFrame) -> DataFrame:
    """(cid, comp) of every content that shares a bucket."""
    of = components(edges).withColumnRenamed("comp", "new")
    return save(bands.select("cid").distinct().join(of, "cid", "left").select("cid", F.coalesce("new", "cid").alias("comp")), "labels")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept."""
    return classes(docs.select("doc_id", "text")).select("doc_id", "class_id", "class_size", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the one of which `classes` says kept. Of rows that repeat both its
    doc_id and its text one stays, the first in the order of their other columns."""
    rows = save(classes(docs.select("doc_id", "text")), "kept").withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.xxhash64("text"))
    gone = save(rows.where("not kept").select("__id", "__hash").distinct(), "gone")
    twice = save(rows.where("kept and class_size > 1").groupBy("__id", "__hash").count().where("count > 1").drop("count"), "twice")
    out = docs.join(sized(gone), same, "left_anti")
    if not twice.limit(1).count():
        return out
    many = out.join(sized(twice), same, "left_semi")
    one = many.groupBy("doc_id", "text").agg(F.min(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("__"))).alias("__row"))
    return out.join(sized(twice), same, "left_anti").unionByName(one.select(*[c if c in ("doc_id", "text") else F.col("__row")[c].alias(c) for c in docs.columns]))
