"""Line deduplication with a segment-partition edit join, in DataFrame functions only.

A line is what stands between line feeds; compared are lines folded to lower case
with runs of white space as one blank and none at the ends. Empty folded lines are
always kept. Lines stand in the order of (doc_id, text, line number). A line is dropped if
an equal folded line stands earlier, or if its first occurrence has an earlier line within
the edit distance that the shorter of the two allows: one edit for every EDIT_CHARS
characters, THRESHOLD at most, so that lines of a few characters have to be equal.

1. Equal lines are one content: grouping by the folded line counts a hot line
   map-side, and carries its first place only. Contents are saved to the shared folder.
2. Segment index: a line that allows t edits is cut into t + 1 even segments; by
   the pigeonhole principle a line within t edits holds one of them unchanged.
   Each line is indexed under (its length, segment number, segment).
3. Length-aware probes: for every length n - t .. n and every segment of that
   length, only substrings at the starts that the length difference and the segment
   number allow are probed.
4. Hot buckets. A line needs one earlier near line, not all of them. In a bucket of more than HOT_BUCKET lines
   (variants of one line) LEADERS of the lines that have none yet lead, the earliest among them: each line behind them is held against
   these few, and whoever is near to one is settled. After ROUNDS of this at most, what is still open meets every earlier line of its
   buckets, settled ones too, which is exact. Lines carry the parities of their character pairs, folded to
   126 bits; an edit flips at most 4 of them, so of BLOCKS = 4 x THRESHOLD + 1 blocks
   one is equal, and a bucket is joined block by block. Of the pairs
   that meet, those with more flips than the edits allow drop out in the join, and
   each is made in the first block that is equal.
5. Candidates lose what they have in common at both ends, and are verified by a banded
   bit-parallel edit distance: the band of 2 x THRESHOLD + 1 rows around the diagonal is one BIGINT
   for the rises and one for the falls, and `aggregate` moves both along the other line (see
   `banded_distance`). Edits
   are counted in characters. The report counts them in UTF-8 bytes, as `levenshtein` in its
   SQL does; this is never less than the count in characters, so that the candidates are
   the same.

Contents are told apart by 128 bits of hash and length, rows by doc_id and 96 bits of their text.

Defined cases: a null text has no lines and stays null; an empty one stays empty; a
null doc_id counts as larger than any other; rows with one doc_id and different texts are
documents of their own, in the order of a hash of the text; a row that repeats both keeps
what its twin keeps; a document of which nothing is kept gets an empty text; very long lines
and texts are ordinary ones; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import save, sized

THRESHOLD = 2
#: Characters of a line for each edit that it allows.
EDIT_CHARS = 8
HOT_BUCKET = 16
#: Dropped lines of a document are looked up block by block, so that very long texts don't take a square of their lines.
BLOCK_LINES = 256
_LINES = 2**31


def folded(line: Column) -> Column:
    # most lines have single blanks only, and need no pattern
    odd = F.contains(line, F.lit("  "))
    for c in ("\t", "\x0b", "\f", "\r"):
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line)))


def _hashes(text: Column) -> list[Column]:
    """What tells rows with one doc_id apart."""
    return [F.xxhash64(text).alias("text_hash"), F.hash(text).alias("text_hash2")]


#: A row of documents.
ROW = ["doc_id", "text_hash", "text_hash2"]


def lines(docs: DataFrame) -> DataFrame:
    """ROW, line (number from 0), folded (never empty), place: all lines in an order of their own."""
    # doc_id, 31 bits of the hash and the line number as one number, so that the first place is a plain minimum
    base = F.coalesce("doc_id", F.lit(2**63 - 1)).cast("decimal(20,0)") * F.lit(2**62).cast("decimal(19,0)")
    rows = docs.select("doc_id", *_hashes(F.col("text")), base.alias("base"), "text")
    each = rows.select(*ROW, "base", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    # whether a line is empty when folded is asked of the line as it is: a filter on the folded one would fold it twice.
    # Most lines begin with a character that shows it, and need no trimming
    each = each.where((F.ascii("raw") > 32) | (F.length(F.btrim("raw", F.lit(" \t\x0b\f\r"))) > 0))
    place = F.col("base") + (F.col("text_hash").bitwiseAND(_LINES - 1) * _LINES + F.col("line")).cast("decimal(19,0)")
    return each.select(*ROW, "line", folded(F.col("raw")).alias("folded"), place.alias("place"))


def _ids(folded: Column) -> list[Column]:
    return [F.xxhash64(folded).alias("id"), (F.hash(folded).cast("bigint") * 2**31 + F.length(folded)).alias("id2")]


def contents(each: DataFrame, threshold: int) -> DataFrame:
    """id, id2, folded, chars, place (the first), places (how many), short (whether there are lines close to its length
    that allow fewer edits than threshold), saved."""
    c = each.groupBy("folded").agg(F.min("place").alias("place"), F.count("*").alias("places"))
    chars = F.length("folded")
    return save(c.select(*_ids(F.col("folded")), "folded", chars.alias("chars"), "place", "places", (chars < EDIT_CHARS * threshold + threshold).alias("short")), "lines", by="short")


def edits(chars: Column, threshold: int) -> Column:
    """How many edits a line of so many characters allows."""
    return F.least(F.lit(threshold), F.floor(chars / EDIT_CHARS).cast("int"))


def segment(chars: Column, k: int, threshold: int) -> tuple[Column, Column]:
    """(start from 1, length) of segment k of a line of so many characters; later segments are the longer ones."""
    size, longer = F.floor(chars / (threshold + 1)).cast("int"), (chars % (threshold + 1)).cast("int")
    extra = F.greatest(F.lit(0), F.lit(k) - (threshold + 1 - longer))
    return F.lit(1) + size * k + extra, size + F.when(F.lit(k) >= threshold + 1 - longer, 1).otherwise(0)


def _key(chars: Column, k: int, start: Column, size: Column) -> Column:
    """The bucket of a segment of the folded line. Where each character is a byte, cutting bytes finds the start at once."""
    part = F.when(F.octet_length("folded") == F.col("chars"), F.substring(F.col("folded").cast("binary"), start, size)).otherwise(F.substring("folded", start, size).cast("binary"))
    return F.xxhash64(chars, F.lit(k), part)


def _keys(c: DataFrame, chars: Column, threshold: int, shifts: Callable[[int, int], list[int]]) -> DataFrame:
    """(id, key) of the segments that a line of so many characters is cut into, each at the given shifts."""

    def of_class(t: int) -> Column:
        keys = []
        for k in range(t + 1):
            start, size = segment(chars, k, t)
            keys += [_key(chars, k, start + shift, size) for shift in shifts(t, k)]
        return F.array(*keys) if keys else F.array().cast("array<bigint>")

    any_class = F.array().cast("array<bigint>")
    for t in range(1, threshold + 1):
        any_class = F.when(edits(chars, threshold) == t, of_class(t)).otherwise(any_class)
    # lines that aren't short allow as many edits as any, and need no cases, in which Spark would compute what keys share again and again
    parts = [c.where("NOT short").select("id", F.explode(of_class(threshold)).alias("key")), c.where("short").select("id", F.explode(any_class).alias("key"))]
    return reduce(DataFrame.union, parts)


def index_keys(c: DataFrame, threshold: int) -> DataFrame:
    return _keys(c, F.col("chars"), threshold, lambda t, k: [0])


def probe_keys(c: DataFrame, index: DataFrame, threshold: int) -> DataFrame:
    """Keys of indexed lines, not longer than this one, that it may be near to. Those of its own segments are read from the index.
    Each length is a scan of its own: the code that Spark makes for all keys at once is too long for the JVM to compile."""
    asked = [index]
    for less in range(threshold + 1):

        def shifts(t: int, k: int, less: int = less) -> list[int]:
            # by how much the segment may have moved: what came before it, and what comes after
            low, high = max(-k, less - (t - k)), min(k, less + (t - k))
            return [s for s in range(low, high + 1) if t >= less and (less or s)]

        asked.append(_keys(c, F.col("chars") - less, threshold, shifts))
    return reduce(DataFrame.union, asked)


def parities(line: Column) -> tuple[Column, Column]:
    """Two 63-bit numbers: parities of the counts of hashed character pairs."""
    chars = F.split(line, "")
    pairs = F.transform(F.zip_with(chars, F.slice(chars, 2, 2**30), lambda a, b: F.xxhash64(a, b)), lambda h: F.pmod(h, F.lit(126)))
    bit = lambda low: F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, p: F.when((p >= low) & (p < low + 63), acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (p - low).cast("int")))).otherwise(acc))
    return bit(0), bit(63)


def blocks(threshold: int) -> int:
    return 4 * threshold + 1


def _block(a: Column, b: Column, k: int, threshold: int) -> list[Column]:
    """Block k of a line's parities, as one or two numbers."""
    width = 126 // blocks(threshold)
    at = k * width
    cut = lambda x, lo, size: F.shiftright(x, lo).bitwiseAND(F.lit((1 << size) - 1))
    if at + width <= 63:
        return [cut(a, at, width)]
    if at >= 63:
        return [cut(b, at - 63, width)]
    return [cut(a, at, 63 - at), cut(b, 0, at + width - 63)]


def _block_keys(a: Column, b: Column, key: Column, threshold: int) -> Column:
    """The bucket's key with each block of a line's parities."""
    return F.array(*(F.xxhash64(key, F.lit(k), *_block(a, b, k, threshold)) for k in range(blocks(threshold))))


def _first_block(x: Column, y: Column, threshold: int) -> Column:
    """The first block in which two lines are equal, of the exclusive or of their parities."""
    return F.coalesce(*(F.when(reduce(Column.__and__, [part == 0 for part in _block(x, y, k, threshold)]), F.lit(k)) for k in range(blocks(threshold))))


#: Leaders of a hot bucket that its lines are held against in a round, and rounds.
LEADERS, ROUNDS = 4, 20
#: Another round follows if the last one settled one of so many open lines.
WORTH = 20


def near_lines(c: DataFrame, threshold: int, in_bytes: bool = False) -> DataFrame:
    """(id, id2) of the contents that have an earlier near one."""
    index = save(index_keys(c, threshold), "segments")
    probe = probe_keys(c, index, threshold)
    hot = save(index.groupBy("key").count().where(F.col("count") > HOT_BUCKET).select("key"), "hot")
    few = sized(hot)
    # One pass over the probes for cold and for hot buckets: probes of hot buckets are marked and spread by their line's id, so
    # that none of them meets anything or is one task. Cold buckets have few lines
    spread_by = F.when(F.col("hot"), F.xxhash64("id").bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("bigint"))
    marked = probe.join(few.withColumn("hot", F.lit(True)), "key", "left").select("id", "key", spread_by.alias("spread"))
    listed = index.join(few, "key", "left_anti").select("key", F.lit(0).cast("bigint").alias("spread"), F.col("id").alias("near"))
    is_hot = F.col("spread") != 0
    met = marked.join(listed, ["key", "spread"], "left").where(is_hot | (F.col("near").isNotNull() & (F.col("id") != F.col("near"))))
    met = save(met.select("id", F.when(is_hot, F.col("key")).alias("key"), "near", is_hot.alias("hot")), "met", by="hot")
    near = save(verified(_each_once(met.where("NOT hot").select("id", "near")), c, threshold, in_bytes), "near")
    if not hot.limit(1).count():
        return near
    bits = [p.alias(k) for k, p in zip(("p0", "p1"), parities(F.col("folded")), strict=True)]
    asked, listed = met.where("hot").select("id", "key"), save(index.join(few, "key", "left_semi"), "hot")
    own = save(c.join(sized(save(asked.union(listed).select("id").distinct(), "hot_ids")), "id", "left_semi").select("id", "id2", "folded", "chars", "place", *bits), "parities")
    marks = own.select("id", "chars", "place", "p0", "p1")

    # rounds of leaders: whoever has a near leader is settled
    used = None
    for number in range(ROUNDS):
        open_ = _unsettled(marks, near)
        waiting = save(asked.join(open_.select("id", "place", "p0", "p1"), "id"), "waiting")
        full = waiting.groupBy("key").count().where(F.col("count") > HOT_BUCKET).select("key")
        choice = listed.join(open_.select("id", "place", "p0", "p1"), "id").join(sized(save(full, "full")), "key", "left_semi")
        choice = choice if used is None else choice.join(used, ["key", "id"], "left_anti")
        # the earliest, and others from anywhere: neighbours have the same lines near. Spark keeps so many rows a key and task before it shuffles
        some = lambda order, n: choice.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(order))).where(F.col("k") <= n).drop("k")
        leaders = save(some(F.col("place"), 1).union(some(F.xxhash64("id", F.lit(number)), LEADERS - 1)).distinct(), "leaders")
        if not leaders.limit(1).count():
            break
        led = waiting.join(leaders.toDF("key", "near", "first", "q0", "q1"), "key").where("first < place")
        led = led.where(_flips(F.col("p0").bitwiseXOR(F.col("q0")), F.col("p1").bitwiseXOR(F.col("q1"))) <= 4 * threshold)
        settled = save(verified(_each_once(led.select("id", "near")), own, threshold, in_bytes), "settled")
        near = near.union(settled)
        if settled.count() * WORTH < open_.count():
            break
        used = leaders.select("key", "id") if used is None else used.union(leaders.select("key", "id"))

    # what is left meets every earlier line of its buckets, block by block
    state = save(marks.join(near.select(F.col("id").alias("done")).distinct(), F.col("id") == F.col("done"), "left").select("id", "chars", "place", "p0", "p1", F.col("done").isNull().alias("open")), "state")
    spread = lambda x: x.join(state, "id").select("id", "chars", "place", "open", "p0", "p1", F.posexplode(_block_keys(F.col("p0"), F.col("p1"), F.col("key"), threshold)).alias("block", "key"))
    other = spread(listed).drop("block").toDF("near", "chars_near", "place_near", "open_near", "q0", "q1", "key")
    x, y = F.col("p0").bitwiseXOR(F.col("q0")), F.col("p1").bitwiseXOR(F.col("q1"))
    # a pair comes from its first equal block, and lines of one length from one side only
    once = (F.col("block") == _first_block(x, y, threshold)) & ((F.col("chars") != F.col("chars_near")) | (F.col("id") < F.col("near")))
    matters = F.when(F.col("place") > F.col("place_near"), F.col("open")).otherwise(F.col("open_near"))
    sides = []
    for mine, theirs in (("open", None), (None, "open_near")):  # at least one end is open; both joins are on it first, so that settled lines don't meet
        left = spread(asked).where(mine) if mine else spread(asked).where("NOT open")
        right = other if mine else other.where(theirs)
        sides.append(left.join(right, "key").where(matters & (_flips(x, y) <= 4 * threshold) & once).select("id", "near"))
    return near.union(verified(_each_once(sides[0].union(sides[1])), own, threshold, in_bytes))


def _flips(x: Column, y: Column) -> Column:
    return F.bit_count(x) + F.bit_count(y)


def _unsettled(marks: DataFrame, near: DataFrame) -> DataFrame:
    return marks.join(near.select("id"), "id", "left_anti")


def _each_once(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).distinct()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two arrays whose sizes differ by `threshold` at most, exact up to threshold, and more than threshold beyond it.

    Column j of the table of distances is kept for the rows j - threshold .. j + threshold of `a`, as bits
    of two numbers: where the distance rises by one from the row above, and where it falls. The bits that
    match b[j] give the next column with one addition (Myers 1999, in the diagonal band of Hyyro 2003).
    The distance itself is followed down the diagonal that ends in the last cell."""
    # bound once: inside the lambdas below, an expression over columns would be computed at every step
    ends = F.struct(a.alias("a"), b.alias("b"), (F.size(a) - F.size(b)).alias("more"))
    return _let(ends, lambda x: _banded(x["a"], x["b"], x["more"], threshold))


def _banded(a: Column, b: Column, more: Column, threshold: int) -> Column:
    t, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    number = lambda x: F.lit(x).cast("bigint")

    def matches(c: Column, j: Column) -> Column:
        return reduce(Column.__add__, [F.when(F.get(a, j + (k - t)) == c, number(1 << k)).otherwise(number(0)) for k in range(width)])

    def step(acc: Column, c: Column) -> Column:
        j, rise, fall = acc["j"], acc["rise"], acc["fall"]

        def column(match: Column) -> Column:
            same = (match.bitwiseAND(rise) + rise).bitwiseXOR(rise).bitwiseOR(match).bitwiseOR(fall).bitwiseAND(number(full))
            return _let(same, move)

        def move(same: Column) -> Column:
            lower, right, left = F.shiftright(same, 1), fall.bitwiseOR(F.bitwise_not(same.bitwiseOR(rise))), same.bitwiseAND(rise)
            return F.struct(
                (j + 1).alias("j"),
                left.bitwiseOR(F.bitwise_not(lower.bitwiseOR(right)).bitwiseAND(number(full))).alias("rise"),
                lower.bitwiseAND(right).alias("fall"),
                (acc["distance"] + 1 - F.call_function("shiftright", same, more + t).bitwiseAND(number(1))).alias("distance"),
            )

        # the distance never falls down a diagonal, so that it is settled once it is too large
        return F.when(acc["distance"] > t, acc).otherwise(_let(matches(c, j), column))

    start = F.struct(F.lit(0).alias("j"), number(full - (1 << t) + 1).alias("rise"), number(0).alias("fall"), F.greatest(more, F.lit(0)).cast("bigint").alias("distance"))
    return F.aggregate(b, start, step, lambda acc: acc["distance"])


def _trimmed(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body of two texts without the beginning and the end that they have in common, which cost no edits. Both are found
    by doubling steps, up to 2**15 - 1 characters; what a longer line has in common beyond that just stays."""
    steps = F.array(*(F.lit(1 << e) for e in range(14, -1, -1)))
    na, nb = F.length(a), F.length(b)

    def common(most: Column, x: Callable[[Column, Column], Column], y: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(steps, F.lit(0), lambda k, s: F.when(k + s <= most, F.when(x(k, s) == y(k, s), k + s).otherwise(k)).otherwise(k))

    def behind(head: Column) -> Column:
        tail = common(F.least(na, nb) - head, lambda k, s: F.substring(a, na - k - s + 1, s), lambda k, s: F.substring(b, nb - k - s + 1, s))
        return _let(tail, lambda tail: body(F.substring(a, head + 1, na - head - tail), F.substring(b, head + 1, nb - head - tail)))

    return _let(common(F.least(na, nb), lambda k, s: F.substring(a, k + 1, s), lambda k, s: F.substring(b, k + 1, s)), behind)


def distance(a: Column, b: Column, threshold: int, in_bytes: bool = False) -> Column:
    """Edit distance of two texts whose lengths differ by `threshold` at most, as `banded_distance` counts it."""

    def units(x: Column) -> Column:
        return F.when(F.length(x) > 0, F.split(F.decode(x, "ISO-8859-1") if in_bytes else x, "")).otherwise(F.array().cast("array<string>"))

    kind = "binary" if in_bytes else "string"
    return _let(F.struct(a.cast(kind).alias("a"), b.cast(kind).alias("b")), lambda x: _trimmed(x["a"], x["b"], lambda a, b: banded_distance(units(a), units(b), threshold)))


def verified(pairs: DataFrame, c: DataFrame, threshold: int, in_bytes: bool = False) -> DataFrame:
    """(id, id2): contents of the pairs that have an earlier near content among them."""
    pairs = save(pairs, "pairs")
    ends = sized(save(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends"))
    texts = save(c.join(ends, "id", "left_semi").select("id", "id2", "folded", "place", "chars"), "texts")
    both = pairs
    for end in "ab":
        both = both.join(texts.toDF(end, f"{end}2", f"text_{end}", f"place_{end}", f"chars_{end}"), end)
    allowed = edits(F.least("chars_a", "chars_b"), threshold)
    if in_bytes:  # lines of nearly as many characters can differ by more bytes than the band is wide
        both = both.where(F.abs(F.octet_length("text_a") - F.octet_length("text_b")) <= allowed)
    near = both.where(distance(F.col("text_a"), F.col("text_b"), threshold, in_bytes) <= allowed)
    later = F.when(F.col("place_a") < F.col("place_b"), F.struct(F.col("b").alias("id"), F.col("b2").alias("id2"))).otherwise(F.struct(F.col("a").alias("id"), F.col("a2").alias("id2")))
    return near.select(later.alias("later")).select("later.*").distinct()


def dropped(docs: DataFrame, threshold: int = THRESHOLD, in_bytes: bool = False) -> DataFrame:
    """ROW, gone: the numbers of the lines to drop by blocks of BLOCK_LINES, n_gone: how many, and n_near: how many
    of them have only a near earlier line.
    Only documents that lose lines have a row."""
    docs = docs.select("doc_id", "text")
    each = lines(docs)
    c = contents(each, threshold)
    near = near_lines(c, threshold, in_bytes).distinct().withColumn("near", F.lit(True))
    # Contents that lose a line: those with more than one place, and those with an earlier near content.
    marked = c.select("id", "id2", "place", "places").join(near, ["id", "id2"], "left").where("places > 1 OR near")
    marked = sized(save(marked.select("id", "id2", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near")), "marked"))
    lost = each.select(*ROW, "line", *_ids(F.col("folded")), "place").join(marked, ["id", "id2"]).where(F.col("near") | (F.col("place") > F.col("first")))
    first = (F.col("place") == F.col("first")).cast("bigint")
    by_block = lost.groupBy(*ROW, F.floor(F.col("line") / BLOCK_LINES).cast("int").alias("block")).agg(F.collect_set("line").alias("lines"), F.sum(first).alias("n_near"))
    return by_block.groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("block", "lines"))).alias("gone"), F.sum(F.size("lines")).alias("n_gone"), F.sum("n_near").alias("n_near"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, in_bytes: bool = False) -> DataFrame:
    """docs with the dropped lines cut out of text, and columns __lines, __gone, __near counting lines."""
    gone = save(dropped(docs, threshold, in_bytes), "gone")
    gone = gone.toDF(*[f"__{c}" for c in gone.columns])
    mine = F.col("doc_id").eqNullSafe(F.col("__doc_id"))
    for ours, theirs in zip(_hashes(F.col("text")), ROW[1:], strict=True):
        mine &= ours == F.col(f"__{theirs}")
    rows = docs.join(gone, mine, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains(F.try_element_at("__gone", F.floor(i / BLOCK_LINES).cast("int")), i), F.lit(False))), "\n")
    return rows.select(
        *[F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint").alias("__lines"),
        F.coalesce("__n_gone", F.lit(0)).alias("__gone"),
        F.coalesce("__n_near", F.lit(0)).alias("__near"),
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, n_near (first places of lines with an earlier near line), text_sha256 of what is kept."""
    d = dedup_lines(docs.select("doc_id", "text"), in_bytes=True)
    return d.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_dropped"), F.col("__near").alias("n_near"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def report_sql(threshold: int = THRESHOLD) -> str:
    """The same rows in DuckDB: all pairs of lines of nearly one length that share a part, without an index."""
    parts = []
    for t in range(1, threshold + 1):
        size = f"cast(a.chars // {t + 1} AS INT)"
        middle = [f"contains(b.folded, substr(a.folded, {k} * {size} + 1, {size}))" for k in range(1, t)]
        shared = " OR ".join([f"left(a.folded, {size}) = left(b.folded, {size})", *middle, f"right(a.folded, a.chars - {t} * {size}) = right(b.folded, a.chars - {t} * {size})"])
        parts.append(f"(least({threshold}, least(a.chars, b.chars) // {EDIT_CHARS}) = {t} AND abs(a.chars - b.chars) <= {t} AND ({shared}) AND levenshtein(a.folded, b.folded) <= {t})")
    return f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, line, l, trim(regexp_replace(lower(l), '\\s+', ' ', 'g')) AS folded FROM raw),
ok AS (SELECT * FROM each WHERE length(folded) > 0),
c AS (SELECT folded, min(doc_id * {_LINES}::HUGEINT + line) AS place, count(*) AS places, length(folded) AS chars FROM ok GROUP BY folded),
part AS (SELECT * FROM c WHERE chars >= {EDIT_CHARS}),
near AS (SELECT b.folded FROM part a JOIN part b ON b.chars BETWEEN a.chars - {threshold} AND a.chars + {threshold} AND a.place < b.place
    AND ({" OR ".join(parts)}) GROUP BY b.folded),
lost AS (SELECT ok.doc_id, ok.line, (ok.doc_id * {_LINES}::HUGEINT + ok.line = c.place) AS first FROM ok JOIN c USING (folded) LEFT JOIN near USING (folded)
    WHERE near.folded IS NOT NULL OR ok.doc_id * {_LINES}::HUGEINT + ok.line > c.place),
kept AS (SELECT raw.doc_id, count(*) AS n_lines, count(lost.line) AS n_dropped, count(CASE WHEN lost.first THEN 1 END) AS n_near,
    coalesce(string_agg(CASE WHEN lost.line IS NULL THEN raw.l END, chr(10) ORDER BY raw.line), '') AS kept
    FROM raw LEFT JOIN lost ON raw.doc_id = lost.doc_id AND raw.line = lost.line GROUP BY raw.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_near, 0) AS n_near, sha256(coalesce(kept, '')) AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
