"""Language-model scoring with an Elias-Fano n-gram trie that is dealt out over shards.

Tokens are the words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased, then one end. The model is a hierarchical
Dirichlet model of ORDER words (MacKay and Peto 1995), with c for counts in the training documents:

    p(w) = (c(w) + 1) / (N + V + 1),    p(w | context) = (c(context w) + MASS * p(w | shorter context)) / (c(context) + MASS),

each log10 rounded to 1 / STEP, as is the back-off MASS / (c(context) + MASS) of n-grams that weren't seen. A text's score
is the sum over its tokens; the first tokens of a text have shorter contexts. Training documents are those
whose crc32(doc_id as text) mod 7 is not 2.

1. Blocks. One pass cuts whole texts into tokens over Arrow buffers. A block of documents keeps its distinct words (hashes
   of 64 and 32 bits) with their training counts, and for each token the number of its word: a table in the shared folder.
2. Levels. For n = 1 to ORDER each block asks for its distinct n-grams, with their training counts; a shard gets the
   n-grams of its contexts from all blocks. It adds the counts, makes its part of the trie's level, saves it, maps it into memory
   and answers the blocks from it. An n-gram is (node of its first n-1 words in the level above, place of its
   last word among the successors of the shorter context), and is found by successor search in the
   context's range (see `elias_fano`). So the answer to one level is the question to the next, and one pass over a block does both.
   N-grams with a part that was not seen need no question.
3. Scores. Of the longest n-grams shards add up the codes by document; a block adds these sums to its own. Of n-grams that a block has
   more than OFTEN times the shard answers the code.

No shard holds more than it can: their number follows from the n-grams there are, and the successors of a context
that occurs more than HOT_CONTEXT times are dealt over several shards, which is exact, since the formula needs
the context's count only. A block's repeated n-grams are one, so that a word or passage of a third of all rows is a row a block
(with OFTEN documents at most).
Nothing that grows with the corpus goes to the driver but a number or two a shard.

Defined cases: a null or empty text is one end; a null doc_id is neither held out nor trained on; rows that repeat a doc_id
are documents of their own; without training documents N and V are 0 and every token has probability 1; very long texts
are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import discard, mix, powers, save, small_batches, text_blocks
from furrow.llm.elias_fano import Level, mapped, pack, unpack

ORDER = 3
#: Pseudo-counts of the shorter context.
MASS = 2.0
#: Steps of a log10 probability.
STEP = 1024
#: Text of a block, or one longer document.
BLOCK_BYTES = 8 << 20
#: Questions (distinct n-grams of a block) that one shard is meant to get.
SHARD = 1 << 20
HOT_CONTEXT = 1 << 20
#: Blocks meet their answers in so many parts, and the shards of a level are asked in so many slices, one after the other: what is shuffled
#: at a time is a part of the whole.
PARTS, SLICES = 4, 4
#: Answers of one Arrow batch.
ANSWER_ROWS = 64
#: A longest n-gram that a block has more often keeps its occurrences there, so that no shard's load grows with what is frequent.
OFTEN = 8
#: Byte strings that don't repeat.
_FILES = {"compression": "zstd", "parquet.enable.dictionary": "false"}
_NODE = np.uint64(40)
_P, _END = np.uint64(0x9E3779B97F4A7C15), mix(np.array([0x0A], np.uint64))[0]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash of each token, number of tokens of each row); every row ends with the end token."""
    n = len(data)
    text, inside = _LOWER[data], ~_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    p, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(text.astype(np.uint64) * p[:n], out=sums[1:])
    first = mix((sums[end] - sums[start]) * inverse[start])
    # the second hash: of the first and the last eight bytes and the length, so that it is no function of the first
    raw = np.concatenate([np.zeros(8, np.uint8), text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    unused = (8 - np.minimum(end - start, 8)).astype(np.uint64) * np.uint64(8)
    second = mix(mix(eight[start + 8] << unused) ^ eight[end] >> unused ^ (end - start).astype(np.uint64) * _P) >> np.uint64(32)
    words = np.searchsorted(start, offsets)
    lengths = np.diff(words) + 1
    at = np.cumsum(lengths) - 1
    out, check = np.full(len(start) + len(lengths), _END), np.zeros(len(start) + len(lengths), np.uint64)
    own = np.ones(len(out), bool)
    own[at] = False
    out[own], check[own] = first, second
    return out, check, lengths


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, x in it); equal numbers stay as they stood."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64), x
    # the top bits and the place behind them as one number, which sorts several times as fast as places by x
    places = np.uint64((1 << n.bit_length()) - 1)
    x = x.astype(np.uint64, copy=False)
    order = x << np.uint64(min(63, 64 - int(x.max()).bit_length())) & ~places
    order |= np.arange(n, dtype=np.uint64)
    order.sort()
    order = (order & places).astype(np.int64)
    out = x[order]
    if (out[1:] < out[:-1]).any():  # numbers that differ in bits that had no room
        order = np.argsort(x, kind="stable")
        out = x[order]
    return order, out


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


def _inverse(order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The run of each number before it was put into this order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """One number for each pair, which sorts by a and then b; and by how many bits a is moved."""
    width = int(b.max(initial=0)).bit_length()
    if int(a.max(initial=0)).bit_length() + width > 64:
        b = np.unique(b, return_inverse=True)[1]
        width = int(b.max(initial=0)).bit_length()
    return a.astype(np.uint64) << np.uint64(width) | b.astype(np.uint64), np.uint64(width)


#: kind 0 is the block's documents and tokens, kind 1 its words, which only level 1 needs.
BLOCKS = "block bigint, kind int, doc_ids array<bigint>, held array<boolean>, trained array<boolean>, lengths array<int>, words binary, hash binary, check binary, counts binary, n_words bigint"


def blocks(docs: DataFrame) -> DataFrame:
    """Two rows per block of documents: ids and flags, lengths in tokens, and each token's word as its place among the block's distinct
    words; and of these, in the order of their hashes, the hashes and the training counts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for b in batches:
            for first, offsets, data in text_blocks(b.column("text"), BLOCK_BYTES):
                h, check, lengths = tokens(offsets, data)
                rows = slice(first, first + len(lengths))
                ids, trained = b.column("doc_id")[rows], np.asarray(b.column("trained")[rows].to_pylist(), bool)
                order, sorted_ = _sorted(h >> np.uint64(1))
                starts = _starts(sorted_)
                hashes, at, place = sorted_[starts], order[starts], _inverse(order, starts)
                if (check[at][place] != check).any():  # two words of one hash
                    both, at, place = np.unique(np.stack([h >> np.uint64(1), check]), axis=1, return_index=True, return_inverse=True)
                    hashes = both[0]
                counts = np.bincount(place, np.repeat(trained, lengths), len(hashes)).astype(np.uint64)
                yield _batch([(made, 0, ids.to_pylist(), b.column("held")[rows].to_pylist(), trained.tolist(), lengths, pack(place), None, None, None, len(hashes)), (made, 1, None, None, None, None, None, pack(hashes), pack(check[at]), pack(counts), None)], BLOCKS)
                made += 1

    small_batches(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), flag(fold == 2).alias("held"), flag(fold != 2).alias("trained"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, BLOCKS)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _types(schema: str) -> list[pa.DataType]:
    return [pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array") else _ARROW[kind] for kind in (f.split()[1] for f in schema.split(", "))]


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_names(schema))
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _types(schema), strict=True)], names=_names(schema))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


# --- questions of a block -----------------------------------------------------

#: Of the block's distinct n-grams that shard is asked about, from place `at`: contexts, how many n-grams each has here, its count;
#: of each n-gram the word, the code of the shorter one and the training count. The words' second hashes are level 1's codes. Of the
#: longest n-grams also how often each occurs (0: more than OFTEN times), and the document of each of these occurrences by its place in the block.
ASKS = "level int, shard int, block bigint, at int, contexts binary, sizes binary, totals binary, words binary, codes binary, counts binary, times binary, docs binary"
#: What the shard knows of them: node + 1 within the shard (0: not seen), place among the context's successors, code and count. Of the
#: longest n-grams the documents that hold any (as places), and as codes each one's sum over their occurrences; and as nodes and counts which
#: of the n-grams are more frequent, and their codes.
ANSWERS = "level int, shard int, block bigint, at int, nodes binary, places binary, codes binary, counts binary"
LEVELS = "level int, shard int, grams bigint, total bigint, trie binary"


def _part() -> Column:
    return F.pmod(F.hash("block"), F.lit(PARTS))


def code(p: np.ndarray) -> np.ndarray:
    """-log10 of a probability in steps of 1 / STEP."""
    return np.rint(-np.log10(p) * STEP).astype(np.int64)


def probability(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (-codes / STEP)


def backoff(total: np.ndarray) -> np.ndarray:
    return code(MASS / (total + MASS))


@dataclass
class Grams:
    """The distinct n-grams of a block: what is known of each, and each token's (-1: it has none of this length)."""

    of_token: np.ndarray
    node: np.ndarray  # + 1, 0: not seen
    place: np.ndarray
    code: np.ndarray
    count: np.ndarray


@dataclass
class Corpus:
    """Sums over the training tokens, and where the ids of each vocabulary shard begin."""

    tokens: int
    words: int
    begins: np.ndarray


def _first(block: dict, corpus: Corpus) -> Grams:
    n = block["n_words"]
    node, place, count = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for shard, at, _, places, _, counts in block["answers"]:
        place_here, count_here = unpack(places), unpack(counts)
        here = slice(at, at + len(place_here))
        seen = count_here > 0
        place[here] = place_here + np.uint64(corpus.begins[shard])
        node[here] = np.where(seen, place[here] + np.uint64(1), np.uint64(0))
        count[here] = count_here
    return Grams(unpack(block["words"]).astype(np.int64), node, place, code((count + 1) / max(1, corpus.tokens + corpus.words + 1)), count)


def _shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(x) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


@dataclass
class Longer:
    """A block's n-grams from its (n-1)-grams, as far as they follow from these: those to ask for, by shard and context."""

    tokens: np.ndarray  # of the asked n-grams, one behind the other
    starts: np.ndarray  # where each one's tokens begin
    context: np.ndarray
    word: np.ndarray  # both as places in the (n-1)-grams
    shard: np.ndarray
    rest: np.ndarray  # tokens whose n-gram has a part that was not seen, and their codes
    codes: np.ndarray


def _longer(g: Grams, lengths: np.ndarray, n: int, shards: int) -> Longer:
    at = np.flatnonzero(_nth(lengths) >= n - 1)
    context, word = g.of_token[at - 1], g.of_token[at]
    seen = g.node > 0
    both = seen[context] & seen[word]
    rest, c, w = at[~both], context[~both], word[~both]
    codes = g.code[w] + np.where(seen[c], backoff(g.count[c]), 0)
    at, context, word = at[both], context[both], word[both]
    shard, fan = _shard_of(g.node, shards), g.count // HOT_CONTEXT + 1
    rank = np.empty(len(shard), np.int64)
    rank[_sorted(shard)[0]] = np.arange(len(shard))
    # a context and a place among the successors of the shorter one are one n-gram
    order, pairs = _sorted(_pairs(rank[context], g.place[word])[0])
    hot = np.flatnonzero(fan > 1)
    if len(hot):
        to, hot = shard[context], np.flatnonzero(fan[context] > 1)
        part = mix(g.place[word[hot]]) % fan[context[hot]].astype(np.uint64)
        to[hot] = _shard_of(g.node[context[hot]] + part * _P, shards)
        again = np.argsort(to[order], kind="stable")
        order, pairs = order[again], pairs[again]
    starts = _starts(pairs)
    example = order[starts]
    return Longer(at[order], starts, context[example], word[example], to[example] if len(hot) else shard[context[example]], rest, codes)


def _learn(g: Grams, answers: list[tuple]) -> None:
    for shard, at, nodes, places, codes, counts in answers:
        node = unpack(nodes)
        here = slice(at, at + len(node))
        g.node[here] = np.where(node > 0, node + np.uint64(shard << int(_NODE)), np.uint64(0))
        g.place[here], g.code[here], g.count[here] = unpack(places), unpack(codes), unpack(counts)


# --- a block between two levels -----------------------------------------------

#: What a block knows when it asks a level: its documents with their sums over tokens that have their final code, each token's n-gram
#: (+ 1, 0: none), how many of these are asked for, and the codes of the rest. Of the longest n-grams, only those of tokens whose n-gram
#: is frequent, from 0, and as rest these tokens' documents.
STATES = "block bigint, doc_ids array<bigint>, held array<boolean>, trained array<boolean>, lengths array<int>, known array<bigint>, base array<double>, done array<bigint>, of_token binary, n_asked bigint, rest binary"
#: States (slice -1) and questions (the slice of their shard).
STEPS = f"slice int, {STATES}, {ASKS.replace('block bigint, ', '')}"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _grams(state: dict) -> Grams:
    rest = unpack(state["rest"]).astype(np.int64)
    n, asked = state["n_asked"] + len(rest), state["n_asked"]
    g = Grams(unpack(state["of_token"]).astype(np.int64) - 1, np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64))
    g.code[asked:] = rest
    _learn(g, state["answers"])
    return g


def _nth(lengths: np.ndarray) -> np.ndarray:
    """Each token's number in its document, from 0."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _sums(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.cumsum(lengths) - lengths)


def _cuts(shards: int) -> list[int]:
    """Where each slice's shards begin, and their number at the end."""
    return [shards * k // SLICES for k in range(SLICES + 1)]


def _next(joined: DataFrame, corpus: Corpus, n: int, order: int, shards: int) -> DataFrame:
    """Of blocks with their answers to level n - 1 the states and questions of level n."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _met(batches):
            lengths = np.array(block["lengths"])
            if n == 2:
                g = _first(block, corpus)
                known = _sums((g.count > 0)[g.of_token].astype(np.int64), lengths)
                base = _sums(np.log10((g.count + 1) / max(1, corpus.tokens + corpus.words + 1))[g.of_token], lengths)
                done = np.zeros(len(lengths), np.int64)
            else:
                g = _grams(block)
                known, base, done = (np.array(block[k]) for k in ("known", "base", "done"))
            # tokens that have no more tokens before them have their final code
            nth = np.cumsum(lengths) - lengths + n - 2
            has = np.flatnonzero(lengths > n - 2)
            done[has] += g.code[g.of_token[nth[has]]]
            state = (block["block"], block["doc_ids"], block["held"], block["trained"], lengths, known, base)
            if n > order:  # a model of single words asks nothing more
                done = _sums(g.code[g.of_token], lengths)
                yield _batch([(-1, *state, done, None, 0, None, *[None] * 11)], STEPS)
                continue
            asks = _longer(g, lengths, n, shards)
            doc, ends = np.repeat(np.arange(len(lengths)), lengths), np.append(asks.starts, len(asks.tokens))
            if n == order:
                done += np.rint(np.bincount(doc[asks.rest], asks.codes, len(lengths))).astype(np.int64)
                times = np.diff(ends)
                often = times > OFTEN
                own = (pack(np.repeat(np.flatnonzero(often), times[often])), len(times), pack(doc[asks.tokens[np.repeat(often, times)]]))
            else:
                of_token = np.zeros(len(g.of_token), np.int64)
                of_token[asks.tokens] = np.repeat(np.arange(1, len(ends)), np.diff(ends))
                of_token[asks.rest] = np.arange(len(ends), len(ends) + len(asks.rest))
                own = (pack(of_token), len(asks.starts), pack(asks.codes))
            yield _batch([(-1, *state, done, *own, *[None] * 11)], STEPS)
            if rows := list(_questions(g, asks, block, doc, ends, n, n == order, _cuts(shards))):
                yield _batch(rows, STEPS)

    return joined.mapInArrow(of, STEPS)


def _questions(g: Grams, asks: Longer, block: dict, doc: np.ndarray, ends: np.ndarray, n: int, last: bool, cuts: list[int]) -> Iterator[tuple]:
    trained = np.append(0, np.cumsum(np.array(block["trained"], bool)[doc[asks.tokens]]))
    counts = np.diff(trained[ends])
    begins = _starts(asks.shard).tolist()
    for a, z in zip(begins, [*begins[1:], len(asks.shard)]):
        shard = int(asks.shard[a])
        runs = a + _starts(asks.context[a:z])
        of_run, w = asks.context[runs], asks.word[a:z]
        mine = (None, None)
        if last:
            times = np.diff(ends[a : z + 1])
            few = times <= OFTEN
            mine = (pack(times * few), pack(doc[asks.tokens[ends[a] : ends[z]][np.repeat(few, times)]]))
        yield (bisect_right(cuts, shard) - 1, block["block"], *[None] * 10, n, shard, a, pack(g.node[of_run] - np.uint64(1)), pack(np.diff(np.append(runs, z))), pack(g.count[of_run]), pack(g.place[w]), pack(g.code[w]), pack(counts[a:z]), *mine)


def _scores(joined: DataFrame, corpus: Corpus) -> DataFrame:
    """Of blocks with their documents' sums over the longest n-grams the scores."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _met(batches):
            done, lengths = np.array(block["done"]), block["lengths"]
            if block["n_asked"]:
                codes = np.zeros(block["n_asked"], np.int64)
                for _, at, often, docs, sums, of_often in block["answers"]:
                    done[unpack(docs).astype(np.int64)] += unpack(sums).astype(np.int64)
                    codes[at + unpack(often).astype(np.int64)] = unpack(of_often)
                grams, docs = (unpack(block[k]).astype(np.int64) for k in ("of_token", "rest"))
                done += np.rint(np.bincount(docs, codes[grams], len(done))).astype(np.int64)
            columns = [block["doc_ids"], block["held"], lengths, block["known"], [corpus.tokens] * len(lengths), block["base"], -done / STEP]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _types(SCORES), strict=True)], names=_names(SCORES))

    return joined.mapInArrow(of, SCORES)


def _first_asks(table: DataFrame, shards: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, hashes, check, counts in _rows(batches):
            h, c, n = unpack(hashes), unpack(check), unpack(counts)
            to = _vocabulary_shard(h, shards)
            cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])).tolist()
            yield _batch([(1, int(to[a]), block, a, b"", b"", b"", pack(h[a:z]), pack(c[a:z]), pack(n[a:z]), None, None) for a, z in zip(cuts, [*cuts[1:], len(h)], strict=True)], ASKS)

    return table.select("block", "hash", "check", "counts").mapInArrow(of, ASKS)


def _vocabulary_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards of level 1 are ranges of the 63-bit hash."""
    return ((h >> np.uint64(31)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: c[i].as_py() for name, c in zip(b.schema.names, b.columns, strict=True)}


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks with their answers, from rows of which a block's own is followed by its answers."""
    block = None
    for row in _dicts(batches):
        if row["shard"] is not None:
            block["answers"].append(tuple(row[k] for k in _names(ANSWERS) if k not in ("level", "block")))
            continue
        if block:
            yield block
        block = row | {"answers": []}
    if block:
        yield block


# --- shards -------------------------------------------------------------------


def _vocabulary(asks: list[tuple]) -> tuple[bytes, int, int, Iterator[tuple]]:
    """Level 1 of a shard: (trie, words, tokens, answers)."""
    h, check, n = (np.concatenate([unpack(a[i]) for a in asks]) for i in (7, 8, 9))
    order = np.lexsort((check, h))
    h, check, n = h[order], check[order], n[order]
    at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])))
    h, check, n = h[at], check[at], np.add.reduceat(n, at)
    seen = n > 0
    h, check, n = h[seen], check[seen], n[seen].astype(np.int64)
    none = np.zeros(len(h), np.uint16)  # probabilities of single words follow from their counts
    trie = Level.encode(np.zeros(len(h), np.uint64), h, none, none)
    level = Level(mapped(trie))

    def answers() -> Iterator[tuple]:
        for _, shard, block, first, _, _, _, words, checks, *_ in asks:
            words, checks = unpack(words), unpack(checks)
            at, _ = level.find(np.zeros(1, np.uint64), np.array([len(words)]), words)
            while (next_ := (at >= 0) & (check[np.minimum(at, len(check) - 1)] != checks) if len(check) else np.zeros(len(at), bool)).any():
                more = np.where(next_, at + 1, at)  # words of one hash stand side by side
                at = np.where(next_ & ((more >= len(h)) | (h[np.minimum(more, len(h) - 1)] != words)), -1, more)
            found = at >= 0
            yield 1, shard, block, first, b"", pack(np.where(found, at, 0)), b"", pack(np.where(found, n[np.maximum(at, 0)], 0) if len(n) else at * 0)

    return trie, len(h), int(n.sum()), answers()


def _level(asks: list[tuple], last: bool) -> tuple[bytes, int, int, Iterator[tuple]]:
    """A level of a shard: (trie, n-grams, their sum, answers). What several blocks ask is looked up once."""
    runs, sizes, totals = (np.concatenate([unpack(a[i]) for a in asks]) for i in (4, 5, 6))
    word, lower, n = (np.concatenate([unpack(a[i]) for a in asks]) for i in (7, 8, 9))
    # nodes by the shard and the place in it, in fewer bits
    order, _ = _sorted(_pairs(runs >> _NODE, runs & np.uint64((1 << int(_NODE)) - 1))[0])
    starts = _starts(runs[order])
    contexts, of_run = runs[order[starts]], _inverse(order, starts)
    total = np.zeros(len(contexts), np.int64)
    total[of_run] = totals
    pairs, width = _pairs(np.repeat(of_run, sizes.astype(np.int64)), word)
    order, pairs = _sorted(pairs)
    starts = _starts(pairs)
    of_ask, example, of_context = _inverse(order, starts), order[starts], (pairs[starts] >> width).astype(np.int64)
    word, lower, n = word[example], lower[example].astype(np.int64), np.add.reduceat(n[order], starts).astype(np.int64)
    seen = n > 0
    codes = code((n[seen] + MASS * probability(np.arange(lower.max() + 1))[lower[seen]]) / (total[of_context[seen]] + MASS))
    trie = Level.encode(contexts[of_context[seen]], word[seen], codes, backoff(n[seen])[: 0 if last else None])
    n = n[seen]
    level = Level(mapped(trie))
    at, place = level.find(contexts, np.bincount(of_context, minlength=len(contexts)), word)
    found, at = at >= 0, np.maximum(at, 0)
    value = np.where(found, level.code[at] if len(n) else 0, lower + backoff(total)[of_context])
    shard = asks[0][1]
    # a context that is dealt over shards has places in each of them
    place = np.where(found, np.where(total[of_context] >= HOT_CONTEXT, place << 24 | shard, place), 0)
    node = np.where(found, at + 1, 0)
    count = np.where(found, n[at] if len(n) else 0, 0)

    def answers() -> Iterator[tuple]:
        start = 0
        for number, shard, block, first, _, _, _, words, _, _, times, docs in asks:
            end = start + (len(words) - 1) // words[0]
            own = of_ask[start:end]
            start = end
            if last:
                times = unpack(times).astype(np.int64)
                sums = np.rint(np.bincount(unpack(docs).astype(np.int64), np.repeat(value[own], times))).astype(np.int64)
                holds, often = np.flatnonzero(sums), np.flatnonzero(times == 0)
                yield number, shard, block, first, pack(often), pack(holds), pack(sums[holds]), pack(value[own[often]])
            else:
                yield number, shard, block, first, *(pack(x[own]) for x in (node, place, value, count))

    return trie, int(seen.sum()), int(n.sum()), answers()


def _answers(asks: DataFrame, begin: int, shards: int, last: bool) -> DataFrame:
    """What so many shards from begin make of all questions, saved: levels are kind 0, answers kind 1. A task gets the questions of one shard."""
    schema = f"level int, shard int, block bigint, at int, nodes binary, places binary, codes binary, counts binary, {LEVELS[22:]}"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                number, shard = held[0][:2]
                trie, grams, total, answers = _vocabulary(held) if number == 1 else _level(held, last)
                yield _batch([(number, shard, None, None, None, None, None, None, grams, total, trie)], schema)
                while rows := [(*a, None, None, None) for a in islice(answers, ANSWER_ROWS)]:
                    yield _batch(rows, schema)
                held.clear()

        for row in _rows(batches):
            if held and held[0][1] != row[1]:
                yield from out()
            held.append(row)
        yield from out()

    dealt = asks.repartitionById(shards, F.col("shard") - begin)
    made = dealt.mapInArrow(of, schema).withColumns({"kind": F.when(F.col("trie").isNull(), 1).otherwise(0), "part": F.when(F.col("trie").isNull(), _part()).otherwise(0)})
    return save(made, "level", by=["kind", "part"], **_FILES)


# --- the whole ----------------------------------------------------------------


def _join(table: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Each block and behind it its answers to a level. They are as many as the block has n-grams, and no more."""
    if not answers:
        return table.withColumn("shard", F.lit(None).cast("int"))
    every = reduce(DataFrame.union, answers).drop("level")
    return table.unionByName(every, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("shard"))


def score(docs: DataFrame, order: int = ORDER, shard: int = SHARD, keep: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """(scores of all rows, the trie's levels by shard): the model of the training documents, applied to all. Without keep the
    levels are deleted when they have answered, and the list is empty."""
    both = save(blocks(docs).withColumn("part", _part()), "blocks", by=["kind", "part"], **_FILES)
    table = both.where("kind = 0").drop("kind")
    of = lambda n: max(1, -(-int(n or 0) // shard))
    n_words, questions = table.agg(F.sum("n_words"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n))).first()
    shards = of(n_words)
    made = [_answers(_first_asks(both.where("kind = 1"), shards), 0, shards, False)]
    discard(both, part="kind=1")
    sizes = {r.shard: (r.grams, r.total) for r in made[0].where("kind = 0").select("shard", "grams", "total").collect()}  # two numbers a shard
    words = np.array([sizes.get(s, (0, 0))[0] for s in range(shards)], np.int64)
    corpus = Corpus(sum(t for _, t in sizes.values()), int(words.sum()), np.append(0, np.cumsum(words))[:-1])
    columns = ["block", "doc_ids", "held", "trained", "lengths", "words", "n_words"]
    states = [(table.where(f"part = {p}").select(columns), both, f"kind=0/part={p}") for p in range(PARTS)]
    answers = lambda p: [m.where(f"kind = 1 AND part = {p}").select(*_names(ANSWERS)) for m in made]
    levels = []

    def kept() -> None:
        if keep:
            levels.append(reduce(DataFrame.union, (m.where("kind = 0").select(*_names(LEVELS)) for m in made)))

    kept()
    shards = of(questions)
    for n in range(2, max(order, 2) + 1):
        asked = []
        for p, (state, saved, at) in enumerate(states):
            asked.append(save(_next(_join(state, answers(p)), corpus, n, order, shards), "step", by="slice", **_FILES))
            discard(saved, part=at)
            discard(*made, part=f"kind=1/part={p}")
        if not keep:
            discard(*made)
        states, made = [(t.where("slice = -1").select(*_names(STATES)), t, "") for t in asked], []
        for k, (a, z) in enumerate(zip(_cuts(shards), _cuts(shards)[1:])) if n <= order else ():
            if a < z:
                made.append(_answers(reduce(DataFrame.union, (t.where(f"slice = {k}").select(*_names(ASKS)) for t in asked)), a, z - a, n == order))
                discard(*asked, part=f"slice={k}")
                if not keep:
                    discard(made[-1], part="kind=0")
        if made:
            kept()
    done = [save(_scores(_join(state, answers(p)), corpus), "scores", **_FILES) for p, (state, *_) in enumerate(states)]
    discard(*(t for _, t, _ in states))
    if keep:
        for p in range(PARTS):
            discard(*made, part=f"kind=1/part={p}")
    else:
        discard(*made)
    return reduce(DataFrame.union, done), levels


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score(docs, keep=False)[0]
