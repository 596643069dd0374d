"""Language-model scoring against a model in plain dictionaries, and the Elias-Fano sequences against sorted arrays."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import elias_fano, lm_scoring

DOCS = "doc_id bigint, text string, score double, n_tokens string, block int"


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows, order):
    """(held out, tokens, known, N, base score, score) of each row."""
    fold = [None if i is None else zlib.crc32(str(i).encode()) % 7 for i, _ in rows]
    count = [Counter() for _ in range(order + 1)]
    for (_, text), f in zip(rows, fold, strict=True):
        if f is not None and f != 2:
            w = split(text)
            for n in range(1, order + 1):
                count[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total, distinct = sum(count[1].values()), len(count[1])
    steps = lambda p: round(-log10(p) * lm_scoring.STEP)

    def code(gram):
        if len(gram) == 1:
            return steps((count[1][gram] + 1) / max(1, total + distinct + 1))
        lower, n, of_context = code(gram[1:]), count[len(gram)][gram], count[len(gram) - 1][gram[:-1]]
        if n:
            return steps((n + lm_scoring.MASS * 10 ** (-lower / lm_scoring.STEP)) / (of_context + lm_scoring.MASS))
        return lower + steps(lm_scoring.MASS / (of_context + lm_scoring.MASS))

    out = []
    for (_, text), f in zip(rows, fold, strict=True):
        w = split(text)
        base = sum(log10((count[1][(t,)] + 1) / max(1, total + distinct + 1)) for t in w)
        codes = sum(code(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))
        out.append((f == 2, len(w), sum(count[1][(t,)] > 0 for t in w), total, base, -codes / lm_scoring.STEP))
    return out


def check(spark, rows, order=3, shard=None):
    df = spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in rows], DOCS).repartition(3)
    got = lm_scoring.score(df, order, shard or lm_scoring.SHARD)[0].collect()
    key = lambda r: (r[0] is None, r[0] or 0, *(round(x, 6) if isinstance(x, float) else x for x in r[1:]))
    want = sorted(((i, *b) for (i, _), b in zip(rows, brute(rows, order), strict=True)), key=key)
    assert len(got) == len(want)
    for a, b in zip(sorted((tuple(r) for r in got), key=key), want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=2.5 / lm_scoring.STEP), (a, b)


def prose(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "a", "mill", "river", "Stone", "ÄÖÜ", "rain,", "averyveryverylongwordindeed", "averyveryverylongwordindeee", "x"]
    p = np.array([8, 6, 5, 3, 3, 2, 2, 1, 1, 1, 1], float)
    return [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=p / p.sum()))) for i in range(n)]


def test_scores_match_plain_model(spark):
    check(spark, prose(60))


def test_query_scores_with_three_words(spark):
    """The query's model has word triples, whatever the number of parts its blocks meet their answers in."""
    rows = prose(60, 4)
    got = {r.doc_id: r.score for r in lm_scoring.report(spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in rows], DOCS).repartition(5)).collect()}
    pairs, triples = ([b[-1] for b in brute(rows, order)] for order in (2, 3))
    assert len(got) == 60 and all(got[i] == pytest.approx(t, abs=2.5 / lm_scoring.STEP) for (i, _), t in zip(rows, triples, strict=True))
    assert sum(abs(got[i] - p) > 1 for (i, _), p in zip(rows, pairs, strict=True)) > 30


def test_many_shards_and_split_contexts(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT_CONTEXT", 50)
    check(spark, prose(80, 1), shard=7)
    check(spark, prose(40, 2), order=4, shard=11)


def test_a_task_gets_one_shard(spark):
    """Shards are dealt by number: by a hash of it several fell into one task, and the longest task grew with the input."""
    df = spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in prose(80, 5)], DOCS).repartition(3)
    for level in lm_scoring.score(df, shard=60)[1][1:]:
        made = level.select("shard", F.input_file_name().alias("file")).collect()
        assert len(made) > 5 and len({r.file for r in made}) == len({r.shard for r in made}) == len(made)


def test_blocks_make_their_questions_once():
    """One pass asks all slices, and a block goes on without its n-grams: the shards add up the longest ones by document."""
    lengths, n_words, seen = np.array([4, 1, 6]), 4, 2
    node = np.arange(1, n_words + 1, dtype=np.uint64)
    node[seen:] = 0
    g = lm_scoring.Grams(np.array([0, 1, 0, 1, 3, 0, 1, 0, 2, 0, 1]), node, np.arange(n_words, dtype=np.uint64), np.full(n_words, 7), np.array([5, 5, 0, 0]))
    asks = lm_scoring._longer(g, lengths, 2, 5)
    grams = [(int(c), int(w)) for c, w in zip(asks.context, asks.word, strict=True)]
    assert sorted(grams) == [(0, 1), (1, 0)] and sorted(asks.rest.tolist()) == [8, 9]
    assert sorted(asks.tokens.tolist()) == [1, 2, 3, 6, 7, 10] and (np.diff(asks.shard) >= 0).all()
    block = {"block": 1, "trained": [True, True, False]}
    doc, ends, cuts = np.repeat(np.arange(3), lengths), np.append(asks.starts, 6), lm_scoring._cuts(5)
    rows = list(lm_scoring._questions(g, asks, block, doc, ends, 2, True, cuts))
    asked = [dict(zip(lm_scoring._names(lm_scoring.STEPS), r, strict=True)) for r in rows]
    assert all(cuts[r["slice"]] <= r["shard"] < cuts[r["slice"] + 1] for r in asked)
    assert sum(int(elias_fano.unpack(r["counts"]).sum()) for r in asked) == 3  # tokens 1 to 3 of the first document
    answers = [a for shard in {r["shard"] for r in asked} for a in lm_scoring._level([tuple(r[k] for k in lm_scoring._names(lm_scoring.ASKS)) for r in asked if r["shard"] == shard], True)[3]]
    assert all(len(elias_fano.unpack(places)) <= 2 and not len(elias_fano.unpack(nodes)) for *_, nodes, places, _, _ in answers)


def test_frequent_longest_grams_stay_in_their_block(spark):
    """What a block has very often is one question, whatever the number of its documents."""
    lengths = np.full(50, 20)
    g = lm_scoring.Grams(np.tile(np.arange(2), 500), np.array([1, 2], np.uint64), np.array([0, 1], np.uint64), np.full(2, 7), np.full(2, 500))
    asks = lm_scoring._longer(g, lengths, 2, 1)
    rows = list(lm_scoring._questions(g, asks, {"block": 1, "trained": [True] * 50}, np.repeat(np.arange(50), lengths), np.append(asks.starts, len(asks.tokens)), 2, True, [0, 1]))
    assert len(asks.tokens) == 950 and [len(elias_fano.unpack(r[-1])) for r in rows] == [0]
    check(spark, [(i, "a b c " * (i % 9) + "d " + "e f g " * (i % 2)) for i in range(60)])


def test_model_of_single_words(spark):
    check(spark, prose(20, 6), order=1)


def test_sorted():
    rng = np.random.default_rng(7)
    for top in (1, 2, 1000, 2**40, 2**64 - 1):
        for n in (0, 1, 2, 1000):
            x = rng.integers(0, top, n, np.uint64)
            x[: n // 3] = x[n // 3 : 2 * (n // 3)] ^ np.uint64(1)  # numbers that differ in their last bit only
            order, y = lm_scoring._sorted(x)
            assert order.tolist() == np.argsort(x, kind="stable").tolist() and (y == x[order]).all()
            assert lm_scoring._inverse(order, lm_scoring._starts(y)).tolist() == (np.unique(x, return_inverse=True)[1].tolist() if n else [])


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "x " * 3000), (6, "dup here"), (6, "dup here"), (6, "other"), (None, "dup here"), (None, None), (9, "\x00 \x1c nul \x0b vt 梦 \U0001f600"), (16, "w" * 5000)])
    check(spark, [(None, "a b")])
    assert lm_scoring.score(spark.createDataFrame([], DOCS))[0].collect() == []


def test_two_words_of_one_hash(spark, monkeypatch):
    """With hashes of a few bits, words are told apart by their second hash."""
    real = lm_scoring.tokens

    def few(offsets, data):
        h, check, lengths = real(offsets, data)
        return h & np.uint64(0x8000000000000001 | 6), check, lengths

    monkeypatch.setattr(lm_scoring, "tokens", few)
    rows = prose(30, 3)
    blocks = lm_scoring.blocks(spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in rows], DOCS).coalesce(1))
    asks = [tuple(r) for r in lm_scoring._first_asks(blocks.where("kind = 1"), 1).collect()]
    counts = Counter(w for (i, t) in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in split(t))
    trie, words, tokens, answers = lm_scoring._vocabulary(asks)
    assert (words, tokens) == (len(counts), sum(counts.values()))
    got = [elias_fano.unpack(a[7]) for a in answers]
    assert sorted(np.concatenate(got).tolist()) == sorted(counts.values())


def test_probabilities_sum_to_one():
    counts = np.array([5, 3, 1, 0, 0])
    lower = np.array([0.4, 0.3, 0.1, 0.15, 0.05])
    total = counts.sum()
    assert ((counts + lm_scoring.MASS * lower) / (total + lm_scoring.MASS)).sum() == pytest.approx(1)
    assert 10 ** (-lm_scoring.backoff(np.array([total]))[0] / lm_scoring.STEP) == pytest.approx(lm_scoring.MASS / (total + lm_scoring.MASS), rel=2e-3)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for top in (1, 3, 100, 10**6, 2**40, 2**62):
        for n in (0, 1, 2, 63, 64, 1000):
            x = np.sort(rng.integers(0, top, n).astype(np.uint64))
            e = elias_fano.EliasFano(elias_fano.mapped(elias_fano.EliasFano.encode(x)))
            assert e.get(np.arange(n)).tolist() == x.tolist()
            ask = np.concatenate([x, x + np.uint64(1), rng.integers(0, 2 * top, 50).astype(np.uint64)])
            assert e.successor(ask).tolist() == np.searchsorted(x, ask).tolist()
    x = np.sort(rng.integers(0, 2**40, 10_000).astype(np.uint64))
    assert len(elias_fano.EliasFano.encode(x)) < 10_000 * (2 + np.log2(2**40 / 10_000)) / 8 + 200


def test_level():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 40, (500, 2)), axis=0).astype(np.uint64)
    context, word = pairs[:, 0] * np.uint64(2**35), pairs[:, 1]
    code = np.arange(len(pairs))
    level = elias_fano.Level(elias_fano.mapped(elias_fano.Level.encode(context, word, code, code + 1)))
    known = {(int(c), int(w)): i for i, (c, w) in enumerate(zip(context, word, strict=True))}
    ask = [(c * 2**35 + d, w) for c in range(42) for d in (0, 1) for w in range(45)]
    ask_context, ask_word = np.array(ask, np.uint64).T
    at, place = level.find(ask_context, np.ones(len(ask), np.int64), ask_word)
    runs = level.find(np.unique(ask_context), np.full(84, 45), ask_word)
    assert all((a == b).all() for a, b in zip(runs, (at, place), strict=True))
    assert at.tolist() == [known.get(k, -1) for k in ask]
    first = {}
    for (c, _), i in known.items():
        first[c] = min(first.get(c, i), i)
    assert all(p == (i - first[k[0]] if i >= 0 else -1) for k, i, p in zip(ask, at.tolist(), place.tolist(), strict=True))
    assert level.code[at[at >= 0]].tolist() == at[at >= 0].tolist()


def test_pack():
    for top in (1, 255, 256, 2**33, 2**63):
        x = np.random.default_rng(2).integers(0, top, 100).astype(np.uint64)
        assert elias_fano.unpack(elias_fano.pack(x)).tolist() == x.tolist()
    assert not len(elias_fano.unpack(elias_fano.pack(np.zeros(0))))
