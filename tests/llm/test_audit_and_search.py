"""The filter audit and the lexical search against plain loops."""

import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from furrow.llm import filter_audit, lexical_search

# columns whose names clash with those of results
DOCS = "doc_id bigint, text string, lang string, part int, mask int, fp string, score double, rank int"
LABELS = "doc_id bigint, quality int, toxic int, flags string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 0.5, 3) for r in rows], DOCS)


ODD = [
    (1, None, "en"), (2, "", None), (3, "", ""), (4, " \t\n\x0b\x0c\r", "en"), (5, "a " * 300, "en"), (6, " ".join(f"w{i}" for i in range(250)), "de"),
    (7, "HELLO World", "de"), (8, "price $5", "de"), (9, "ÄÖÜ é 梦 \U0001f600 A", None), (10, "same text", "en"), (10, "same text", "en"), (11, "same text", "de"),
    (None, "same text", "de"), (None, "other", "de"), (None, "other", "de"), (12, "x" * 100_000, "fr"), (13, "a\x1cb\x85c d", "fr"), (14, "x" * 100_000, "fr"),
]


def brute_audit(rows, labels):
    fails = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in rows)
        fails.append(f)
    flag = lambda i, k: any(x[0] == i and x[k] == 1 for x in labels if x[0] is not None)
    out = {}
    for part in {lang or "" for *_, lang in rows}:
        mine = [(f, flag(r[0], 1), flag(r[0], 2)) for f, r in zip(fails, rows, strict=True) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                here = [m for m in left if m[0][x]]
                stay = [m for m in left if not m[0][x]]
                shapley[x] += len(here)
                alone = sum(m[0][x] and sum(m[0].values()) == 1 for m in mine)
                out[part, "".join(order), step] = [len(stay), len(here), sum(m[0][x] for m in mine) - len(here), alone, sum(m[1] for m in here), sum(m[2] for m in here)]
                left = stay
        for (p, o, step), v in out.items():
            if p == part:
                v.append(shapley[o[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_odd_rows(spark):
    labels = [(1, 1, 0), (5, 0, 1), (5, 1, None), (10, 1, 1), (None, 1, 1), (99, 1, 1)]
    got = filter_audit.audit(docs(spark, ODD), spark.createDataFrame([(*x, "y") for x in labels], LABELS)).collect()
    want = brute_audit(ODD, labels)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want and len(got) == len(want) == 600 * 4
    assert filter_audit.audit(docs(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_audit_hot_text(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 40}", "en") for i in range(300)]
    got = filter_audit.audit(docs(spark, rows).repartition(5), spark.createDataFrame([], LABELS)).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute_audit(rows, [])


@pytest.mark.parametrize("chain_bytes", [1, 10**6])
def test_chains_tell_colliding_texts_apart(spark, chain_bytes):
    """All texts have one fingerprint, and chains are given up early."""
    rng = np.random.default_rng(0)
    rows = [(7, 7, int(i), f"t{rng.integers(20)}") for i in rng.permutation(200)] + [(7, 7, None, "t1"), (7, 7, None, "lonely")]
    least = {}
    for _, _, i, t in rows:
        least[t] = min(least.get(t, math.inf), math.inf if i is None else i)
    want = {i for _, _, i, t in rows if (math.inf if i is None else i) != least[t]}
    got = filter_audit.non_minimum(spark.sparkContext.parallelize(rows, 6), 3, chain_bytes).collect()
    assert {x[0] for x in got} == want and len(got) == len(want)


def test_filters_apply(spark):
    kept = {r.doc_id for r in filter_audit.apply_filters(docs(spark, ODD), "BCD").collect()}
    assert 8 not in kept and 7 not in kept and 5 not in kept and {1, 2, 6, 10} <= kept


# --- ranked lexical search


def brute_search(rows, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    d = [(i, Counter(split(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in d), sum(sum(c.values()) for _, c in d)
    df = Counter(t for _, c in d for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in d:
            n, score = sum(c.values()), 0
            for t in split(text):
                if c[t]:
                    m = 25 + (75 * n * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i, score))
        out += [(item, r, x[3], x[4]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, items, **options):
    d = spark.createDataFrame([(i, t, 0.1, 7) for i, t in rows], "doc_id bigint, text string, score double, rank int").repartition(4)
    b = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id bigint, text string, doc_id int")
    return sorted(map(tuple, lexical_search.search(d, b, **options).collect()), key=repr)


def prose(n, size, seed):
    rng = np.random.default_rng(seed)
    words = ["river", "Mill", "stone", "ÄÖÜ", "averyveryverylongwordindeed", "averyverywordthatislongindeed", "x1", "42", "of", "the", "grain"]
    p = 1 / np.arange(1, len(words) + 1)
    return [(i, " ".join(rng.choice(words, rng.integers(0, size), p=p / p.sum()))) for i in range(n)]


def test_search_brute_force(spark):
    rows, items = prose(200, 40, 0), prose(12, 9, 1)
    assert found(spark, rows, items) == brute_search(rows, items)
    assert found(spark, rows, items, k=3) == brute_search(rows, items, 3)


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "DOC_BYTES", 300)
    rows, items = prose(120, 30, 2), prose(9, 9, 3)
    assert found(spark, rows, items, block_bytes=40) == brute_search(rows, items)


def test_search_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "!?"), (4, "Mill"), (4, "mill"), (None, "mill"), (None, "mill stone"), (5, "mill " * 5000), (6, "no"), (7, "stone\x00stone")]
    items = [(1, "mill MILL stone"), (2, None), (3, ""), (4, "unknown"), (1, "stone"), (None, "no")]
    assert found(spark, rows, items) == brute_search(rows, items)
    assert found(spark, [], items) == found(spark, rows, []) == found(spark, [(1, None)], items) == []


def test_search_words_that_share_a_hash_bit(spark):
    """Only whole words count: beginnings, ends and longer words with both are no terms."""
    rows = [(1, "averyveryXverylongwordindeed"), (2, "averyveryverylongwordindeed"), (3, "averyver ngwordindeed"), (4, "filler")]
    assert [r[2] for r in found(spark, rows, [(1, "averyveryverylongwordindeed")])] == [2]


def test_impacts_beyond_64_bits():
    n = np.array([10**9, 5])
    got = lexical_search.impacts(np.array([3, 1]), n, np.array([7, 7]), 10**10, 10**13)
    assert got.tolist() == [7 * ((3 * 10**9) // (3000 + 8 * (25 + 75 * 10**9 * 10**10 // 10**13))), 7 * (10**9 // (1000 + 8 * 25))]


def test_best_keeps_ties_in_order():
    scores = np.array([5, 9, 5, 0, 5, 9])
    ids, null = np.array([4, 8, 2, 1, 0, 3]), np.array([False, False, False, False, True, False])
    assert [(int(scores[i]), int(ids[i])) for i in lexical_search.best(scores, ids, null, 4)] == [(9, 3), (9, 8), (5, 2), (5, 4)]
    assert defaultdict(int, Counter(scores[lexical_search.best(scores, ids, null, 10)].tolist())) == {9: 2, 5: 3}
