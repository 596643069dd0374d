import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import compare

from furrow.llm import decontaminate, exact_dedup, langid, license_scan, line_dedup, near_dedup, quality, queries, sentencepiece_codec, url_filter, warc
from furrow.llm.common import word_list

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id bigint, score double"


def docs(spark, texts, langs=None, sources=None, ids=None):
    """Documents with columns whose names clash with those of results."""
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", 0, 7, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "   \n\t", "one", "a b c d e f", "x" * 5000, "word " * 3000, "dup text here now yes", "dup text here now yes", "ÄÖÜ éè 梦 \U0001f600 ▁", "\x00 nul \x0b vt \x0c ff \r cr", None]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    compare(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])


# --- exact dedup


def test_exact_dedup_odd_rows(spark):
    rows = {r.doc_id: r for r in exact_dedup.report(docs(spark, ODD)).collect()}
    strip = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in enumerate(ODD):
        groups.setdefault(strip(t), []).append((-len(t or ""), i))
    for norm, members in groups.items():
        for _, i in members:
            assert rows[i].keep_id == min(members)[1] and rows[i].group_size == len(members) and rows[i].kept == (i == min(members)[1])
            assert rows[i].text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_dedup_repeated_and_null_ids(spark):
    r = exact_dedup.report(docs(spark, ["a b", "ab", "ab", "z"], ids=[5, None, 3, None])).collect()
    assert {x.doc_id: x.keep_id for x in r if x.group_size == 3} == {5: 5, None: 5, 3: 5} and len(r) == 4
    assert exact_dedup.report(docs(spark, [])).count() == 0


def test_filters_merge_losslessly(spark):
    rng = np.random.default_rng(0)
    fps = rng.integers(-(2**63), 2**63 - 1, 2000)
    fps = np.concatenate([fps, fps[:300], fps[:50], np.full(500, fps[0])])
    d = spark.createDataFrame([(int(x),) for x in fps], "fp bigint").repartition(7)
    for slices in (1, 8):
        filters = exact_dedup.build_filters(d, slices)
        assert all(len(r.remainders) == -(-(64 - (slices - 1).bit_length() - r.q) // 8) * r.n < 8 * r.n for r in filters.collect() if r.q > 8)
        got = {r.fp: r.n for r in exact_dedup.merged_filter(filters, slices).collect()}
        assert got == Counter(fps.tolist())


def test_filter_round_trip():
    rng = np.random.default_rng(1)
    for bits in (61, 64):
        for n in (1, 2, 300):
            low = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) >> np.uint64(64 - bits))
            counts = rng.integers(1, 4, len(low))
            for q in (None, 0, 3, 12):
                got = exact_dedup.decode(bits, *exact_dedup.encode(low, counts, bits, q))
                assert got[0].tolist() == low.tolist() and got[1].tolist() == counts.tolist()


def test_exact_dedup_ties_keep_one(spark):
    r = exact_dedup.report(docs(spark, ["a b"] * 3 + ["q"] * 2 + ["z"], ids=[5, 5, 5, None, None, 6])).collect()
    assert sorted((x.doc_id or 0, x.group_size, x.kept) for x in r) == [(0, 2, False), (0, 2, True), (5, 3, False), (5, 3, False), (5, 3, True), (6, 1, True)]


# --- decontamination and license scan


def test_decontamination_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "A-B"]
    items = {i: " ".join(rng.choices(vocabulary, k=k)) for i, k in enumerate((25, 12, 10, 4, 1, 0))} | {90: None, 91: "w1 w2 w3"}
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(30)] + [f"pre {items[0]} post {items[1]}", items[2].upper(), items[3], *ODD]
    b = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    want = decontaminate.brute(dict(enumerate(texts)), items)
    for block in (decontaminate.BLOCK_BYTES, 60):
        s = decontaminate.scan(docs(spark, texts).select("doc_id", "text").withColumn("scan", F.lit("clash")), b, block_bytes=block)
        assert s.columns == ["doc_id", "text", "scan"]
        got = {r.doc_id: (r.scan.n_words, sum(x.end - x.start for x in r.scan.spans), len(r.scan["items"])) for r in s.collect()}
        assert got == {k: v[:3] for k, v in want.items()}
    assert {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs(spark, texts), b).collect()} == want
    assert decontaminate.report(docs(spark, texts), b.limit(0)).where("contaminated").count() == 0


def test_decontamination_odd_items(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    items = [(1, passage), (1, passage), (None, "lone words"), (2, None), (3, "!!"), (4, passage)]
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    d = docs(spark, [passage, "x " + passage + " y " + passage, "lone words", None, "z " * 50_000 + passage], ids=[7, 7, None, None, 9])
    for block in (decontaminate.BLOCK_BYTES, 40):
        rows = decontaminate.scan(d.select("doc_id", "text"), b, block_bytes=block).collect()
        got = sorted((r.doc_id or 0, r.scan.n_words, [(x.start, x.end) for x in r.scan.spans], r.scan["items"]) for r in rows)
        assert got == [(0, 0, [], []), (0, 2, [(0, 2)], ["null"]), (7, 15, [(0, 15)], ["1", "4"]), (7, 32, [(1, 16), (17, 32)], ["1", "4"]), (9, 50_015, [(50_000, 50_015)], ["1", "4"])]
    assert decontaminate.report(d.limit(0), b).count() == 0


def test_decontamination_cuts_or_drops(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    b = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    d = docs(spark, [f"keep this {passage.upper()}, and that", "clean"])
    assert [r.text for r in decontaminate.cut_spans(d, b).orderBy("doc_id").collect()] == ["keep this , and that", "clean"]
    kept = decontaminate.drop_contaminated(d, b)
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == d.columns


def test_license_scan(spark):
    texts = ["Released under the MIT license. MIT, License!", "GNU General Public License, version 3", "SPDX-License-Identifier: Apache-2.0 / apache license version 2.0", "smit license", "licensed under CC BY-NC 4.0", *ODD]
    rows = {r.doc_id: r for r in license_scan.report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert (rows[i].n_words, rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].base_labels) == license_scan.brute(t)
        assert 0 <= rows[i].score <= 1 and set(filter(None, rows[i].base_labels.split(","))) <= set(rows[i].labels.split(","))
    assert rows[0].labels == "mit" and rows[1].labels == "gpl,gpl-3.0" and rows[4].labels == "cc-by-nc-4.0"
    assert "apache-2.0" in rows[2].labels


def test_license_scan_odd_tables(spark):
    assert license_scan.report(docs(spark, [])).count() == 0
    texts = ["word " * 100_000 + "MIT license", "mit license mit license", "mit license mit license", None]
    r = license_scan.report(docs(spark, texts, ids=[3, 4, 4, None]).withColumn("scan", F.lit(1))).collect()
    assert sorted((x.doc_id or 0, x.n_words, x.n_base, x.first_word, x.last_word) for x in r) == [(0, 0, 0, None, None), (3, 100_002, 1, 100_000, 100_000), (4, 4, 2, 0, 2), (4, 4, 2, 0, 2)]


def test_license_gate_loses_nothing(spark, monkeypatch):
    """The gated scan against all rules on every text, over the tables and the licence pages."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["https://opensource.org/license/mit", "see https://opensource.org/licenses/isc and spdx.org/licenses/0bsd", "Creative Commons Attribution 4.0, X11 license"]
    gated = license_scan._scan(pa.array(texts))
    everything = {k for r in license_scan.compiled()[0] for k in r[2]}
    for text, row in zip(texts, gated, strict=True):
        found = license_scan.detect(text or "", everything)
        assert [(x["label"], x["start"], x["end"]) for x in row["detections"]] == [(x[2], x[0], x[1]) for x in found]
        assert set(row["labels"]) == {x[2] for x in found} | set(row["base_labels"])
    assert gated[-3]["labels"] == ["mit"] and gated[-2]["labels"] == ["0bsd", "isc"]


def test_suppression():
    found = [(0, 10, "a", 1), (2, 8, "b", 5), (3, 6, "c", 4), (0, 20, "d", 1), (30, 40, "e", 2), (30, 40, "f", 1)]
    assert {x[2] for x in license_scan.suppress(found)} == {"b", "d", "e"}


def test_license_rules_are_many_and_gated():
    assert len(license_scan.compiled()[0]) > 300
    for i in range(len(license_scan.compiled()[0])):
        license_scan.pattern_of(i)


# --- language identification


def test_language_id(spark):
    texts = ["the house and the tree " * 3, "das haus und der baum " * 3, None, "123 !!", ""] * 6
    langs = ["en", "de", None, "en", "de"] * 6
    r = {x.doc_id: x for x in langid.report(docs(spark, texts, langs=langs)).collect()}
    for i, t in enumerate(texts):
        assert r[i].lang_pred == ("und" if not re.search("[a-z]", t or "") else langs[i])
        assert 0 <= r[i].score <= 1 and r[i].held_out == (__import__("zlib").crc32(str(i).encode()) % 4 == 2)
    assert {x.lang_pred for x in langid.report(docs(spark, texts, langs=[None] * 30)).collect()} == {"und"}


def plain_grams(text):
    """Buckets of the n-grams of one text, character by character."""
    folded = ""
    for c in text or "":
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalpha():
            folded += low
        elif not folded.endswith(" "):
            folded += " "
    out = []
    for i in range(len(folded)):
        h = 0
        for n in range(1, 4):
            if i + n > len(folded):
                break
            h = ((h ^ ord(folded[i + n - 1])) * 0x01000193 + n) & 0xFFFFFFFF
            g = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
            out.append(g >> 17)
    return out


@pytest.mark.parametrize("block", [None, 1, 2])
def test_language_id_brute_force(spark, block):
    texts = ["the house, and THE tree", "das Haus und der Baum", "la casa y el árbol", "le arbre; et la maison", "", None, "12 -- 3", "ǅungla İstanbul ß", "tree " * 4000, "der der the"] * 2
    langs = ["en", "de", "es", "fr", "en", "de", None, "hr", "en", None] * 2
    d = docs(spark, texts, langs=langs)
    counts, documents = {}, Counter()
    for t, lang in zip(texts, langs, strict=True):
        if lang:
            counts.setdefault(lang, Counter()).update(plain_grams(t))
            documents[lang] += 1
    table = {k: {b: np.log((n + 0.5) / (sum(c.values()) + 0.5 * langid.BUCKETS)) for b, n in c.items()} for k, c in counts.items()}
    rest = {k: np.log(0.5 / (sum(c.values()) + 0.5 * langid.BUCKETS)) for k, c in counts.items()}
    rows = langid.predict(d.select("doc_id", "text", F.lit(1).alias("language")), langid.train(d), block=block).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        if not any(c.isalpha() for c in t or ""):
            assert r.language == ("und", 0.0)
            continue
        total = {k: np.log(documents[k] / sum(documents.values())) + sum(table[k].get(b, rest[k]) for b in plain_grams(t)) for k in table}
        best = max(sorted(total), key=lambda k: total[k])
        assert r.language.lang_pred == best and r.language.score == pytest.approx(1 / sum(np.exp(v - total[best]) for v in total.values()), rel=1e-3)


def test_language_id_odd_tables(spark):
    assert langid.report(docs(spark, [])).count() == 0
    r = langid.report(docs(spark, ["the tree"] * 3 + ["der Baum"] * 2, langs=["en"] * 3 + ["de"] * 2, ids=[None, 4, 4, 5, None])).collect()
    assert len(r) == 5 and not any(x.held_out for x in r if x.doc_id is None)


def test_language_id_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.report(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


# --- near dedup


def brute_classes(texts, least=0.8):
    bags = []
    for t in texts:
        w = word_list(t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = sum((bags[i] | bags[j]).values())
            if union and sum((bags[i] & bags[j]).values()) / union >= least:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_dedup_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 3)
    rng = random.Random(5)
    base = [f"b{rng.randrange(400)}" for _ in range(120)]
    texts = list(ODD)
    for _ in range(60):  # one family with word changes, some beyond the limit, some cut short
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w[: rng.choice((120, 120, 110, 96))]))
    texts += [" ".join(["r s t u v"] * k) for k in (10, 11, 20, 22)] + [" ".join(f"o{i}_{k}" for k in range(40)) for i in range(8)]
    r = {x.doc_id: x for x in near_dedup.report(docs(spark, texts)).collect()}
    want = brute_classes(texts)
    assert [r[i].class_id for i in range(len(texts))] == want
    assert [r[i].kept for i in range(len(texts))] == [want[i] == i for i in range(len(texts))]
    assert near_dedup.report(docs(spark, [])).count() == 0
    kept = near_dedup.keep_one(docs(spark, texts))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want))


def test_near_dedup_of_a_whole_table(spark):
    """All pairs that share a shingle, by an inverted index, over every document of sf0.01."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bags, holders = {}, {}
    for r in d.select("doc_id", "text").collect():
        w = word_list(r.text)
        bags[r.doc_id] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        for g in bags[r.doc_id]:
            holders.setdefault(g, []).append(r.doc_id)
    label = {i: i for i in bags}
    links = 0
    for a, b in {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}:
        union = sum((bags[a] | bags[b]).values())
        if sum((bags[a] & bags[b]).values()) / union >= 0.8:
            links += 1
            x, y = sorted((label[a], label[b]))
            label = {i: x if k == y else k for i, k in label.items()} if x != y else label
    got = {r.doc_id: r.class_id for r in near_dedup.report(d).collect()}
    assert got == label and links > 50


def test_near_dedup_repeated_and_null_ids(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near, unique = base + " tail", " ".join(f"u{k}" for k in range(30))
    texts = [base, near, unique, unique.upper() + " more", base, None, None, "", "x y", "x y", "lonely words"]
    ids = [5, 5, None, None, 5, 7, 7, None, 8, 8, None]
    d = docs(spark, texts, ids=ids)
    kept = near_dedup.keep_one(d)
    rows = kept.collect()
    assert kept.columns == d.columns and len(rows) == 7
    assert sum((r.text or "").startswith("w0") for r in rows) == 1 and sum((r.text or "").lower().startswith("u0") for r in rows) == 1
    assert [r.text for r in rows if r.doc_id == 8] == ["x y"] and [r.text for r in rows if r.doc_id == 7] == [None, None]
    assert {r.text for r in rows if r.doc_id is None} >= {"", "lonely words"}
    report = near_dedup.report(d).collect()
    assert len(report) == len(texts) and {r.class_size for r in report if r.doc_id == 5} == {3}


def test_contents_of_one_half_digest(spark):
    s = spark.createDataFrame([(1, 9, 4, 1, 3), (2, 9, 5, 2, 3), (3, 9, 5, 3, 3), (4, 8, 1, 4, 3)], "doc_id bigint, d1 bigint, d2 bigint, text_hash bigint, n bigint")
    c = near_dedup._contents(s).collect()
    assert len({r.cid for r in c}) == 3 and {(r.d1, r.d2): (r.doc_id, r.copies) for r in c} == {(9, 4): (1, 1), (9, 5): (2, 2), (8, 1): (4, 1)}


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    n = 300
    shingle = rng.integers(0, 2**63, n).astype(np.uint64)
    a, b = rng.integers(1, 9, n), rng.integers(1, 9, n)
    a[:40], b[40:90] = 0, 0
    row, g, c = np.repeat([0, 1], n), np.tile(shingle, 2), np.concatenate([a, b])
    use = c > 0
    sig = near_dedup.bag_minhash(2, row[use], g[use], c[use], m=4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 4096)


def test_overlap_and_differences():
    a, b = pa.array(["a b c d e f g", "x y", ""]), pa.array(["a b c d e f h", "x y", ""])
    assert near_dedup.overlap(a, b).tolist() == [0.5, 1.0, 0.0]
    d = near_dedup.differences(a, b).to_pylist()
    assert [(x["n"], len(x["added"]), len(x["removed"])) for x in d] == [(3, 1, 1), (1, 0, 0), (0, 0, 0)]


# --- line dedup


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(a, b):
    return min(2, min(len(a), len(b)) // 8)


@pytest.mark.parametrize("hot", [64, 2])
def test_line_dedup_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_BUCKET", hot)
    rng = random.Random(4)
    base = ["the quick brown fox jumps over the lazy dog again", "pack my box with five dozen liquor jugs for me", "short", "a line of sixteen."]
    edit = lambda s: s if not s else (lambda i: rng.choice((s[:i] + "q" + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "q" + s[i:])))(rng.randrange(len(s)))
    texts = []
    for _ in range(25):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                s = edit(s)
            lines.append(s.upper() if rng.random() < 0.2 else s)
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "  \t spaced   out line of words  \nspaced out line of words"]
    fold = lambda s: re.sub(r"\s+", " ", s.lower()).strip(" ")
    first = {}
    for d, t in enumerate(texts):
        for k, s in enumerate((t or "").split("\n")):
            if fold(s):
                first.setdefault(fold(s), (d, k))
    near = {s: any(o[1] < first[s] and levenshtein(s, o[0]) <= allowed(s, o[0]) for o in first.items()) for s in first}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    for d, t in enumerate(texts):
        if t is None:
            assert got[d] is None
            continue
        keep = [s for k, s in enumerate(t.split("\n")) if fold(s) not in first or (first[fold(s)] == (d, k) and not near[fold(s)])]
        assert got[d] == "\n".join(keep), d


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.dedup_lines(docs(spark, ["some line that is long enough", "another line that is long"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert line_dedup.report(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [64, 2])
def test_line_dedup_short_lines(spark, monkeypatch, hot):
    """Lines of every length that isn't 0: one edit for every eight characters, two at most."""
    monkeypatch.setattr(line_dedup, "HOT_BUCKET", hot)
    rng = random.Random(9)
    lines = ["les.", "of, edti oner.", "are is anwh reenen.", "are. is anwh reenen.", "x" * 12 + "y" * 11, "x" * 12 + "y" * 13, "", " ", "ok", "a", "b", "öen.", "äöen.", "zwölfeck", "zwolfeck", "a zwölfeck of them", "a zwolfecc of them"]
    lines += ["".join(rng.choices("abcdö", k=rng.randrange(1, 12))) for _ in range(60)]
    lines += ["".join(rng.choices("abö", k=rng.choice((7, 8, 9, 15, 16, 17)))) for _ in range(80)]
    texts = ["\n".join(rng.choices(lines, k=6)) for _ in range(60)]
    first = {}
    for d, t in enumerate(texts):
        for k, s in enumerate(t.split("\n")):
            if s.strip():
                first.setdefault(s, (d, k))
    near = {s: any(first[o] < first[s] and levenshtein(s, o) <= allowed(s, o) for o in first) for s in first}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    for d, t in enumerate(texts):
        assert got[d] == "\n".join(s for k, s in enumerate(t.split("\n")) if not s.strip() or (first[s] == (d, k) and not near[s])), d
    raw = [s.encode().decode("latin-1") for s in first]
    in_bytes = {s: any(first[o] < first[s] and levenshtein(r, q) <= allowed(s, o) for o, q in zip(first, raw, strict=True)) for s, r in zip(first, raw, strict=True)}
    assert sum(r.n_near for r in line_dedup.report(docs(spark, texts)).collect()) == sum(in_bytes.values()) < sum(near.values())


@pytest.mark.parametrize("threshold", [1, 2, 4])
def test_banded_distance_is_levenshtein(spark, threshold):
    rng = random.Random(6)
    pairs = [("", ""), ("a", ""), ("ab", "ba"), ("kitten", "sitting")]
    for _ in range(150):
        a = "".join(rng.choices("abö", k=rng.randrange(0, 14)))
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            b[(i := rng.randrange(len(b) + 1)) : i + rng.randrange(2)] = rng.choices("abc", k=rng.randrange(2))
        pairs.append((a, "".join(b)))
    pairs = [(a, b) for a, b in pairs if abs(len(a) - len(b)) <= threshold]
    d = spark.createDataFrame([(list(a), list(b)) for a, b in pairs], "a array<string>, b array<string>")
    got = d.select(line_dedup.banded_distance(F.col("a"), F.col("b"), threshold).alias("d")).collect()
    for (a, b), r in zip(pairs, got, strict=True):
        assert min(r.d, threshold + 1) == min(levenshtein(a, b), threshold + 1), (a, b, r.d)
    texts = spark.createDataFrame([("xyö" * 9 + a + "tail" * k, "xyö" * 9 + b + "tail" * k) for k, (a, b) in enumerate(pairs[:60])], "a string, b string")
    got = texts.select("a", "b", line_dedup.distance(F.col("a"), F.col("b"), threshold).alias("d")).collect()
    assert all(min(r.d, threshold + 1) == min(levenshtein(r.a, r.b), threshold + 1) for r in got)
    near = texts.where(F.abs(F.octet_length("a") - F.octet_length("b")) <= threshold)
    for r in near.select("a", "b", line_dedup.distance(F.col("a"), F.col("b"), threshold, in_bytes=True).alias("d")).collect():
        assert min(r.d, threshold + 1) == min(levenshtein(r.a.encode(), r.b.encode()), threshold + 1)


def test_line_dedup_repeated_and_null_ids(spark):
    one, other, third = "the first line of them all", "an entirely different and unique sentence", "words that stand nowhere else at all"
    texts = [one, one + "\n" + other, other + "\n" + third, one + "\n" + third, "x\n" + third, "x\n" + third]
    ids = [5, 5, None, None, 9, 9]
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(docs(spark, texts, ids=ids)).collect())
    kept = [s for _, i, t in rows for s in t.split("\n") if s]
    assert len(rows) == 6 and sorted(set(kept)) == sorted([one, other, third, "x"]) and [r for r in rows if r[1] == 9] == [(False, 9, "x\n" + third)] * 2
    assert kept.count(one) == kept.count(other) == 1 and kept.count(third) == 2  # the two rows 9 are one document


# --- SentencePiece


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.Pieces.load()


SAMPLE = ["", None, " ", "   ", "Hello  world\n\ttab", " lead and trail ", "éè 梦ἡ ꙮ \U0001f600", "a▁b", "▁", "x" * 300, "THERHAOU!! OUSHED!!"]


def test_codec_matches_the_library_and_round_trips(spark, model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    texts = SAMPLE + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for algorithm in ("merges", "viterbi"):
        rows = sorted(sentencepiece_codec.decode(sentencepiece_codec.encode(d, algorithm=algorithm, check="ok")).collect())
        assert [r.decoded for r in rows] == texts and all(r.ok for r in rows)
        if algorithm == "merges":
            for r in rows:
                if r.text and "▁" not in r.text:
                    assert r.ids == lib.encode(r.text)


def test_viterbi_is_the_best_segmentation(model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    score = {lib.id_to_piece(i): lib.get_score(i) for i in range(259, lib.get_piece_size())}
    for word in ("▁then", "▁entebest", "thlyouble", "▁the.", "queeuxai", "▁▁x", "梦a"):
        best = [0.0] + [-np.inf] * len(word)
        for e in range(1, len(word) + 1):
            best[e] = max(best[s] + score.get(word[s:e], model.unknown if e == s + 1 else -np.inf) for s in range(e))
        order, flat, counts = model.encode_words([word], "viterbi")
        if flat.min() >= 259:
            assert sum(lib.get_score(int(i)) for i in flat) == pytest.approx(best[-1])


def plain_viterbi(model, lib, text):
    """The largest sum of scores over all ways to cut a text into pieces or single characters."""
    score = {lib.id_to_piece(i): lib.get_score(i) for i in range(259, lib.get_piece_size())}
    text = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-np.inf] * len(text)
    for e in range(1, len(text) + 1):
        best[e] = max(best[s] + score.get(text[s:e], model.unknown if e == s + 1 else -np.inf) for s in range(max(0, e - model.longest), e))
    return best[-1]


def test_viterbi_of_whole_texts(spark, model, monkeypatch):
    """Cuts between words, blocks of positions and the cache lose nothing; the library's own unigram mode is never better."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    proto = sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece_codec.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    unigram = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    monkeypatch.setattr(sentencepiece_codec, "_CELLS", 400)
    monkeypatch.setattr(sentencepiece_codec, "BLOCK_BYTES", 300)
    monkeypatch.setattr(sentencepiece_codec, "CACHE_BYTES", 3000)
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").limit(60).collect()]
    texts += ["".join(rng.choices("abcdefgh", k=700)), "a1b2\n\nc  d,T.X", "x" * 200]
    got = sentencepiece_codec.Encoder(model, "viterbi")(pa.array(texts))
    assert all(got.field(1).to_pylist())
    for text, ids in zip(texts, got.field(0).to_pylist(), strict=True):
        if min(ids) >= 259:
            total = sum(lib.get_score(i) for i in ids)
            assert total == pytest.approx(plain_viterbi(model, lib, text))
            theirs = unigram.encode(text)
            assert min(theirs) < 259 or total >= sum(lib.get_score(i) for i in theirs) - 1e-3


def test_equal_hashes_of_words_do_no_harm(model, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec.Encoder, "_find", lambda self, key: (np.zeros(len(key), np.int64), np.full(len(key), len(self.keys) > 0)))
    texts = ["some words here", "", "other words there"]
    got = sentencepiece_codec.Encoder(model, "viterbi")(pa.array(texts))
    assert all(got.field(1).to_pylist()) and sentencepiece_codec.decode_column(got.field(0), model).to_pylist() == texts


def test_codec_odd_rows(spark, model):
    d = docs(spark, [*ODD, "a" * 200_000, "word " * 20_000, *ODD], ids=None).withColumn("ids", F.lit("clash"))
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(d, check="score")).collect()
    assert len(rows) == 2 * len(ODD) + 2 and all(r.decoded == r.text and r.score for r in rows)
    assert all((r.ids is None) == (r.text is None) for r in rows) and {len(r.ids) for r in rows if r.text == ""} == {0}
    assert sentencepiece_codec.encode(docs(spark, [])).count() == 0
    raw = spark.sql("SELECT 1 AS doc_id, cast(X'61FF20C3' AS string) AS text")  # not UTF-8
    assert sentencepiece_codec.encode(raw, check="ok").first().ok


# --- quality


def test_quality_brute_force_sites(spark):
    good = ["A quiet sentence about the river and its banks. " * 6] * 30
    bad = ["###$$$ %%% &&& *** ### " * 20] * 10
    texts, sources = good + bad + [None, ""], ["h1"] * 20 + ["h2"] * 20 + ["h3", None]
    d = docs(spark, texts, sources=sources)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(i, 0, 0) for i in range(30, 40)] + [(3, 1, 0), (999, 0, 0), (None, 1, 1), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    r = {x.doc_id: x for x in quality.report(d, labels).collect()}
    assert len(r) == 42 and all(r[i].accepted for i in range(30)) and not any(r[i].accepted for i in range(30, 40))
    rate = (30 + 1) / (40 + 2)
    assert r[40].site_posterior == pytest.approx(rate, abs=1e-6)
    n, good_n = {"h1": 20, "h2": 20}, {"h1": 20, "h2": 10}
    var = rate * (1 - rate)
    between = (sum(n[h] * (good_n[h] / n[h] - rate) ** 2 for h in n) - var) / (40 - sum(v * v for v in n.values()) / 40)
    k = min(max(var / between - 1, quality.WEAK), quality.STRONG)
    for i, h in ((0, "h1"), (39, "h2")):
        host = (good_n[h] + rate * k) / (n[h] + k)
        assert r[i].site_posterior == pytest.approx((good_n[h] + host * k) / (n[h] + k), abs=1e-5)
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns
    assert quality.report(d, labels.limit(0)).count() == 42 and quality.report(docs(spark, []), labels).count() == 0


def test_quality_of_documents_by_hand(spark):
    """The document model and both parts together, with repeated rows, ties and very long texts."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["river", "stone", "walks", "Quiet."], k=rng.randrange(5, 90))) for _ in range(40)] + ["".join(rng.choices("#$%& x", k=200)) for _ in range(20)] + ["long words " * 20_000, None, ""]
    texts += texts[:5]
    ids = [*range(63), *range(5)]
    d = docs(spark, texts, ids=ids, sources=[f"h{i % 3}" for i in range(len(texts))])
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    r = quality.of_documents(d, labels).collect()
    w, mean, scale = quality.fit(d, labels)
    x = quality.features(pa.array(texts))
    by_text = {t: float(np.clip((f - mean) / scale, -8, 8) @ w[:-1] + w[-1]) for t, f in zip(texts, x, strict=True)}
    rate = (45 + 1) / (65 + 2)  # five rows stand twice
    assert len(r) == len(texts)
    for row in r:
        assert row["__doc"] == pytest.approx(by_text[row.text])
        odds = row["__doc"] - np.log(rate / (1 - rate)) + np.log(row["__site"] / (1 - row["__site"]))
        assert row["__quality"] == pytest.approx(1 / (1 + np.exp(-odds)))
    assert (x[62] == quality.features(pa.array([""]))[0]).all() and set(d.columns) < set(r[0].asDict())


def test_quality_on_the_tables(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = quality.report(d, labels).withColumnRenamed("quality", "p").join(labels, "doc_id")
    assert r.agg(F.avg((F.col("accepted") == (F.col("quality") == 1)).cast("double"))).first()[0] > 0.98


# --- URL filter and WARC


def test_url_filter_brute_force(spark):
    rng = random.Random(3)
    listed = [("l1", "domain", "a.org", "block", "2024-01-10"), ("l1", "domain", "a.org", "lift", "2024-02-20"), ("l2", "host", "x.a.org", "allow", "2024-01-15"), ("l2", "path", "x.a.org/p/q", "block", "2024-01-01"), ("l3", "domain", "a.org", "block", "2024-05-01"), ("l3", "domain", "a.org", "allow", "2024-05-01"), (None, "host", None, "block", "2024-01-01")]
    urls = ["http://x.a.org/p/q/r", "https://WWW.a.org:80/z?x", "http://y.a.org", "http://b.org/", "nonsense", None, "http://x.a.org/p/qq"]
    caps = [(i, rng.choice(urls), f"2024-{rng.randrange(1, 7):02d}-{rng.randrange(1, 28):02d}") for i in range(120)]
    c = spark.createDataFrame(caps, "capture_id bigint, url string, day string").select("capture_id", "url", F.to_date("day").alias("fetched"))
    got = {r.capture_id: r for r in url_filter.evaluate(c, url_filter.entries(spark, [(*x[:4], x[4]) for x in listed])).collect()}
    spans = [("l1", "domain", "a.org", "block", "2024-01-10", "2024-02-20"), ("l2", "host", "x.a.org", "allow", "2024-01-15", "9"), ("l2", "path", "x.a.org/p/q", "block", "2024-01-01", "9"), ("l3", "domain", "a.org", "block", "2024-05-01", "9")]
    for i, url, day in caps:
        m = re.match(r"[a-z]+://(?:www\.)?([^/:?]+)[^/?]*([^?]*)", (url or "").lower())
        host, path = (m[1], m[2]) if m else ("", "")
        hit = [s for s in spans if s[4] <= day < s[5] and host and {"host": host == s[2], "domain": host == s[2] or host.endswith("." + s[2]), "path": (host + path.rstrip("/") + "/").startswith(s[2] + "/")}[s[1]]]
        best = min(hit, key=lambda s: ({"path": 0, "host": 1, "domain": 2}[s[1]], -len(s[2]), s[0]), default=None)
        assert got[i].n_active == len(hit) and got[i].verdict == (best[3] if best else "none"), (url, day)
    assert url_filter.evaluate(c.limit(0), url_filter.entries(spark)).count() == 0


def test_line_dedup_candidates_are_linear_in_the_variants_of_a_line(spark, monkeypatch):
    """Lines that differ in a counter: all but the first have an earlier near line, and few pairs show it."""
    made, real = [], line_dedup._each_once

    def counted(pairs):
        out = line_dedup.save(real(pairs), "counted")
        made.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "_each_once", counted)
    rows = [f"listing page number {i:05d} of the catalogue of the mill" for i in range(600)]
    got = line_dedup.report(docs(spark, rows).repartition(4)).agg(F.sum("n_near"), F.count("*")).first()
    assert tuple(got) == (599, 600) and sum(made) < 20 * len(rows)


def test_url_filter_far_dates(spark):
    """A corrupt fetch date costs a month, not all months up to it."""
    listed = url_filter.entries(spark, [("l", "host", "a.org", "block", "2024-01-01"), ("l", "host", "b.org", "allow", "2024-02-01"), ("l", "host", "b.org", "lift", "2024-02-15")])
    c = spark.createDataFrame([(0, "http://a.org", "9999-12-31"), (1, "http://a.org", "0001-01-01"), (2, "http://b.org", "2024-02-10"), (3, "http://b.org", None)], "capture_id int, url string, day string").select("capture_id", "url", F.to_date("day").alias("fetched"))
    assert url_filter.by_month(url_filter.intervals(listed), c.select(F.col("fetched").alias("day"))).count() == 3
    assert {r.capture_id: r.verdict for r in url_filter.evaluate(c, listed).collect()} == {0: "block", 1: "none", 2: "allow", 3: "none"}


def test_url_filter_deep_paths_and_repeated_captures(spark):
    deep = "a.org/" + "/".join("abcdefghijkl")
    listed = url_filter.entries(spark, [("l", "path", deep, "block", "2024-01-01"), ("l", "host", "a.org", "allow", "2024-01-01")])
    caps = [(0, f"http://{deep}/m", "2024-02-01"), (1, "http://a.org/a/b", "2024-02-01"), (1, "http://a.org/a/b", "2024-02-01")]
    c = spark.createDataFrame(caps, "capture_id bigint, url string, day string").select("capture_id", "url", F.to_date("day").alias("fetched"))
    assert {(r.capture_id, r.n_active, r.verdict) for r in url_filter.evaluate(c, listed).collect()} == {(0, 2, "block"), (1, 1, "allow")}


def test_url_filter_cleans_hosts(spark):
    listed = url_filter.entries(spark, [("l", "host", "WWW.c.org", "block", "2024-01-01"), ("l", "host", "d.org.", "block", "2024-01-01"), ("l", "path", "www.e.org//p/", "block", "2024-01-01"), ("l", "domain", "www.org", "block", "2024-01-01")])
    urls = {"http://user:pw@d.org/": True, "http://a@b@d.org.:8080/x": True, "https://c.org": True, "http://www.c.org/": True, "http://e.org/p": True, "http://e.org/q/p": False, "http://www.org/": True, "http://d.org.uk/": False, "http://x.d.org/": False, "http://user@e.org/p/" + "x/" * 3000: True}
    c = spark.createDataFrame(list(enumerate(urls)), "capture_id bigint, url string").withColumn("fetched", F.lit("2024-03-01").cast("date")).withColumn("kind", F.lit("clash"))
    got = {r.url: r.verdict for r in url_filter.evaluate(c, listed).collect()}
    assert got == {u: "block" if b else "none" for u, b in urls.items()}
    assert {r.verdict for r in url_filter.evaluate(c, listed.limit(0)).collect()} == {"none"}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, captured string")


def test_warc_round_trip(spark):
    big, other = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 80, "z" * 1000
    rows = [(1, "http://b.org/x#f", big, "c"), (2, "https://www.a.org/", big, "c"), (3, None, None, "c"), (4, "http://a.org/q?y=1", "small", "c"), (5, "line\nbreak", "small", "c"), (6, "http://a.org", other, "c"), (7, "http://a.org", other, "c"), (7, "http://a.org", other, "c"), (None, "http://a.org", other, "c")]
    got = warc.report(pages(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(r.position for r in got) == list(range(len(rows)))
    for r in got:
        html = next(h or "" for i, _, h, _ in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "revisit", 7), (7, "response", None), (None, "revisit", 7)}
    assert warc.report(pages(spark, [])).count() == 0


def test_merged_index_is_in_order(spark):
    rng = random.Random(8)
    rows = [(i, f"http://h{rng.choice((1, 1, 1, 2, 3))}.org/{rng.randrange(4)}", f"{i}", "c") for i in range(600)]
    path = warc.new_path(spark, "test")
    warc.write(pages(spark, rows).withColumn("captured", warc.captured(F.col("page_id"))).repartition(5), path, compression="none")
    index = warc.save(warc.read(spark, path), "index")
    got = warc.merge_index(index, range_rows=50).orderBy("position").collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and sorted(r.page_id for r in got) == list(range(600)) and [r.position for r in got] == list(range(600))


def test_records_can_be_read_from_their_place(spark):
    """Each record is a gzip member: cut out of its archive by the index, it is that record and no more."""
    import gzip

    rows = [(i, f"http://a.org/{i}", "<p>" + "text ÄÖ \x00 \r\n\r\n " * (i % 7 * 40) + "</p>") for i in range(60)] + [(100, "http://b.org", None), (101, "http://long.org", "xy" * 9_000_000)]
    captures = pages(spark, [(*r, "") for r in rows]).withColumn("captured", warc.captured(F.col("page_id"))).repartition(3)
    path = warc.new_path(spark, "test")
    warc.write(captures, path)
    index = warc.read(spark, path).collect()
    files = {r.path.rpartition("/")[2]: bytes(r.content) for r in spark.read.format("binaryFile").load(path).where("path NOT LIKE '%/\\_%'").collect()}
    assert len(index) == len(rows) and sum(r.length for r in index) == sum(map(len, files.values()))
    for r in index:
        record = gzip.decompress(files[r.archive][r.offset : r.offset + r.length])
        head, _, rest = record.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and f"urn:capture:{r.page_id}>".encode() in head and record.endswith(b"\r\n\r\n")
        html = dict((k, v) for k, _, v in rows)[r.page_id] or ""
        assert r.record_type == "revisit" or rest[:-4].partition(b"\r\n\r\n")[2] == html.encode()


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 16)
    monkeypatch.setattr(warc, "SMALL_BYTES", 100)
    rows = [(i, f"http://h.org/{i}", chr(97 + i % 26) * (50, 350, 5000)[i % 3], "c") for i in range(90)]
    path = warc.new_path(spark, "test")
    warc.write(pages(spark, rows).coalesce(1), path)
    counts = warc.read(spark, path).groupBy("archive").agg(F.count("*").alias("n"), F.max("payload_bytes").alias("b")).collect()
    assert sum(r.n for r in counts) == 90 and {(r.b, r.n) for r in counts} <= {(50, 16), (50, 14), (350, 4), (350, 2), (5000, 1)}


def test_loser_tree():
    rng = random.Random(2)
    rows = [(str(rng.randrange(40)), "t", rng.randrange(9), "", "", 0, "", None, "a", i) for i in range(500)]
    for k in (1, 2, 3, 8, 13):
        assert list(warc.loser_tree([sorted(rows[i::k], key=warc.sort_key) for i in range(k)] + [[]])) == sorted(rows, key=warc.sort_key)
    assert list(warc.loser_tree([])) == [] == list(warc.loser_tree([[]]))


# --- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    table = spark.read.parquet(f"{sf}/documents.parquet")
    d = table
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.save(stage(spark, d, sf), name)
        counts.append(out.count())
        if name != "tokenize":
            assert out.columns == table.columns
        d = out
    assert counts[0] < table.count() and counts == sorted(counts, reverse=True) and d.where("NOT round_trip").count() == 0


def test_pipeline_keeps_no_copies(spark, tmp_path):
    """run() with planted exact copies against line dedup and near dedup by hand."""
    import corpus_pipeline

    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(4, 9))) for _ in range(9))
    whole = ["\n".join(line() for _ in range(rng.randrange(2, 6))) for _ in range(12)]
    texts = [*whole, *whole[:4], *[whole[5]] * 40, whole[1] + "\n" + whole[2], whole[3].upper() + "\n\n ", None, "", "\n", "!!! ???", "-- ** --"]
    sf_dir = str(tmp_path)
    docs(spark, texts).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(0, "zq " * 30)], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")

    good = {r.doc_id for r in corpus_pipeline.stage_quality(spark, docs(spark, texts), sf_dir).select("doc_id").collect()}
    assert {0, 1, 2, 3, 5, 12, 16, 50, 56, 57} <= good
    seen, left = set(), {}
    for i in sorted(good):
        keep = [s for s in (texts[i] or "").split("\n") if not s.strip() or not (s.lower().strip() in seen or seen.add(s.lower().strip()))]
        if not (texts[i] or "").strip() or "".join(keep).strip():
            left[i] = "\n".join(keep)
    label = brute_classes(list(left.values()))
    want = {i for k, i in enumerate(left) if label[k] == k}
    rows = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(rows) == want and {i for i in want if not rows[i]} <= {58, 59, 60}


def test_pipeline_odd_rows(spark, tmp_path):
    """run() with repeated and null ids, null, empty and very long texts: no text is lost that stands nowhere else; and with empty tables."""
    import corpus_pipeline

    rng = random.Random(12)
    line = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(4, 9))) for _ in range(9))
    whole = [line() + "\n" + line() for _ in range(6)] + ["\n".join(line() for _ in range(3000))]
    texts = [*whole, whole[0], whole[1], whole[1], None, "", None]
    ids = [5, 5, None, None, 5, 6, 7, 5, None, 8, None, None, 5]
    sf_dir = str(tmp_path / "some")
    docs(spark, texts, ids=ids).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(0, "zq " * 30)], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    rows = sentencepiece_codec.decode(corpus_pipeline.run(spark, sf_dir)).collect()
    assert sorted(r.decoded for r in rows if r.decoded) == sorted(whole) and all(r.round_trip for r in rows)
    assert len(rows) == len(whole) + 3  # the null and empty texts stay

    sf_dir = str(tmp_path / "none")
    docs(spark, []).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
