"""License scan: ordered signature rules behind a keyword prefilter.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A
base detection is a place where a base phrase's words stand consecutively. Some
hundreds of hand-written rules find further licences: word hashes tell which
keywords a text holds, only rules with all their keywords there are run, and of
their detections those that lie inside one of higher priority (then longer, then
earlier) are suppressed. Base labels are never suppressed.

Defined cases: null and empty texts have no words and no labels, with score 0;
repeated rows are scanned each for itself; very long texts are scanned whole; detections that
tie in priority, length and place stand by their label; an empty table gives an empty result; a column named `scan` is replaced by the result of
the scan, other columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import Words, arrow_once, text_blocks, word_list, words
from furrow.llm.license_rules import rules

BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
SCAN = "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: array<string>, labels: array<string>, score: double, detections: array<struct<label: string, start: bigint, end: bigint>>>"
_ARROW = pa.struct(
    [(k, pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
)


def word_hash(word: str) -> int:
    raw = word.encode()
    return int(words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)).hash[0])


@cache
def compiled() -> tuple[list[tuple[str, int, frozenset[str], str]], dict[int, str], np.ndarray]:
    """The rules, the keyword of each hash, and the sorted hashes of keywords that rules hang on."""
    all_rules = [(label, priority, frozenset(keys), pattern) for label, priority, keys, pattern in rules()]
    if bad := [r[0] for r in all_rules if not r[2]]:
        raise ValueError(f"rules without a keyword: {bad}")
    hashes = {word_hash(k): k for r in all_rules for k in r[2]}
    return all_rules, hashes, np.array(sorted(word_hash(anchor(r[2])) for r in all_rules), np.uint64)


def anchor(keys: frozenset[str]) -> str:
    """The longest keyword, as a stand-in for the rarest."""
    return max(keys, key=lambda k: (len(k), k))


@cache
def pattern_of(rule: int) -> re.Pattern:
    """Patterns are compiled when their keywords first occur."""
    return re.compile(compiled()[0][rule][3], re.DOTALL)


@cache
def rarest() -> dict[str, list[int]]:
    """Rules by their anchor."""
    out: dict[str, list[int]] = {}
    for i, (_, _, keys, _) in enumerate(compiled()[0]):
        out.setdefault(anchor(keys), []).append(i)
    return out


def detect(text: str, keywords: set[str]) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) in characters, after suppression."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
    found = []
    for k in keywords:
        for i in rarest().get(k, ()):
            label, priority, keys, _ = compiled()[0][i]
            if keys <= keywords:
                found += [(*m.span(), label, priority) for m in pattern_of(i).finditer(low)]
    return suppress(found)


def suppress(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Without detections contained in one that ranks higher; what stays, by start.

    Higher ranks come first. Kept intervals are held as an envelope, starts and ends
    both rising (a kept interval inside another can't be kept), so each test is a
    binary search."""
    from bisect import bisect_right

    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for d in sorted(set(found), key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
        at = bisect_right(starts, d[0])
        if at and max(ends[at - 1 : at]) >= d[1]:
            continue
        kept.append(d)
        # intervals that the new one contains need no place in the envelope
        lo = at
        while lo < len(starts) and ends[lo] <= d[1]:
            lo += 1
        starts[at:lo], ends[at:lo] = [d[0]], [d[1]]
    return sorted(kept)


def _base(w: Words) -> list[tuple[int, str]]:
    """(first word, label) of all places of base phrases."""
    out = []
    for label, phrase in BASE.items():
        parts = phrase.split()
        at = np.flatnonzero(w.hash[: max(0, len(w.hash) - len(parts) + 1)] == np.uint64(word_hash(parts[0])))
        for k, part in enumerate(parts):
            at = at[(w.hash[at + k] == np.uint64(word_hash(part))) & (w.row[at + k] == w.row[at])]
        out += [(i, label) for i in at.tolist() if w.joined(i, len(parts)) == phrase.encode()]
    return sorted(out)


def _scan(column: pa.Array) -> list[dict]:
    _, of_hash, keys = compiled()
    keyed = np.zeros(1 << 16, bool)
    keyed[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    out: list[dict] = []
    for row, offsets, data in text_blocks(column):
        w = words(offsets, data)
        found = [{"n_words": int(n), "n_base": 0, "first_word": None, "last_word": None, "base": set(), "keys": set()} for n in np.diff(w.first)]
        for i, label in _base(w):
            r = found[w.row[i]]
            at = i - int(w.first[w.row[i]])
            r["n_base"] += 1
            r["first_word"], r["last_word"] = at if r["first_word"] is None else r["first_word"], at
            r["base"].add(label)
        at = np.flatnonzero(keyed[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
        at = at[np.isin(w.hash[at], keys)]
        for r in np.unique(w.row[at]).tolist():
            found[r]["keys"] = {of_hash[h] for h in np.unique(w.hash[w.first[r] : w.first[r + 1]]).tolist() if h in of_hash}
        for k, r in enumerate(found):
            text = column[row + k].as_py() if r["keys"] else ""
            got = detect(text, r["keys"]) if r["keys"] else []
            best: dict[str, int] = {}
            for _, _, label, priority in got:
                best[label] = max(best.get(label, 0), priority)
            base = r.pop("base")
            del r["keys"]
            miss = 1.0
            for p in best.values():
                miss *= 1 - min(0.95, 0.4 + p / 100)
            if base:
                miss *= 0.1
            out.append(r | {"base_labels": sorted(base), "labels": sorted(base | set(best)), "score": round(1 - miss, 6), "detections": [{"label": x[2], "start": x[0], "end": x[1]} for x in got]})
    return out


def scan(docs: DataFrame, text: str = "text", into: str = "scan") -> DataFrame:
    """docs with a column `into`: counts, labels, score, and the detections with their character spans."""

    def of(column: pa.Array) -> pa.Array:
        return pa.array(_scan(column), _ARROW)

    return docs.withColumn(into, arrow_once(of, SCAN)(F.col(text)))


def report(docs: DataFrame) -> DataFrame:
    s = scan(docs.select("doc_id", "text"))
    joined = {c: F.array_join(f"scan.{c}", ",") for c in ("base_labels", "labels")}
    return s.select("doc_id", *(F.col(f"scan.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word")), *(v.alias(k) for k, v in joined.items()), F.col("scan.score").alias("score"))


def brute(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base labels by plain loops, for tests."""
    w = [x.decode() for x in word_list(text)]
    at = [(i, label) for label, phrase in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at}))
