"""SentencePiece encoding and decoding in batched numpy.

The text gets a blank in front (blanks are U+2581 in the pieces) and is cut into words wherever
no piece holds the two characters around the cut in a row: before each run of blanks, around
line feeds, and elsewhere. No piece crosses a cut, so that words can be encoded each for itself. A block of texts is cut at once: hashes of all words by prefix sums
probe the sorted keys of the words that the worker already knows; only new words are
encoded. Words of one length advance together: substring hashes probe the sorted keys of
the pieces, which gives the score and the id of every substring of every word; then

* `viterbi`, the default, finds the segmentation of the largest sum of scores: vectorised
  maxima over the words store a backpointer at every position. Of equal sums the longest
  last piece wins. It takes a word's positions in blocks, so that time and memory are linear
  in its length;
* `merges` joins, round by round, each word's adjacent pair whose piece scores best,
  which is how the library segments with models of type BPE.

Characters that no piece covers become byte pieces. Decoding joins the pieces' bytes
and drops the blank in front. Decoding what was encoded gives the text back exactly;
a literal U+2581 is encoded as bytes for that. `encode` decodes every block again and holds
it against the texts: were two words' hashes ever equal, the texts concerned are encoded
word by word instead.

Memory: blocks of BLOCK_BYTES of text or one longer text; CACHE_BYTES of known words, and none
longer than CACHE_WORD bytes.

Defined cases: a null text has null ids, decodes to null and counts as a round trip; an empty
text has no ids and decodes to an empty text; repeated rows are encoded each for itself; an
empty table gives an empty result; a column that has the name of a result column is replaced by
it, other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import arrow_once, mix, powers, text_blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581 of the text; no UTF-8 text can hold it.
LITERAL = "\udfff"
BLOCK_BYTES = 1 << 20
CACHE_BYTES = 24 << 20
CACHE_WORD = 64
_CELLS = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


def hash_codes(code: np.ndarray) -> np.ndarray:
    """Hashes of whole rows of code points."""
    h = np.zeros(len(code), np.uint64)
    for k in range(code.shape[1]):
        h = h * _P + code[:, k].astype(np.uint64) + np.uint64(1)
    return mix(h ^ np.uint64(code.shape[1]))


@dataclass
class Pieces:
    """A model: sorted hashes of the normal pieces with scores and ids, the bytes of every id, the ids of the byte pieces."""

    keys: np.ndarray
    scores: np.ndarray
    ids: np.ndarray
    longest: int
    unknown: float
    byte_ids: np.ndarray
    raw: np.ndarray
    raw_at: np.ndarray
    bpe: bool

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.name != "identity" or not model.trainer_spec.byte_fallback or not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with an identity normaliser, a blank in front and byte fallback are supported")
        keys, scores, ids, raw, byte_ids = [], [], [], [], np.zeros(256, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type in (1, 4):
                code = np.frombuffer(p.piece.encode("utf-32-le"), np.uint32)
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} holds U+2581 after another character")
                keys.append(hash_codes(code[None])[0]), scores.append(p.score), ids.append(i)
            if p.type == 6:
                byte_ids[int(p.piece[3:5], 16)] = i
                raw.append(bytes([int(p.piece[3:5], 16)]))
            else:
                raw.append(p.piece.replace(SPACE, " ").encode() if p.type in (1, 4) else b"")
        order = np.argsort(np.array(keys, np.uint64))
        at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        return cls(np.array(keys, np.uint64)[order], np.array(scores)[order], np.array(ids, np.int32)[order], max(len(p.piece) for p in model.pieces if p.type == 1), min(scores) - 10, byte_ids, np.frombuffer(b"".join(raw), np.uint8), at, model.trainer_spec.model_type == 2)

    def substrings(self, code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of code[:, s : s + k] at [:, s, k - 1] for k up to most; -inf and -1 where that is no piece."""
        n, size = code.shape
        score, ids = np.full((n, size, most), -np.inf), np.full((n, size, most), -1, np.int32)
        h = np.zeros((n, size), np.uint64)
        c = code.astype(np.uint64) + np.uint64(1)
        for k in range(1, min(most, size) + 1):
            h = h[:, : size - k + 1] * _P + c[:, k - 1 :]
            key = mix(h ^ np.uint64(k))
            maybe = np.nonzero(self.bits[(key & np.uint64(0xFFFFF)).astype(np.int64)])
            found = key[maybe]
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            ok = self.keys[at] == found
            where = (maybe[0][ok], maybe[1][ok])
            score[where[0], where[1], k - 1] = self.scores[at[ok]]
            ids[where[0], where[1], k - 1] = self.ids[at[ok]]
        return score, ids

    @property
    def cuts(self) -> np.ndarray:
        """For each pair of bytes whether texts are cut between them: no piece holds the two in a row, and the second begins a character."""
        if "_cuts" not in self.__dict__:
            table = np.ones((256, 256), bool)
            inside = np.ones(max(len(self.raw) - 1, 0), bool)
            inside[self.raw_at[1:-1][(self.raw_at[1:-1] > 0) & (self.raw_at[1:-1] < len(self.raw))] - 1] = False
            table[self.raw[:-1][inside], self.raw[1:][inside]] = False
            table[:, 0x80:0xC0] = False
            self.__dict__["_cuts"] = table.ravel()
        return self.__dict__["_cuts"]

    @property
    def bits(self) -> np.ndarray:
        if "_bits" not in self.__dict__:
            table = np.zeros(1 << 20, bool)
            table[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.__dict__["_bits"] = table
        return self.__dict__["_bits"]

    def viterbi(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids (-1: none) of the pieces at their starts, lengths 0 elsewhere: the segmentation of the largest sum of scores."""
        n, size = code.shape
        most = min(self.longest, size)
        best, back, piece = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int32)
        best[:, 0] = 0
        lengths = np.arange(1, most + 1, dtype=np.int32)
        block = max(most, _CELLS // (n * most))
        for a in range(0, size, block):
            score, ids = self.substrings(code[:, a : a + block + most - 1], most)
            score[:, :, 0] = np.where(np.isinf(score[:, :, 0]), self.unknown, score[:, :, 0])
            for at in range(a, min(a + block, size)):
                m = min(most, size - at)
                total = best[:, at : at + 1] + score[:, at - a, :m]
                ends = slice(at + 1, at + 1 + m)
                better = total > best[:, ends]  # the longest last piece comes first, and stays where sums are equal
                np.copyto(best[:, ends], total, where=better)
                np.copyto(back[:, ends], lengths[:m], where=better)
                np.copyto(piece[:, ends], ids[:, at - a, :m], where=better)
        out, found = np.zeros((n, size), np.int32), np.full((n, size), -1, np.int32)
        rows, end = np.arange(n), np.full(n, size)
        while len(rows):
            length = back[rows, end]
            start = end - length
            out[rows, start], found[rows, start] = length, piece[rows, end]
            rows, end = rows[start > 0], start[start > 0]
        return out, found

    def merges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for best-scoring adjacent pairs joined until none is a piece. Takes the square of a word's length."""
        n, size = code.shape
        score, ids = self.substrings(code, min(self.longest, size))
        most = score.shape[2]
        out = np.ones((n, size), np.int32)
        live, pos = np.arange(n), np.arange(size)
        while len(live):
            length = np.pad(out[live], ((0, 0), (0, 1)))
            after = np.minimum(pos + length[:, :-1], size)
            second = np.take_along_axis(length, after, axis=1)
            total = length[:, :-1] + second
            ok = (length[:, :-1] > 0) & (second > 0) & (total <= most)
            value = np.where(ok, score[live[:, None], pos, np.minimum(total, most) - 1], -np.inf)
            pick = value.argmax(axis=1)
            r = np.arange(len(live))
            go = value[r, pick] > -np.inf
            r, pick = r[go], pick[go]
            out[live[r], after[r, pick]] = 0
            out[live[r], pick] = total[r, pick]
            live = live[go]
        return out, np.take_along_axis(ids, np.maximum(out - 1, 0)[:, :, None], axis=2)[:, :, 0]

    def encode_codes(self, code: np.ndarray, algorithm: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows joined, how many each row has) of words of one length as code points, with U+2581 for blanks and LITERAL for U+2581."""
        lengths, ids = self.viterbi(code) if algorithm == "viterbi" else self.merges(code)
        row, start = np.nonzero(lengths)
        found = ids[row, start]
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found, np.bincount(row, minlength=len(code))
        # characters that no piece covers become one id a byte
        chars, which = np.unique(code[row, start][missing], return_inverse=True)
        raw = [(SPACE if c == ord(LITERAL) else chr(c)).encode("utf-8", "surrogateescape") for c in chars.tolist()]
        size = np.ones(len(found), np.int64)
        size[missing] = np.array([len(x) for x in raw])[which]
        own, _ = gather(self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)], np.concatenate([[0], np.cumsum([len(x) for x in raw])]), which)
        out = np.repeat(found, size)
        out[out < 0] = own
        return out, np.bincount(row, weights=size, minlength=len(code)).astype(np.int64)

    def encode_words(self, all_words: list[str], algorithm: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order of the words, their ids joined, how many ids each has). Words have U+2581 for blanks and LITERAL for U+2581."""
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(all_words):
            by_size.setdefault(len(w), []).append(i)
        order, flat, counts = [], [], []
        for size, members in by_size.items():
            for part in self._parts(members, size):
                code = np.frombuffer("".join([all_words[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size)
                found, count = self.encode_codes(code, algorithm)
                order += part
                flat.append(found), counts.append(count)
        return order, np.concatenate(flat) if flat else np.zeros(0, np.int32), np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def _parts(self, members, size: int):
        step = max(1, _CELLS // (size * min(size, self.longest)))
        return (members[a : a + step] for a in range(0, len(members), step))

    def encode_spans(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, algorithm: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for spans of UTF-8 bytes with plain blanks."""
        high = np.concatenate([[0], np.cumsum(text >= 0x80)])
        plain = high[end] == high[start]
        others = np.flatnonzero(~plain)
        order, flat, counts = self.encode_words([as_word(text[start[i] : end[i]]) for i in others.tolist()], algorithm)
        orders, flats, all_counts = [others[order] if len(order) else others], [flat], [counts]
        size = np.where(plain, end - start, 0)
        by_size = np.argsort(size, kind="stable")[len(others) :]
        for members in np.split(by_size, np.flatnonzero(np.diff(size[by_size])) + 1) if len(by_size) else []:
            for part in self._parts(members, int(size[members[0]])):
                code = text[start[part][:, None] + np.arange(size[part[0]])].astype(np.uint32)
                code[code == 0x20] = ord(SPACE)
                found, count = self.encode_codes(code, algorithm)
                orders.append(part), flats.append(found), all_counts.append(count)
        return np.concatenate(orders), np.concatenate(flats), np.concatenate(all_counts)

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids joined, and how many each has."""
        return gather(self.raw, self.raw_at, ids.astype(np.int64))


class Encoder:
    """Encodes texts and remembers words; one lives in each Python worker."""

    def __init__(self, pieces: Pieces, algorithm: str):
        self.pieces, self.algorithm = pieces, algorithm
        self.clear()

    def clear(self) -> None:
        # sorted hashes of known words, the place of each in `at`; ids of word k are ids[at[k] : at[k + 1]]
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, column: pa.Array) -> pa.StructArray:
        values, sizes, ok = [], [], []
        for _, offsets, data in text_blocks(column, BLOCK_BYTES):
            ids, n, same = self._block(offsets, data)
            values.append(ids), sizes.append(n), ok.append(same)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        offsets = np.concatenate([[0], np.cumsum(join(sizes, np.int64))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(join(values, np.int32)), mask=column.is_null() if column.null_count else None)
        return pa.StructArray.from_arrays([lists, pa.array(join(ok, bool))], ["ids", "ok"])

    def _block(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts joined, how many each text has, and whether they decode to the text."""
        some = np.diff(offsets) > 0
        text = np.insert(data, offsets[:-1][some], 0x20)
        begin = offsets + np.concatenate([[0], np.cumsum(some)])
        starts = np.zeros(len(text), bool)
        starts[1:] = self.pieces.cuts[text[:-1].astype(np.int32) * 256 + text[1:]]
        starts[begin[:-1][some]] = True
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(text))
        parts, counts, same = [], [], True
        for a, b in self._chunks(start, end):
            piece = text[start[a] : end[b - 1]]
            ids, n = self._words(piece, start[a:b] - start[a], end[a:b] - start[a])
            raw, _ = self.pieces.decoded(ids)
            if not np.array_equal(raw, piece):  # two words of one hash
                order, flat, found = self.pieces.encode_spans(text, start[a:b], end[a:b], self.algorithm)
                ids, n = gather(flat, np.concatenate([[0], np.cumsum(found)]), np.argsort(order))
                same = same and np.array_equal(self.pieces.decoded(ids)[0], piece)
            parts.append(ids), counts.append(n)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        cut = upto[np.searchsorted(start, begin)]
        ok = np.ones(len(some), bool)
        if not same:
            own = [ids[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
            ok = np.array([np.array_equal(self.pieces.decoded(x)[0], text[begin[k] : begin[k + 1]]) for k, x in enumerate(own)], bool)
        return ids, np.diff(cut), ok

    def _chunks(self, start: np.ndarray, end: np.ndarray):
        a = 0
        while a < len(start):
            b = max(int(np.searchsorted(end, start[a] + BLOCK_BYTES, "right")), a + 1)
            yield a, b
            a = b

    def _words(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, inv = powers(len(text) + 1)
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * p[: len(text)], out=sums[1:])
        key = mix((sums[end] - sums[start]) * inv[start])
        if self.ids.nbytes + 40 * len(self.keys) > CACHE_BYTES:
            self.clear()
        at, known = self._find(key)
        if known.all():
            return gather(self.ids, self.at, at)
        unknown = np.flatnonzero(~known)
        new, first = np.unique(key[unknown], return_index=True)
        first = unknown[first]
        keep = end[first] - start[first] <= CACHE_WORD
        n, n_ids = self._add(new[keep], first[keep], text, start, end)
        kept = self.keys, self.slot
        if not keep.all():
            self._add(new[~keep], first[~keep], text, start, end)
        slots, _ = self._find(key[unknown])
        at[unknown] = slots
        out = gather(self.ids, self.at, at)
        if not keep.all():
            self.keys, self.slot = kept
            self.ids, self.at = self.ids[:n_ids].copy(), self.at[: n + 1].copy()
        return out

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.slot[at], self.keys[at] == key

    def _add(self, key: np.ndarray, first: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[int, int]:
        if len(key):
            order, flat, counts = self.pieces.encode_spans(text, start[first], end[first], self.algorithm)
            slot = np.empty(len(key), np.int64)
            slot[order] = np.arange(len(key)) + len(self.keys)
            where = np.searchsorted(self.keys, key)
            self.keys, self.slot = np.insert(self.keys, where, key), np.insert(self.slot, where, slot)
            self.ids = np.concatenate([self.ids, flat])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
        return len(self.at) - 1, len(self.ids)


def as_word(raw: np.ndarray) -> str:
    return raw.tobytes().decode("utf-8", "surrogateescape").replace(SPACE, LITERAL).replace(" ", SPACE)


def gather(values: np.ndarray, at: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[at[i] : at[i + 1]] of every i of index, joined; and their lengths."""
    length = at[index + 1] - at[index]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(at[index] - (ends - length), length)], length


def decode_column(column: pa.Array, pieces: Pieces) -> pa.Array:
    lists = column.to_numpy(zero_copy_only=False)
    null = np.array([x is None for x in lists], bool)
    sizes = np.array([0 if x is None else len(x) for x in lists], np.int64)
    ids = np.concatenate([x for x in lists if x is not None]) if (~null).any() else np.zeros(0, np.int64)
    raw, length = pieces.decoded(ids)
    bounds = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(sizes)])]
    out = []
    for k in range(len(lists)):
        text = raw[bounds[k] : bounds[k + 1]].tobytes()
        out.append(None if null[k] else (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


_encoders: dict[tuple, Encoder] = {}


def encode(docs: DataFrame, model: str = MODEL, algorithm: str = "viterbi", text: str = "text", into: str = "ids", check: str | None = None) -> DataFrame:
    """docs with the token ids of text; algorithm: viterbi or merges. check: a column that says whether
    decoding the ids gives the text, byte for byte; it is found in the same pass."""
    known = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def of(column: pa.Array) -> pa.Array:
        key = (model, algorithm)
        if key not in _encoders:
            _encoders[key] = Encoder(known.value, algorithm)
        return _encoders[key](column)

    rows = docs.withColumn("__encoded", arrow_once(of, "struct<ids: array<int>, ok: boolean>")(F.col(text))).withColumn(into, F.col("__encoded.ids"))
    return (rows.withColumn(check, F.col("__encoded.ok")) if check else rows).drop("__encoded")


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with the text of token ids."""
    known = rows.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def of(column: pa.Array) -> pa.Array:
        return decode_column(column, known.value)

    return rows.withColumn(into, arrow_once(of, "string")(F.col(ids)))
