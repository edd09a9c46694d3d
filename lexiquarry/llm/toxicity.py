"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all texts.
2. Passages that may hide a word - words with leetspeak, an inner mark or a
   doubled letter, and runs of short words - become character lattices whose
   arcs keep, replace or drop a character at a channel cost. A Viterbi search
   finds the likeliest reading under channel and model.
3. A text's words and the words restored from it are scored by logistic
   regression over hashed words and word beginnings.

Every other word has a lattice with a single path, so it is read as it is.
Blanks are in a lattice only between words of at most ``FRAGMENT`` letters and
digits, so a word parted into a longer piece and another is not rejoined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexiquarry.llm import ftrl, wordhash as W
from lexiquarry.llm.scratch import small_batches

PARAMS = ftrl.Params(bits=18, alpha=1.0, l1=3.0, epochs=8)
#: Labelled rows to learn from, at most.
SAMPLE = 6000
BEGINNINGS = (5, 6, 7)
#: Letters and digits of a short word, at most, and its characters.
FRAGMENT, FRAGMENT_CHARS = 3, 5

_LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
_ANY = "abcdefghijklmnopqrstuvwxyz"
_SYMBOLS = 28  # 0: a boundary, 1 to 26: a to z, 27: other letters
_CODE = {c: k + 1 for k, c in enumerate(_ANY)}
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27
_KIND = np.full(256, 2)
_KIND[[*range(97, 123), *range(128, 256)]] = 0
_KIND[48:58] = 1
_LETTER = _KIND == 0
_IS_LEET = np.zeros(256, bool)
_IS_LEET[[ord(c) for c in _LEET]] = True
# a mark, or the first byte of a character that may be one; C3 to CA begin Latin letters, and two signs
_IS_MARK = _KIND == 2
_IS_MARK[0xC2] = True
_IS_MARK[0xCB:] = True
_IS_CHAR = np.ones(256, bool)
_IS_CHAR[0x80:0xC0] = False


@W.released
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SYMBOLS**3, np.int64)
    for batch in batches:
        raw, offsets = W.texts(batch.column(0))
        for a, b in W.chunks(offsets):
            c = _CLASS[W.LOWER[raw[offsets[a] : offsets[b]]]]
            # two boundaries around each text
            at = np.arange(len(c)) + 2 * np.repeat(np.arange(1, b - a + 1), np.diff(offsets[a : b + 1]))
            line = np.zeros(len(c) + 2 * (b - a) + 2, np.int64)
            line[at] = c
            total += np.bincount((line[:-2] * _SYMBOLS + line[1:-1]) * _SYMBOLS + line[2:], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs, -ln p(c | a, b), as an array [a, b, c], from the trigrams of all texts."""
    rows = small_batches(docs.select(F.col("text").cast("string"))).mapInArrow(_counted, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(_SYMBOLS**3)
    for code, k in rows:  # at most 28 ** 3
        n[code] = k
    return costs(n.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS))


def costs(n: np.ndarray) -> np.ndarray:
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + _SYMBOLS)
    two = (n.sum(axis=0) + 20 * one) / (n.sum(axis=(0, 2))[:, None] + 20)
    return -np.log((n + 20 * two[None]) / (n.sum(axis=2)[:, :, None] + 20))


def _arcs(text: str, k: int) -> list[tuple[str, float]]:
    """Readings of character ``k``: what it stands for ("": nothing, " ": a boundary) and the channel's cost."""
    c = text[k]
    if c.isalpha():
        out = [(c, 0.0)]
        if k and text[k - 1] == c:
            run = (k > 1 and text[k - 2] == c) or text[k + 1 : k + 2] == c
            out.append(("", 0.4 if run else 4.0))
        return out
    inner = 0 < k < len(text) - 1
    if c in _LEET:
        ends = c == "!" and (k + 1 == len(text) or text[k + 1].isspace())
        return [(x, 0.5) for x in _LEET[c]] + [(" ", 1.0 if ends else 5.0)] + ([("", 7.0)] if inner else [])
    if inner and not c.isalnum():
        out = [("", 0.3), (" ", 1.0)]
        if c == "*" and text[k - 1].isalpha() and text[k + 1].isalpha():
            out += [(x, 3.0) for x in _ANY]  # may stand for any letter
        return out
    return [(" ", 0.2)]


def decode(text: str, cost: np.ndarray | list[float]) -> str:
    """The likeliest reading of a lower-case passage; words are split by single blanks. ``cost``: as an array, or its items in a list."""
    if not isinstance(cost, list):
        cost = cost.ravel().tolist()
    # a state is the last two symbols, as one number
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    last = ""
    for k, c in enumerate(text):
        after: dict[int, tuple[float, tuple | None]] = {}
        if c != last and c.isalpha():  # the one reading, as is
            x = _CODE.get(c, 27)
            for s, (total, path) in states.items():
                key, value = s % _SYMBOLS * _SYMBOLS + x, total + cost[s * _SYMBOLS + x]
                if key not in after or value < after[key][0]:
                    after[key] = (value, (path, c))
        else:
            arcs = [(r, channel, 0 if r in ("", " ") else _CODE.get(r, 27)) for r, channel in _arcs(text, k)]
            for s, (total, path) in states.items():
                b = s % _SYMBOLS
                for r, channel, x in arcs:
                    if r == "" or (r == " " and b == 0):
                        key, value, new = s, total + channel, path
                    else:
                        key, value, new = b * _SYMBOLS + x, total + channel + cost[s * _SYMBOLS + x], (path, r)
                    if key not in after or value < after[key][0]:
                        after[key] = (value, new)
        states, last = after, c
    _, path = min(((v + cost[s * _SYMBOLS], p) for s, (v, p) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out)).strip()


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, start and end of the passages that may hide a word, in lower-case bytes."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    starts, ends, first = W.spans(raw, offsets)
    if not len(starts):
        return none, none, none
    letter, char = _LETTER[raw], _IS_CHAR[raw]
    # marks between letters or digits of one word; those around it are boundaries in any reading
    mark, at = _IS_MARK[raw] & ~W.SPACE[raw], np.arange(n)
    solid = ~mark & ~W.SPACE[raw]
    begins, stops = np.zeros(n, np.int64), np.full(n, n)
    begins[starts], stops[ends - 1] = starts, ends
    before = np.maximum.accumulate(np.where(solid, at, -1)) >= np.maximum.accumulate(begins)
    behind = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1] < np.minimum.accumulate(stops[::-1])[::-1]
    hit = _IS_LEET[raw] | (mark & before & behind)
    hit[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    for k in range(1, min(4, n // 2) + 1):  # a letter of k bytes, twice
        same = raw[:-k] == raw[k:]
        twice = same[: n - 2 * k + 1].copy()
        for m in range(1, k):
            twice &= same[m : n - 2 * k + 1 + m]
        lead = raw[: len(twice)]
        hit[: len(twice)] |= twice & letter[: len(twice)] & ((lead < 0x80) if k == 1 else (lead >= 0xC0))
    # a match that begins in a text's last bytes can run into the next text; a lattice of that word alone is harmless
    word = np.unique(np.searchsorted(starts, np.flatnonzero(hit), side="right") - 1)
    # blanks before a text's first word belong to no word
    word = word[word >= 0]
    doc = np.searchsorted(first, word, side="right") - 1
    count = lambda what: (c := np.concatenate(([0], np.cumsum(what))))[ends] - c[starts]
    size = count((letter & char) | (raw >= 48) & (raw < 58))
    short = (size <= FRAGMENT) & (count(char) <= FRAGMENT_CHARS) & (count(letter | _IS_LEET[raw]) > 0)
    edge = np.zeros(len(starts) + 1, bool)
    edge[first] = True
    begin = np.flatnonzero(short & (np.concatenate(([True], ~short[:-1])) | edge[:-1]))
    end = np.flatnonzero(short & (np.concatenate((~short[1:], [True])) | edge[1:]))
    run = end > begin
    begin, end = begin[run], end[run]
    doc = np.concatenate((doc, np.searchsorted(first, begin, side="right") - 1))
    return doc, np.concatenate((starts[word], starts[begin])), np.concatenate((ends[word], ends[end]))


class Features:
    """The featuriser; a task remembers readings, and forgets them when there are many."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.astype(np.float32)
        self.items: list[float] = []
        self.read: dict[bytes, bytes] = {}

    def __getstate__(self):
        return {"cost": self.cost, "items": [], "read": {}}

    def restored(self, piece: bytes) -> bytes:
        out = self.read.get(piece)
        if out is None:
            if len(self.read) > 100_000:
                self.read.clear()
            self.items = self.items or self.cost.ravel().tolist()
            out = decode(piece.decode("utf-8", "replace"), self.items).encode()
            if len(piece) <= 256:
                self.read[piece] = out
        return out

    def _words(self, raw, offsets):
        starts, ends, first = W.spans(raw, offsets, _KIND)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        ok = _LETTER[raw[starts]]
        return starts[ok], ends[ok], doc[ok]

    def _hashed(self, raw, starts, ends, doc):
        value, docs = [W.hashes(raw, starts, ends)], [doc]
        for k in BEGINNINGS:
            ok = ends - starts > k
            value.append(W.mix(W.hashes(raw, starts[ok], starts[ok] + k)))
            docs.append(doc[ok])
        return np.concatenate(value), np.concatenate(docs)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = W.LOWER[raw]
        words = self._words(raw, offsets)
        where, begin, end = passages(raw, offsets)
        if len(where):
            # what a passage is read as stands in place of its words
            depth = np.bincount(begin, minlength=len(raw) + 1) - np.bincount(end, minlength=len(raw) + 1)
            free = np.cumsum(depth)[words[0]] == 0
            words = tuple(w[free] for w in words)
        value, doc = self._hashed(raw, *words)
        if len(where):
            # each passage once a text
            _, one = np.unique(W.mix(W.hashes(raw, begin, end) + W.mix(where.astype(np.uint64))), return_index=True)
            where, begin, end = where[one], begin[one], end[one]
            pieces = [self.restored(raw[a:b].tobytes()) for a, b in zip(begin, end, strict=True)]
            cut = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
            more = np.frombuffer(b"".join(pieces), np.uint8)
            v, d = self._hashed(more, *self._words(more, cut))
            value, doc = np.concatenate((value, v)), np.concatenate((doc, where[d]))
        doc, bucket, _ = ftrl.summed(doc, value & np.uint64((1 << PARAMS.bits) - 1), PARAMS.bits)
        return doc, bucket, np.ones(len(doc))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Features, np.ndarray]:
    """Featuriser and weights, from the ``toxic`` of labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    features = Features(language_model(docs))
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", F.col("toxic").alias("label"))
    return features, ftrl.fit(docs, known, features, PARAMS, SAMPLE)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier) and predicted for each row of ``docs``.

    Null and empty texts have no words and get the score of the bias alone.
    Repeated rows are scored alike; a null doc_id is kept, not held out. Other
    columns are ignored. An empty table gives an empty result, and without
    usable labels every score is 0.5.
    """
    features, weights = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = ftrl.score(rows, features, weights, "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
