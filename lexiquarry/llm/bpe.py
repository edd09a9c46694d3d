"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree hold ``rank * n + position`` of each adjacent pair,
so the root is the leftmost pair of lowest rank. A merge joins two symbols,
which changes at most three leaves: the merged pair and its two neighbours;
each is a logarithmic point update. Encoding ends when the root is empty.

Words of up to ``SMALL`` bytes are encoded many at a time, their trees being
the rows of one array, set right level by level; longer ones have a tree of their
own. Words repeat a
lot, so a task remembers what it encoded, in two halves of ``REMEMBERED`` bytes
together and of words of at most ``SHORT`` characters: when the newer half is
full the older one is dropped, and words met again move to the newer. Memory
follows neither the vocabulary of the corpus nor texts without blanks, and a
worker that waits holds the vocabulary file alone.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from lexiquarry.llm import wordhash as W
from lexiquarry.llm.scratch import small_batches

SMALL = 32
REMEMBERED, SHORT = 48 << 20, 64
_BLANK = "\t-\r \x85\xa0  -     　"
#: The pattern of byte-level BPE, with Unicode's White_Space spelt out.
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: A blank beside more white space: only then do the parts of a text between blanks depend on each other.
_TANGLED = regex.compile(rf" [{_BLANK}]|[{_BLANK}] ")
_DOUBLE = ["  ", *(x for c in "\t\n\r\x0b\x0c" for x in (f" {c}", f"{c} "))]
_RARE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Below it str.isalpha and \p{L} agree in any version of Unicode.
_LATIN = "\u0250"
_NONE = np.int32(1 << 30)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies -> bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Model:
    """A vocabulary file of the ``tokenizers`` library: byte-level BPE without normaliser."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * self.size
        for t, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self._bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self._sizes = np.fromiter(map(len, self.token_bytes), np.int64, self.size)
        self._starts = np.cumsum(self._sizes) - self._sizes
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.pairs = pairs
        # open addressing, so that many pairs are looked up at once
        bits = 18
        self._mask = (1 << bits) - 1
        self._key = np.full(1 << bits, -1, np.int64)
        self._rank = np.full(1 << bits, -1, np.int64)
        self._made_of = np.zeros(len(spec["model"]["merges"]), np.int64)
        self._probes = 1
        for (a, b), (rank, made) in pairs.items():
            key = a * self.size + b
            h, k = self._slot(key), 0
            while self._key[(h + k) & self._mask] >= 0:
                k += 1
            self._probes = max(self._probes, k + 1)
            at = (h + k) & self._mask
            self._key[at], self._rank[at], self._made_of[rank] = key, rank, made
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.past_first: dict[str, bytes] = {}
        self.past_later: dict[str, bytes] = {}
        self.held = 0

    def _slot(self, key):
        return ((key * 0x9E3779B1) >> 15) & self._mask

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of pairs, or -1."""
        key = a * self.size + b
        at = self._slot(key)
        rank = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        for _ in range(self._probes):
            have = self._key[at[todo]]
            hit = have == key[todo]
            rank[todo[hit]] = self._rank[at[todo[hit]]]
            todo = todo[~hit & (have >= 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self._mask
        return rank

    def encode_long(self, piece: bytes) -> list[int]:
        """One word, by a tree of its own."""
        n = len(piece)
        if n < 2:
            return [int(self.of_byte[b]) for b in piece]
        pairs, ids = self.pairs, [int(self.of_byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        leaves = 1 << (n - 1).bit_length()
        none = 1 << 62
        tree = [none] * (2 * leaves)

        def leaf(i: int) -> int:
            j = after[i]
            got = pairs.get((ids[i], ids[j])) if j < n else None
            return none if got is None else got[0] * n + i

        for i in range(n):
            tree[leaves + i] = leaf(i)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def update(i: int, value: int) -> None:
            k = leaves + i
            tree[k] = value
            k >>= 1
            while k:
                value = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == value:
                    break
                tree[k] = value
                k >>= 1

        while tree[1] < none:
            i = tree[1] % n
            j = after[i]
            ids[i] = pairs[(ids[i], ids[j])][1]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            update(j, none)
            update(i, leaf(i))
            if before[i] >= 0:
                update(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of words of at most ``SMALL`` bytes: one tree a row."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for low, n in ((0, 4), (4, 8), (8, 16), (16, SMALL)):
            group = np.flatnonzero((sizes > low) & (sizes <= n))
            for g in range(0, len(group), 20_000):
                rows = group[g : g + 20_000]
                for r, ids in zip(rows, self._trees([pieces[r] for r in rows], sizes[rows], n), strict=True):
                    out[r] = ids
        return out

    def _trees(self, pieces: list[bytes], sizes: np.ndarray, n: int) -> list[bytes]:
        """Words of at most ``n`` bytes. A round makes one merge in every word, so the trees are set right level by level, all rows at once."""
        m = len(pieces)
        raw = np.frombuffer(b"".join([p.ljust(n, b"\0") for p in pieces]), np.uint8).reshape(m, n)
        col = np.arange(n)
        ids = self.of_byte[raw]
        there = col < sizes[:, None]
        # column n stands for the end of a word, and for what is before its start
        after = np.tile(np.minimum(col + 1, n), (m, 1))
        after[np.arange(m), sizes - 1] = n
        before = np.tile(np.append((col - 1) % (n + 1), n), (m, 1))
        leaves = np.full((m, n + 1), _NONE, np.int32)
        r, c = np.nonzero(there[:, 1:])
        rank = self._look(ids[r, c], ids[r, c + 1])
        leaves[r, c] = np.where(rank >= 0, rank * n + c, _NONE)
        out, kept = np.empty_like(ids), np.empty_like(there)
        own = np.arange(m)  # where the rows at work belong
        while True:
            level = leaves[:, :n]
            while level.shape[1] > 1:
                level = np.minimum(level[:, ::2], level[:, 1::2])
            root = level[:, 0]
            live = np.flatnonzero(root < _NONE)
            if 2 * len(live) < len(root) or not len(live):
                ended = np.flatnonzero(root == _NONE)
                out[own[ended]], kept[own[ended]] = ids[ended], there[ended]
                if not len(live):
                    break
                ids, there, after, before, leaves, root, own = (x[live] for x in (ids, there, after, before, leaves, root, own))
                live = np.arange(len(own))
            best = root[live].astype(np.int64)
            i = best % n
            j = after[live, i]
            nxt, prev = after[live, j], before[live, i]
            ids[live, i] = made = self._made_of[best // n]
            there[live, j] = False
            after[live, i] = nxt
            before[live, nxt] = i
            leaves[live, j] = _NONE
            ahead, back = np.flatnonzero(nxt < n), np.flatnonzero(prev < n)
            left = np.concatenate((made[ahead], ids[live[back], prev[back]]))
            right = np.concatenate((ids[live[ahead], nxt[ahead]], made[back]))
            rank = self._look(left, right)
            at = np.concatenate((i[ahead], prev[back]))
            value = np.where(rank >= 0, rank * n + at, _NONE)
            leaves[live, i] = _NONE
            leaves[np.concatenate((live[ahead], live[back])), at] = value
        flat = out[kept].astype("<u4").tobytes()
        cut = (np.concatenate(([0], np.cumsum(kept.sum(axis=1)))) * 4).tolist()
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids, by trees."""
        raw = [p.encode() for p in pieces]
        out = [b""] * len(raw)
        short = [k for k, p in enumerate(raw) if len(p) <= SMALL]
        for k, ids in zip(short, self.encode_many([raw[k] for k in short]), strict=True):
            out[k] = ids
        for k, p in enumerate(raw):
            if len(p) > SMALL:
                out[k] = np.array(self.encode_long(p), "<u4").tobytes()
        return out

    def _learn(self, units: list[str], into: dict[str, bytes], blank: str) -> None:
        """Encode units - a blank or nothing, then text - and remember them."""
        odd, words = [], []
        for u in units:
            # the blank, if any, and Latin letters are one piece
            (words if u.isalpha() and (u.isascii() or max(u) < _LATIN) else odd).append(u)
        into.update(zip(words, self._fresh([blank + u for u in words]), strict=True))
        if not odd:
            return
        split = [_PIECE.findall(blank + u) for u in odd]
        ids: dict[str, bytes] = {}
        for p in {p for ps in split for p in ps}:
            # a piece that was a unit of its own
            if p[0] == " ":
                got = self.later.get(p[1:]) or self.past_later.get(p[1:])
            else:
                got = self.first.get(p) or self.past_first.get(p)
            ids[p] = got or b""
        fresh = [p for p, x in ids.items() if not x]
        ids.update(zip(fresh, self._fresh(fresh), strict=True))
        for u, ps in zip(odd, split, strict=True):
            into[u] = ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps])

    def _plain(self, text: str) -> list[tuple[dict, list[str]]]:
        """Where to look up the parts of a text without special tokens, and the parts."""
        if any(map(text.__contains__, _DOUBLE)) or (not text.isascii() and any(map(text.__contains__, _RARE)) and _TANGLED.search(text)):
            return [(self.first, _PIECE.findall(text))]
        units = text.split(" ")
        if not units[0]:
            return [(self.later, units[1:])]
        return [(self.first, units[:1]), (self.later, units[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if 2 * self.held > REMEMBERED:
            self._age()
        plans = []
        for t in texts:
            plan = []
            if self._special is not None and self._special.search(t):
                for part in self._special.split(t):
                    if part in self.special:
                        plan.append((None, np.array([self.special[part]], "<u4").tobytes()))
                    elif part:
                        plan += self._plain(part)
            elif t:
                plan = self._plain(t)
            plans.append(plan)
        long: list[tuple[dict, str]] = []
        for table, past, blank in ((self.first, self.past_first, ""), (self.later, self.past_later, " ")):
            seen: set[str] = set()
            for plan in plans:
                for t, us in plan:
                    if t is table:
                        seen.update(us)
            if new := seen.difference(table):
                again = new.intersection(past)
                table.update((u, past[u]) for u in again)
                self._learn(list(new - again), table, blank)
                long += [(table, u) for u in new if len(u) > SHORT]
                # as CPython holds them: two objects and their place in a table
                short = [u for u in new if len(u) <= SHORT]
                self.held += 232 * len(short) + sum(map(len, short)) + sum(map(len, map(table.__getitem__, short)))
        out = [b"".join([us if t is None else b"".join(map(t.__getitem__, us)) for t, us in plan]) for plan in plans]
        for table, u in long:
            del table[u]
        return out

    def _age(self) -> None:
        """Forget what was not met since this was last done."""
        self.past_first, self.first = self.first, {}
        self.past_later, self.later = self.later, {}
        self.held = 0

    def forget(self) -> None:
        for table in (self.first, self.later, self.past_first, self.past_later):
            table.clear()
        self.held = 0

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD, as in a lossy conversion."""
        tokens, parts = np.frombuffer(ids, "<u4"), []
        for a in range(0, len(tokens), 1 << 15):
            t = tokens[a : a + (1 << 15)]
            sizes = self._sizes[t]
            ends = np.cumsum(sizes)
            parts.append(self._bytes[np.repeat(self._starts[t] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(parts).decode("utf-8", "replace").encode()


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model of a file, read once a worker."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _groups(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    size = a = 0
    sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for b, n in enumerate(sizes):
        if size and size + n > most:
            yield a, b
            a, size = b, 0
        size += int(n)
    if a < len(sizes):
        yield a, len(sizes)


def _run(path: str, digests: bool):
    @W.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        gc.disable()  # nothing here makes cycles, and each collection would walk what is remembered
        try:
            yield from encoded(m, batches)
        finally:
            m.forget()
            gc.enable()

    def encoded(m: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in _groups(column):
                part = batch.slice(a, b - a)
                ids = m.encode([t or "" for t in part.column("text").to_pylist()])
                count = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    back = [hashlib.sha256(m.decode(x)).hexdigest() for x in ids]
                    cols = [part.column("doc_id"), count, pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(back)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), count, lists, pa.array([m.decode(x).decode() for x in ids])], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def _input(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and the text decoded from them, for each row of ``docs``.

    ``path``: a byte-level BPE file of the ``tokenizers`` library, present on
    every executor. Encoding is that library's with add_special_tokens=False,
    decoding that with skip_special_tokens=False. A null text counts as empty:
    no ids, decoded to the empty text. Repeated rows and null ids are returned
    as they come; other columns are ignored; an empty table stays empty.
    """
    return small_batches(_input(docs)).mapInArrow(_run(path, False), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests in place of ids and decoded text."""
    return small_batches(_input(docs)).mapInArrow(_run(path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
