"""Token counts under a unigram vocabulary, without the tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; a
Viterbi pass over their ends carries the best score and the number of pieces
on that path. Ties follow the ``tokenizers`` library's Unigram model: among
paths of equal score to a position, the one whose last piece starts first. A
character without a piece of its own costs the lowest score less 10; it counts
as its UTF-8 bytes under byte fallback, else a run of such characters as one.

Words are split before each blank, as by Metaspace with a blank put in front.
A worker remembers the counts of up to ``REMEMBERED`` words of at most ``SHORT``
characters, then starts afresh.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiquarry.llm import wordhash as W
from lexiquarry.llm.scratch import small_batches

REMEMBERED, SHORT = 500_000, 64
_BLANK = "▁"
UNKNOWN_PENALTY = 10.0


class Counter(dict):
    """word -> number of pieces; missing words are worked out."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        super().__init__()
        self.fallback = byte_fallback and all(any(p == f"<0x{b:02X}>" for p, _ in pieces) for b in (0, 255))
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()

    def __missing__(self, word: str) -> int:
        out = self.count(_BLANK + word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out

    def count(self, text: str) -> int:
        n = len(text)
        best, pieces, unknown = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        single = [False] * (n + 1)
        done = 0
        matches = self.automaton.iter(text)
        pending = next(matches, None)
        while done < n:
            end = done + 1
            # matches with this end, longest first
            while pending is not None and pending[0] + 1 == end:
                size, score = pending[1]
                total = best[end - size] + score
                if best[end] is None or total > best[end]:
                    best[end], pieces[end] = total, pieces[end - size] + 1
                single[end] = single[end] or size == 1
                pending = next(matches, None)
            if not single[end]:
                total = best[done] + self.unknown
                if best[end] is None or total > best[end]:
                    best[end], unknown[end] = total, True
                    if self.fallback:
                        pieces[end] = pieces[done] + len(text[done].encode("utf-8", "replace"))
                    else:
                        pieces[end] = pieces[done] + (not unknown[done])
            done = end
        return pieces[n]


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


_counters: dict[tuple[str, bool], Counter] = {}


def counter(path: str, byte_fallback: bool) -> Counter:
    key = (path, byte_fallback)
    if key not in _counters:
        _counters[key] = Counter(vocabulary(path), byte_fallback)
    return _counters[key]


def count_text(c: Counter, text: str | None) -> int:
    if not text:
        return 0
    words = text.split(" ")
    if text[0] == " ":
        words = words[1:]
    return sum(map(c.__getitem__, words))


def _run(path: str, byte_fallback: bool):
    @W.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, byte_fallback)
        gc.disable()  # nothing here makes cycles
        try:
            for batch in batches:
                n = [count_text(c, t.as_py()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])
        finally:
            gc.enable()

    return run


def token_counts(docs: DataFrame, path: str, byte_fallback: bool = True) -> DataFrame:
    """doc_id and n_tokens for each row of ``docs``.

    ``path``: a SentencePiece file, present on every executor, whose pieces and
    scores are taken as the unigram vocabulary. Null and empty texts have no
    tokens. Repeated rows and null ids are returned as they come; other columns
    are ignored; an empty table stays empty.
    """
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return small_batches(rows).mapInArrow(_run(path, byte_fallback), "doc_id long, n_tokens long")
