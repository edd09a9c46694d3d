"""Vectorised word and shingle hashing over Arrow string columns.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. A batch of
texts is hashed in a fixed number of passes over its UTF-8 buffer, without a
Python object per word. Chunks hold about ``CHUNK`` bytes, or one text if that
is longer, so memory follows the longest text and not the batch.

Null texts count as empty: they have no words.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19

_U = np.uint64
_RADIX = _U(0x9E3779B97F4A7C15 | 1)
_RADIX_INV = _U(pow(int(_RADIX), -1, 1 << 64))
_PAIR = _U(0xC2B2AE3D27D4EB4F)
_LONE = _U(0x165667B19E3779F9)

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE64 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function of batches that gives freed memory back at its end, since a worker waits for the next task, or another stage's, as it is."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, 2 * CHUNK), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 2 * CHUNK:
            _powers[name] = have
    return have[:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` bytes, or one longer text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def spans(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each text's first word.

    ``apart``: optional byte classes; a word also ends where the class changes.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    np.copyto(first[1:], space[:-1])
    if apart is not None:
        kind = apart[raw]
        first[1:] |= kind[1:] != kind[:-1]
    inner = offsets[:-1]
    first[inner[inner < len(raw)]] = True
    first &= ~space
    starts = np.flatnonzero(first)
    last = np.empty(len(raw), bool)
    last[-1] = True
    np.copyto(last[:-1], space[1:])
    if apart is not None:
        last[:-1] |= kind[1:] != kind[:-1]
    last[inner[inner > 0] - 1] = True
    last &= ~space
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(raw)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE64[raw] * _power("up", _RADIX, n), out=total[1:])
    value = (total[ends] - total[starts]) * _power("down", _RADIX_INV, n)[starts]
    return mix(value + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, first: np.ndarray, n: int, lone: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles in text order, and each text's first shingle.

    A text with 1 to n - 1 words has its whole word sequence as the only
    shingle if ``lone``, else none.
    """
    counts = np.diff(first)
    m = np.maximum(counts - (n - 1), 0)
    short = np.flatnonzero((counts > 0) & (m == 0)) if lone else np.zeros(0, np.int64)
    total = len(words)
    if total >= n:
        value = words[: total - n + 1].copy()
        for k in range(1, n):
            value *= _PAIR
            value += words[k : total - n + 1 + k]
        value = mix(value)
    else:
        value = np.zeros(0, np.uint64)
    sizes = m.copy()
    sizes[short] = 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    pos = np.repeat(first[:-1] - at[:-1], sizes) + np.arange(at[-1])
    if len(short):
        out = np.zeros(at[-1], np.uint64)
        whole = np.ones(at[-1], bool)
        whole[at[short]] = False
        out[whole] = value[pos[whole]]
        for i in short:
            x = np.array([len(words[first[i] : first[i + 1]])], np.uint64) * _LONE
            for w in words[first[i] : first[i + 1]]:
                x = mix(x * _PAIR + w)
            out[at[i]] = x[0]
        return out, at
    return value[pos], at
