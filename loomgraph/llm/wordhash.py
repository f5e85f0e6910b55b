"""Word and shingle hashes of whole Arrow string columns, as numpy vectors.

A word's hash is the difference of two prefix sums of a polynomial over its bytes, so a
slice of many documents is hashed without a Python step per word.  Texts are read from
Arrow's buffers in slices of about 256 KB; a longer text is cut at a word boundary,
so memory is bounded by a slice (or one word) plus 8 bytes a word of one document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[65:91] = _CODE[97:123]  # A-Z as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of words: all but ASCII white space; and letters, digits and non-ASCII (before or after lower-casing).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, _INVERSE)):
                steps = np.full(n, np.uint64(b))
                steps[0] = 1
                _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and offsets; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def _hash(b: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``b`` and the number of words that start before each offset of ``at``."""
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    m = is_word[b]
    cut = at[(at > 0) & (at < n)]
    opens, closes = m.copy(), m.copy()
    opens[1:] &= ~m[:-1]
    opens[cut] = m[cut]
    closes[:-1] &= ~m[1:]
    closes[cut - 1] = m[cut - 1]
    s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _table(max(n, SLICE))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[b] * power[:n], out=sums[1:])
        return mix((sums[e] - sums[s]) * inverse[s]), np.searchsorted(s, at)


def words(column: pa.Array, is_word: np.ndarray = NOT_SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first document, word hashes, offsets of documents in them) slice by slice."""
    data, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, side="right")) - 1)
        if at[j] - at[i] <= SLICE:
            h, starts = _hash(data[at[i] : at[j]], at[i : j + 1] - at[i], is_word)
            yield i, h, starts
        else:  # one long text, in pieces that end between words
            parts, a, end = [], int(at[i]), int(at[j])
            while a < end:
                size = SLICE
                while (b := min(a + size, end)) < end:
                    gaps = np.flatnonzero(~is_word[data[a:b]])
                    if len(gaps):
                        b = a + int(gaps[-1]) + 1
                        break
                    size *= 2
                parts.append(_hash(data[a:b], np.zeros(1, np.int64), is_word)[0])
                a = b
            h = np.concatenate(parts)
            yield i, h, np.array([0, len(h)])
        i = j


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence if it is shorter; none without words."""
    with np.errstate(over="ignore"):
        n = len(h)
        if n == 0:
            return h
        if n < k:
            return mix((h * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + _STEP[63] * np.uint64(n))
        out = h[: n - k + 1] * _STEP[0]
        for j in range(1, k):
            out = out + h[j : n - k + 1 + j] * _STEP[j]
        return mix(out)


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted without repeats."""
    s = np.sort(s)
    return s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))]


def trimmed(run):
    """``run`` for mapInArrow; at a task's end the worker, which waits for others, returns what was freed to the system."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)

    return whole
