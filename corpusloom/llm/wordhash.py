"""64-bit hashes of the words of many texts at once, in numpy on Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in one numpy step; a longer text is a step of its own.
STEP_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RANDOM = np.random.default_rng(20240601)
_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODES[_SPACE] = 0
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _CODES[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _STEP, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _STEP, np.uint64))
    return _POWERS


def hash_words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte of each word; number of the first word of each text and at last the count).

    data: the bytes of all texts; offsets: where each begins, and the end. fold: A-Z count as a-z.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = ~space
    begins[1:] &= space[:-1] | first[1:n]
    last = ~space
    last[:-1] &= space[1:] | first[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(offsets), np.int64)
    number = np.cumsum(begins) - 1
    at = np.arange(n) - starts[np.maximum(number, 0)]
    longest = int((ends - starts).max())
    np.clip(at, 0, longest, out=at)  # spaces, whose code is 0
    values = (_FOLDED if fold else _CODES)[data] * _powers(longest + 1)[at]
    return mix(np.add.reduceat(values, starts)), starts, ends, np.searchsorted(starts, offsets)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; those across two texts are to be left out by the caller."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(out)


def steps(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) for runs of texts of about STEP_BYTES; null texts are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(column):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + STEP_BYTES, "right")) - 1)
        yield k, flat[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k]
        k = end
