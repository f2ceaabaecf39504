"""A compressed FM-index over words: the Burrows-Wheeler transform in a wavelet matrix of packed bits, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first depth symbols or more, by doubling; ties stay in the order of the text."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        if k >= depth or int(rank.max(initial=0)) == n - 1:
            return np.argsort(rank, kind="stable")
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        k *= 2


class WaveletMatrix:
    """rank queries on a sequence of symbols below 2 ** levels; one packed bit a symbol and level, and a count for each 64 of them."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n, self.levels = len(symbols), max(1, int(top).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for level in reversed(range(self.levels)):
            bits = ((now >> level) & 1).astype(np.uint8)
            packed = np.packbits(bits, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])[:-1])
            self.zeros.append(self.n - int(bits.sum()))
            one = bits.astype(bool)
            now = np.concatenate([now[~one], now[one]])

    def mapped(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """at[i] carried through the levels along symbols[i]; the difference from position 0 carried alike is the rank."""
        for k, level in enumerate(reversed(range(self.levels))):
            block = at >> 6
            ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            at = np.where((symbols >> level) & 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Backward search over a text of symbols from 0 up. depth: the longest pattern that will be searched."""

    def __init__(self, text: np.ndarray, depth: int):
        order = suffix_order(text, depth)
        top = int(text.max(initial=0))
        self.n = len(text)
        self.bwt = WaveletMatrix(text[order - 1], top)
        count = np.bincount(text, minlength=top + 1)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        symbols = np.arange(top + 1)
        # where a symbol's suffixes begin, less what position 0 is carried to
        self.base = first - self.bwt.mapped(symbols, np.zeros(top + 1, np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of the patterns with a symbol put before each."""
        both = self.bwt.mapped(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.base[symbols]
        return base + both[: len(symbols)], base + both[len(symbols) :]

    def reach(self, text: np.ndarray, end: np.ndarray, least: np.ndarray, often: int = 2) -> np.ndarray:
        """For each end the start of the longest match text[start:end] with start >= least that occurs `often` times or more; end itself if no symbol does."""
        start = end.copy()
        live = np.flatnonzero(start > least)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        while len(live):
            low, high = self.extend(text[start[live] - 1], low, high)
            good = high - low >= often
            live, low, high = live[good], low[good], high[good]
            start[live] -= 1
            on = start[live] > least[live]
            live, low, high = live[on], low[on], high[on]
        return start


def repeated_windows(segments: list[np.ndarray], copies: list[int], width: int) -> list[np.ndarray]:
    """For each segment, whether the window of width symbols at each start occurs twice or more in all segments with their copies.

    Symbols are 1 and up. Matching statistics by backward search: from the right end as far left as the match occurs
    twice, which settles all windows inside at once; and from the leftmost open window, where a mismatch rules out all
    windows that contain it.
    """
    if not segments:
        return []
    mark = np.zeros(1, np.int64)
    parts, begin, at = [], [], 0
    for s, c in zip(segments, copies, strict=True):
        begin.append(at)
        for _ in range(min(2, c)):
            parts += [s, mark]
            at += len(s) + 1
    text = np.concatenate(parts)
    size = np.array([len(s) for s in segments], np.int64)
    index = FMIndex(text, int(size.max()) + 1)
    first = np.array(begin, np.int64)
    hit = np.zeros(int(size.sum()) + 1, np.int64)  # differences of flags over the segments' own positions, joined
    place = np.concatenate([[0], np.cumsum(size)[:-1]])
    left, right = first.copy(), first + size  # open windows lie in text[left:right]
    live = np.flatnonzero(right - left >= width)
    while len(live):
        start = index.reach(text, right[live], left[live])
        found = right[live] - start >= width
        a, b = start[found] - first[live[found]], right[live[found]] - first[live[found]] - width + 1
        np.add.at(hit, place[live[found]] + a, 1)
        np.add.at(hit, place[live[found]] + b, -1)
        right[live] = np.where(found, start - 1 + width, right[live] - 1)
        live = live[right[live] - left[live] >= width]
        if not len(live):
            break
        end = left[live] + width
        start = index.reach(text, end, left[live])
        found = start <= left[live]
        np.add.at(hit, place[live[found]] + left[live[found]] - first[live[found]], 1)
        np.add.at(hit, place[live[found]] + left[live[found]] - first[live[found]] + 1, -1)
        left[live] = np.where(found, left[live] + 1, start)
        live = live[right[live] - left[live] >= width]
    flags = np.cumsum(hit[:-1]) > 0
    return [flags[p : p + max(0, n - width + 1)] for p, n in zip(place, size, strict=True)]
