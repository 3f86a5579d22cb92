"""An FM-index over integer symbols: backward search on a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with ranks: one count a 64-bit word, and a population count."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        self.words = np.append(np.frombuffer(np.pad(packed, (0, -len(packed) % 8)).tobytes(), "<u8"), np.uint64(0))
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64))
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, low = at >> 6, (at & 63).astype(np.uint64)
        kept = self.words[word] & ((np.uint64(1) << low) - np.uint64(1))
        return self.before[word] + np.bitwise_count(kept)


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels, self.zeros = [], []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(len(now) - self.levels[-1].ones)
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        # Where the block of each symbol begins in the last order.
        self.first = np.full(size, len(now), np.int64)
        symbols, starts = np.unique(now, return_index=True)
        self.first[symbols] = starts

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is before each place."""
        at = at.copy()
        for k, level in enumerate(range(self.depth - 1, -1, -1)):
            one = (symbol >> level) & 1 == 1
            ones = self.levels[k].rank(at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at - self.first[symbol]


class FMIndex:
    """Of passages over an alphabet of 32-bit words, searched for patterns of up to ``longest`` words.

    Suffixes are sorted by their first ``longest`` words (at least), which is all that backward
    search of such patterns needs.
    """

    def __init__(self, passages: list[np.ndarray], longest: int):
        gap = np.zeros(1, np.int64)
        self.words = np.unique(np.concatenate(passages)) if passages else np.zeros(0, np.uint32)
        parts = [x for p in passages for x in (np.searchsorted(self.words, p) + 1, gap)]
        text = np.concatenate([gap, *parts]).astype(np.int64)
        rank, width = text, 1
        while width < longest:
            after = np.append(rank[width:], np.zeros(min(width, len(rank)), np.int64))[: len(rank)]
            _, rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        size = len(self.words) + 1
        self.starts = np.append(0, np.cumsum(np.bincount(text, minlength=size)))
        self.bwt = WaveletMatrix(text[self.suffixes - 1], size)
        self.length = len(text)

    def matching(self, text: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics, up to ``threshold``: how many words that end at each of ``ends`` are found
        together in the index, and the interval of suffixes that begin with them."""
        place = np.minimum(np.searchsorted(self.words, text), max(len(self.words) - 1, 0))
        symbol = np.where(self.words[place] == text, place + 1, 0) if len(self.words) else np.zeros(len(text), np.int64)
        found, low, high = (np.zeros(len(ends), np.int64) for _ in range(3))
        open_, lo, hi = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), self.length, np.int64)
        for step in range(threshold):
            at = ends[open_] - step
            c = np.where(at >= 0, symbol[at], 0)
            lo, hi = self.starts[c] + self.bwt.rank(c, lo), self.starts[c] + self.bwt.rank(c, hi)
            on = (c > 0) & (hi > lo)
            open_, lo, hi = open_[on], lo[on], hi[on]
            found[open_], low[open_], high[open_] = step + 1, lo, hi
            if not len(open_):
                break
        return found, low, high
