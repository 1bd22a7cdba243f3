"""A compressed full-text index over numbers: backward search over a wavelet matrix of the Burrows-Wheeler text."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit row with counts of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class WaveletMatrix:
    """Counts of any symbol before any position of a row of numbers, one packed bit row a level."""

    def __init__(self, row: np.ndarray, symbols: int):
        self.levels = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bits = ((row >> shift) & 1).astype(bool)
            self.levels.append((shift, Bits(bits), int(len(row) - bits.sum())))
            row = np.concatenate([row[~bits], row[bits]])
        self.first = self._mapped(np.arange(symbols), np.zeros(symbols, np.int64))

    def _mapped(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def count(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._mapped(symbol, at) - self.first[symbol]


class FMIndex:
    """Intervals of patterns of up to `depth` symbols in a text of numbers below `symbols`.

    The text ends with 0, which no pattern holds.

    Suffixes are sorted by their first `depth` symbols, which is all that such patterns see. Neither the text
    nor its suffix array is kept.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        n = len(text)
        rank, length = text.astype(np.int64), 1
        while True:
            after = np.zeros(n, np.int64)
            if length < n:
                after[:-length] = rank[length:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            length *= 2
            if length >= depth or fresh[-1] == n - 1:
                break
            rank = np.empty(n, np.int64)
            rank[order] = fresh
        self.size = n
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]])
        self.wavelet = WaveletMatrix(text[order - 1], symbols)  # the first suffix is preceded by the last symbol

    def before(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns with one more symbol in front."""
        both = self.wavelet.count(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.smaller[symbol]
        return start + both[: len(symbol)], start + both[len(symbol) :]

    def reach(self, text: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
        """Matching statistics: for each range of `text` the smallest start >= first from which the text up to
        `last` (included) occurs `least` times or more; last + 1 if not even its last symbol does."""
        start = last + 1
        low, high = np.zeros(len(last), np.int64), np.full(len(last), self.size, np.int64)
        going = np.arange(len(last))
        while len(going):
            going = going[start[going] > first[going]]
            symbol = text[start[going] - 1]
            new_low, new_high = self.before(symbol, low[going], high[going])
            enough = new_high - new_low >= least
            going = going[enough]
            low[going], high[going] = new_low[enough], new_high[enough]
            start[going] -= 1
        return start
