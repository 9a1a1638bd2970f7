"""FM-index over integer sequences with a wavelet matrix, and matching statistics of many sequences at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with counts of ones before every 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """Counts of a symbol before a place, in one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        self.depth = max(1, int(top).bit_length())
        for bit in range(self.depth - 1, -1, -1):
            ones = (symbols >> bit) & 1
            self.levels.append((bit, Bits(ones)))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences before low, before high) of each symbol, up to a constant per symbol that :class:`Index` knows."""
        for bit, bits in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(high)
            low = np.where(one, bits.zeros + a, low - a)
            high = np.where(one, bits.zeros + b, high - b)
        return low, high


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        after = np.full(n, -1, dtype=np.int64)
        after[:-width] = rank[width:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        fresh = np.r_[False, key[order][1:] != key[order][:-1]]
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            break
        width *= 2
        if width >= n:
            break
    return order


class Index:
    """FM-index of sequences of positive numbers; 0 parts them and ends the text."""

    def __init__(self, sequences: np.ndarray, ends: np.ndarray):
        """``sequences`` lie one behind the other and end at ``ends``."""
        text = np.insert(sequences, ends, 0)
        self.names, text = np.unique(text, return_inverse=True)
        order = suffix_order(text)
        last = text[order - 1]
        self.tree = Wavelet(last, len(self.names) - 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.names)))])
        self.size = len(text)
        everything = np.arange(len(self.names))
        self.base = self.tree.ranks(everything, np.zeros_like(everything), np.zeros_like(everything))[0]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with ``symbol`` and go on as the given intervals."""
        a, b = self.tree.ranks(symbol, low, high)
        shift = self.first[symbol] - self.base[symbol]
        return a + shift, b + shift


def repeated_windows(index: Index, sequences: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Mask over the places of ``sequences``: a window of ``width`` starts there that the index holds twice or more.

    Each sequence is read from its end by backward search. While what was read occurs twice it is extended; when it does
    not, every window that holds it is unique, and reading starts again before its last symbol. Match lengths below the
    window are the matching statistics that are not reported.
    """
    found = np.zeros(len(sequences), dtype=bool)
    symbols = np.searchsorted(index.names, sequences)
    end, at = ends.copy(), ends - 1
    first = starts.copy()
    low, high = np.zeros_like(at), np.full_like(at, index.size)
    alive = np.flatnonzero(end - first >= width)
    end, at, first, low, high = end[alive], at[alive], first[alive], low[alive], high[alive]
    while len(at):
        a, b = index.extend(symbols[at], low, high)
        twice = b - a >= 2
        low, high = np.where(twice, a, 0), np.where(twice, b, index.size)
        whole = twice & (end - at >= width)
        found[at[whole]] = True
        fresh = np.minimum(end - 1, at + width)
        end = np.where(twice, end, fresh)
        at = np.where(twice, at - 1, end - 1)
        go = (at >= first) & (end - first >= width)
        end, at, first, low, high = end[go], at[go], first[go], low[go], high[go]
    return found
