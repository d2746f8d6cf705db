"""A compressed FM-index: the Burrows-Wheeler transform of a shard's texts in a wavelet matrix of packed bits.

Texts are streamed through it by backward search, many at once: each step prepends one symbol to every text's current
match and narrows its interval. A match of full length first drops its last symbol, which widens the interval to that
of the shorter match. The length of a match, capped at the threshold, is the matching statistic of its first position.
"""

from __future__ import annotations

import secrets

import numpy as np

from .common import window_hash


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; the last symbols of the texts are distinct, so this ends with the longest repeat."""
    order = np.argsort(codes, kind="stable")
    n = len(codes)
    rank = np.empty(n, np.int64)
    s = codes[order]
    rank[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
    step = 1
    while n and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[:-step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
        step *= 2
    return order


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, from the highest, one packed row with counts every 64 places."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.rows = []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1 > 0
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.append(0, np.cumsum(np.bitwise_count(words)))[:-1].astype(np.int64)
            zeros = int(len(bit) - bit.sum())
            self.rows.append((b, words, counts, zeros))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def trace(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place ``at`` of the first row ends up among the last row's, following each symbol's bits."""
        for b, words, counts, zeros in self.rows:
            block = at >> 6
            below = words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[block] + np.bitwise_count(below)
            at = np.where((symbol >> b) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """An index of texts of symbols (uint64), given one after another with their offsets."""

    def __init__(self, values: np.ndarray, offs: np.ndarray):
        self.texts = len(offs) - 1
        distinct, code = np.unique(values, return_inverse=True)
        self.offs = offs
        # Each text is followed by an end symbol of its own; the ends are the least symbols.
        ends = offs[1:] + np.arange(self.texts)
        codes = np.empty(len(values) + self.texts, np.int64)
        inner = np.ones(len(codes), bool)
        inner[ends] = False
        codes[inner] = code + self.texts
        codes[ends] = np.arange(self.texts)
        self.codes, self.starts = codes, offs[:-1] + np.arange(self.texts)
        self.order = suffix_array(codes)
        last = codes[self.order - 1]
        last = np.where(last < self.texts, 0, last - self.texts + 1)  # no search goes past a text's start
        self.bits = max(1, int(len(distinct)).bit_length())
        self.wavelet = Wavelet(last, self.bits)
        # Before each symbol: the suffixes that begin with a smaller one, and its first place in the last row.
        self.smaller = self.texts + np.append(0, np.cumsum(np.bincount(code, minlength=len(distinct))))
        symbols = np.arange(1, len(distinct) + 1)
        self.base = self.smaller[:-1] - self.wavelet.trace(symbols, np.zeros(len(distinct), np.int64))

    def shorter(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix, by rank, the interval of those that share its first ``length`` symbols."""
        n = len(self.order)
        whole = self.order + length <= n
        h = np.append(window_hash(self.codes.astype(np.uint64), length, secrets.randbits(64)), np.zeros(min(length - 1, n), np.uint64))[self.order]
        new = np.ones(n + 1, bool)
        new[1:-1] = (h[1:] != h[:-1]) | ~whole[1:] | ~whole[:-1]
        edges = np.flatnonzero(new)
        block = np.cumsum(new[:-1]) - 1
        return edges[block], edges[block + 1]

    def widths(self, window: int) -> np.ndarray:
        """For every place of every text that has ``window`` symbols from it on, in order, how often those occur in all texts."""
        low34, high34 = self.shorter(window - 1)
        n = np.diff(self.offs)
        most = int(n.max(initial=0))
        # Longest first, so that the texts still running are always the first few.
        order = np.argsort(-n, kind="stable")
        length = n[order]
        start = self.starts[order]
        low, high = np.zeros(self.texts, np.int64), np.full(self.texts, len(self.codes), np.int64)
        out_n = np.maximum(length - window + 1, 0)
        out_at = np.empty(self.texts, np.int64)
        out_at[order] = out_n
        out_at = (np.cumsum(out_at) - out_at)[order]
        out = np.zeros(int(out_n.sum()), np.int64)
        for step in range(1, most + 1):
            k = int(np.searchsorted(-length, -step, side="right"))  # texts of at least ``step`` symbols
            lo, hi = low[:k], high[:k]
            if step > window:
                lo, hi = low34[lo], high34[lo]
            symbol = self.codes[start[:k] + length[:k] - step] - self.texts
            place = self.wavelet.trace(np.concatenate([symbol, symbol]) + 1, np.concatenate([lo, hi])) + np.tile(self.base[symbol], 2)
            low[:k], high[:k] = place[:k], place[k:]
            if step >= window:
                out[out_at[:k] + length[:k] - step] = high[:k] - low[:k]
        return out


def repeats(values: np.ndarray, offs: np.ndarray, window: int) -> np.ndarray:
    """Whether each window of the texts occurs in more than one place of the shard."""
    return FMIndex(values, offs).widths(window) > 1
