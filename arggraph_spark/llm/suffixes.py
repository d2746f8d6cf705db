"""A logarithmic family of suffix arrays.

A new batch of texts gets a suffix array. It is located in every existing level by a vectorised binary search, eight
bytes at a time, which finds long matches and, for merging, the places where its suffixes go. Levels of equal size
class are merged, so that there are logarithmically many and each suffix is moved logarithmically often.
"""

from __future__ import annotations

import secrets

import numpy as np

from .common import window_hash

#: Bytes of a batch.
BATCH_BYTES = 1 << 18


class Family:
    """Levels over one buffer of bytes; a suffix is a place in it, ordered by its first ``window`` bytes."""

    def __init__(self, data: np.ndarray, window: int):
        if window < 8:
            raise ValueError("windows have at least 8 bytes")
        self.window = window
        self.n = len(data)
        self.keys = np.ndarray((max(len(data) - 7, 0),), ">u8", np.ascontiguousarray(data), strides=(1,))
        self.whole = window_hash(data.astype(np.uint64), window, secrets.randbits(64))  # keyed anew for each family
        self.depths = [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]
        self.levels: list[tuple[int, np.ndarray]] = []  # (size class, suffixes in order)

    def key(self, at: np.ndarray) -> np.ndarray:
        return self.keys[at].astype(np.uint64)

    def same(self, at: np.ndarray) -> np.ndarray:
        return self.whole[at]

    def array(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array of a batch and, for each of its places, whether the suffix equals a neighbour's over the window."""
        order = starts[np.argsort(self.key(starts), kind="stable")]
        k = self.key(order)
        new = np.append(True, k[1:] != k[:-1])
        h = self.same(order)
        for d in self.depths[1:]:
            # Only groups that hold different windows are sorted further.
            group = np.cumsum(new) - 1
            lead = np.flatnonzero(new)
            mixed = np.minimum.reduceat(h, lead) != np.maximum.reduceat(h, lead)
            at = np.flatnonzero(mixed[group])
            if not len(at):
                break
            key = self.key(order[at] + d)
            by = np.lexsort((key, group[at]))
            order[at], h[at] = order[at][by], h[at][by]
            key, g = key[by], group[at]
            # ``at`` is sorted and groups are contiguous, so sorting within groups keeps each group's places.
            split = np.append(True, (key[1:] != key[:-1]) | (g[1:] != g[:-1]))
            new[at] |= split
        equal = np.append(False, h[1:] == h[:-1]) & ~new if len(order) else np.zeros(0, bool)
        return order, equal | np.append(equal[1:], False)

    def locate(self, level: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of the batch the interval of the level's suffixes that share its whole window."""
        first = self.key(level)
        mine = self.key(batch)
        low, high = np.searchsorted(first, mine, "left"), np.searchsorted(first, mine, "right")
        going = np.flatnonzero(high > low)
        for d in self.depths[1:]:
            if not len(going):
                break
            key = self.key(batch[going] + d)
            lo, hi = low[going], high[going]
            edges = []
            for right in (False, True):
                a, b = lo.copy(), hi.copy()
                while True:
                    open_ = np.flatnonzero(a < b)
                    if not len(open_):
                        break
                    mid = (a[open_] + b[open_]) >> 1
                    k = self.key(level[mid] + d)
                    up = k <= key[open_] if right else k < key[open_]
                    a[open_[up]] = mid[up] + 1
                    b[open_[~up]] = mid[~up]
                edges.append(a)
            low[going], high[going] = edges
            going = going[edges[1] > edges[0]]
        return low, high

    def add(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds a batch; gives its suffixes with whether each has a long match so far, in the batch or a level (one of equal suffixes stands for all of them in later levels)."""
        batch, found = self.array(starts)
        matched = [batch[found]]
        places = []
        for _, level in self.levels:
            low, high = self.locate(level, batch)
            hit = high > low
            matched += [batch[hit], level[low[hit]]]
            places.append(low)
        size, run, at = max(len(starts), 1).bit_length(), batch, places.pop() if places else None
        while self.levels and self.levels[-1][0] <= size:
            _, level = self.levels.pop()
            if at is None:
                at, _ = self.locate(level, run)
            run = np.insert(level, at, run)
            at, size = None, max(len(run), 1).bit_length()
        self.levels.append((size, run))
        return batch, np.concatenate(matched)


def repeats(values: np.ndarray, offs: np.ndarray, window: int) -> np.ndarray:
    """Whether each window of the texts (bytes) occurs in more than one place of the shard."""
    data = values.astype(np.uint8)
    family = Family(data, window)
    n = np.maximum(np.diff(offs) - window + 1, 0)
    first = np.cumsum(n) - n
    start = np.arange(n.sum()) + np.repeat(offs[:-1] - first, n)
    seen = np.zeros(len(data) + 1, bool)
    cut = np.searchsorted(start, np.arange(BATCH_BYTES, len(data) + BATCH_BYTES, BATCH_BYTES))
    s = 0
    for e in cut.tolist():
        if e > s:
            seen[family.add(start[s:e])[1]] = True
        s = e
    # A level's match is noted for one of its equal suffixes; the rest of them were noted when they met.
    return seen[start]
