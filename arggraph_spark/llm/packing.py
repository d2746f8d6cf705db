"""Best-fit packing: bin completion by branch and bound over the histogram of lengths.

Lengths are at most the capacity, so their histogram is a summary of bounded size whatever the number of rows. The
plan is made on it: a pattern (a filling) and how many sequences follow it. Rows then find their place in the plan by
their rank among the rows of equal length, without any of them meeting in one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, free_names, join_bounded, materialize

#: The search for fewer sequences ends after so many fillings; the first plans are always completed.
NODES = 20_000

#: (index of a size, number) of a filling's items, larger sizes first.
Items = tuple[tuple[int, int], ...]


class Sums:
    """The items left, as counts of sizes, and the sums that they can reach, by which fillings are enumerated.

    ``reach[i]`` has bit t if items of ``sizes[i:]`` (descending) can sum to t; so no branch of an enumeration ends
    without a filling, whatever the number of sizes. Only tables of sizes from one whose count changed are made anew.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.mask = capacity, (1 << (capacity + 1)) - 1
        self.sizes = sorted((s for s, n in histogram.items() if n), reverse=True)
        self.count = [histogram[s] for s in self.sizes]
        self.reach = [1] * (len(self.sizes) + 1)
        self.valid = len(self.sizes)
        self.seen = 0

    def change(self, items: Items, times: int) -> None:
        for i, n in items:
            most, before = self.capacity // self.sizes[i], self.count[i]
            self.count[i] += n * times
            if min(before, most) != min(self.count[i], most):
                self.valid = max(self.valid, i + 1)

    def _tables(self, at: int) -> None:
        for i in range(self.valid - 1, at - 1, -1):
            s, sums = self.sizes[i], self.reach[i + 1]
            left, step = min(self.count[i], self.capacity // s), 1
            while left > 0:
                step = min(step, left)
                sums |= (sums << (step * s)) & self.mask
                left -= step
                step *= 2
            self.reach[i] = sums
        self.valid = min(self.valid, at)

    def _exactly(self, t: int, at: int, after: Items | None) -> Iterator[Items]:
        """Fillings from ``sizes[at:]`` that sum to ``t``, larger items first; those that come after ``after`` only."""
        if not t:
            if after is None:
                yield ()
            return
        at = max(at, bisect_left(self.sizes, -t, key=lambda s: -s))
        if after and after[0][0] >= at:
            at = after[0][0]
        else:
            after = None
        for i in range(at, len(self.sizes)):
            if not self.reach[i] >> t & 1:
                return
            s, rest = self.sizes[i], self.reach[i + 1]
            most = min(self.count[i], t // s)
            if after and i == at:
                n = after[0][1]
                if n <= most and rest >> (t - n * s) & 1:
                    for more in self._exactly(t - n * s, i + 1, after[1:]):
                        yield ((i, n), *more)
                most = min(most, n - 1)
            for n in range(most, 0, -1):
                if rest >> (t - n * s) & 1:
                    for more in self._exactly(t - n * s, i + 1, None):
                        yield ((i, n), *more)

    def filling(self, first: int, most_waste: int, after: tuple[int, Items] | None = None, limit: int | None = None) -> tuple[int, Items] | None:
        """The (waste, others) next to ``after`` of the undominated fillings around an item of size ``first``, the largest.

        They come least waste first and of equal waste those of larger items first. A filling is dominated when one
        more item would fit. None if there are no more, or ``limit`` fillings were seen.
        """
        self.change(((first, 1),), -1)
        self._tables(first)
        room = self.capacity - self.sizes[first]
        try:
            for waste in range(after[0] if after else 0, min(most_waste, room) + 1):
                if not self.reach[first] >> (room - waste) & 1:
                    continue
                for others in self._exactly(room - waste, first, after[1] if after and waste == after[0] else None):
                    self.seen += 1
                    taken = dict(others)
                    fitting = range(max(first, bisect_left(self.sizes, -waste, key=lambda s: -s)), len(self.sizes))
                    if not any(self.count[i] > taken.get(i, 0) for i in reversed(fitting)):
                        return waste, others
                    if limit is not None and self.seen >= limit:
                        return None
            return None
        finally:
            self.change(((first, 1),), 1)

    def best_fit(self, first: int) -> Items:
        """The filling that takes the largest item that fits, again and again."""
        room, items = self.capacity, []
        for i in range(first, len(self.sizes)):
            if n := min(room // self.sizes[i], self.count[i]):
                items.append((i, n))
                room -= n * self.sizes[i]
        return tuple(items)

    def around(self, first: int, others: Items) -> Items:
        return ((first, 1 + others[0][1]), *others[1:]) if others and others[0][0] == first else ((first, 1), *others)

    def pattern(self, items: Items) -> tuple[int, ...]:
        return tuple(self.sizes[i] for i, n in items for _ in range(n))


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any plan needs: by the total, and with items that can't share one counted apart (Martello and Toth's L2)."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n), np.int64)
    if not len(sizes):
        return 0
    count = np.array([histogram[int(s)] for s in sizes], np.int64)
    n, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(sizes * count)])
    half = np.searchsorted(sizes, capacity // 2, "right")
    small = np.concatenate([[0], sizes[:half]])
    low, high = np.searchsorted(sizes, small, "left"), np.searchsorted(sizes, capacity - small, "right")
    high = np.maximum(high, half)
    apart, middle = n[-1] - n[high], n[high] - n[half]
    free = middle * capacity - (total[high] - total[half])
    rest = np.maximum(total[half] - total[np.minimum(low, half)] - free, 0)
    return max(int(np.max(apart + middle + -(-rest // capacity))), -(-int(total[-1]) // capacity))


def descend(histogram: dict[int, int], capacity: int, greedy: int) -> list[tuple[int, tuple[int, ...]]]:
    """A plan without a search: ``greedy`` sequences by best fit, then least wasteful fillings as often as the items last."""
    left, made, first = Sums(histogram, capacity), [], 0
    while True:
        while first < len(left.sizes) and not left.count[first]:
            first += 1
        if first == len(left.sizes):
            return made
        items = left.best_fit(first) if len(made) < greedy else left.around(first, left.filling(first, capacity)[1])
        times = 1 if len(made) < greedy else min(left.count[i] // n for i, n in items)
        left.change(items, -times)
        made.append((times, left.pattern(items)))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, sizes) of the patterns that pack all items, in as few sequences as the search finds.

    Branch and bound: the least wasteful fillings around the largest items left make a plan, as do those after 1, 2, 4,
    ... sequences by best fit; the best is the incumbent, and ends the search if it meets the lower bound. Else a filling
    is followed as often as the items last, then one time less, and then the next one, leaving a branch whose waste
    exceeds that of the incumbent. Fillings around equal items follow in the order of their enumeration. The search is
    exhaustive unless it ends at ``NODES`` fillings.
    """
    total, least = sum(s * n for s, n in histogram.items()), lower_bound(histogram, capacity)
    best, most, greedy = [], total + 1, 0
    while most > least and greedy < min(most, 4096):
        made = descend(histogram, capacity, greedy)
        if sum(n for n, _ in made) < most:
            best, most = made, sum(n for n, _ in made)
        greedy = max(1, 2 * greedy)
    if most <= least:
        return best
    left = Sums(histogram, capacity)
    path: list[tuple[int, int, Items, Items, int]] = []  # index of the largest size, waste, others, all items, times
    waste = nodes = 0
    while nodes + left.seen < NODES:
        top = path[-1][0] if path else 0
        first = next((i for i in range(top, len(left.sizes)) if left.count[i]), None)
        if first is None:
            best, most = [(n, left.pattern(items)) for *_, items, n in path], sum(p[4] for p in path)
            if most <= least:
                break
        after = path[-1][1:3] if path and path[-1][0] == first else None
        while True:
            allowed = (most - 1) * capacity - total - waste
            found = left.filling(first, allowed, after, NODES - nodes) if first is not None and allowed >= 0 else None
            if found:
                items = left.around(first, found[1])
                times = min(left.count[i] // n for i, n in items)
                if found[0]:
                    times = min(times, allowed // found[0])
                break
            if not path:
                return best
            first, lost, others, items, times = path.pop()
            left.change(items, times)
            waste -= lost * times
            found, times = (lost, others), times - 1
            if times:
                break
            after = found
        path.append((first, *found, items, times))
        left.change(items, -times)
        waste += found[0] * times
        nodes += 1
    return best


def pack(pieces: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences of at most ``capacity``, filled without gaps from 0.

    Every row is placed, repeated rows each on their own; rows of equal length take places in the order of ``order``
    within the partition that wrote them. Lengths must be 1 to ``capacity``; texts aren't read. An empty table stays
    empty. Columns named like the results are replaced; other names can't clash.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    part, nth, count, before, rank, s, low, high, times_, base_, offset_ = free_names([*pieces.columns, "sequence_id", "offset"], "_part", "_in", "_n", "_before", "_rank", "_s", "_from", "_to", "_times", "_base", "_offset")
    columns = pieces.columns
    pieces = materialize(pieces.withColumn(part, F.spark_partition_id()))
    counts = materialize(pieces.groupBy(part, length).agg(F.count(F.lit(1)).alias(count)))
    histogram = {r[0]: r[1] for r in counts.groupBy(length).agg(F.sum(count)).collect()}  # at most ``capacity`` rows
    if any(x is None or not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    rows, base, taken = [], 0, dict.fromkeys(histogram, 0)
    for times, pattern in plan(histogram, capacity):
        offset = 0
        for x in sorted(set(pattern), reverse=True):
            m = pattern.count(x)
            rows.append((x, taken[x], taken[x] + m * times, times, base, offset))
            taken[x] += m * times
            offset += m * x
        base += times
    places = spark.createDataFrame(rows, ", ".join(f"`{c}` long" for c in (s, low, high, times_, base_, offset_)))
    # The plan has about capacity patterns of at most sqrt(2 * capacity) sizes each, however many rows there are.
    places = F.broadcast(places) if len(rows) * 64 <= BROADCAST_BYTES else places.hint("merge")
    earlier = counts.withColumn(before, F.sum(count).over(Window.partitionBy(length).orderBy(part)) - F.col(count)).drop(count)
    ranked = pieces.withColumn(nth, F.row_number().over(Window.partitionBy(part, length).orderBy(*order)) - 1)
    ranked = join_bounded(ranked, materialize(earlier), [part, length], "inner", 64).withColumn(rank, F.col(nth) + F.col(before))
    at = F.col(rank) - F.col(low)
    return (
        ranked.join(places, (F.col(length) == F.col(s)) & (F.col(rank) >= F.col(low)) & (F.col(rank) < F.col(high)))
        .withColumn("sequence_id", F.col(base_) + at % F.col(times_))
        .withColumn("offset", (F.col(offset_) + F.floor(at / F.col(times_)) * F.col(length)).cast("long"))
        .select(*(F.col(f"`{c}`") for c in columns), "sequence_id", "offset")
    )
