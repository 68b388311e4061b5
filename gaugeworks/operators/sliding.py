"""Order statistics of a frame that slides: sorted buckets that values enter and leave."""

from __future__ import annotations

import bisect
import math
from collections import deque
from dataclasses import dataclass
from typing import ClassVar

from gaugeworks.operators.folds import Fold

#: Values of a bucket; twice as many are split.
BUCKET = 512


class Sorted:
    """A multiset of numbers by rank. Entering, leaving and picking look at one bucket and at the number of buckets."""

    def __init__(self) -> None:
        self.buckets: list[list[float]] = []
        self.tops: list[float] = []
        self.size = 0

    def add(self, x: float) -> None:
        self.size += 1
        if not self.buckets:
            self.buckets, self.tops = [[x]], [x]
            return
        i = min(bisect.bisect_left(self.tops, x), len(self.tops) - 1)
        bucket = self.buckets[i]
        bisect.insort(bucket, x)
        self.tops[i] = bucket[-1]
        if len(bucket) > 2 * BUCKET:
            self.buckets[i : i + 1] = [bucket[:BUCKET], bucket[BUCKET:]]
            self.tops[i : i + 1] = [bucket[BUCKET - 1], bucket[-1]]

    def remove(self, x: float) -> None:
        self.size -= 1
        i = bisect.bisect_left(self.tops, x)
        bucket = self.buckets[i]
        del bucket[bisect.bisect_left(bucket, x)]
        if bucket:
            self.tops[i] = bucket[-1]
        else:
            del self.buckets[i], self.tops[i]

    def at(self, rank: int) -> float:
        for bucket in self.buckets:
            if rank < len(bucket):
                return bucket[rank]
            rank -= len(bucket)
        raise IndexError(rank)


class Frame:
    """The last `size` rows in order of arrival and of value; nulls take a row and are no value, NaN is the largest."""

    def __init__(self, size: int, rows: list[float | None] = ()) -> None:
        self.rows: deque[float | None] = deque()
        self.size, self.sorted, self.nans = size, Sorted(), 0
        for x in rows:
            self.push(x)

    def push(self, x: float | None) -> None:
        self._count(x, 1)
        self.rows.append(x)
        if len(self.rows) > self.size:
            self._count(self.rows.popleft(), -1)

    def _count(self, x: float | None, by: int) -> None:
        if x is None:
            return
        if math.isnan(x):
            self.nans += by
        elif by > 0:
            self.sorted.add(x)
        else:
            self.sorted.remove(x)

    def median(self) -> float | None:
        """The upper one; null without values."""
        n = self.sorted.size + self.nans
        if not n:
            return None
        return self.sorted.at(n // 2) if n // 2 < self.sorted.size else math.nan


@dataclass(frozen=True)
class SlidingMedian(Fold):
    """Upper median of the last `size` rows."""

    size: int = 10
    state_type: ClassVar[str] = "held array<double>"

    def start(self) -> Frame:
        return Frame(self.size)

    def pack(self, state: Frame) -> tuple:
        return (list(state.rows),)

    def unpack(self, stored: tuple) -> Frame:
        return Frame(self.size, stored[0] or [])

    def run(self, state, values):  # noqa: ANN001, ANN201
        out = []
        for x in values:
            state.push(x)
            out.append(state.median())
        return state, (out,)
