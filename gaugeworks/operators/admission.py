"""Deterministic admission control: what a loaded stream lets through."""

from __future__ import annotations

import io
from dataclasses import dataclass, replace
from enum import Enum
from fractions import Fraction
from functools import cached_property
from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.folds import Composable, folded
from gaugeworks.operators.ordered import Stream, numbered


class Quality(Enum):
    """Degradation levels; the value is the sampling rate."""

    FULL = 1
    HIGH = 2
    MEDIUM = 4
    LOW = 8
    MINIMAL = 16

    @classmethod
    def from_level(cls, level: int) -> Quality:
        levels = list(cls)
        return levels[min(max(level, 0), len(levels) - 1)]


LEVELS = [q.value for q in Quality]


def sample_every(df: DataFrame, stream: Stream, rate: int) -> DataFrame:
    """Keeps the first row of each `rate` rows; rates below 1 count as 1."""
    return numbered(df, stream, "_n").filter(F.col("_n") % max(1, rate) == 0).drop("_n")


def drop_newest(df: DataFrame, stream: Stream, capacity: int) -> DataFrame:
    """Keeps the first `capacity` rows of each admission window (the stream's keys; without any, all rows are one window)."""
    if not stream.keys:
        return df.orderBy(*stream.order).limit(capacity)
    rank = F.row_number().over(stream.window())
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= capacity).drop("_rank")


def drop_oldest(df: DataFrame, stream: Stream, capacity: int) -> DataFrame:
    """Keeps the last `capacity` rows of each admission window."""
    if not stream.keys:
        return df.orderBy(*(F.desc(c) for c in stream.order)).limit(capacity)
    rank = F.row_number().over(Window.partitionBy(*stream.keys).orderBy(*(F.desc(c) for c in stream.order)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= capacity).drop("_rank")


#: Rows that a bucket's function takes in one step, at first and at most, and rows taken one by one at most before the next try.
STRETCH, LONGEST, SINGLES = 16, 1 << 16, 64
#: Times beyond are taken one by one, as their differences may not fit.
_FAR = 1 << 62


def _saved(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _loaded(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return [found[k] for k in found.files]


@dataclass(frozen=True)
class TokenBucket(Composable):
    """Accepts a row if a token is left. Tokens come back with event time, fractions included, up to the capacity.

    Tokens are counted in whole units, of which a nanosecond brings a whole number, so neither
    rounding nor the way rows are cut into blocks changes what is accepted. What a run of rows
    does to the tokens is a function of pieces, each the tokens before plus a number, or a number;
    two starts less than a cost apart differ by one accepted row at most, so there are some two
    pieces for each cost that the capacity holds, however long the run. Where no start fills the
    bucket, n rows that bring d1, d2, ... accept n + min(0, floor((tokens + w) / cost)) in all, w being
    the least of d1 + ... + dj - j * cost: such stretches are one step, other rows one each.
    """

    capacity: float = 100.0
    refill_per_second: float = 1000.0
    initial: float = 100.0
    cost: float = 1.0
    state_type: ClassVar[str] = "units long, last long"

    def __post_init__(self) -> None:
        if min(self.capacity, self.refill_per_second, self.initial) < 0 or self.cost <= 0:
            raise ValueError("capacity, refill and initial tokens can't be negative, and a row costs something")
        if self._scale * Fraction(str(self.capacity)) >= 1 << 62:
            raise ValueError("a capacity of that many units of this refill can't be counted")

    @classmethod
    def of_rate(cls, per_second: float, time: str = "timestamp_ns") -> TokenBucket:
        return cls((time,), {"accepted": "boolean", "tokens": "double"}, per_second * 0.1, per_second, per_second * 0.1)

    @property
    def carry(self) -> str:
        return self.inputs[0]

    @cached_property
    def _scale(self) -> int:
        """Units of a token."""
        parts = [Fraction(str(x)) for x in (self.refill_per_second, self.capacity, self.initial, self.cost)]
        return int(np.lcm.reduce([p.denominator for p in parts], dtype=object)) * 10**9

    @cached_property
    def _units(self) -> tuple[int, int, int, int]:
        """Capacity, initial tokens and cost, and what a nanosecond brings."""
        of = lambda x: int(Fraction(str(x)) * self._scale)
        return of(self.capacity), min(of(self.initial), of(self.capacity)), of(self.cost), of(self.refill_per_second) // 10**9

    def pack(self, state):  # noqa: ANN001, ANN201
        return state

    def unpack(self, stored):  # noqa: ANN001, ANN201
        return tuple(stored)

    def run(self, state, times):  # noqa: ANN001, ANN201
        capacity, initial, cost, gain = self._units
        units, last = state or (initial, None)
        accepted, left = [], []
        for t in times:
            if t is not None:
                if last is not None and t > last:
                    units = min(capacity, units + (t - last) * gain)
                last = t if last is None or t > last else last
            ok = units >= cost
            units -= cost if ok else 0
            accepted.append(ok)
            left.append(units / self._scale)
        return (units, last), (accepted, left)

    def core(self):  # noqa: ANN201
        return self._units[1]

    def seeded(self, core, carried):  # noqa: ANN001, ANN201
        return core, carried

    def identity(self):  # noqa: ANN201
        """Pieces: where each starts, whether the tokens before count in it, and what is added."""
        return np.zeros(1, np.int64), np.ones(1, bool), np.zeros(1, np.int64)

    def extended(self, function, carried, times):  # noqa: ANN001, ANN201
        refills, after = self._refills(carried, times)
        capacity, _, cost, _ = self._units
        longest = min(LONGEST, (1 << 60) // (capacity + cost))
        at, size, singles = 0, STRETCH, 1
        while at < len(refills):
            if len(function[0]) == 1 and not function[1][0]:
                # All starts have met: the plain loop.
                units = int(function[2][0])
                for more in refills[at:].tolist():
                    units = min(capacity, units + more)
                    units -= cost if units >= cost else 0
                return (*function[:2], np.array([units], np.int64)), after
            part = refills[at : at + min(size, longest)]
            function, done = self._stretched(function, part)
            at += done
            if done == len(part) > 0:
                size, singles = min(2 * size, LONGEST), 1
                continue
            size = max(STRETCH, done)
            singles = 1 if done > 8 else min(2 * singles, SINGLES)
            for more in refills[at : at + singles].tolist():
                function = self._charged(self._refilled(function, more) if more else function)
            at += singles
        return function, after

    def _refills(self, carried, times) -> tuple[np.ndarray, int | None]:  # noqa: ANN001
        """What each row brings, the capacity at most, and the greatest time after them."""
        capacity, _, _, gain = self._units
        known = [t for t in times if t is not None]
        after = max([*known, *([] if carried is None else [carried])], default=None)
        if after is None or not gain:
            return np.zeros(len(times), np.int64), after
        if after >= _FAR or min([*known, *([] if carried is None else [carried])]) <= -_FAR:
            refills = []
            for t in times:
                refills.append(0 if t is None or carried is None else min(capacity, max(0, t - carried) * gain))
                carried = carried if t is None else t if carried is None else max(t, carried)
            return np.array(refills, np.int64), after
        tops = np.maximum.accumulate(np.array([-_FAR if carried is None else carried, *(-_FAR if t is None else t for t in times)], np.int64))
        passed = np.where(tops[:-1] == -_FAR, 0, np.diff(tops))
        if gain >= capacity:
            return np.where(passed > 0, capacity, 0), after
        return np.minimum(np.minimum(passed, capacity // gain + 1) * gain, capacity), after

    def _stretched(self, function, refills: np.ndarray):  # noqa: ANN001, ANN202
        """(function, n) with the first n rows behind it, before which no start fills the bucket."""
        capacity, _, cost, _ = self._units
        starts, slopes, added = function
        ends = np.append(starts[1:], capacity + 1)
        most = int(np.where(slopes, ends - 1 + added, added).max())
        net = np.cumsum(refills) - cost * np.arange(len(refills))
        least = np.minimum(np.minimum.accumulate(net - cost), 0)
        before = np.append(0, least[:-1])[: len(least)]
        full = net + np.maximum(most, np.where(before < 0, cost - 1 - before, 0)) > capacity
        n = int(full.argmax()) if full.any() else len(full)
        if not n:
            return function, 0
        total, w = int(net[n - 1]) - cost, -int(least[n - 1])
        # Tokens w, w - cost, ... and more accept one row more than those below.
        low, high = starts + added, ends + added
        first = np.maximum((w - high) // cost + 1, 0)
        count = np.where(slopes, np.maximum(-((low - w) // cost) - first, 0), 0)
        if count.any():
            piece = np.repeat(np.arange(len(starts)), count)
            cuts = w - cost * (first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)) - added[piece]
            order = np.argsort(np.append(starts, cuts), kind="stable")
            piece = np.append(np.arange(len(starts)), piece)[order]
            starts, slopes, added = np.append(starts, cuts)[order], slopes[piece], added[piece]
        tokens = np.where(slopes, starts + added, added)
        return self._merged(starts, slopes, added + total - cost * np.minimum((tokens - w) // cost, 0)), n

    def _refilled(self, function, more: int):  # noqa: ANN001, ANN202
        capacity = self._units[0]
        starts, slopes, added = self._split(function, capacity - more)
        full = np.where(slopes, starts + added, added) >= capacity - more
        return self._merged(starts, slopes & ~full, np.where(full, capacity, added + more))

    def _charged(self, function):  # noqa: ANN001, ANN202
        cost = self._units[2]
        starts, slopes, added = self._split(function, cost)
        return self._merged(starts, slopes, added - cost * (np.where(slopes, starts + added, added) >= cost))

    def _split(self, function, value: int):  # noqa: ANN001, ANN202
        """The pieces cut where they reach a value."""
        starts, slopes, added = function
        ends = np.append(starts[1:], self._units[0] + 1)
        at = value - added
        crossing = np.flatnonzero(slopes & (starts < at) & (at < ends))
        if not len(crossing):
            return function
        return np.insert(starts, crossing + 1, at[crossing]), np.insert(slopes, crossing + 1, True), np.insert(added, crossing + 1, added[crossing])

    @staticmethod
    def _merged(starts, slopes, added):  # noqa: ANN001, ANN205
        new = np.append(True, (slopes[1:] != slopes[:-1]) | (added[1:] != added[:-1]))
        return (starts, slopes, added) if new.all() else (starts[new], slopes[new], added[new])

    def packed(self, function) -> bytes:  # noqa: ANN001
        return _saved(*function)

    def applied(self, packed, core):  # noqa: ANN001, ANN201
        starts, slopes, added = _loaded(packed)
        i = int(np.searchsorted(starts, core, "right")) - 1
        return int(added[i]) + (core if slopes[i] else 0)


@dataclass(frozen=True)
class Controller(Composable):
    """Adaptive quality: lasting high utilisation lowers it a level, lasting low one raises it.

    One counter serves both directions and starts anew between the marks; a level changes on
    the update after `hysteresis` counted ones. Below full quality every 2nd to 16th row passes.
    """

    high: float = 0.8
    low: float = 0.5
    hysteresis: int = 10
    state_type: ClassVar[str] = "level int, counter long, samples long"

    def pack(self, state):  # noqa: ANN001, ANN201
        return state

    def unpack(self, stored):  # noqa: ANN001, ANN201
        return tuple(stored)

    def __post_init__(self) -> None:
        if not 0 <= self.low < self.high <= 1:
            raise ValueError("marks must lie between 0 and 1, low below high")

    @classmethod
    def of(cls, column: str = "utilization", **marks: float) -> Controller:
        return replace(cls((column,), {"quality": "int", "accepted": "boolean"}), **marks)

    def run(self, state, utilisations):  # noqa: ANN001, ANN201
        level, counter, samples = state or (0, 0, 0)
        qualities, accepted = [], []
        for u in utilisations:
            if u is not None and (u > self.high or u < self.low):
                due, counter = counter >= self.hysteresis, counter + 1
                step = 1 if u > self.high else -1
                if due and 0 <= level + step < len(LEVELS):
                    level, counter = level + step, 0
            elif u is not None:
                counter = 0
            ok = True
            if level:
                ok = samples % LEVELS[level] == 0
                samples += 1
            qualities.append(level)
            accepted.append(ok)
        return (level, counter, samples), (qualities, accepted)

    # A counter past the hysteresis acts as one at it, and of the samples only their number modulo
    # the greatest rate counts: levels and counters are few, and a run maps each of them.

    def core(self):  # noqa: ANN201
        return [0, 0, 0]

    def seeded(self, core, carried):  # noqa: ANN001, ANN201, ARG002
        return tuple(core)

    def _steps(self) -> list[np.ndarray]:
        """By state (level, counter): the next one after a high, a low and another utilisation."""
        each, last = self.hysteresis + 1, len(LEVELS) - 1
        level, counter = np.divmod(np.arange(each * len(LEVELS)), each)
        out = []
        for step in (1, -1):
            moves = (counter >= self.hysteresis) & (level + step >= 0) & (level + step <= last)
            out.append(np.where(moves, (level + step) * each, level * each + np.minimum(counter + 1, self.hysteresis)))
        return [*out, level * each]

    def identity(self):  # noqa: ANN201
        states = (self.hysteresis + 1) * len(LEVELS)
        return np.arange(states), np.zeros(states, np.int64)

    def extended(self, function, carried, utilisations):  # noqa: ANN001, ANN201
        to, samples = function
        high, low, other = self._steps()
        for u in utilisations:
            if u is not None:
                to = (high if u > self.high else low if u < self.low else other)[to]
            samples = samples + (to > self.hysteresis)
        return (to, samples), carried

    def packed(self, function) -> bytes:  # noqa: ANN001
        return _saved(*function)

    def applied(self, packed, core):  # noqa: ANN001, ANN201
        to, samples = _loaded(packed)
        level, counter, before = core
        state = level * (self.hysteresis + 1) + min(counter, self.hysteresis)
        level, counter = divmod(int(to[state]), self.hysteresis + 1)
        return [level, counter, (before + int(samples[state])) % LEVELS[-1]]


class Strategy(Enum):
    """What to do when a stream outgrows its capacity."""

    BLOCK = "block"
    DROP_NEWEST = "drop_newest"
    DROP_OLDEST = "drop_oldest"
    SAMPLE = "sample"
    ADAPTIVE = "adaptive"

    @property
    def may_block(self) -> bool:
        return self is Strategy.BLOCK

    @property
    def may_drop(self) -> bool:
        return self is not Strategy.BLOCK

    def apply(self, df: DataFrame, stream: Stream, capacity: int = 1024, rate: int = 1, utilization: str = "utilization") -> DataFrame:
        """The admitted rows. Blocking loses nothing: in streams, sources are throttled by their own options."""
        if self is Strategy.DROP_NEWEST:
            return drop_newest(df, stream, capacity)
        if self is Strategy.DROP_OLDEST:
            return drop_oldest(df, stream, capacity)
        if self is Strategy.SAMPLE:
            return sample_every(df, stream, rate)
        if self is Strategy.ADAPTIVE:
            return folded(df, stream, Controller.of(utilization)).filter("accepted").drop("quality", "accepted")
        return df


def admission_stats(df: DataFrame, keys: tuple[str, ...] = (), accepted: Column | None = None, dropped: Column | None = None, blocked: Column | None = None, sampled_out: Column | None = None) -> DataFrame:
    """Counts of the flags, with total, drop_rate (0 if none) and acceptance_rate (1 if none)."""
    flags = {"accepted": accepted, "dropped": dropped, "blocked": blocked, "sampled_out": sampled_out}
    counts = df.groupBy(*keys).agg(*((F.count_if(c) if c is not None else F.lit(0).cast("long")).alias(k) for k, c in flags.items()))
    total = F.col("accepted") + F.col("dropped") + F.col("sampled_out")
    return counts.withColumn("total", total).withColumns(
        {"drop_rate": F.coalesce(F.try_divide(F.col("dropped") + F.col("sampled_out"), total), F.lit(0.0)), "acceptance_rate": F.coalesce(F.try_divide(F.col("accepted"), total), F.lit(1.0))}
    )
