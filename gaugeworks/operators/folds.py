"""Sequential operators: a state that each row changes, in order, with bounded memory.

A fold sees its stream as sorted Arrow batches and keeps only the state, so one key may be
as long as it likes. `spread` streams of affine folds (EMA, filters, Kalman) are range
partitioned instead: each block is first summed up as y -> A*y + B, the few blocks of a
stream are composed in order, and a second pass starts every block from its true state;
there rounding may differ in the last bits from the plain loop. Composable folds (token bucket,
controller) do likewise with functions of their own: a block's function is built without knowing
its start, the few functions of a stream are applied in order, and the results are those of the
plain loop.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.operators.ordered import AUTO, Stream, blocks, by_size

_SQL = {"double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "string": T.StringType()}
_ARROW = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


@dataclass(frozen=True)
class Fold:
    """inputs: columns it reads; outputs: name -> type of what it adds.

    On streams the state is stored by `state_type`, as `pack` makes it and `unpack` takes it. A
    fold that names no type stores a pickle.
    """

    inputs: tuple[str, ...]
    outputs: dict[str, str] = field(default_factory=dict)
    state_type: ClassVar[str] = "blob binary"

    def pack(self, state) -> tuple:  # noqa: ANN001
        return (pickle.dumps(state),)

    def unpack(self, stored: tuple):  # noqa: ANN201
        return pickle.loads(stored[0])

    def start(self):  # noqa: ANN201
        return None

    def run(self, state, *columns: list) -> tuple[object, tuple[list, ...]]:  # noqa: ANN001
        """(state after, one list for each output) for the next rows of one stream."""
        raise NotImplementedError


@dataclass(frozen=True)
class Composable(Fold):
    """A fold that does to its state, over any run of rows, what a function of bounded size does.

    The core of a state is what such a function maps. What else a run hangs on is carried: the
    greatest value of the `carry` column before it. Cores are stored as JSON.
    """

    carry: ClassVar[str | None] = None

    def core(self):  # noqa: ANN201
        """The core of the first state."""
        raise NotImplementedError

    def identity(self):  # noqa: ANN201
        """The function of no rows."""
        raise NotImplementedError

    def extended(self, function, carried, *columns: list):  # noqa: ANN001, ANN201
        """(function, carried) with further rows behind it."""
        raise NotImplementedError

    def packed(self, function) -> bytes:  # noqa: ANN001
        raise NotImplementedError

    def applied(self, packed: bytes, core):  # noqa: ANN001, ANN201
        raise NotImplementedError

    def seeded(self, core, carried):  # noqa: ANN001, ANN201
        """The state that `run` starts from."""
        raise NotImplementedError


@dataclass(frozen=True)
class Affine(Fold):
    """y = a*y' + b, the first row as the subclass says. Null readings leave the state and give it again."""

    def coefficients(self, position: int, values: np.ndarray, previous: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of the readings from a position (their number before) on; a first reading has a = 0."""
        raise NotImplementedError

    @property
    def initial(self) -> float | None:
        """The output before the first reading."""
        return None

    def others(self, position: int, count: int) -> list[np.ndarray]:
        """Further outputs after each of `count` readings from a position on; they depend on the number of readings only."""
        return []


@dataclass(frozen=True)
class Ema(Affine):
    """Exponential moving average, 0 < alpha <= 1; the first reading passes."""

    alpha: float = 0.5
    state_type: ClassVar[str] = "y double"

    def pack(self, state):  # noqa: ANN001, ANN201
        return (state,)

    def unpack(self, stored):  # noqa: ANN001, ANN201
        return stored[0]

    def __post_init__(self) -> None:
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must be above 0 and at most 1")

    @classmethod
    def from_time_constant(cls, column: str, out: str, tau: float, hz: float) -> Ema:
        dt = 1 / hz
        return cls((column,), {out: "double"}, dt / (tau + dt))

    @classmethod
    def from_cutoff(cls, column: str, out: str, cutoff: float, hz: float) -> Ema:
        return cls((column,), {out: "double"}, (1 / hz) / (1 / (2 * math.pi * cutoff) + 1 / hz))

    def run(self, state, values):  # noqa: ANN001, ANN201
        a, b, y, out = self.alpha, 1 - self.alpha, state, []
        for x in values:
            if x is not None:
                y = x if y is None else a * x + b * y
            out.append(y)
        return y, (out,)

    def coefficients(self, position, values, previous):  # noqa: ANN001, ANN201
        a, b = np.full(len(values), 1 - self.alpha), self.alpha * values
        if position == 0 and len(values):
            a[0], b[0] = 0.0, values[0]
        return a, b


def low_pass(column: str, out: str, cutoff: float, hz: float) -> Ema:
    return Ema.from_cutoff(column, out, cutoff, hz)


@dataclass(frozen=True)
class HighPass(Affine):
    """y = alpha * (y' + x - x'); the first reading passes, so a constant decays."""

    alpha: float = 0.5
    state_type: ClassVar[str] = "y double, before double"

    def pack(self, state):  # noqa: ANN001, ANN201
        return state or (None, None)

    def unpack(self, stored):  # noqa: ANN001, ANN201
        return tuple(stored)

    @classmethod
    def of(cls, column: str, out: str, cutoff: float, hz: float) -> HighPass:
        rc = 1 / (2 * math.pi * cutoff)
        return cls((column,), {out: "double"}, rc / (rc + 1 / hz))

    def run(self, state, values):  # noqa: ANN001, ANN201
        alpha, (y, before), out = self.alpha, state or (None, None), []
        for x in values:
            if x is not None:
                y = x if y is None else alpha * (y + x - before)
                before = x
            out.append(y)
        return (y, before), (out,)

    def coefficients(self, position, values, previous):  # noqa: ANN001, ANN201
        before = np.concatenate([[previous if previous is not None else 0.0], values[:-1]])
        a, b = np.full(len(values), self.alpha), self.alpha * (values - before)
        if position == 0 and len(values):
            a[0], b[0] = 0.0, values[0]
        return a, b


@dataclass(frozen=True)
class Kalman(Affine):
    """One-dimensional Kalman filter. The gain depends on the number of readings only."""

    x0: float = 0.0
    p0: float = 1.0
    q: float = 0.01
    r: float = 0.1
    state_type: ClassVar[str] = "x double, p double"

    def pack(self, state):  # noqa: ANN001, ANN201
        return state

    def unpack(self, stored):  # noqa: ANN001, ANN201
        return tuple(stored)

    def run(self, state, values):  # noqa: ANN001, ANN201
        x, p = state or (self.x0, self.p0)
        q, r, out, errors, gains = self.q, self.r, [], [], []
        gain = None
        for z in values:
            if z is not None:
                predicted = p + q
                gain = predicted / (predicted + r)
                x = x + gain * (z - x)
                p = (1 - gain) * predicted
            out.append(x)
            errors.append(p)
            gains.append(gain)
        return (x, p), (out, errors, gains)[: len(self.outputs)]

    def gain(self, covariance: float) -> float:
        """The gain that a covariance would give without process noise."""
        return covariance / (covariance + self.r)

    @property
    def initial(self) -> float | None:
        return self.x0

    def covariances(self, position: int, count: int) -> np.ndarray:
        """The covariance before each of `count` readings from a position on, and after the last."""
        return _covariances(self.p0, self.q, self.r).at(position, count + 1)

    def coefficients(self, position, values, previous):  # noqa: ANN001, ANN201
        p = self.covariances(position, len(values))[:-1] + self.q
        g = p / (p + self.r)
        a, b = 1 - g, g * values
        if position == 0 and len(values):
            a[0], b[0] = 0.0, (1 - g[0]) * self.x0 + g[0] * values[0]
        return a, b

    def others(self, position, count):  # noqa: ANN001, ANN201
        # Before the first reading stands the initial covariance, without a gain.
        if position + count == 0:
            return [np.array([self.p0]), np.array([np.nan])]
        p = self.covariances(position, count)
        return [p[1:], (p[:-1] + self.q) / (p[:-1] + self.q + self.r)]


class Covariances:
    """Covariances of a Kalman filter by number of readings: computed once, up to where they settle."""

    def __init__(self, p0: float, q: float, r: float) -> None:
        self.q, self.r, self.known, self.settled = q, r, [p0], False

    def at(self, position: int, count: int) -> np.ndarray:
        if self.q == 0 and self.r > 0 and self.known[0] > 0:
            # Without process noise they never settle, but have a closed form.
            return 1 / (1 / self.known[0] + np.arange(position, position + count) / self.r)
        while len(self.known) < position + count and not self.settled:
            p = self.known[-1] + self.q
            new = (1 - p / (p + self.r)) * p if p + self.r else 0.0
            self.settled = new in self.known[-2:]
            self.known.append(new)
        return np.array(self.known[position : position + count] + [self.known[-1]] * (count - max(0, min(len(self.known) - position, count))))


@lru_cache(maxsize=16)
def _covariances(p0: float, q: float, r: float) -> Covariances:
    return Covariances(p0, q, r)


def folded(df: DataFrame, stream: Stream, fold: Fold) -> DataFrame:
    """df with the fold's outputs."""
    if clash := {*df.columns} & {*fold.outputs}:
        raise ValueError(f"input already has the columns {', '.join(sorted(clash))}")
    if stream.spread == AUTO:
        return by_size(df, stream, lambda rows, s: folded(rows, s, fold))
    if stream.spread and isinstance(fold, Affine):
        return _spread(df, stream, fold)
    if stream.spread and isinstance(fold, Composable):
        return _composed(df, stream, fold)
    if stream.keys:
        rows = df.repartition(*(F.col(k) for k in stream.keys))
    else:
        rows = df.coalesce(1)
    rows = rows.sortWithinPartitions(*stream.keys, *stream.order)
    schema = T.StructType([*df.schema.fields, *(T.StructField(k, _SQL[t]) for k, t in fold.outputs.items())])
    return rows.mapInArrow(_runner(fold, stream.keys, schema.names), schema)


def groups(batch: pa.RecordBatch, keys: tuple[str, ...]) -> list[tuple[tuple, int, int]]:
    """(key, start, end) of the runs of equal keys."""
    if not keys:
        return [((), 0, batch.num_rows)] if batch.num_rows else []
    rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
    cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
    return [(rows[a], a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _runner(fold: Fold, keys: tuple[str, ...], names: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            inputs, outs = [batch.column(c).to_pylist() for c in fold.inputs], [[] for _ in fold.outputs]
            for key, a, b in groups(batch, keys):
                if key != current:
                    current, state = key, fold.start()
                state, got = fold.run(state, *(c[a:b] for c in inputs))
                for have, new in zip(outs, got, strict=True):
                    have.extend(new)
            added = [pa.array(o, _ARROW[t]) for o, t in zip(outs, fold.outputs.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    return run


def _spread(df: DataFrame, stream: Stream, fold: Affine) -> DataFrame:
    """The two-pass form: blocks as affine maps, composed in order, then run from their true starts."""
    (column,), keys = fold.inputs, stream.keys
    cut = blocks(df, stream)
    readings = cut.filter(F.col(column).isNotNull())
    per = readings.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"), F.max_by(F.col(column).cast("double"), F.struct(*stream.order)).alias("_last"))
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_position", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("_previous", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")))
    per = per.select(*keys, "_block", "_position", "_previous")
    placed = _same_keys(cut, per, [*keys, "_block"], "left").select(*cut.columns, "_position", "_previous")
    # Without a shuffle's reordering: sorted within the stream's blocks, one state each.
    ordered = placed.repartition("_block", *keys).sortWithinPartitions("_block", *keys, *stream.order)
    key_schema = [cut.schema[k] for k in keys] + [T.StructField("_block", T.IntegerType())]
    maps = ordered.mapInArrow(_block_maps(fold, (*keys, "_block")), T.StructType([*key_schema, T.StructField("_a", T.DoubleType()), T.StructField("_b", T.DoubleType())]))
    starts = maps.repartition(*(F.col(k) for k in keys or ("_one",))) if keys else maps.coalesce(1)
    starts = starts.sortWithinPartitions(*keys, "_block").mapInArrow(_compose(keys), T.StructType([*key_schema, T.StructField("_start", T.DoubleType())]))
    begun = _same_keys(placed, starts, [*keys, "_block"], "left").select(*placed.columns, "_start")
    ordered = begun.repartition("_block", *keys).sortWithinPartitions("_block", *keys, *stream.order)
    names = list(fold.outputs)
    if len(names) > 1 + len(fold.others(0, 0)):
        raise ValueError(f"a spread stream has no outputs beyond {names[: 1 + len(fold.others(0, 0))]}")
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return ordered.mapInArrow(_from_starts(fold, (*keys, "_block"), df.columns, names), schema)


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    other = right.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(other, same, how)


def _block_maps(fold: Affine, keys: tuple[str, ...]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        current, a, b, position, previous = None, 1.0, 0.0, 0, None
        types = None
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for key, lo, hi in groups(batch, keys):
                if key != current:
                    if current is not None:
                        done.append((*current, a, b))
                    current, a, b = key, 1.0, 0.0
                    position, previous = batch.column("_position")[lo].as_py() or 0, batch.column("_previous")[lo].as_py()
                x = np.array([v for v in batch.column(fold.inputs[0])[lo:hi].to_pylist() if v is not None], dtype=float)
                if len(x):
                    for p, q in zip(*(c.tolist() for c in fold.coefficients(position, x, previous)), strict=True):
                        a, b = p * a, p * b + q
                    position, previous = position + len(x), float(x[-1])
        if current is not None:
            done.append((*current, a, b))
            columns = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.float64(), pa.float64()], strict=True)], [*keys, "_a", "_b"])

    return run


def _compose(keys: tuple[str, ...]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, y = object(), 0.0
        for batch in batches:
            starts = []
            maps = list(zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True))
            for key, lo, hi in groups(batch, keys):
                if key != current:
                    current, y = key, 0.0
                for a, b in maps[lo:hi]:
                    starts.append(y)
                    y = a * y + b
            names = [*keys, "_block"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(starts, pa.float64())], [*names, "_start"])

    return run


def _from_starts(fold: Affine, keys: tuple[str, ...], columns: list[str], names: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, y, position, previous = None, 0.0, 0, None
        for batch in batches:
            out: list[float | None] = []
            more: list[list[float | None]] = [[] for _ in names[1:]]
            for key, lo, hi in groups(batch, keys):
                if key != current:
                    current, y = key, batch.column("_start")[lo].as_py() or 0.0
                    position, previous = batch.column("_position")[lo].as_py() or 0, batch.column("_previous")[lo].as_py()
                values = batch.column(fold.inputs[0])[lo:hi].to_pylist()
                x = np.array([v for v in values if v is not None], dtype=float)
                steps = iter(zip(*(c.tolist() for c in fold.coefficients(position, x, previous)), strict=True)) if len(x) else iter(())
                if more:
                    # By row, the number of readings so far in this part: null readings give the last values again.
                    seen = np.cumsum([v is not None for v in values])
                    for have, new, old in zip(more, fold.others(position, len(x)) if len(x) else fold.others(position, 0), fold.others(position - 1, 1) if position else fold.others(0, 0), strict=False):
                        told = np.concatenate([old[-1:], new])[seen] if len(x) else np.repeat(old[-1:], len(values))
                        have += [None if np.isnan(t) else t for t in told.tolist()]
                for v in values:
                    if v is not None:
                        a, b = next(steps)
                        y = a * y + b
                        position += 1
                    out.append(y if position else fold.initial)
                if len(x):
                    previous = float(x[-1])
            added = [pa.array(o, pa.float64()) for o in (out, *more)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], [*columns, *names])

    return run


def _composed(df: DataFrame, stream: Stream, fold: Composable) -> DataFrame:
    """The two-pass form for composable folds."""
    keys, cut = stream.keys, blocks(df, stream)
    from pyspark.sql import Window

    largest = F.max(fold.carry) if fold.carry else F.lit(None).cast("long")
    per = cut.groupBy(*keys, "_block").agg(largest.alias("_largest"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_block", F.max("_largest").over(before).alias("_carried"))
    placed = _same_keys(cut, per, [*keys, "_block"], "left").select(*cut.columns, "_carried")
    whole = (*keys, "_block")
    key_schema = [cut.schema[k] for k in whole]
    dealt = lambda rows: rows.repartition("_block", *keys).sortWithinPartitions("_block", *keys, *stream.order)
    functions = dealt(placed).mapInArrow(_block_functions(fold, whole), T.StructType([*key_schema, T.StructField("_function", T.BinaryType())]))
    # A row for each block of a stream.
    starts = functions.repartition(*(F.col(k) for k in keys)) if keys else functions.coalesce(1)
    starts = starts.sortWithinPartitions(*keys, "_block").mapInArrow(_applied(fold, keys), T.StructType([*key_schema, T.StructField("_core", T.StringType())]))
    begun = _same_keys(placed, starts, list(whole), "left").select(*placed.columns, "_core")
    schema = T.StructType([*df.schema.fields, *(T.StructField(k, _SQL[t]) for k, t in fold.outputs.items())])
    return dealt(begun).mapInArrow(_from_cores(fold, whole, df.columns), schema)


def _block_functions(fold: Composable, keys: tuple[str, ...]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        current, function, carried, types = None, None, None, None
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            inputs = [batch.column(c).to_pylist() for c in fold.inputs]
            for key, lo, hi in groups(batch, keys):
                if key != current:
                    if current is not None:
                        done.append((*current, fold.packed(function)))
                    current, function, carried = key, fold.identity(), batch.column("_carried")[lo].as_py()
                function, carried = fold.extended(function, carried, *(c[lo:hi] for c in inputs))
        if current is not None:
            done.append((*current, fold.packed(function)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [*types, pa.binary()], strict=True)], [*keys, "_function"])

    return run


def _applied(fold: Composable, keys: tuple[str, ...]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, core = object(), None
        for batch in batches:
            starts, functions = [], batch.column("_function").to_pylist()
            for key, lo, hi in groups(batch, keys):
                if key != current:
                    current, core = key, fold.core()
                for f in functions[lo:hi]:
                    starts.append(json.dumps(core))
                    core = fold.applied(f, core)
            names = [*keys, "_block"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(starts, pa.string())], [*names, "_core"])

    return run


def _from_cores(fold: Composable, keys: tuple[str, ...], columns: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            inputs, outs = [batch.column(c).to_pylist() for c in fold.inputs], [[] for _ in fold.outputs]
            for key, lo, hi in groups(batch, keys):
                if key != current:
                    current, state = key, fold.seeded(json.loads(batch.column("_core")[lo].as_py()), batch.column("_carried")[lo].as_py())
                state, got = fold.run(state, *(c[lo:hi] for c in inputs))
                for have, new in zip(outs, got, strict=True):
                    have.extend(new)
            added = [pa.array(o, _ARROW[t]) for o, t in zip(outs, fold.outputs.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], [*columns, *fold.outputs])

    return run
