"""Stages that may speak when nothing comes: process, tick when idle, flush at the end.

A machine gives at most one output for each input, one when its stream has been idle for
`idle_ns`, and one when it ends. Time is the rows' own, so batch and stream agree. A stream is
forgotten, after a flush, when nothing came for `forget_ns`; its next row starts it anew.

Control rows steer a single key while the others go on: `reset` starts it anew, `pause` lets its
rows pass unprocessed until `resume`, `flush` makes it speak. What comes out tells its cause:
row, tick, flush or paused.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugeworks.operators.folds import _ARROW, _SQL, groups
from gaugeworks.operators.ordered import Stream

ROW, TICK, FLUSH, PAUSED = "row", "tick", "flush", "paused"
RESET, PAUSE, RESUME = "reset", "pause", "resume"
CONTROLS = (RESET, PAUSE, RESUME, FLUSH)
#: What a machine emits besides the stream's keys.
AT, CAUSE = "at_ns", "cause"
Spoken = tuple[int, str, tuple | None]


@dataclass(frozen=True)
class Machine:
    """inputs: columns it reads; outputs: name -> type. State is stored by state_type, as in folds."""

    inputs: tuple[str, ...]
    outputs: dict[str, str] = field(default_factory=dict)
    idle_ns: int | None = None
    forget_ns: int | None = None
    state_type: ClassVar[str] = "blob binary"

    def __post_init__(self) -> None:
        if self.idle_ns is not None and self.forget_ns is not None and self.forget_ns < self.idle_ns:
            raise ValueError("a stream can't be forgotten before it is idle")

    def pack(self, state: Any) -> tuple:
        return (pickle.dumps(state),)

    def unpack(self, stored: tuple) -> Any:
        return pickle.loads(stored[0])

    def start(self) -> Any:
        return None

    def process(self, state: Any, *values: Any) -> tuple[Any, tuple | None]:
        """(state after, outputs or None) for one row."""
        raise NotImplementedError

    def tick(self, state: Any) -> tuple[Any, tuple | None]:
        """Once for each time the stream falls idle."""
        return state, None

    def flush(self, state: Any) -> tuple[Any, tuple | None]:
        return self.tick(state)


@dataclass(frozen=True)
class Debounce(Machine):
    """The last row of each burst: a value is told once nothing came for idle_ns."""

    def start(self) -> list:
        return []

    def process(self, state, *values):  # noqa: ANN001, ANN201
        return [tuple(values)], None

    def tick(self, state):  # noqa: ANN001, ANN201
        return [], state[0] if state else None


@dataclass(frozen=True)
class Batched(Machine):
    """Sums and counts of every `size` rows; what is left is told when the stream falls idle or ends. Null values count and add nothing."""

    size: int = 10
    state_type: ClassVar[str] = "rows long, total double"

    def start(self) -> tuple:
        return 0, 0.0

    def pack(self, state: Any) -> tuple:
        return state

    def unpack(self, stored: tuple) -> Any:
        return tuple(stored)

    def process(self, state, value):  # noqa: ANN001, ANN201
        rows, total = state[0] + 1, state[1] + (value or 0.0)
        return ((0, 0.0), (rows, total)) if rows == self.size else ((rows, total), None)

    def tick(self, state):  # noqa: ANN001, ANN201
        return (0, 0.0), state if state[0] else None


class Running:
    """One stream of a machine: its state, the time of its last row and whether it has ticked since, or is paused."""

    def __init__(self, machine: Machine, state: Any = None, last: int | None = None, ticked: bool = False, paused: bool = False) -> None:
        self.machine, self.last, self.ticked, self.paused = machine, last, ticked, paused
        self.state = machine.start() if state is None else state

    def passed(self, now: int) -> Iterator[Spoken]:
        """What falls due before a time: a tick, and the end of a stream that is forgotten."""
        m, last = self.machine, self.last
        if last is None or self.paused:
            return
        if m.idle_ns is not None and not self.ticked and now > last + m.idle_ns:
            self.ticked = True
            yield from self._spoken(last + m.idle_ns, TICK, m.tick)
        if m.forget_ns is not None and now > last + m.forget_ns:
            yield from self._spoken(last + m.forget_ns, FLUSH, m.flush)
            self.__init__(m)

    def due(self) -> int | None:
        """When something is to be told next if nothing comes."""
        m = self.machine
        if self.last is None or self.paused:
            return None
        waits = [x for x in (None if self.ticked else m.idle_ns, m.forget_ns) if x is not None]
        return self.last + min(waits) if waits else None

    def row(self, at: int | None, control: str | None, values: tuple) -> Iterator[Spoken]:
        """A row without a time comes at the time of the one before."""
        at = self.last if at is None else at
        if at is not None:
            yield from self.passed(at)
        if control == RESET:
            self.__init__(self.machine, paused=self.paused)
        elif control in (PAUSE, RESUME):
            self.paused = control == PAUSE
        elif control == FLUSH:
            yield from self._spoken(at, FLUSH, self.machine.flush)
        elif self.paused:
            yield at, PAUSED, None
        else:
            self.last, self.ticked = at if self.last is None or (at is not None and at > self.last) else self.last, False
            self.state, out = self.machine.process(self.state, *values)
            if out is not None:
                yield at, ROW, out

    def ended(self) -> Iterator[Spoken]:
        """The end of a finished stream: it falls idle, then it is flushed, or forgotten."""
        if self.last is None or self.paused:
            return
        waits = [x for x in (self.machine.idle_ns, self.machine.forget_ns) if x is not None]
        if waits:
            yield from self.passed(self.last + max(waits) + 1)
        if self.last is not None:
            yield from self._spoken(self.last + (self.machine.idle_ns or 0), FLUSH, self.machine.flush)

    def _spoken(self, at: int | None, cause: str, speak) -> Iterator[Spoken]:  # noqa: ANN001
        self.state, out = speak(self.state)
        if out is not None:
            yield at, cause, out


def out_schema(df: DataFrame, keys: tuple[str, ...], machine: Machine) -> T.StructType:
    if clash := {*keys} & {AT, CAUSE, *machine.outputs}:
        raise ValueError(f"keys have the names of outputs: {', '.join(sorted(clash))}")
    return T.StructType([*(df.schema[k] for k in keys), T.StructField(AT, T.LongType()), T.StructField(CAUSE, T.StringType()), *(T.StructField(k, _SQL[t]) for k, t in machine.outputs.items())])


def spoken(df: DataFrame, stream: Stream, machine: Machine, time: str = "timestamp_ns", control: str | None = None) -> DataFrame:
    """What a machine says over a finished stream: the keys, at_ns, cause and its outputs (null where paused rows pass).

    Only the state is held, so a key may be any length. Without keys the stream is one task's,
    since what a machine does to its state may be anything. An empty table says nothing.
    """
    keys = stream.keys
    schema = out_schema(df, keys, machine)
    rows = (df.repartition(*keys) if keys else df.coalesce(1)).sortWithinPartitions(*keys, *stream.order)
    arrow = [pa.int64(), pa.string(), *(_ARROW[t] for t in machine.outputs.values())]
    nothing = (None,) * len(machine.outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running, types = None, None, None

        def told(said: list[tuple[tuple, Spoken]]) -> pa.RecordBatch:
            columns = [*zip(*(key for key, _ in said), strict=True)] if keys else []
            rest = zip(*((at, cause, *(out or nothing)) for _, (at, cause, out) in said), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, *rest], [*types, *arrow], strict=True)], schema.names)

        for batch in batches:
            said: list[tuple[tuple, Spoken]] = []
            types = [batch.schema.field(k).type for k in keys]
            times, values = batch.column(time).to_pylist(), [batch.column(c).to_pylist() for c in machine.inputs]
            controls = batch.column(control).to_pylist() if control else [None] * batch.num_rows
            for key, lo, hi in groups(batch, keys):
                if key != current or running is None:
                    if running is not None:
                        said += [(current, s) for s in running.ended()]
                    current, running = key, Running(machine)
                for i in range(lo, hi):
                    said += [(key, s) for s in running.row(times[i], controls[i], tuple(v[i] for v in values))]
            if said:
                yield told(said)
        if running is not None and (said := [(current, s) for s in running.ended()]):
            yield told(said)

    return rows.mapInArrow(run, schema)
