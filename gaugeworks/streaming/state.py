"""Stateful processors: folds, machines with timers and nearest as-of pairs, by key.

Rows and state keep their types: a long next to a null stays a long, NaN stays NaN. State is
typed by what a fold or machine says. The rows of one key in one micro-batch are sorted in the
memory of a task, so a source's own limits (maxFilesPerTrigger, maxBytesPerTrigger) bound it. All need the
RocksDB state store.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.functions.clock import event_time as event_time_of
from gaugeworks.operators.folds import _SQL, Fold
from gaugeworks.operators.fusion import CELL_SPANS
from gaugeworks.operators.machines import Machine, Running, out_schema

MS = 1_000_000  # nanoseconds


def _by(order: tuple[str, ...]):  # noqa: ANN202
    """Sort key of rows; nulls first, as Spark sorts, and NaN last."""
    return lambda row: tuple((row[c] is not None, row[c] != row[c], row[c]) for c in order)


def _plain(value: Any) -> Any:
    """Rows as tuples, at any depth: state is told by position."""
    return tuple(map(_plain, value)) if isinstance(value, tuple) else [_plain(v) for v in value] if isinstance(value, list) else value


class FoldProcessor(StatefulProcessor):
    """Adds a fold's outputs to each row."""

    def __init__(self, fold: Fold, order: tuple[str, ...], names: list[str]) -> None:
        self.fold, self.order, self.names = fold, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.fold.state_type)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: ARG002
        fold, batch = self.fold, sorted(rows, key=_by(self.order))
        state = fold.unpack(self.state.get()) if self.state.exists() else fold.start()
        state, got = fold.run(state, *([r[c] for r in batch] for c in fold.inputs))
        self.state.update(_plain(fold.pack(state)))
        row = Row(*self.names, *fold.outputs)
        for i, r in enumerate(batch):
            yield row(*(r[c] for c in self.names), *(g[i] for g in got))

    def close(self) -> None:
        pass


def streamed(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], fold: Fold, mode: str = "append") -> DataFrame:
    """A fold over a streaming DataFrame.

    A row that comes in a later micro-batch than its successors is folded in after them.
    """
    if clash := {*df.columns} & {*fold.outputs}:
        raise ValueError(f"input already has the columns {', '.join(sorted(clash))}")
    schema = T.StructType([*df.schema.fields, *(T.StructField(k, _SQL[t]) for k, t in fold.outputs.items())])
    return df.groupBy(*keys).transformWithState(FoldProcessor(fold, tuple(order), df.columns), schema, mode, "None")


class MachineProcessor(StatefulProcessor):
    """What a machine says; one timer a key, at the next tick or end."""

    def __init__(self, machine: Machine, order: tuple[str, ...], time: str, control: str | None, names: list[str]) -> None:
        self.machine, self.order, self.time, self.control, self.names = machine, order, time, control, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.machine.state_type)
        self.clock = handle.getValueState("clock", "last long, ticked boolean, paused boolean, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: ARG002
        running, timer = self._restored()
        for r in sorted(rows, key=_by(self.order)):
            for said in running.row(r[self.time], r[self.control] if self.control else None, tuple(r[c] for c in self.machine.inputs)):
                yield self._told(key, said)
        self._kept(running, timer)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: ARG002
        running, _ = self._restored()
        # Rows to come are later than the watermark.
        for said in running.passed(timerValues.getCurrentWatermarkInMs() * MS + 1):
            yield self._told(key, said)
        self._kept(running, None)

    def _restored(self) -> tuple[Running, int | None]:
        if not self.clock.exists():
            return Running(self.machine), None
        last, ticked, paused, timer = self.clock.get()
        return Running(self.machine, self.machine.unpack(self.state.get()), last, ticked, paused), timer

    def _kept(self, running: Running, timer: int | None) -> None:
        due = running.due()
        wanted = None if due is None else due // MS + 1
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if running.last is None and not running.paused and running.state == self.machine.start():
            self.state.clear()
            self.clock.clear()
        else:
            self.state.update(_plain(self.machine.pack(running.state)))
            self.clock.update((running.last, running.ticked, running.paused, wanted))

    def _told(self, key: Any, said: tuple) -> Row:
        at, cause, out = said
        return Row(*self.names)(*key, at, cause, *(out or (None,) * len(self.machine.outputs)))

    def close(self) -> None:
        pass


def spoken(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], machine: Machine, delay: str, time: str = "timestamp_ns", control: str | None = None, event_time: str = "event_time") -> DataFrame:
    """What a machine says over a stream: as `machines.spoken` says over the same rows, once the watermark has passed.

    event_time is derived from `time` where it is missing. Rows later than the watermark are
    left out. The last row's tick comes when the watermark passes it, a flush by a control row or
    when the stream is forgotten.
    """
    df = df if event_time in df.columns else df.withColumn(event_time, event_time_of(F.col(time)))
    schema = out_schema(df, keys, machine)
    return df.withWatermark(event_time, delay).groupBy(*keys).transformWithState(MachineProcessor(machine, tuple(order), time, control, schema.names), schema, "append", "EventTime")


class NearestProcessor(StatefulProcessor):
    """Pairs the primaries of one time cell once nothing nearer can come, then forgets the cell."""

    def __init__(self, tolerance: int, width: int, how: str, primary: list[str]) -> None:
        self.tolerance, self.width, self.how, self.primary = tolerance, width, how, primary

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.types[0])
        self.near = handle.getListState("near", self.types[1])
        self.timers = handle.getValueState("timers", "due long, last long")

    types: tuple[T.StructType, T.StructType]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: ARG002
        waiting, near = [], []
        for r in rows:
            if r["_kind"] == 0:
                waiting.append((r["_t"], _plain(r["_p"])))
            else:
                near.append((r["_t"], r["_seq"], _plain(r["_s"])))
        if waiting:
            self.waiting.appendList(waiting)
        if near:
            self.near.appendList(near)
        due, last = self.timers.get() if self.timers.exists() else (None, None)
        if last is None:
            last = self._ms((key[-1] + 1) * self.width - 1)
            self.handle.registerTimer(last)
        if waiting and (due is None or self._ms(min(t for t, _ in waiting)) < due):
            if due is not None and due != last:
                self.handle.deleteTimer(due)
            due = self._ms(min(t for t, _ in waiting))
            if due != last:
                self.handle.registerTimer(due)
        self.timers.update((due, last))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: ARG002
        now = timerValues.getCurrentWatermarkInMs()
        if not self.timers.exists():
            return
        _, last = self.timers.get()
        near = sorted(map(_plain, self.near.get()), key=lambda x: (x[0], x[1] is not None, x[1]))
        times, late = [x[0] for x in near], []
        for t, p in map(_plain, self.waiting.get()):
            # Rows to come are later than the watermark, so none of them is within the tolerance.
            if self._ms(t) <= now or now >= last:
                yield from self._paired(t, p, near, times)
            else:
                late.append((t, p))
        if now >= last:
            for state in (self.waiting, self.near, self.timers):
                state.clear()
            return
        self.waiting.put(late) if late else self.waiting.clear()
        due = self._ms(min(t for t, _ in late)) if late else None
        # Primaries to come are later than the watermark too: older secondaries are out of their reach.
        low = min([now * MS, *(t for t, _ in late)]) - self.tolerance
        kept = near[bisect.bisect_left(times, low) :]
        if len(kept) < len(near):
            self.near.put(kept) if kept else self.near.clear()
        if due is not None and due != last:
            self.handle.registerTimer(due)
        self.timers.update((due, last))

    def _ms(self, t: int) -> int:
        """The watermark at which nothing to come can be near a time."""
        return -(-(t + self.tolerance) // MS)

    def _paired(self, t: int, p: Any, near: list, times: list[int]) -> Iterator[Row]:
        i = bisect.bisect_left(times, t)
        # Of secondaries with one time the first has the lowest seq.
        around = [near[k] for k in {i, bisect.bisect_left(times, times[i - 1]) if i else i} if k < len(near)]
        best = min((x for x in around if abs(x[0] - t) <= self.tolerance), key=lambda x: (abs(x[0] - t), x[1] is not None, x[1]), default=None)
        if self.how == "left_anti":
            if best is None:
                yield Row(*self.primary)(*p)
        elif best is not None or self.how == "left":
            yield Row(*self.primary, "secondary", "time_diff")(*p, best and best[2], abs(best[0] - t) if best else None)

    def close(self) -> None:
        pass


def asof_nearest(primary: DataFrame, secondary: DataFrame, tolerance: int, delay: str, keys: tuple[str, ...] = (), time: str = "timestamp_ns", seq: str = "seq", how: str = "inner", event_time: str = "event_time", cell_spans: int | None = None) -> DataFrame:
    """Pairs each primary of a stream with the nearest secondary of another, as `fusion.asof_nearest` does with tables.

    A primary comes out once, when the watermark says that nothing nearer can come. Both streams
    are cut into time cells, secondaries copied to the cells that they can reach, so a stream without
    keys has as many tasks as it has open cells, and a cell's state goes when it is over. event_time is
    derived from `time` where it is missing; rows without a time, and rows later than the
    watermark, are left out.
    """
    width = max(1, tolerance) * (cell_spans or CELL_SPANS)
    if how not in ("inner", "left", "left_anti"):
        raise ValueError(f"no kind of join {how}")
    cell = lambda at: F.floor(at.cast("decimal(38,0)") / F.lit(width)).cast("long")

    def tagged(df: DataFrame, kind: int) -> DataFrame:
        columns = df.columns
        df = df if event_time in columns else df.withColumn(event_time, event_time_of(F.col(time)))
        df = df.filter(F.col(time).isNotNull()).withWatermark(event_time, delay)
        cells = cell(F.col(time)) if kind == 0 else F.explode(F.array_distinct(F.array(cell(F.col(time) - tolerance), cell(F.col(time) + tolerance))))
        own, other = F.struct(*columns), F.lit(None).cast(secondary.schema if kind == 0 else primary.schema)
        return df.select(
            *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(event_time).alias("_event_time"), F.col(time).cast("long").alias("_t"), F.lit(kind).alias("_kind"),
            (F.col(seq) if kind else F.lit(None).cast(secondary.schema[seq].dataType)).alias("_seq"), (other if kind else own).alias("_p"), (own if kind else other).alias("_s"), cells.alias("_cell"),
        )

    both = tagged(primary, 0).unionByName(tagged(secondary, 1))
    nullable = lambda s: T.StructType([T.StructField(f.name, f.dataType) for f in s.fields])
    processor = NearestProcessor(tolerance, width, how, primary.columns)
    t = T.StructField("t", T.LongType())
    processor.types = T.StructType([t, T.StructField("p", nullable(primary.schema))]), T.StructType([t, T.StructField("seq", secondary.schema[seq].dataType), T.StructField("s", nullable(secondary.schema))])
    out = nullable(primary.schema)
    if how != "left_anti":
        out = out.add("secondary", nullable(secondary.schema)).add("time_diff", "long")
    return both.groupBy(*(f"_k{i}" for i in range(len(keys))), "_cell").transformWithState(processor, out, "append", "EventTime")
