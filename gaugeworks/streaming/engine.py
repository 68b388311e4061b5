"""The same operators on streams: folds with keyed state, event-time windows, query control."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from gaugeworks.operators.folds import Fold
from gaugeworks.operators.sliding import Frame
from gaugeworks.streaming.state import asof_nearest, spoken, streamed  # noqa: F401

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass(frozen=True)
class LastRows(Fold):
    """Moving average and upper median of the last `size` readings; null rows are no reading."""

    size: int = 10
    state_type: ClassVar[str] = "held array<double>"

    def start(self):  # noqa: ANN201
        return Frame(self.size)

    def pack(self, state):  # noqa: ANN001, ANN201
        return (list(state.rows),)

    def unpack(self, stored):  # noqa: ANN001, ANN201
        return Frame(self.size, stored[0] or [])

    def run(self, state, values):  # noqa: ANN001, ANN201
        averages, medians = [], []
        for x in values:
            if x is not None:
                state.push(x)
            averages.append(sum(state.rows) / len(state.rows) if state.rows else None)
            medians.append(state.median())
        named = {"average": averages, "median": medians}
        return state, tuple(named[k] for k in self.outputs)


@dataclass(frozen=True)
class Running(Fold):
    """Count, sum in whole units and largest time so far, as count, mean and timestamp_ns of a clock that never goes back."""

    scale: int = 100
    state_type: ClassVar[str] = "n long, units long, top long"

    def pack(self, state):  # noqa: ANN001, ANN201
        return state

    def unpack(self, stored):  # noqa: ANN001, ANN201
        return tuple(stored)

    def run(self, state, values, times):  # noqa: ANN001, ANN201
        n, units, top = state or (0, 0, None)
        counts, means, tops = [], [], []
        for x, t in zip(values, times, strict=True):
            n += 1
            units += 0 if x is None else round(x * self.scale)
            top = t if top is None or (t is not None and t > top) else top
            counts.append(n)
            means.append(units / self.scale / n)
            tops.append(top)
        return (n, units, top), (counts, means, tops)


def windowed(df: DataFrame, time: str, delay: str, size: str, slide: str | None = None, keys: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    """Tumbling or sliding event-time windows; rows later than the watermark are left out."""
    return df.withWatermark(time, delay).groupBy(F.window(time, size, slide), *keys).agg(*(c.alias(k) for k, c in aggregates.items()))


def sessions(df: DataFrame, time: str, delay: str, gap: str, keys: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    return df.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(*(c.alias(k) for k, c in aggregates.items()))


def first_seen(df: DataFrame, time: str, delay: str, *columns: str) -> DataFrame:
    """One row of those that agree in the columns within the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(columns))


def interval_pairs(primary: DataFrame, secondary: DataFrame, tolerance: str, delay: str, keys: tuple[str, ...] = (), time: str = "event_time", seq: str = "seq") -> DataFrame:
    """All pairs within the tolerance, from two streams with watermarks; `nearest_of` reduces them."""
    left = primary.withWatermark(time, delay).select(*(F.col(c).alias(f"p_{c}") for c in primary.columns))
    right = secondary.withWatermark(time, delay).select(*(F.col(c).alias(f"s_{c}") for c in secondary.columns))
    near = F.expr(f"s_{time} between p_{time} - interval {tolerance} and p_{time} + interval {tolerance}")
    for k in keys:
        near = near & (F.col(f"p_{k}") == F.col(f"s_{k}"))
    return left.join(right, near)


def nearest_of(pairs: DataFrame, keys: tuple[str, ...] = (), time: str = "event_time", seq: str = "seq") -> DataFrame:
    """Of each primary's pairs the nearest, ties to the lower secondary seq (for a finished batch of pairs)."""
    gap = F.abs(F.unix_micros(f"p_{time}") - F.unix_micros(f"s_{time}"))
    mine = [c for c in pairs.columns if c.startswith("p_")]
    theirs = [c for c in pairs.columns if c.startswith("s_")]
    best = F.min_by(F.struct(*theirs, gap.alias("time_diff_us")), F.struct(gap, F.col(f"s_{seq}")))
    return pairs.groupBy(*mine).agg(best.alias("best")).select(*mine, "best.*")


class State(Enum):
    CREATED = "created"
    RUNNING = "running"
    PAUSED = "paused"
    STOPPED = "stopped"
    ERROR = "error"


@dataclass
class Handle:
    """Controls a streaming query: pause and resume keep its checkpoint, reset starts a new one.

    writer: gives a configured DataStreamWriter for a checkpoint folder.
    """

    writer: Callable[[str], DataStreamWriter]
    checkpoint: str
    query: StreamingQuery | None = None
    generation: int = 0
    paused: bool = False
    progress: list[dict] = field(default_factory=list)

    @property
    def state(self) -> State:
        if self.query is None:
            return State.CREATED
        if self.query.exception() is not None:
            return State.ERROR
        return State.RUNNING if self.query.isActive else State.PAUSED if self.paused else State.STOPPED

    def start(self) -> Handle:
        self.paused = False
        self.query = self.writer(f"{self.checkpoint}/{self.generation}").start()
        return self

    def pause(self) -> None:
        self._stop()
        self.paused = True

    def resume(self) -> Handle:
        return self.start()

    def reset(self) -> Handle:
        self._stop()
        self.generation += 1
        return self.start()

    def shutdown(self) -> None:
        """Stops after what has come in is through."""
        if self.query is not None and self.query.isActive:
            self.query.processAllAvailable()
        self._stop()

    def join(self, timeout: float | None = None) -> bool:
        """Whether the query ended within the time."""
        done = self.query.awaitTermination(timeout) if timeout is not None else self.query.awaitTermination()
        self._keep()
        return done is None or bool(done)

    def _stop(self) -> None:
        if self.query is not None:
            self._keep()
            self.query.stop()

    def _keep(self) -> None:
        self.progress += [p for p in map(_plain, self.query.recentProgress) if p not in self.progress]

    @property
    def total_processed(self) -> int:
        if self.query is not None:
            self._keep()
        return sum(p["rows"] for p in self.progress)

    @property
    def elapsed(self) -> float:
        return sum(p["ms"] for p in self.progress) / 1000

    @property
    def throughput(self) -> float:
        rows = self.total_processed
        return rows / self.elapsed if self.elapsed else 0.0


def _plain(p) -> dict:  # noqa: ANN001
    return {"run": str(p["runId"]), "batch": p["batchId"], "rows": p["numInputRows"], "ms": p["durationMs"].get("triggerExecution", 0)}


def callback(df: DataFrame, function: Callable[[DataFrame, int], None], **options: str) -> DataStreamWriter:
    """Each micro-batch as a DataFrame to a function."""
    return df.writeStream.options(**options).foreachBatch(function)


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and gives the result as a table."""
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
