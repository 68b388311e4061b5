"""Metrics of a running query: what its stages observe reaches a bounded recorder, and exports.

`watched` lets each stage of a pipeline observe the rows that pass and their latency, as states
of fixed size, in the query itself. A Recorder, added to the session as a listener, merges them as
micro-batches end and keeps a snapshot of each. Snapshots have the columns of
`metrics.pipeline_snapshot`, so `export` writes them as JSON, CSV and text. Percentiles are those
of logarithmic buckets.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gaugeworks.operators import export
from gaugeworks.operators.core import Pipeline
from gaugeworks.operators.percentiles import Sums, bucket_of, histogram, moments

_LATENCY = "struct<count:bigint,mean_ns:double,min_ns:bigint,max_ns:bigint,p50_ns:bigint,p95_ns:bigint,p99_ns:bigint,p999_ns:bigint>"
_JITTER = "struct<count:bigint,mean_ns:double,variance:double,std_dev_ns:double,min_ns:bigint,max_ns:bigint,range_ns:bigint>"
_STAGE = f"struct<name:string,input_count:bigint,output_count:bigint,filtered_count:bigint,dropped_count:bigint,error_count:bigint,latency:{_LATENCY},jitter:{_JITTER},throughput_ratio:double,filter_rate:double,drop_rate:double,error_rate:double,throughput:double>"
#: Of a recorded snapshot.
SCHEMA = (
    f"recorded_at timestamp, query string, batch bigint, empty_polls bigint, stages array<{_STAGE}>, total_input bigint, total_output bigint, end_to_end_latency {_LATENCY}, end_to_end_jitter {_JITTER}, "
    "elapsed_secs double, busy_secs double, drop_rate double, throughput double"
)


def event_latency(time_column: str = "timestamp_ns") -> Column:
    """Nanoseconds from a row's own time to now, 0 at least."""
    return F.greatest(F.unix_micros(F.current_timestamp()) * 1000 - F.col(time_column), F.lit(0))


def watched(pipeline: Pipeline, df: DataFrame, name: str, latency: Column | None = None, errors: Column | None = None) -> DataFrame:
    """The pipeline's result; each stage observes its rows and their latency under `name`.

    latency: by columns that every stage keeps; errors: rows that count as errors, not as output.
    """
    if "/" in name:
        raise ValueError("the name of a watched pipeline has no slash")
    latency = event_latency() if latency is None else latency
    failed = F.coalesce(errors, F.lit(False)) if errors is not None else F.lit(False)

    def observed(rows: DataFrame, place: int, stage: str) -> DataFrame:
        rows = rows.withColumn("_latency", latency).withColumn("_bucket", bucket_of(F.col("_latency")))
        return rows.observe(f"{name}/{place}/{stage}", F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("errors"), histogram("_bucket").alias("histogram"), moments("_latency").alias("moments")).drop("_latency", "_bucket")

    df = observed(df, 0, "")
    for i, stage in enumerate(pipeline.stages, 1):
        df = observed(stage(df), i, stage.name)
    return df


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


class Recorder(StreamingQueryListener):
    """Snapshots of the watched pipeline `name`, the last `limit` of them.

    A batch that is reported twice counts once. elapsed_secs is the time since the query's start as
    its batches tell it, busy_secs what they took; a batch without rows is an empty poll.
    """

    def __init__(self, name: str, limit: int = 1000) -> None:
        self.name, self.history = name, deque(maxlen=limit)
        self.sums: dict[int, Sums] = {}
        self.stages: dict[int, str] = {}
        self.seen: set[tuple[str, int]] = set()
        self.begun: datetime | None = None
        self.busy, self.empty, self.failed = 0.0, 0, []
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        self.take(event.progress)

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        if event.exception:
            self.failed.append(event.exception)

    def take(self, progress) -> None:  # noqa: ANN001
        """One micro-batch's report."""
        found = {k: v for k, v in progress.observedMetrics.items() if k.startswith(f"{self.name}/")}
        with self.lock:
            batch = (str(progress.runId), progress.batchId)
            if not found or batch in self.seen:
                return
            self.seen = {batch, *(s for s in self.seen if s[0] == batch[0] and s[1] > batch[1] - 100)}
            for key, row in found.items():
                _, place, stage = key.split("/", 2)
                self.stages[int(place)] = stage
                self.sums.setdefault(int(place), Sums()).add(row)
            now = datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00"))
            took = progress.durationMs.get("triggerExecution", 0) / 1000
            self.begun = self.begun or now
            self.busy += took
            self.empty += progress.numInputRows == 0
            self.history.append(self._snapshot(now, progress.name or str(progress.id), progress.batchId, (now - self.begun).total_seconds() + took))

    def _snapshot(self, now: datetime, query: str, batch: int, elapsed: float) -> tuple:
        places = sorted(self.sums)
        stages = []
        for before, place in zip(places, places[1:], strict=False):
            a, b = self.sums[before], self.sums[place]
            good, gone = b.rows - b.errors, max(a.rows - b.rows, 0)
            stages.append((self.stages[place], a.rows, good, gone, 0, b.errors, b.latency(), b.jitter(), _share(good, a.rows), _share(gone, a.rows), 0.0, _share(b.errors, a.rows), _share(good, elapsed)))
        first, last = self.sums[places[0]], self.sums[places[-1]]
        total = last.rows - last.errors
        return now, query, batch, self.empty, stages, first.rows, total, last.latency(), last.jitter(), elapsed, self.busy, 1 - _share(total, first.rows) if first.rows else 0.0, _share(total, elapsed)

    def wait(self, rows: int, seconds: float = 30) -> bool:
        """Whether reports of so many input rows came within the time; listeners hear a batch after it has ended."""
        until = time.monotonic() + seconds
        while time.monotonic() < until:
            if self.sums and self.sums[min(self.sums)].rows >= rows:
                return True
            time.sleep(0.05)
        return False

    def snapshots(self, spark: SparkSession) -> DataFrame:
        """The kept snapshots as a table."""
        with self.lock:
            kept = list(self.history)
        return spark.createDataFrame(kept, SCHEMA)

    def latest(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            kept = list(self.history)[-1:]
        return spark.createDataFrame(kept, SCHEMA)

    def export(self, spark: SparkSession, path: str, kind: str) -> None:
        """All kept snapshots as json, csv or text."""
        export.write(self.snapshots(spark), path, kind)

    def page(self, spark: SparkSession) -> str:
        """The dashboard of the last snapshot, with the throughput of those before."""
        [last] = self.latest(spark).collect()
        with self.lock:
            history = [h[-1] for h in self.history]
        return export.dashboard(last, history)

    def clear(self) -> None:
        with self.lock:
            self.history.clear()
