"""Quality metrics as aggregates: counters, latency, jitter, targets, queue depth."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.ordered import Stream, running, with_previous
from gaugeworks.operators.percentiles import PERCENTILES, bucket_of, bucket_value, summary  # noqa: F401


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def counters(df: DataFrame, kind: str = "kind", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of received, processed, filtered, dropped and errors, with their rates (0 where nothing is counted)."""
    names = ("received", "processed", "filtered", "dropped", "errors")
    got = df.groupBy(*keys).agg(*(F.count_if(F.col(kind) == n).alias(n) for n in names))
    return got.withColumns({"drop_rate": _rate(F.col("dropped"), F.col("received")), "filter_rate": _rate(F.col("filtered"), F.col("processed")), "error_rate": _rate(F.col("errors"), F.col("received"))})


def event_rate(df: DataFrame, time: str = "timestamp_ns", keys: tuple[str, ...] = ()) -> DataFrame:
    """count, elapsed_secs and rate; 0 if no time passed."""
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), ((F.max(time) - F.min(time)) / 1e9).alias("elapsed_secs"))
    return got.withColumn("rate", F.when(F.col("elapsed_secs") > 0, F.col("count") / F.col("elapsed_secs")).otherwise(F.lit(0.0)))


#: Of a latency, in order.
LATENCY = ("count", "mean_ns", "min_ns", "max_ns", *PERCENTILES)


def latency_aggregates(column: str = "latency_ns", accuracy: int = 10_000) -> list[Column]:
    """count, mean, min, max and percentiles of whole nanoseconds by a sketch of fixed size."""
    value = F.col(column)
    tail = [F.coalesce(F.percentile_approx(value, p, accuracy), F.lit(0)).cast("long").alias(name) for name, p in PERCENTILES.items()]
    return [F.count(value).alias("count"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_ns"), F.min(value).alias("min_ns"), F.max(value).alias("max_ns"), *tail]


def latency(df: DataFrame, column: str = "latency_ns", keys: tuple[str, ...] = (), exact: bool = True, spread: bool | str = False) -> DataFrame:
    """Latencies by key, exact ones by ranks over value counts. Without a value count, mean and percentiles are 0."""
    if exact:
        got = summary(df, column, keys, spread=spread).withColumnsRenamed({"mean": "mean_ns", "least": "min_ns", "most": "max_ns"})
        got = got.withColumns({"mean_ns": F.coalesce("mean_ns", F.lit(0.0))} | {name: F.coalesce(F.col(name).cast("long"), F.lit(0)) for name in PERCENTILES})
    else:
        got = df.groupBy(*keys).agg(*latency_aggregates(column))
    return got.withColumns({"mean_us": F.col("mean_ns") / 1000, "p99_us": F.col("p99_ns") / 1000})


def _with_latency(counted: DataFrame, df: DataFrame, column: str, keys: tuple[str, ...], out: str, spread: bool | str) -> DataFrame:
    """Rows by key with the exact latency of the key as a struct, its zeros where there is no value."""
    found = latency(df, column, keys, spread=spread)
    zero = {"count": F.lit(0).cast("long"), "mean_ns": F.lit(0.0)} | {name: F.lit(0).cast("long") for name in PERCENTILES}
    found = found.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *([] if keys else [F.lit(0).alias("_one")]), *(F.col(c).alias(f"_{c}") for c in LATENCY))
    left = counted if keys else counted.withColumn("_none", F.lit(0))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] or [F.col("_none") == F.col("_one")]
    joined = left.join(found, reduce(lambda a, b: a & b, same), "left")
    return joined.select(*counted.columns, F.struct(*(F.coalesce(f"_{c}", zero[c]).alias(c) if c in zero else F.col(f"_{c}").alias(c) for c in LATENCY)).alias(out))


def latency_bucket(value: Column) -> Column:
    """Number of the 64 logarithmic buckets that compatible histograms use."""
    return bucket_of(value)


def latency_histogram(df: DataFrame, column: str = "latency_ns", keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, latency_bucket(F.col(column)).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def jitter_aggregates(column: str) -> list[Column]:
    """count, mean, sample variance and deviation (0 below two values), min, max, range."""
    v = F.col(column)
    return [
        F.count(v).alias("count"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean_ns"),
        F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_dev_ns"),
        F.min(v).alias("min_ns"),
        F.max(v).alias("max_ns"),
        (F.max(v) - F.min(v)).alias("range_ns"),
    ]


def jitter(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    got = df.groupBy(*keys).agg(*jitter_aggregates(column))
    return got.withColumns({"std_dev_us": F.col("std_dev_ns") / 1e3, "std_dev_ms": F.col("std_dev_ns") / 1e6, "coefficient_of_variation": F.when(F.col("mean_ns") != 0, F.col("std_dev_ns") / F.col("mean_ns")).otherwise(F.lit(0.0))})


def intervals(df: DataFrame, stream: Stream, time: str = "timestamp_ns", out: str = "interval_ns") -> DataFrame:
    """Time since the row before; null for the first."""
    return with_previous(df, stream, time, "_previous").withColumn(out, F.col(time) - F.col("_previous")).drop("_previous")


def stage_metrics(df: DataFrame, latency_column: str = "latency_ns", keys: tuple[str, ...] = ("name",), spread: bool | str = False) -> DataFrame:
    """A row for each stage of item rows (name, outcome in output, filtered, dropped, error; latency_ns, bytes, timestamp_ns).

    Every item counts as input. Rates are by input.
    """
    ns = F.col(latency_column)
    got = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("input_count"),
        *(F.count_if(F.col("outcome") == o).alias(f"{n}_count") for o, n in (("output", "output"), ("filtered", "filtered"), ("dropped", "dropped"), ("error", "error"))),
        F.struct(*jitter_aggregates(latency_column)).alias("jitter"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_processed"),
        F.coalesce(F.sum(ns), F.lit(0)).alias("total_ns"),
        ((F.max("timestamp_ns") - F.min("timestamp_ns")) / 1e9).alias("elapsed_secs"),
    )
    return with_stage_rates(_with_latency(got, df, latency_column, keys, "latency", spread))


def with_stage_rates(stages: DataFrame) -> DataFrame:
    """throughput_ratio, filter_rate and drop_rate by input; per second rates where time passed."""
    per = lambda c: F.when(F.col("elapsed_secs") > 0, F.col(c) / F.col("elapsed_secs")).otherwise(F.lit(0.0))
    out = {"throughput_ratio": _rate(F.col("output_count"), F.col("input_count")), "filter_rate": _rate(F.col("filtered_count"), F.col("input_count")), "drop_rate": _rate(F.col("dropped_count"), F.col("input_count"))}
    if "total_ns" in stages.columns:
        out["avg_processing_ns"] = _rate(F.col("total_ns"), F.col("input_count"))
    if "elapsed_secs" in stages.columns:
        out["throughput"] = per("output_count")
        if "bytes_processed" in stages.columns:
            out["bytes_per_sec"] = per("bytes_processed")
    return stages.withColumns(out)


def pipeline_snapshot(stages: DataFrame, end_to_end: DataFrame, latency_column: str = "latency_ns", spread: bool | str = False) -> DataFrame:
    """One row: stages as an array by name, end-to-end latency and jitter, totals, drop_rate (1 - out / in) and throughput.

    end_to_end: an item a row (latency_ns null if it never came out, timestamp_ns).
    """
    listed = stages.agg(F.sort_array(F.collect_list(F.struct("name", *(c for c in stages.columns if c != "name")))).alias("stages"))
    total = end_to_end.agg(
        F.count(F.lit(1)).alias("total_input"),
        F.count(latency_column).alias("total_output"),
        F.struct(*jitter_aggregates(latency_column)).alias("end_to_end_jitter"),
        F.coalesce((F.max("timestamp_ns") - F.min("timestamp_ns")) / 1e9, F.lit(0.0)).alias("elapsed_secs"),
    )
    total = _with_latency(total, end_to_end, latency_column, (), "end_to_end_latency", spread)
    both = listed.join(total)  # one row on either side
    return both.withColumns({"drop_rate": F.when(F.col("total_input") > 0, 1 - F.col("total_output") / F.col("total_input")).otherwise(F.lit(0.0)), "throughput": F.when(F.col("elapsed_secs") > 0, F.col("total_output") / F.col("elapsed_secs")).otherwise(F.lit(0.0))})


@dataclass(frozen=True)
class Targets:
    """Limits, all inclusive."""

    throughput: float = 10_000.0
    p99_us: float = 10_000.0
    jitter_ms: float = 2.0

    def check(self, df: DataFrame, throughput: str = "throughput", p99_ns: str = "p99_ns", jitter_ns: str = "std_dev_ns") -> DataFrame:
        got = df.withColumns({"throughput_ok": F.col(throughput) >= self.throughput, "latency_ok": F.col(p99_ns) / 1000 <= self.p99_us, "jitter_ok": F.col(jitter_ns) / 1e6 <= self.jitter_ms})
        return got.withColumn("all_ok", F.col("throughput_ok") & F.col("latency_ok") & F.col("jitter_ok"))


def token_latency(starts: DataFrame, ends: DataFrame, seq: str = "seq", time: str = "timestamp_ns") -> DataFrame:
    """seq, timestamp_ns and latency_ns of each started item; null latency for those that never ended."""
    done = ends.groupBy(seq).agg(F.min(time).alias("_end"))
    return starts.select(seq, time).join(done, seq, "left").select(seq, time, (F.col("_end") - F.col(time)).alias("latency_ns"))


def snapshot_summary(snapshots: DataFrame) -> DataFrame:
    """One row over (throughput, p99_ns, std_dev_ns, total_input, total_output) rows; zeros if there are none."""
    nil = lambda c: F.coalesce(c, F.lit(0.0))
    got = snapshots.agg(
        F.count(F.lit(1)).alias("snapshots"),
        nil(F.avg("throughput")).alias("avg_throughput"),
        nil(F.min("throughput")).alias("min_throughput"),
        nil(F.max("throughput")).alias("max_throughput"),
        nil(F.avg("p99_ns")).alias("avg_p99_ns"),
        nil(F.max("p99_ns").cast("double")).alias("max_p99_ns"),
        nil(F.avg("std_dev_ns")).alias("avg_jitter_ns"),
        nil(F.max("std_dev_ns")).alias("max_jitter_ns"),
        F.coalesce(F.sum("total_input"), F.lit(0)).alias("total_input"),
        F.coalesce(F.sum("total_output"), F.lit(0)).alias("total_output"),
    )
    return got.withColumn("overall_drop_rate", F.when(F.col("total_input") > 0, 1 - F.col("total_output") / F.col("total_input")).otherwise(F.lit(0.0)))


def queue_depth(df: DataFrame, stream: Stream, kind: str = "kind") -> DataFrame:
    """Adds the queue's depth after each event of kind send, recv or drop."""
    step = F.when(F.col(kind) == "send", 1).when(F.col(kind) == "recv", -1).otherwise(0).cast("long")
    return running(df, stream, depth=("sum", step))


def queue_metrics(df: DataFrame, stream: Stream, capacity: int | None = None, kind: str = "kind") -> DataFrame:
    """sent, received, dropped, depth, max_depth, utilization (% of capacity, 0 if unbounded), pressure (80 % and more), drop_rate (% of sent)."""
    count = lambda k: F.count_if(F.col(kind) == k)
    got = queue_depth(df, stream, kind).groupBy(*stream.keys).agg(count("send").alias("sent"), count("recv").alias("received"), count("drop").alias("dropped"), F.max("depth").alias("max_depth"))
    depth = F.col("sent") - F.col("received")
    used = depth * 100.0 / capacity if capacity else F.lit(0.0)
    return got.withColumns({"depth": depth, "max_depth": F.greatest(F.col("max_depth"), F.lit(0)), "utilization": used, "pressure": used >= 80, "drop_rate": F.coalesce(F.try_divide(F.col("dropped") * 100.0, F.col("sent")), F.lit(0.0))})


def latest(df: DataFrame, limit: int, order: str = "recorded_at", keys: tuple[str, ...] = ()) -> DataFrame:
    """The last `limit` rows of each key: what a bounded recorder keeps."""
    if not keys:
        return df.orderBy(F.desc(order)).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
