"""Exports of a metrics snapshot: JSON, CSV, text, status lines, and what a recorder keeps.

A snapshot is the one-row table of metrics.pipeline_snapshot. JSON and CSV are built as
Columns, so many snapshots export in parallel; text helpers work on one collected row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gaugeworks.operators.metrics import Targets, latest

#: Columns of the CSV, in order (fixed values).
CSV_COLUMNS = ["timestamp", "stage", "input_count", "output_count", "filtered_count", "dropped_count", "error_count", "throughput_ratio", "mean_latency_ns", "p99_latency_ns", "jitter_ns"]
PIPELINE_ROW = "_pipeline"
GLYPHS = "▁▂▃▄▅▆▇"


def _fixed(c: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", (F.col(c) if isinstance(c, str) else c).cast("double"))


def _object(**parts: Column) -> Column:
    inner = [F.concat(F.lit(f'"{k}": '), v.cast("string")) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *inner), F.lit("}"))


def to_json(snapshots: DataFrame, out: str = "json") -> DataFrame:
    """Adds the JSON document of each snapshot: counts whole, rates with 2, 4 or 3 decimals."""
    latency = lambda c: _object(count=c["count"], mean_ns=_fixed(c["mean_ns"], 2), **{p: c[p] for p in ("p50_ns", "p95_ns", "p99_ns", "p999_ns")})
    jitter = lambda c: _object(count=c["count"], mean_ns=_fixed(c["mean_ns"], 2), std_dev_ns=_fixed(c["std_dev_ns"], 2))
    stage = lambda s: _object(
        name=F.to_json(F.struct(s["name"].alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(s["name"].alias("n")))) - 6),
        **{c: s[c] for c in ("input_count", "output_count", "filtered_count", "dropped_count", "error_count")},
        throughput_ratio=_fixed(s["throughput_ratio"], 4),
        latency=_object(mean_ns=_fixed(s["latency"]["mean_ns"], 2), p99_ns=s["latency"]["p99_ns"]),
        jitter=_object(std_dev_ns=_fixed(s["jitter"]["std_dev_ns"], 2)),
    )
    document = _object(
        throughput=_fixed("throughput", 2),
        total_input=F.col("total_input"),
        total_output=F.col("total_output"),
        drop_rate=_fixed("drop_rate", 4),
        elapsed_secs=_fixed("elapsed_secs", 3),
        end_to_end_latency=latency(F.col("end_to_end_latency")),
        end_to_end_jitter=jitter(F.col("end_to_end_jitter")),
        stages=F.concat(F.lit("["), F.array_join(F.transform("stages", stage), ", "), F.lit("]")),
    )
    return snapshots.withColumn(out, document)


def to_csv_rows(snapshots: DataFrame) -> DataFrame:
    """The CSV's columns: a `_pipeline` row and one for each stage of every snapshot."""
    ratio = F.coalesce(F.try_divide(F.col("total_output"), F.col("total_input")), F.lit(0.0))
    stage_row = lambda at, s: F.struct(
        _fixed(at, 3).alias("timestamp"), s["name"].alias("stage"), *(s[c].cast("long").alias(c) for c in CSV_COLUMNS[2:7]), _fixed(s["throughput_ratio"], 4).alias("throughput_ratio"),
        _fixed(s["latency"]["mean_ns"], 2).alias("mean_latency_ns"), s["latency"]["p99_ns"].cast("long").alias("p99_latency_ns"), _fixed(s["jitter"]["std_dev_ns"], 2).alias("jitter_ns"),
    )
    whole = F.struct(
        _fixed("elapsed_secs", 3).alias("timestamp"), F.lit(PIPELINE_ROW).alias("stage"), F.col("total_input").cast("long").alias("input_count"), F.col("total_output").cast("long").alias("output_count"), F.lit(0).cast("long").alias("filtered_count"),
        F.greatest(F.col("total_input") - F.col("total_output"), F.lit(0)).cast("long").alias("dropped_count"), F.lit(0).cast("long").alias("error_count"), _fixed(ratio, 4).alias("throughput_ratio"),
        _fixed(F.col("end_to_end_latency.mean_ns"), 2).alias("mean_latency_ns"), F.col("end_to_end_latency.p99_ns").cast("long").alias("p99_latency_ns"), _fixed(F.col("end_to_end_jitter.std_dev_ns"), 2).alias("jitter_ns"),
    )
    rows = F.concat(F.array(whole), F.transform("stages", lambda s: stage_row(F.col("elapsed_secs"), s)))
    return snapshots.select(F.inline(rows))


def write(snapshots: DataFrame, path: str, kind: str) -> None:
    """Writes json (a document a line), csv (with header) or text (a summary a line) with Spark's writers."""
    if kind == "json":
        to_json(snapshots).select("json").write.text(path)
    elif kind == "csv":
        to_csv_rows(snapshots).write.csv(path, header=True)
    elif kind == "text":
        snapshots.select(summary_line().alias("value")).write.text(path)
    else:
        raise ValueError(f"no export kind {kind}")


def summary_line() -> Column:
    return F.format_string(
        "in %d, out %d, dropped %.2f%%, %.1f items/s, p99 %.1f us, jitter %.3f ms",
        "total_input", "total_output", F.col("drop_rate") * 100, F.col("throughput"), F.col("end_to_end_latency.p99_ns") / 1000, F.col("end_to_end_jitter.std_dev_ns") / 1e6,
    )


def record(history: DataFrame, snapshot: DataFrame, limit: int = 1000, order: str = "recorded_at") -> DataFrame:
    """History with one more snapshot, the last `limit` kept."""
    return latest(history.unionByName(snapshot), limit, order)


def sparkline(values: list[float], width: int = 30) -> str:
    """One glyph a value, between the least and the largest; the last `width` values."""
    shown = values[-width:]
    if not shown:
        return ""
    low, span = min(shown), max(shown) - min(shown)
    return "".join(GLYPHS[int((v - low) / span * (len(GLYPHS) - 1)) if span else 0] for v in shown)


def status_line(snapshot: Row, targets: Targets | None = None) -> str:
    """A snapshot in one line, with a mark for each target that is missed."""
    t = targets or Targets()
    p99, jitter = snapshot.end_to_end_latency["p99_ns"] / 1000, snapshot.end_to_end_jitter["std_dev_ns"] / 1e6
    parts = [("thr", f"{snapshot.throughput:.0f}/s", snapshot.throughput >= t.throughput), ("p99", f"{p99:.1f}us", p99 <= t.p99_us), ("jit", f"{jitter:.3f}ms", jitter <= t.jitter_ms)]
    return " | ".join(f"{k} {v}{'' if ok else ' !'}" for k, v, ok in parts)


def dashboard(snapshot: Row, history: list[float] = (), targets: Targets | None = None) -> str:
    """A page of text: status, throughput history, stages."""
    lines = [status_line(snapshot, targets), f"throughput {sparkline(list(history))}", f"{'stage':<20}{'in':>12}{'out':>12}{'filtered':>12}{'dropped':>12}{'p99 us':>12}"]
    lines += [f"{s['name']:<20}{s['input_count']:>12}{s['output_count']:>12}{s['filtered_count']:>12}{s['dropped_count']:>12}{s['latency']['p99_ns'] / 1000:>12.1f}" for s in snapshot.stages]
    return "\n".join(lines)
