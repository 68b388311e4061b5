"""Metrics of running queries, dead letters and sinks that may run twice."""

import csv
import glob
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeworks import errors
from gaugeworks.operators import metrics
from gaugeworks.operators.core import Pipeline
from gaugeworks.streaming import engine, letters, live

SCHEMA = "seq long, latency_ns long, value double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("live")
    rows = [(i, 1000 + i * 37 % 500, float(i % 10) if i % 17 else None) for i in range(200)]
    for p in range(4):
        spark.createDataFrame(rows[p * 50 : p * 50 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return at


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")


def test_snapshots_of_a_running_query(spark, folder):
    chain = Pipeline().filter(F.col("value") > 1).map(value=F.col("value") * 2).filter(F.col("value") < 16)
    recorder = live.Recorder("watch", limit=3)
    spark.streams.addListener(recorder)
    try:
        rows = live.watched(chain, stream(spark, folder), "watch", F.col("latency_ns"), F.col("value") > 14)
        out = engine.drain(rows, "watched", f"{folder}/ck_w")
        assert recorder.wait(200)
    finally:
        spark.streams.removeListener(recorder)
    kept = recorder.snapshots(spark).orderBy("batch").collect()
    assert len(kept) == 3 and kept[-1].total_input == 200  # the first was pushed out
    last, rows = kept[-1], spark.read.schema(SCHEMA).parquet(f"{folder}/in")
    passed = [rows, rows.filter("value > 1"), rows.filter("value > 1"), rows.filter("value > 1 and value < 8")]
    counts = [p.count() for p in passed]
    failed = [0, rows.filter("value > 1 and value > 14").count(), rows.filter("value > 7").count(), rows.filter("value > 7 and value < 8").count()]
    assert [(s.input_count, s.output_count, s.filtered_count, s.error_count) for s in last.stages] == [(a, b - f, a - b, f) for a, b, f in zip(counts, counts[1:], failed[1:], strict=False)]
    assert [s.name for s in last.stages] == ["filter", "map", "filter"] and out.count() == counts[-1]
    exact = metrics.latency(passed[-1]).first()
    jitter = metrics.jitter(passed[-1], "latency_ns").first()
    assert (last.end_to_end_latency["count"], last.end_to_end_latency.min_ns, last.end_to_end_latency.max_ns) == (exact["count"], exact.min_ns, exact.max_ns)
    assert last.end_to_end_latency.mean_ns == pytest.approx(exact.mean_ns) and last.end_to_end_jitter.std_dev_ns == pytest.approx(jitter.std_dev_ns)
    bucket = (exact.p99_ns.bit_length() - 1) * 10 // 3
    assert last.end_to_end_latency.p99_ns == 1 << (bucket * 3 // 10)
    assert last.throughput > 0 and 0 < last.busy_secs and last.stages[0].throughput_ratio == pytest.approx((counts[1] - failed[1]) / 200)
    # The kept snapshots reach JSON and CSV.
    recorder.export(spark, f"{folder}/json", "json")
    texts = [json.loads(line) for f in glob.glob(f"{folder}/json/part-*") for line in open(f, encoding="utf-8")]
    assert sorted(t["total_input"] for t in texts) == [100, 150, 200] and len(texts[0]["stages"]) == 3
    recorder.export(spark, f"{folder}/csv", "csv")
    table = [r for f in glob.glob(f"{folder}/csv/part-*.csv") for r in csv.DictReader(open(f, encoding="utf-8"))]
    assert Counter(r["stage"] for r in table) == {"_pipeline": 3, "filter": 6, "map": 3}
    assert "filter" in recorder.page(spark)
    recorder.clear()
    assert recorder.snapshots(spark).count() == 0


def test_a_batch_counts_once(spark, folder):
    class Report:
        runId, batchId, id, name, numInputRows, timestamp = "r", 0, "q", None, 5, "2026-01-01T00:00:00.000Z"
        durationMs = {"triggerExecution": 100}
        observedMetrics = {f"w/{i}/{s}": spark.createDataFrame([(i, 100 + i) for i in range(5 - i)], "seq long, v long").withColumn("b", live.bucket_of(F.col("v"))).agg(F.count(F.lit(1)).alias("rows"), F.lit(0).alias("errors"), live.histogram("b").alias("histogram"), live.moments("v").alias("moments")).first() for i, s in enumerate(["", "a/b"])}

    recorder = live.Recorder("w")
    recorder.take(Report)
    recorder.take(Report)
    [only] = recorder.snapshots(spark).collect()
    assert (only.total_input, only.total_output, only.stages[0].name, only.elapsed_secs, only.throughput) == (5, 4, "a/b", 0.1, 40.0)
    with pytest.raises(ValueError, match="slash"):
        live.watched(Pipeline(), spark.range(1), "a/b", F.lit(1))


def halved(seq, value):
    if value is None:
        raise errors.ReadFailed(f"no value at {seq}")
    if value == 9:
        raise errors.SensorTimeout("nine")
    return value / 2, int(10 / value)


HALF = letters.Guarded("half", halved, ("seq", "value"), {"half": "double", "tenth": "long"})
def check():
    return letters.Check(F.col("value") < 8.5, errors.InvalidData, "too large")


def test_dead_letters_of_a_stream(spark, folder):
    sink = letters.two_way(f"{folder}/good", f"{folder}/dead", letters.Check(F.col("seq") >= 5), HALF, latest="seq")
    seen = []
    twice = lambda df, i: (seen.append(i), sink(df, i), sink(df, i))  # noqa: E731  # as after a failure
    engine.callback(stream(spark, folder), twice, checkpointLocation=f"{folder}/ck_d").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/in").collect()
    good, dead = letters.read(spark, f"{folder}/good").collect(), letters.read(spark, f"{folder}/dead").collect()
    kind = lambda r: "InvalidData" if r.seq < 5 else "ReadFailed" if r.value is None else "SensorTimeout" if r.value == 9 else "StageError" if r.value == 0 else None
    assert sorted(r.seq for r in good) == [r.seq for r in sorted(rows) if kind(r) is None]
    assert sorted((r.seq, r.kind) for r in dead) == [(r.seq, kind(r)) for r in sorted(rows) if kind(r)]
    assert {(r.half, r.tenth) for r in good} == {(v / 2, int(10 / v)) for v in range(1, 9)}
    for r in dead:
        assert json.loads(r.letter)["seq"] == r.seq and r.stage == ("check" if r.seq < 5 else "half")
        assert r.message == {"InvalidData": "check failed", "ReadFailed": f"no value at {r.seq}", "SensorTimeout": "nine", "StageError": "ZeroDivisionError: float division by zero"}[r.kind] or r.kind == "StageError"
        assert type(letters.raised(r.kind, r.message)).__name__ == r.kind


def test_the_first_error_stays(spark):
    df = spark.createDataFrame([(1, 9.0, None), (2, None, "x"), (3, 2.0, None)], "seq long, value double, extra string")
    got = {r.seq: r for r in letters.passed(df, check(), HALF, letters.Check(F.col("half") > 5, errors.StageError, "small")).collect()}
    assert (got[1].error.kind, got[1].half) == ("InvalidData", None)
    assert got[2].error.kind == "InvalidData"  # null isn't below a limit
    assert (got[3].error.kind, got[3].error.message, got[3].half, got[3].extra) == ("StageError", "small", 1.0, None)
    with pytest.raises(ValueError, match="half"):
        letters.guarded(df.withColumnRenamed("extra", "half"), HALF)
    assert letters.passed(df.filter("false"), check(), HALF).count() == 0
    bad = letters.guarded(df, letters.Guarded("wrong", lambda: (1,), (), {"a": "int", "b": "int"})).select("error.message").distinct().collect()
    assert [r.message for r in bad] == ["1 outputs, not 2"]
    assert type(letters.raised("Unknown", "x")) is errors.PipelineError
