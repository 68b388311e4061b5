import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import clock
from gaugeworks.operators import admission, folds, fusion, ordered
from gaugeworks.operators.ordered import Stream
from gaugeworks.sources.sensors import ImuDataSource
from gaugeworks.streaming import engine

KEYED = Stream(("k",), ("seq",))
SCHEMA = "k string, seq long, timestamp_ns long, value double, utilization double, kind string"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Four files, read one a micro-batch in order."""
    for k, v in engine.ROCKSDB.items():
        spark.conf.set(k, v)
    folder = tmp_path_factory.mktemp("stream")
    rows = [("ab"[i % 2], i, i * 10**8, float(i * 7 % 23), (i % 10) / 10, "ps"[i % 3 == 0]) for i in range(80)]
    for part in range(4):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    return folder


def stream(spark, files):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{files}/in")


FOLDS = {
    "ema": folds.Ema(("value",), {"y": "double"}, 0.3),
    "high_pass": folds.HighPass.of("value", "y", 10, 100),
    "kalman": folds.Kalman(("value",), {"x": "double", "p": "double"}),
    "bucket": admission.TokenBucket(("timestamp_ns",), {"accepted": "boolean", "tokens": "double"}, 2, 3, 1),
    "controller": admission.Controller.of("utilization", hysteresis=1),
    "sync": fusion.ArrivalSync(("kind", "timestamp_ns", "seq"), {"t": "long", "s": "long", "d": "long"}, 10**9, 4),
    "last_rows": engine.LastRows(("value",), {"average": "double", "median": "double"}, 5),
    "running": engine.Running(("value", "timestamp_ns"), {"count": "long", "mean": "double", "top": "long"}),
}


@pytest.mark.parametrize("name", FOLDS)
def test_stream_equals_batch(spark, files, name):
    fold = FOLDS[name]
    got = engine.drain(engine.streamed(stream(spark, files), ("k",), ("seq",), fold), f"q_{name}", f"{files}/ck_{name}")
    want = folds.folded(spark.read.schema(SCHEMA).parquet(f"{files}/in"), KEYED, fold)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_folds_equal_windows(spark, files):
    df = spark.read.schema(SCHEMA).parquet(f"{files}/in")
    rows = folds.folded(df, KEYED, FOLDS["last_rows"]).orderBy("k", "seq").collect()
    plain = ordered.median_filter(ordered.moving_average(df, KEYED, "value", 5), KEYED, "value", 5).orderBy("k", "seq").collect()
    assert [r.average for r in rows] == pytest.approx([r.average for r in plain])
    assert [r.median for r in rows] == [r.median for r in plain]
    status = ordered.running_status(df, KEYED).orderBy("k", "seq").collect()
    run = folds.folded(df, KEYED, FOLDS["running"]).orderBy("k", "seq").collect()
    assert [r["count"] for r in run] == [r["count"] for r in status] and [r.mean for r in run] == [r.mean for r in status]


def timed(df):
    return df.withColumn("event_time", clock.event_time(F.col("timestamp_ns")))


def test_event_time_windows(spark, files):
    got = engine.drain(engine.windowed(timed(stream(spark, files)), "event_time", "1 second", "2 seconds", keys=("k",), n=F.count(F.lit(1))), "w", f"{files}/ck_w", "complete")
    assert got.agg(F.sum("n")).first()[0] == 80 and got.count() == 8
    slid = engine.drain(engine.windowed(timed(stream(spark, files)), "event_time", "1 second", "2 seconds", "1 second", n=F.count(F.lit(1))), "w2", f"{files}/ck_w2", "complete")
    assert slid.agg(F.sum("n")).first()[0] == 160
    one = engine.drain(engine.sessions(timed(stream(spark, files)), "event_time", "1 second", "5 seconds", ("k",), n=F.count(F.lit(1))), "s", f"{files}/ck_s", "complete")
    assert sorted(r.n for r in one.collect()) == [40, 40]


def test_dedup_within_watermark(spark, files):
    got = engine.drain(engine.first_seen(timed(stream(spark, files)), "event_time", "1 hour", "k"), "d", f"{files}/ck_d")
    assert got.count() == 2


def test_interval_join_and_nearest(spark, files):
    both = timed(stream(spark, files))
    primary, secondary = both.filter("kind = 'p'").select("k", "seq", "event_time", "timestamp_ns"), both.filter("kind = 's'").select("k", "seq", "event_time", "timestamp_ns")
    pairs = engine.drain(engine.interval_pairs(primary, secondary, "150 milliseconds", "1 second", ("k",)), "j", f"{files}/ck_j")
    got = {(r.p_seq, r.s_seq) for r in engine.nearest_of(pairs).collect()}
    rows = spark.read.schema(SCHEMA).parquet(f"{files}/in")
    want = fusion.asof_nearest(rows.filter("kind = 'p'"), rows.filter("kind = 's'"), 150_000_000, ("k",))
    assert got == {(r.seq, r.secondary.seq) for r in want.collect()}


def test_handle(spark, files):
    seen = []
    writer = lambda ck: engine.callback(stream(spark, files), lambda df, i: seen.append(df.count()), checkpointLocation=ck)
    handle = engine.Handle(writer, f"{files}/ck_h")
    assert handle.state is engine.State.CREATED
    handle.start()
    assert handle.state is engine.State.RUNNING
    handle.query.processAllAvailable()
    handle.pause()
    assert handle.state is engine.State.PAUSED and sum(seen) == 80
    handle.resume()
    handle.shutdown()
    assert handle.state is engine.State.STOPPED and sum(seen) == 80
    handle.reset()
    handle.shutdown()
    assert sum(seen) == 160 and handle.join(1)
    assert handle.total_processed >= 80 and handle.throughput > 0


def test_streaming_source(spark, tmp_path):
    spark.dataSource.register(ImuDataSource)
    df = spark.readStream.format("mock_imu").option("rows", "250").option("batch", "100").load()
    query = df.writeStream.format("memory").queryName("imu").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table("imu").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(250))
