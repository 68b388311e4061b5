import math
import random
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gaugeworks.errors import quarantine
from gaugeworks.operators import admission, core, export, folds, fusion, metrics, ordered
from gaugeworks.operators.ordered import Stream

ONE = Stream((), ("seq",))
SPREAD = Stream((), ("seq",), spread=True)
KEYED = Stream(("k",), ("seq",))
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, values, parts=3):
    return spark.createDataFrame(list(enumerate(map(float, values))), "seq long, value double").repartition(parts)


def series(df, column):
    return [r[column] for r in df.orderBy("seq").collect()]


def test_chains(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "x long")
    chain = core.Pipeline().map(x=F.col("x") * 2).filter(F.col("x") > 5).map(x=F.col("x") * 10)
    assert sorted(r.x for r in chain(df).collect()) == [60, 80, 100, 120, 140, 160, 180]
    odd = core.Pipeline().map(x=F.col("x") * 2).filter(F.col("x") > 5).map(x=F.col("x") + 1)
    assert [[r.x for r in odd(spark.createDataFrame([(v,)], "x long")).collect()] for v in (1, 3, 5)] == [[], [7], [11]]
    keep = core.Pipeline().filter_map("x", F.when(F.col("x") > 0, F.col("x") * 2))
    assert [r.x for r in keep(spark.createDataFrame([(5,), (0,), (-3,), (None,)], "x long")).collect()] == [10]
    joined = core.Pipeline().chain(chain).then(core.identity(), lambda d: d.limit(100), core.quantity_scaled("x", 0.5))
    assert joined(df).count() == 7 and [s.name for s in joined.stages][:3] == ["map", "filter", "map"]
    assert core.projected("x")(df.withColumn("y", F.lit(1))).columns == ["x"]


def test_inspect_and_stage_counts(spark):
    seen = Observation()
    df, counts = core.Pipeline().filter(F.col("id") % 2 == 0).inspect(seen, F.sum("id").alias("s")).map(y=F.col("id") * 10).measured(spark.range(1, 6))
    assert sorted(r.y for r in df.collect()) == [20, 40]
    assert seen.get == {"s": 6}
    assert counts()[0] == {"name": "filter", "input_count": 5, "output_count": 2, "filtered_count": 3}


def test_four_stages(spark):
    with pytest.raises(ValueError, match="output"):
        core.FourStage(lambda d: d, lambda d: d, lambda d: d).build()
    step = lambda e: lambda d: d.withColumn("id", e)
    got = core.FourStage.of(lambda d: d, step(F.col("id") + 1), step(F.col("id") * 2), step(F.col("id") - 1))(spark.range(5))
    assert sorted(r.id for r in got.collect()) == [2 * x + 1 for x in range(5)]


def test_quarantine(spark):
    good, bad = quarantine(spark.createDataFrame([(1.0,), (math.nan,), (None,)], "x double"), F.col("x") < 10)
    assert good.count() == 1 and bad.count() == 2


@pytest.mark.parametrize("stream", [ONE, SPREAD])
def test_windows(spark, stream):
    assert series(ordered.moving_average(frame(spark, [3, 6, 9, 12]), stream, "value", 3), "average") == [3, 4.5, 6, 9]
    assert series(ordered.median_filter(frame(spark, [1, 3]), stream, "value", 5), "median") == [1, 3]
    assert series(ordered.median_filter(frame(spark, [1, 1, 1, 100]), stream, "value", 5), "median")[-1] == 1


@FEW
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=60), size=st.integers(1, 7), parts=st.integers(1, 5))
def test_spread_windows_equal_plain_ones(spark, values, size, parts):
    before, ordered.CELL = ordered.CELL, 8
    try:
        df = frame(spark, values, parts)
        assert series(ordered.moving_average(df, SPREAD, "value", size), "average") == series(ordered.moving_average(df, ONE, "value", size), "average")
        assert series(ordered.running_status(df, SPREAD), "mean") == series(ordered.running_status(df, ONE), "mean")
        assert series(ordered.numbered(df, SPREAD), "n") == list(range(len(values)))
        assert series(ordered.with_previous(df, SPREAD, "value", "p"), "p") == [None, *values[:-1]]
        assert series(ordered.moving_average(df, ONE, "value", 1), "average") == values
    finally:
        ordered.CELL = before


def test_running_kinds_with_null_keys(spark):
    rows = [(None if i % 3 else "a", i, None if i % 5 == 0 else i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, seq long, x long").repartition(4)
    values = {"c": ("count", F.col("x")), "s": ("sum", F.col("x")), "hi": ("max", -F.col("x")), "lo": ("min", F.col("x"))}
    plain = sorted(map(str, ordered.running(df, KEYED, **values).collect()))
    assert sorted(map(str, ordered.running(df, Stream(("k",), ("seq",), True), **values).collect())) == plain


def test_clock_and_gaps(spark):
    raw = spark.createDataFrame([(0, 1000), (1, 500), (2, 2000)], "event long, raw long")
    got = ordered.stamped(raw, Stream((), ("event",)), "raw").orderBy("event").collect()
    assert [(r.timestamp_ns, r.seq) for r in got] == [(1000, 0), (1000, 1), (2000, 2)]
    gaps = ordered.sequence_gaps(spark.createDataFrame([(1,), (2,), (5,), (6,)], "seq long"), ONE)
    assert series(gaps, "dropped") == [0, 0, 2, 0]
    assert series(ordered.sequence_gaps(gaps.drop("dropped"), SPREAD), "dropped") == [0, 0, 2, 0]


def fold_of(spark, fold, values, stream=ONE, parts=3):
    return series(folds.folded(frame(spark, values, parts), stream, fold), next(iter(fold.outputs)))


EMA, HIGH = folds.Ema(("value",), {"y": "double"}, 0.5), folds.HighPass.of("value", "y", 0.1, 100)
KALMAN = folds.Kalman(("value",), {"y": "double", "p": "double", "g": "double"})


def test_filters(spark):
    assert fold_of(spark, EMA, [10, 20, 30]) == [10, 15, 22.5]
    assert folds.Ema.from_time_constant("v", "y", 1, 10).alpha == pytest.approx(0.0909, abs=1e-4)
    assert fold_of(spark, folds.low_pass("value", "y", 10, 100), [1] * 50)[-1] == pytest.approx(1, abs=0.01)
    assert abs(fold_of(spark, HIGH, [10] * 1000)[-1]) < 0.1
    assert fold_of(spark, HIGH, [10])[0] == 10
    assert fold_of(spark, KALMAN, [10] * 100)[-1] == pytest.approx(10, abs=0.1)
    assert fold_of(spark, KALMAN, [1.2])[0] == pytest.approx(1.0918919, abs=1e-7)
    assert KALMAN.gain(1.0) == pytest.approx(1 / 1.1)
    for alpha in (0, 1.1, -1):
        with pytest.raises(ValueError, match="alpha"):
            folds.Ema(("v",), {"y": "double"}, alpha)
    with pytest.raises(ValueError, match="value"):
        folds.folded(frame(spark, [1]), ONE, folds.Ema(("value",), {"value": "double"}))


@FEW
@given(values=st.lists(st.floats(-100, 100), min_size=1, max_size=80), which=st.sampled_from([EMA, HIGH, KALMAN, folds.Ema(("value",), {"y": "double"}, 0.001)]))
def test_scan_is_the_loop(spark, values, which):
    _, (want, *_) = which.run(which.start(), values)
    assert fold_of(spark, which, values, parts=4) == want
    assert fold_of(spark, which, values, SPREAD, parts=4) == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert fold_of(spark, folds.Ema(("value",), {"y": "double"}, 1.0), values) == values


@pytest.mark.parametrize("stream", [KEYED, Stream(("k",), ("seq",), True)])
def test_folds_by_key_with_nulls(spark, stream):
    rows = [(k, i, None if i in (0, 4) else float(i * (2 if k else 1))) for k in (None, "a") for i in range(9)]
    got = folds.folded(spark.createDataFrame(rows, "k string, seq long, value double").repartition(5), stream, EMA).collect()
    for k in (None, "a"):
        _, (want,) = EMA.run(None, [v for kk, _, v in rows if kk == k])
        assert [r.y for r in sorted((r for r in got if r.k == k), key=lambda r: r.seq)] == pytest.approx(want)


def pairs(spark, primary, secondary, tolerance, how="inner"):
    p = spark.createDataFrame(primary, "seq long, timestamp_ns long, k string").repartition(3)
    s = spark.createDataFrame(secondary, "seq long, timestamp_ns long, k string").repartition(3)
    return fusion.asof_nearest(p, s, tolerance, ("k",), how=how)


def test_asof_cases(spark):
    s = [(10, 1000, "a"), (20, 2000, "a"), (30, 3000, "a")]
    got = pairs(spark, [(100, 2050, "a")], s, 100).collect()
    assert [(r.secondary.seq, r.time_diff) for r in got] == [(20, 50)]
    assert pairs(spark, [(1, 1_000_000, "a")], s, 10).count() == 0
    assert [r.seq for r in pairs(spark, [(1, 1_000_000, "a"), (2, 1000, "b"), (3, None, "a"), (4, 1000, "a")], s, 10, "left_anti").orderBy("seq").collect()] == [1, 2, 3]
    assert [r.secondary.seq for r in pairs(spark, [(1, 1000, "a")], [(5, 900, "a"), (4, 1100, "a")], 200).collect()] == [4]
    assert [r.secondary.seq for r in pairs(spark, [(1, 1000, "a")], [(5, 1000, "a"), (4, 1000, "a"), (3, 999, "a")], 0).collect()] == [4]
    left = pairs(spark, [(1, 5, "a")], [], 3, "left").collect()
    assert left[0].secondary is None and left[0].time_diff is None


@FEW
@given(seed=st.integers(0, 1000), tolerance=st.sampled_from([0, 1, 3, 50]))
def test_asof_is_brute_force(spark, seed, tolerance):
    before, fusion.CELL_SPANS = fusion.CELL_SPANS, 2
    try:
        rnd = random.Random(seed)
        make = lambda: [(i, rnd.randrange(-60, 60), rnd.choice("ab")) for i in range(40)]
        p, s = make(), make()
        want = set()
        for i, t, k in p:
            best = min(((abs(t - u), j) for j, u, kk in s if kk == k and abs(t - u) <= tolerance), default=None)
            if best:
                want.add((i, best[1], best[0]))
        assert {(r.seq, r.secondary.seq, r.time_diff) for r in pairs(spark, p, s, tolerance).collect()} == want
    finally:
        fusion.CELL_SPANS = before


def test_asof_arrival(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ps"), rnd.randrange(200), i) for i in range(150)]
    want, ring = {}, deque(maxlen=5)
    for kind, t, i in rows:
        if kind == "s":
            ring.append((t, i))
            continue
        near = [x for x in ring if abs(x[0] - t) <= 20]
        want[i] = None
        if near:
            best = min(near, key=lambda x: abs(x[0] - t))
            want[i] = best[1]
            ring = deque((x for x in ring if x[0] >= t - 20), maxlen=5)
    df = spark.createDataFrame(rows, "kind string, timestamp_ns long, seq long").repartition(4)
    assert {r.seq: r.secondary_seq for r in fusion.asof_arrival(df, ONE, 20, 5).collect()} == want


def test_weights(spark):
    got = spark.range(1).select(fusion.weighted_average(F.lit(100.0), F.lit(0.0), 3, 1), fusion.weighted_average(F.lit(10.0), F.lit(20.0)), fusion.weighted_average(F.lit(1.0), F.lit(1.0), 0, 0)).first()
    assert tuple(got) == (75, 15, None)
    p = spark.range(1).select(fusion.pair(F.lit("a"), F.lit("b"), F.lit(10), F.lit(7)).alias("p")).first().p
    assert p.time_diff_ns == 3 and p.timestamp_ns == 10


def test_admission(spark):
    df = frame(spark, range(10))
    assert series(admission.sample_every(df, ONE, 4), "seq") == [0, 4, 8] == series(admission.sample_every(df, SPREAD, 4), "seq")
    assert admission.sample_every(df, ONE, 0).count() == 10
    assert series(admission.drop_newest(df, ONE, 3), "seq") == [0, 1, 2]
    assert series(admission.drop_oldest(df, ONE, 3), "seq") == [7, 8, 9]
    S = admission.Strategy
    assert [S.BLOCK.apply(df, ONE).count(), S.DROP_NEWEST.apply(df, ONE, 4).count(), S.DROP_OLDEST.apply(df, ONE, 4).count(), S.SAMPLE.apply(df, ONE, rate=2).count()] == [10, 4, 4, 5]
    assert S.BLOCK.may_block and not S.BLOCK.may_drop and S.SAMPLE.may_drop
    assert admission.Quality.from_level(9) is admission.Quality.MINIMAL


def test_token_bucket():
    bucket = admission.TokenBucket(("t",), {"accepted": "boolean", "tokens": "double"}, 10, 0, 10)
    assert bucket.run(None, [0] * 11)[1][0] == [True] * 10 + [False]
    slow = admission.TokenBucket(("t",), {"accepted": "boolean", "tokens": "double"}, 1, 1, 0)
    assert slow.run(None, [k * 250_000_000 for k in range(9)])[1][0] == [False] * 4 + [True] + [False] * 3 + [True]
    assert admission.TokenBucket.of_rate(1000).capacity == 100
    state, _ = slow.run(None, [0, 10**9, None])
    assert slow.run(state, [0])[0] == state


def test_controller(spark):
    c = admission.Controller.of("u", hysteresis=5)
    assert c.run(None, [0.9] * 5)[1][0][-1] == 0 and c.run(None, [0.9] * 6)[1][0][-1] == 1
    state, (levels, kept) = c.run(None, [0.9] * 12)
    assert levels[-1] == 2 and kept[:6] == [True] * 6 and kept[6] is False
    assert c.run(state, [0.1] * 12)[1][0][-1] == 0
    assert c.run(None, [0.9] * 5 + [0.6] + [0.9] * 5)[1][0][-1] == 0
    with pytest.raises(ValueError, match="marks"):
        admission.Controller.of("u", high=0.3, low=0.5)
    df = spark.createDataFrame([(i, 0.9) for i in range(40)], "seq long, utilization double")
    assert 0 < admission.Strategy.ADAPTIVE.apply(df, ONE).count() < 40


def test_admission_stats(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("d",)] * 2 + [("s",)] * 2, "k string")
    got = admission.admission_stats(df, accepted=F.col("k") == "a", dropped=F.col("k") == "d", sampled_out=F.col("k") == "s").first()
    assert (got.total, got.drop_rate, got.acceptance_rate, got.blocked) == (10, 0.4, 0.6, 0)
    none = admission.admission_stats(df.limit(0), accepted=F.lit(True)).first()
    assert (none.drop_rate, none.acceptance_rate) == (0, 1)


def test_latency(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "latency_ns")
    got = metrics.latency(df).first()
    assert (got.count, got.p50_ns, got.p99_ns, got.min_ns, got.max_ns, got.mean_ns) == (got.count, 50, 99, 1, 100, 50.5)
    near = metrics.latency(df, exact=False).first()
    assert (near.p50_ns, near.p99_ns) == (50, 99)
    none = metrics.latency(df.limit(0)).first()
    assert (none["count"], none.p99_ns, none.min_ns) == (0, 0, None)
    bucket = {v: spark.range(1).select(metrics.latency_bucket(F.lit(v)).alias("b"), metrics.bucket_value(metrics.latency_bucket(F.lit(v)))).first() for v in (0, 1, 2, 4, 8, 16, 32, 1 << 19, 1 << 40)}
    assert {v: tuple(b) for v, b in bucket.items()} == {0: (0, 1), 1: (0, 1), 2: (3, 1), 4: (6, 2), 8: (10, 8), 16: (13, 8), 32: (16, 16), 1 << 19: (63, 1 << 18), 1 << 40: (63, 1 << 18)}


def test_jitter(spark):
    got = metrics.jitter(frame(spark, [2, 4, 4, 4, 5, 5, 7, 9]), "value").first()
    assert (got.mean_ns, got.variance, got.std_dev_ns, got.range_ns) == pytest.approx((5, 32 / 7, 2.138, 7), abs=1e-3)
    one = metrics.jitter(frame(spark, [1000]), "value").first()
    assert one.std_dev_ns == 0 and one.coefficient_of_variation == 0
    assert series(metrics.intervals(spark.createDataFrame([(0, 5), (1, 9)], "seq long, timestamp_ns long"), ONE), "interval_ns") == [None, 4]


def items(spark):
    rows = [("a", o, 100 * i, 8, i * 10**9) for i, o in enumerate(["output"] * 80 + ["filtered"] * 10 + ["dropped"] * 10)]
    return spark.createDataFrame(rows, "name string, outcome string, latency_ns long, bytes long, timestamp_ns long")


def snapshot(spark):
    whole = items(spark).select("timestamp_ns", F.when(F.col("outcome") == "output", F.col("latency_ns")).alias("latency_ns"))
    return metrics.pipeline_snapshot(metrics.stage_metrics(items(spark)), whole)


def test_stage_metrics_and_snapshot(spark):
    s = metrics.stage_metrics(items(spark)).first()
    assert (s.throughput_ratio, s.filter_rate, s.drop_rate, s.bytes_processed) == (0.8, 0.1, 0.1, 800)
    got = snapshot(spark).first()
    assert (got.total_input, got.total_output, got.drop_rate, got.elapsed_secs) == (100, 80, pytest.approx(0.2), 99)
    assert len(got.stages) == 1 and got.stages[0].latency.p99_ns == 9800


def test_targets(spark):
    df = spark.createDataFrame([(10_000.0, 10_000_000, 2_000_000.0), (9_999.0, 10_000_001, 2_000_001.0)], "throughput double, p99_ns long, std_dev_ns double")
    assert sorted(r.all_ok for r in metrics.Targets().check(df).collect()) == [False, True]


def test_summary_recorder_queue(spark):
    row = (100.0, 50, 2.0, 10, 8)
    df = spark.createDataFrame([row, row], "throughput double, p99_ns long, std_dev_ns double, total_input long, total_output long")
    got = metrics.snapshot_summary(df).first()
    assert (got.snapshots, got.avg_throughput, got.max_p99_ns, got.overall_drop_rate) == (2, 100, 50, pytest.approx(0.2))
    assert metrics.snapshot_summary(df.limit(0)).first()[1:] == (0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    kept = export.record(spark.createDataFrame([(i,) for i in range(4)], "recorded_at int"), spark.createDataFrame([(9,)], "recorded_at int"), 3)
    assert sorted(r.recorded_at for r in kept.collect()) == [2, 3, 9]
    events = spark.createDataFrame([(i, "send") for i in range(80)], "seq long, kind string")
    full = metrics.queue_metrics(events, ONE, 100).first()
    assert (full.utilization, full.pressure, full.max_depth) == (80, True, 80)
    after = metrics.queue_metrics(events.union(spark.createDataFrame([(i, "recv") for i in range(80, 110)], "seq long, kind string")), ONE, 100).first()
    assert (after.utilization, after.pressure, after.depth, after.max_depth) == (50, False, 50, 80)
    assert metrics.queue_metrics(events, ONE).first().utilization == 0


def test_counters_and_tokens(spark):
    df = spark.createDataFrame([("received",)] * 4 + [("processed",)] * 2 + [("filtered",), ("dropped",)], "kind string")
    got = metrics.counters(df).first()
    assert (got.drop_rate, got.filter_rate, got.error_rate) == (0.25, 0.5, 0)
    lost = metrics.token_latency(spark.createDataFrame([(1, 10), (2, 20)], "seq long, timestamp_ns long"), spark.createDataFrame([(1, 15), (1, 30)], "seq long, timestamp_ns long"))
    assert series(lost, "latency_ns") == [5, None]
    assert metrics.event_rate(spark.createDataFrame([(5,)], "timestamp_ns long")).first().rate == 0


def test_exports(spark, tmp_path):
    import json

    snap = snapshot(spark)
    document = json.loads(export.to_json(snap).first().json)
    assert document["total_input"] == 100 and document["drop_rate"] == 0.2 and document["stages"][0]["name"] == "a" and document["stages"][0]["throughput_ratio"] == 0.8
    rows = export.to_csv_rows(snap)
    assert rows.columns == export.CSV_COLUMNS
    first = rows.collect()[0]
    assert (first.stage, first.dropped_count, first.throughput_ratio, first.timestamp) == ("_pipeline", 20, "0.8000", "99.000")
    for kind in ("json", "csv", "text"):
        export.write(snap, f"{tmp_path}/{kind}", kind)
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2
    assert "dropped 20.00%" in spark.read.text(f"{tmp_path}/text").first().value
    with pytest.raises(ValueError, match="xml"):
        export.write(snap, f"{tmp_path}/x", "xml")
    assert export.sparkline([0, 1, 2, 3]) == "▁▃▅▇" and export.sparkline([]) == "" and export.sparkline([5, 5]) == "▁▁"
    page = export.dashboard(snap.first(), [1, 2, 3])
    assert "thr" in page and page.splitlines()[-1].startswith("a ")
    assert "!" in export.status_line(snap.first())
