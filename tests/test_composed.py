"""Folds over blocks, hot keys and sliding medians against their plain loops."""

import math
import random
import time
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.operators import admission, folds, ordered, sliding
from gaugeworks.operators.ordered import AUTO, Stream

BUCKETS = [admission.TokenBucket(("t",), {"accepted": "boolean", "tokens": "double"}, *x) for x in ((3, 0.5, 3, 1), (10, 2, 0, 1), (5.5, 0.3, 2.25, 0.75), (2, 0, 2, 1), (0, 5, 0, 1), (100, 1000, 100, 1), (7, 1e-5, 7, 2.5))]
CONTROLLERS = [admission.Controller.of("u", **x) for x in ({"hysteresis": 0}, {"hysteresis": 2}, {"hysteresis": 3, "high": 0.6, "low": 0.4})]
TIMES = st.lists(st.one_of(st.none(), st.integers(0, 10**10)), max_size=60)


def ends_like_the_loop(fold, values, cuts):
    """Blocks as functions, applied in order, then run from their starts: what the loop over all gives."""
    want = fold.run(fold.start(), values)[1]
    core, carried, got = fold.core(), None, [[] for _ in fold.outputs]
    edges = [0, *sorted(cuts), len(values)]
    for a, b in zip(edges, edges[1:], strict=False):
        part = values[a:b]
        for have, new in zip(got, fold.run(fold.seeded(core, carried), part)[1], strict=True):
            have += new
        half = len(part) // 2
        function, after = fold.extended(fold.identity(), carried, part[:half])
        function, after = fold.extended(function, after, part[half:])
        core, carried = fold.applied(fold.packed(function), core), after
    assert got == list(want)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(BUCKETS), TIMES, st.lists(st.integers(0, 60), max_size=5), st.booleans())
def test_bucket_functions(fold, times, cuts, in_order):
    times = sorted(t for t in times if t is not None) if in_order else times
    ends_like_the_loop(fold, times, [min(c, len(times)) for c in cuts])


@settings(max_examples=100, deadline=None)
@given(st.sampled_from(CONTROLLERS), st.lists(st.one_of(st.none(), st.floats(0, 1)), max_size=120), st.lists(st.integers(0, 120), max_size=5))
def test_controller_functions(fold, values, cuts):
    ends_like_the_loop(fold, values, [min(c, len(values)) for c in cuts])


def test_bucket_pieces_are_few():
    """Some two for each cost that the capacity holds, whatever the run."""
    rng, fold = random.Random(3), BUCKETS[5]
    times = [t := 0] + [t := t + rng.randrange(3_000_000) for _ in range(5000)]
    function, _ = fold.extended(fold.identity(), None, times)
    assert len(function[0]) <= 2 * 100 + 3


@pytest.mark.parametrize("fold", BUCKETS, ids=range(len(BUCKETS)))
@pytest.mark.parametrize("pause", [10**6, 4 * 10**8, 2 * 10**9, 10**13])
def test_long_bucket_functions(fold, pause):
    """Stretches longer than any step, at loads that never, seldom and always fill the bucket; times stand still, go back and are missing."""
    rng = random.Random(pause)
    t, times = 0, []
    for i in range(3000):
        t += rng.randrange(pause) if rng.random() < 0.7 else 0
        t += 50 * pause if i % 1000 == 900 else 0
        times.append(None if rng.random() < 0.02 else t - rng.choice([0] * 20 + [pause]))
    ends_like_the_loop(fold, times, [700, 701, 2400])


def test_bucket_functions_of_far_times():
    """Differences that 64 bits can't hold."""
    far = (1 << 63) - 1
    for fold in BUCKETS:
        ends_like_the_loop(fold, [-far, -far + 5, None, 0, 10**9, far, far, 3] * 5, [3, 17])


@pytest.mark.parametrize("bucket", [(3.0, 0.00001, 3.0), (100, 1000, 100), (100, 0.008, 3)], ids=["empty", "full", "filling"])
def test_bucket_functions_cost_little_more_than_the_loop(bucket):
    rng, t, took = random.Random(2), 0, {}
    times = [t := t + rng.randrange(260 * 10**9) for _ in range(20_000)]
    fold = admission.TokenBucket(("t",), {"accepted": "boolean", "tokens": "double"}, *bucket)
    for name, f in (("loop", lambda: fold.run(fold.start(), times)), ("function", lambda: fold.extended(fold.identity(), None, times))):
        began = time.process_time()
        f()
        took[name] = time.process_time() - began
    assert took["function"] < 10 * took["loop"] + 0.2


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_blocks_grow_with_rows(spark, rows, monkeypatch, keys):
    """However few the bytes; the results stay those of the plain form."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 500)
    sizes = [r["count"] for r in ordered.blocks(rows, Stream(keys)).groupBy("_block").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 1000
    for fold in (BUCKETS[1], CONTROLLERS[1]):
        plain, spread = (folds.folded(rows, Stream(keys, spread=s), fold).collect() for s in (False, True))
        assert sorted(map(str, spread)) == sorted(map(str, plain))


def test_bucket_limits():
    with pytest.raises(ValueError, match="counted"):
        admission.TokenBucket(("t",), {}, 1e12, 1e-7)
    with pytest.raises(ValueError, match="negative"):
        admission.TokenBucket(("t",), {}, -1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    t, out = 0, []
    for i in range(6000):
        t += rng.randrange(10**9)
        out.append(("hot" if i % 2 else rng.choice(["a", "b", None]), i, t, rng.random() if i % 17 else None))
    return spark.createDataFrame(out, "k string, seq long, t long, u double").repartition(7)


@pytest.fixture
def uncoalesced(spark):
    """Small shuffles keep their partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("keys", [(), ("k",)])
@pytest.mark.parametrize("fold", [BUCKETS[1], CONTROLLERS[1]], ids=["bucket", "controller"])
def test_spread_equals_plain(spark, rows, keys, fold):
    plain = folds.folded(rows, Stream(keys), fold)
    spread = folds.folded(rows, Stream(keys, spread=True), fold)
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))
    assert spread.columns == plain.columns


def test_unkeyed_buckets_use_more_than_one_task(spark, rows, uncoalesced):
    spread = folds.folded(rows, Stream(spread=True), BUCKETS[1])
    assert spread.withColumn("part", F.spark_partition_id()).select("part").distinct().count() > 1


@pytest.mark.parametrize("hot_rows", [1000, 10**9])
def test_hot_keys_by_size(spark, rows, monkeypatch, uncoalesced, hot_rows):
    """One key holds half of the rows; no caller says so."""
    monkeypatch.setattr(ordered, "HOT_ROWS", hot_rows)
    by, auto = Stream(("k",)), Stream(("k",), spread=AUTO)
    for f in (lambda s: ordered.running(rows, s, n=("count", F.lit(1)), top=("max", F.col("t"))), lambda s: ordered.moving_average(rows.withColumn("w", F.round(F.col("u") * 64)), s, "w", 5), lambda s: ordered.with_previous(rows, s, "t", "before"), lambda s: folds.folded(rows, s, BUCKETS[0])):
        assert sorted(map(str, f(auto).collect())) == sorted(map(str, f(by).collect()))
    if hot_rows == 1000:
        sizes = ordered.running(rows, auto, n=("count", F.lit(1))).filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1  # the hot key isn't one task's
    assert ordered.running(rows, replace(auto, keys=()), n=("count", F.lit(1))).agg(F.max("n")).first()[0] == 6000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(allow_infinity=False), st.sampled_from([1.0, 2.0, math.nan])), max_size=80), st.integers(1, 20), st.integers(1, 4))
def test_sliding_median(values, size, bucket):
    old, sliding.BUCKET = sliding.BUCKET, bucket
    try:
        fold = sliding.SlidingMedian(("x",), {"m": "double"}, size)
        state, (first,) = fold.run(fold.start(), values[:30])
        _, (rest,) = fold.run(fold.unpack(fold.pack(state)), values[30:])
    finally:
        sliding.BUCKET = old
    for i, got in enumerate(first + rest):
        seen = sorted((v for v in values[max(0, i - size + 1) : i + 1] if v is not None), key=lambda v: (v != v, v))
        want = seen[len(seen) // 2] if seen else None
        assert got == want or (got != got and want != want)


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_long_frames_equal_sorted_lists(spark, rows, monkeypatch, keys):
    monkeypatch.setattr(ordered, "CELL", 500)
    want = ordered.median_filter(rows, Stream(keys), "u", 70)
    monkeypatch.setattr(ordered, "LONG_FRAME", 10**6)
    plain = sorted(map(str, ordered.median_filter(rows, Stream(keys), "u", 70).collect()))
    assert sorted(map(str, want.collect())) == plain
    monkeypatch.setattr(ordered, "LONG_FRAME", 64)
    assert sorted(map(str, ordered.median_filter(rows, Stream(keys, spread=True), "u", 70).collect())) == plain


def test_long_frames_cost_little_more():
    """Through a frame of 10,000 rows in about the time of one of 10."""
    import time

    rng = random.Random(1)
    values, took = [rng.random() for _ in range(60_000)], {}
    for size in (10, 10_000):
        fold = sliding.SlidingMedian(("x",), {"m": "double"}, size)
        began = time.process_time()
        fold.run(fold.start(), values)
        took[size] = time.process_time() - began
    assert took[10_000] < 4 * took[10] + 0.2


def test_admission_windows_without_keys(spark, rows):
    """The first and the last rows of all, found by each task's own."""
    for f, want in ((admission.drop_newest, range(5)), (admission.drop_oldest, range(5995, 6000))):
        got = f(rows, Stream(), 5)
        assert sorted(r.seq for r in got.collect()) == list(want)
        assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString().split("TakeOrderedAndProject")[-1]
