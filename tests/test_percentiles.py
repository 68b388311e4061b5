"""Percentiles and states against sorted lists and plain sums."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import metrics, ordered, percentiles
from gaugeworks.operators.percentiles import PERCENTILES


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = [("hot" if i % 3 else rng.choice(["a", None]), rng.choice([rng.randrange(5), rng.randrange(10**12), None])) for i in range(5000)]
    return spark.createDataFrame([*out, ("empty", None), ("one", 7)], "k string, v long").repartition(6)


def nearest_rank(values, share):
    n = len(values)
    # In whole thousandths, as no product of doubles is exact.
    return sorted(values)[max(1, -(-n * round(share * 1000) // 1000)) - 1] if n else None


@pytest.mark.parametrize("spread", [False, True, "auto"])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_against_sorted_lists(spark, rows, monkeypatch, spread, keys):
    monkeypatch.setattr(ordered, "HOT_ROWS", 500)
    got = percentiles.summary(rows, "v", keys, spread=spread).collect()
    held = {}
    for r in rows.collect():
        held.setdefault(r.k if keys else None, []).append(r.v)
    assert len(got) == len(held)
    for r in got:
        values = [v for v in held[r.k if keys else None] if v is not None]
        assert (r["count"], r.least, r.most) == (len(values), min(values, default=None), max(values, default=None))
        assert r.mean == (pytest.approx(sum(values) / len(values)) if values else None)
        assert {n: r[n] for n in PERCENTILES} == {n: nearest_rank(values, p) for n, p in PERCENTILES.items()}


def test_empty_and_odd_values(spark):
    none = spark.createDataFrame([], "k string, v long")
    assert metrics.latency(none, "v", ("k",)).count() == 0
    [r] = metrics.latency(none, "v").collect()
    assert (r["count"], r.mean_ns, r.p50_ns, r.min_ns) == (0, 0.0, 0, None)
    odd = spark.createDataFrame([(x,) for x in (1.5, math.nan, math.nan, -math.inf, None)], "v double")
    [r] = percentiles.summary(odd, "v", percentiles={"low": 0.01, "half": 0.5, "high": 1.0}).collect()
    assert (r["count"], r.low, r.half) == (4, -math.inf, 1.5) and math.isnan(r.high)


def test_no_buffer_of_values(spark, rows):
    """Percentiles sort value counts; no aggregate holds them."""
    plan = metrics.stage_metrics(rows.selectExpr("k as name", "v as latency_ns", "'output' as outcome", "1 as bytes", "0L as timestamp_ns"))._jdf.queryExecution().toString()
    assert "percentile" not in plan.split("== Physical Plan ==")[1].lower().replace("_p", "")
    assert "collect_list" not in plan


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_states_merge(spark, rows, keys):
    """Of parts, in any number, as of the whole."""
    big = rows.withColumn("v", F.col("v") + 10**15)  # far from 0, where squares would cancel
    parts = [percentiles.states(big.filter(F.spark_partition_id() == i), "v", keys) for i in range(6)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    got = {r.k if keys else None: r for r in percentiles.told(percentiles.merged(union, keys)).collect()}
    want = {r.k if keys else None: r for r in percentiles.told(percentiles.states(big, "v", keys)).collect()}
    held = {}
    for r in big.collect():
        held.setdefault(r.k if keys else None, []).append(r.v)
    assert {*got} == {*want} == {*held}
    for k, r in got.items():
        values = [v for v in held[k] if v is not None]
        assert r["count"] == want[k]["count"] == len(values)
        assert r.std_dev == pytest.approx(statistics.stdev(values) if len(values) > 1 else 0, rel=1e-9)
        assert (r.least, r.most) == (want[k].least, want[k].most)
        assert all(r[n] == want[k][n] for n in PERCENTILES)


def test_bucket_percentiles_follow_the_rank(spark):
    """The bucket in which the rank ceil(n * share) falls, told by its value."""
    rng = random.Random(8)
    for n in (1, 2, 99, 1000):
        values = [rng.randrange(1, 1 << rng.randrange(1, 20)) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v long")
        [r] = percentiles.told(percentiles.states(df, "v")).collect()
        for name, share in PERCENTILES.items():
            bucket = min((nearest_rank(values, share).bit_length() - 1) * 10 // 3, 63)
            assert r[name] == 2 ** (bucket * 3 // 10)
    [r] = percentiles.told(percentiles.states(df.filter("false"), "v")).collect()
    assert (r["count"], r.p99_ns, r.std_dev) == (0, 0, 0)


def test_stream_states_equal_batch(spark, rows, tmp_path):
    """A state for each micro-batch, merged afterwards; a batch that runs again replaces its own."""
    from gaugeworks.streaming import letters

    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "2").parquet(f"{tmp_path}/in")
    sink = letters.batches(f"{tmp_path}/states", lambda df: percentiles.states(df, "v", ("k",)))
    seen = []
    twice = lambda df, i: (seen.append(i), sink(df, i), sink(df, i))
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) >= 3
    got = percentiles.told(percentiles.merged(letters.read(spark, f"{tmp_path}/states"), ("k",))).orderBy("k").collect()
    want = percentiles.told(percentiles.states(rows, "v", ("k",))).orderBy("k").collect()
    for a, b in zip(got, want, strict=True):
        assert (a.k, a["count"], a.least, a.most, *(a[n] for n in PERCENTILES)) == (b.k, b["count"], b.least, b.most, *(b[n] for n in PERCENTILES))
        assert a.std_dev == pytest.approx(b.std_dev)
