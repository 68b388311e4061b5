"""Streams against batch: no value altered, timers, control rows, nearest pairs."""

import math
import os
import random
from collections import Counter

import pytest


from gaugeworks.operators import admission, folds, fusion, machines, sliding
from gaugeworks.operators.ordered import Stream
from gaugeworks.streaming import engine

SECOND = 10**9
START = 10**6 * SECOND  # a watermark starts at 0
BIG = 1_700_000_000_123_456_789
SCHEMA = "k string, seq long, timestamp_ns long, value double, note long, control string"


def written(spark, folder, parts, schema=SCHEMA):
    """A file for each part, read one a micro-batch in their order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part-{i}")
        [name] = [n for n in os.listdir(f"{folder}/part-{i}") if n.endswith(".parquet")]
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/part-{i}/{name}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return f"{folder}/in"


def stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    for k, v in engine.ROCKSDB.items():
        spark.conf.set(k, v)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # each is a state store
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def odd_rows():
    """NaN, null and long values that no double holds."""
    return [[("ab"[i % 2], i, BIG + i * SECOND, [1.5, math.nan, None, 2.0 + i][i // 2 % 4], None if i % 3 else BIG + i, None) for i in range(p * 10, p * 10 + 10)] for p in range(3)]


FOLDS = {
    "ema": folds.Ema(("value",), {"y": "double"}, 0.5),
    "kalman": folds.Kalman(("value",), {"x": "double", "p": "double"}),
    "bucket_of_nulls": admission.TokenBucket(("note",), {"accepted": "boolean", "tokens": "double"}, 2, 0.7, 1),
    "sync": fusion.ArrivalSync(("control", "timestamp_ns", "note"), {"t": "long", "s": "long", "d": "long"}, SECOND, 4),
    "last_rows": engine.LastRows(("value",), {"average": "double", "median": "double"}, 5),
    "sliding": sliding.SlidingMedian(("value",), {"median": "double"}, 5),
    "running": engine.Running(("seq", "timestamp_ns"), {"count": "long", "mean": "double", "top": "long"}),
}


@pytest.mark.parametrize("name", FOLDS)
def test_no_value_is_altered(spark, tmp_path, name):
    folder = written(spark, tmp_path, odd_rows())
    got = engine.drain(engine.streamed(stream(spark, folder), ("k",), ("seq",), FOLDS[name]), f"odd_{name}", f"{tmp_path}/ck")
    want = folds.folded(spark.read.schema(SCHEMA).parquet(folder), Stream(("k",)), FOLDS[name])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.note for r in got.collect()} == {None, *(BIG + i for i in range(0, 30, 3))}


def burst_rows():
    """Bursts of three keys with pauses between; the last part only moves the watermark."""
    rng, rows, t = random.Random(2), [], START
    for i in range(120):
        t += rng.choice([1, 1, 1, 9, 40]) * SECOND
        rows.append(("abc"[rng.randrange(3)], i, t, float(i), None, None))
    end = [("z", 1000, t + 1000 * SECOND, 0.0, None, None)]
    return [rows[:30], rows[30:60], rows[60:90], rows[90:], end]


MACHINES = {
    "debounce": machines.Debounce(("seq", "value"), {"last_seq": "long", "value": "double"}, idle_ns=5 * SECOND),
    "batched": machines.Batched(("value",), {"rows": "long", "total": "double"}, idle_ns=30 * SECOND, size=4),
    "forgetful": machines.Batched(("value",), {"rows": "long", "total": "double"}, forget_ns=60 * SECOND, size=4),
    "both": machines.Batched(("value",), {"rows": "long", "total": "double"}, idle_ns=20 * SECOND, forget_ns=60 * SECOND, size=50),
}


@pytest.mark.parametrize("name", MACHINES)
def test_ticks_and_flushes_equal_batch(spark, tmp_path, name):
    folder, by = written(spark, tmp_path, burst_rows()), ("timestamp_ns", "seq")
    got = engine.drain(engine.spoken(stream(spark, folder), ("k",), by, MACHINES[name], "5 seconds"), f"m_{name}", f"{tmp_path}/ck").filter("k <> 'z'")
    want = machines.spoken(spark.read.schema(SCHEMA).parquet(folder), Stream(("k",), by), MACHINES[name]).filter("k <> 'z'")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    causes = {r.cause for r in want.collect()}
    assert causes & {"tick", "flush"} and ("row" in causes) == (name in ("batched", "forgetful"))


def plain_debounce(rows, idle):
    out, last = [], {}
    for k, seq, t, value, *_ in sorted(rows, key=lambda r: r[2]):
        if k in last and t > last[k][0] + idle:
            out.append((k, last[k][0] + idle, "tick", *last[k][1:]))
        last[k] = (t, seq, value)
    return sorted([*out, *((k, t + idle, "tick", s, v) for k, (t, s, v) in last.items())])


def test_debounce_against_a_plain_loop(spark):
    rows = [r for part in burst_rows() for r in part]
    got = machines.spoken(spark.createDataFrame(rows, SCHEMA).repartition(5), Stream(("k",), ("timestamp_ns", "seq")), MACHINES["debounce"])
    assert sorted(map(tuple, got.collect())) == plain_debounce(rows, 5 * SECOND)


def controlled_rows():
    rows = [("ab"[i % 2], i, START + i * SECOND, 1.0, None, None) for i in range(40)]
    rows += [("a", 100, START + 10 * SECOND + 1, None, None, "reset"), ("a", 101, START + 20 * SECOND + 1, None, None, "pause"), ("a", 102, START + 26 * SECOND + 1, None, None, "resume"), ("a", 103, START + 31 * SECOND + 1, None, None, "flush")]
    rows = sorted(rows, key=lambda r: r[2])
    return [rows[:15], rows[15:30], rows[30:], [("z", 1000, START + 4000 * SECOND, 0.0, None, None)]]


def test_control_rows_steer_one_key(spark, tmp_path):
    machine, by = machines.Batched(("value",), {"rows": "long", "total": "double"}, idle_ns=100 * SECOND, size=4), ("timestamp_ns", "seq")
    folder = written(spark, tmp_path, controlled_rows())
    df = spark.read.schema(SCHEMA).parquet(folder)
    got = engine.drain(engine.spoken(stream(spark, folder), ("k",), by, machine, "5 seconds", control="control"), "control", f"{tmp_path}/ck").filter("k <> 'z'").collect()
    want = machines.spoken(df, Stream(("k",), by), machine, control="control").filter("k <> 'z'").collect()
    assert Counter(map(str, got)) == Counter(map(str, want))
    free = machines.spoken(df.filter("control is null"), Stream(("k",), by), machine).filter("k = 'b'").collect()
    assert Counter(map(str, (r for r in got if r.k == "b"))) == Counter(map(str, free))  # the others go on
    causes = Counter(r.cause for r in got if r.k == "a")
    assert causes["paused"] == 3 and causes["flush"] == 1
    # Six rows before the reset, of which four were told; two are gone.
    assert sum(r.rows for r in got if r.k == "a" and r.rows) == 20 - 2 - 3


def test_machines_without_keys_and_rows(spark):
    machine = MACHINES["batched"]
    rows = spark.createDataFrame([(None, i, None if i == 3 else i * SECOND, None if i == 1 else 1.0, None, None) for i in range(6)], SCHEMA)
    got = machines.spoken(rows, Stream((), ("seq",)), machine).collect()
    assert [(r.cause, r.rows, r.total) for r in got] == [("row", 4, 3.0), ("tick", 2, 2.0)]
    assert [r.k for r in machines.spoken(rows, Stream(("k",), ("seq",)), machine).collect()] == [None, None]
    assert machines.spoken(rows.filter("false"), Stream((), ("seq",)), machine).count() == 0
    with pytest.raises(ValueError, match="cause"):
        machines.spoken(rows.withColumnRenamed("k", "cause"), Stream(("cause",)), machine)
    with pytest.raises(ValueError, match="forgotten"):
        machines.Debounce((), {}, idle_ns=5, forget_ns=4)


PAIR = "k string, seq long, timestamp_ns long, value double, kind string"


def pair_rows():
    """Two streams, out of order within a few seconds, with ties in time and gaps."""
    rng, rows = random.Random(7), []
    for i in range(400):
        t = START + int(i * 0.7 * SECOND) + rng.randrange(3) * SECOND
        rows.append((rng.choice(["a", "b", None]), i, t + (rng.randrange(1000) if i % 5 else 0), rng.random(), "ps"[rng.random() < 0.5]))
    parts = [rows[a : a + 80] for a in range(0, 400, 80)]
    end = [("z", 9000 + i, START + 10_000 * SECOND, 0.0, "ps"[i]) for i in range(2)]
    return [*parts, end]


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_nearest_pairs_equal_batch(spark, tmp_path, how, keys):
    folder, tolerance = written(spark, tmp_path, pair_rows(), PAIR), 2 * SECOND
    both = stream(spark, folder, PAIR)
    joined = engine.asof_nearest(both.filter("kind = 'p'"), both.filter("kind = 's'"), tolerance, "10 seconds", keys, how=how, cell_spans=3)
    name = f"near_{how}_{len(keys)}"
    query = joined.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [r for r in spark.table(name).collect() if r.k != "z"]
    rows = spark.read.schema(PAIR).parquet(folder).filter("k is null or k <> 'z'")
    primary, secondary = rows.filter("kind = 'p'"), rows.filter("kind = 's'")
    if keys:
        # Null keys are a key of the stream; the join of tables takes them alike.
        assert fusion.asof_nearest(primary, secondary, tolerance, keys, how=how).filter("k is null").count() == sum(r.k is None for r in got)
    want = fusion.asof_nearest(primary, secondary, tolerance, keys, how=how)
    assert sorted(map(str, got)) == sorted(map(str, want.collect()))
    assert len({r.seq for r in got}) == len(got) > 5
    last = [p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]
    # Cells that are over are forgotten: only the end's stay.
    assert last["customMetrics"].get("rocksdbNumKeys", last["numRowsTotal"]) < 60
    assert spark.table(name).schema.simpleString() == want.schema.simpleString()


def test_nearest_pairs_of_other_kinds(spark):
    with pytest.raises(ValueError, match="outer"):
        engine.asof_nearest(spark.range(1), spark.range(1), 1, "1 second", how="outer")
