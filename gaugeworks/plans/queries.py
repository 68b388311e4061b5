"""The registered queries: each operator on the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gaugeworks import schema
from gaugeworks.functions import clock, lidar, vectors
from gaugeworks import errors
from gaugeworks.operators import admission, core, export, folds, fusion, machines, metrics, ordered, percentiles
from gaugeworks.operators.ordered import Stream
from gaugeworks.sources import sensors
from gaugeworks.storage import shared_path
from gaugeworks.streaming import engine, letters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BY_SENSOR = Stream(("sensor_id",), ("seq",))
GLOBAL = Stream((), ("seq",), spread=True)
BY_TYPE = Stream(("event_type",), ("seq",), spread=True)
ALPHA, HZ, CUTOFF = 0.2, 100.0, 10.0
EULER = (0.5, 0.3, 0.1)
TOLERANCE_NS = 600 * 10**9
BUCKET = admission.TokenBucket(("timestamp_ns",), {"accepted": "boolean", "tokens": "double"}, 3.0, 0.00001, 3.0)
CONTROLLER = admission.Controller.of("utilization", high=0.4, low=0.2, hysteresis=2)
COUNTER_KINDS = {"view": "received", "click": "processed", "signup": "filtered", "purchase": "dropped", "error": "errors"}
QUEUE_KINDS = {"view": "send", "click": "send", "signup": "recv", "purchase": "recv", "error": "drop"}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def kinds(column: str, names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col(column)]


def rounded(c: Column) -> Column:
    """Trigonometry differs in the last bits between engines: compared to a millionth."""
    return F.round(c, 6)


def vector(name: str, v: Column, exact: bool = True) -> list[Column]:
    return [(v[c] if exact else rounded(v[c])).alias(f"{name}_{c}") for c in "xyz"]


def in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = ~F.isnan("value") & F.col("value").between(-1000, 1000)
    return core.Pipeline().filter(finite)(schema.readings(spark, sf_dir)).select("sensor_id", "seq", "timestamp_ns", "event_type", "value")


@query
def flagship_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count, mean and status of each sensor."""
    return ordered.running_status(in_range(spark, sf_dir).select("sensor_id", "seq", "value"), BY_SENSOR)


@query
def flagship_status_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over one stream of all sensors, in blocks."""
    return ordered.running_status(in_range(spark, sf_dir).select("seq", "value"), GLOBAL)


@query
def map_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = core.Pipeline().map(value=F.col("value") * 2).filter(F.col("value") > 50).then(core.identity()).map(value=F.col("value") + 1)
    return chain(in_range(spark, sf_dir).select("seq", "value"))


@query
def filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.Pipeline().filter_map("value", F.when(F.col("value") > 100, F.col("value") * 2))(in_range(spark, sf_dir).select("seq", "value"))


@query
def four_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion, filtering, aggregation (running status) and output, as one plan."""
    pipeline = core.FourStage(
        lambda df: df.select("sensor_id", "seq", "value"),
        lambda df: df.filter("value between 0 and 1000"),
        lambda df: ordered.running_status(df, BY_SENSOR),
        lambda df: df.filter("status <> 'NORMAL'").select("sensor_id", "seq", "status", "mean"),
    ).build()
    return pipeline(in_range(spark, sf_dir))


@query
def payload_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = in_range(spark, sf_dir).select("timestamp_ns", "seq", F.col("value").alias("data"))
    return core.payload_mapped(lambda d: d + 0.5)(stamped)


@query
def moving_average_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.moving_average(in_range(spark, sf_dir).select("sensor_id", "seq", "value"), BY_SENSOR, "value", 10)


@query
def moving_average_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.moving_average(in_range(spark, sf_dir).select("seq", "value"), GLOBAL, "value", 10)


@query
def median_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.median_filter(in_range(spark, sf_dir).select("sensor_id", "seq", "value"), BY_SENSOR, "value", 5)


@query
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.folded(in_range(spark, sf_dir).select("sensor_id", "seq", "value"), BY_SENSOR, folds.Ema(("value",), {"ema": "double"}, ALPHA))


@query
def ema_time_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.folded(in_range(spark, sf_dir).select("sensor_id", "seq", "value"), BY_SENSOR, folds.Ema.from_time_constant("value", "ema", 1.0, 10.0))


@query
def low_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.folded(in_range(spark, sf_dir).select("sensor_id", "seq", "value"), BY_SENSOR, folds.low_pass("value", "low", CUTOFF, HZ))


@query
def high_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.folded(in_range(spark, sf_dir).select("sensor_id", "seq", "value"), BY_SENSOR, folds.HighPass.of("value", "high", CUTOFF, HZ))


@query
def kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = folds.Kalman(("value",), {"estimate": "double", "error_covariance": "double", "gain": "double"})
    return folds.folded(in_range(spark, sf_dir).select("sensor_id", "seq", "value"), BY_SENSOR, fold)


@query
def ema_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream of all sensors, by the two-pass scan; rounded, as blocks may differ in the last bits."""
    got = folds.folded(in_range(spark, sf_dir).select("seq", "value"), GLOBAL, folds.Ema(("value",), {"ema": "double"}, ALPHA))
    return got.withColumn("ema", F.round("ema", 4))


@query
def imu_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, g = F.col("accel"), F.col("gyro")
    return schema.imu(spark, sf_dir).select("seq", vectors.magnitude(a).alias("accel_magnitude"), vectors.magnitude_squared(g).alias("gyro_squared"), vectors.dot(a, g).alias("dot"))


@query
def imu_vector_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, g = F.col("accel"), F.col("gyro")
    ops = {"sum": vectors.add(a, g), "diff": vectors.subtract(a, g), "scaled": vectors.scale(a, 2.5), "cross": vectors.cross(a, g), "unit": vectors.normalized(a)}
    return schema.imu(spark, sf_dir).select("seq", *(c for name, v in ops.items() for c in vector(name, v)))


@query
def imu_ned_to_enu(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = vectors.rotate_imu(F.struct("accel", "gyro"), vectors.NED_ENU)
    return schema.imu(spark, sf_dir).select("seq", *vector("accel", r["accel"]), *vector("gyro", r["gyro"]))


@query
def imu_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = vectors.g_degrees_to_si(F.struct("accel", "gyro"))
    return schema.imu(spark, sf_dir).select("seq", *vector("accel", r["accel"]), *vector("gyro", r["gyro"], exact=False))


@query
def imu_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    calibration = F.struct(vectors.vec3(0.1, 0.2, 0.3).alias("accel_bias"), vectors.vec3(1, 2, 0.5).alias("accel_scale"), vectors.vec3(0.01, 0.01, 0.01).alias("gyro_bias"), F.lit(None).cast("struct<x:double,y:double,z:double>").alias("gyro_scale"))
    r = vectors.calibrated_imu(F.struct("accel", "gyro"), calibration)
    return schema.imu(spark, sf_dir).select("seq", *vector("accel", r["accel"]), *vector("gyro", r["gyro"]))


@query
def rotate_zyx(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = vectors.Rotation.euler_zyx(*EULER).apply(F.col("accel"))
    return schema.imu(spark, sf_dir).select("seq", *vector("accel", r, exact=False))


@query
def calibration_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ten-thousandths are summed, so the mean doesn't depend on the order."""
    rows = schema.imu(spark, sf_dir).select((F.col("seq") % 8).alias("sensor_id"), F.struct(*(F.round(F.col(f"accel.{c}") * 10_000).cast("long").alias(c) for c in "xyz")).alias("accel"))
    got = sensors.calibration_of(rows, ("sensor_id",), "accel")
    return got.select("sensor_id", *vector("bias", F.col("accel_bias")))


@query
def smoothed_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitude of the acceleration and its mean over the last 10 readings, over one stream."""
    raw = schema.imu(spark, sf_dir).select("seq", vectors.magnitude(F.col("accel")).alias("raw"))
    return ordered.moving_average(raw, GLOBAL, "raw", 10, "smoothed")


@query
def lidar_cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = schema.scans(spark, sf_dir).select("seq", F.posexplode("ranges").alias("i", "range"))
    flat = lidar.to_cartesian_2d(F.col("range"), lidar.angle_at(F.col("i"), 0.0, lidar.fixed_increment(64)))
    solid = lidar.to_cartesian_3d(F.col("range"), F.col("i") * F.lit(0.1), F.lit(0.25))
    return points.select("seq", "i", *(rounded(flat[c]).alias(f"flat_{c}") for c in "xy"), *vector("solid", solid, exact=False))


@query
def lidar_valid_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = lidar.points_of(F.col("ranges"), F.col("ranges"), 0.0, lidar.fixed_increment(64))
    return schema.scans(spark, sf_dir).select("seq", lidar.count_valid(points).cast("long").alias("valid"), F.size("ranges").cast("long").alias("points"), lidar.point_at(5, F.col("ranges"), F.col("ranges"), 0.0, 0.5)["angle"].alias("angle_5"))


@query
def seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.sequence_gaps(in_range(spark, sf_dir).select("sensor_id", "seq"), BY_SENSOR)


@query
def monotonic_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clock fed with times that jump back; order is the event's number."""
    raw = in_range(spark, sf_dir).select("sensor_id", F.col("seq").alias("event"), (F.col("timestamp_ns") - F.col("seq") % 7 * 10**12).alias("raw_ns"))
    return ordered.stamped(raw, Stream(("sensor_id",), ("event",)), "raw_ns")


@query
def clock_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("timestamp_ns")
    other = t + (F.col("seq") % 11 - 5) * 1000
    return in_range(spark, sf_dir).select("seq", clock.time_since(t, other).alias("since"), clock.timestamp_diff(t, other).alias("diff"), clock.dropped_since(F.col("seq"), F.lit(100)).alias("dropped"), clock.within_tolerance(t, other, 2000).alias("near"))


def _pairing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = in_range(spark, sf_dir).select("sensor_id", "seq", "timestamp_ns", "value", "event_type")
    return rows.filter("event_type = 'purchase'").drop("event_type"), rows.filter("event_type = 'view'").drop("event_type")


@query
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, secondary = _pairing(spark, sf_dir)
    got = fusion.asof_nearest(primary, secondary, TOLERANCE_NS)
    return got.select("seq", F.col("secondary.seq").alias("secondary_seq"), "time_diff")


@query
def asof_nearest_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, secondary = _pairing(spark, sf_dir)
    got = fusion.asof_nearest(primary, secondary, 100 * TOLERANCE_NS, keys=("sensor_id",), how="left")
    return got.select("sensor_id", "seq", F.col("secondary.seq").alias("secondary_seq"), "time_diff")


@query
def asof_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, secondary = _pairing(spark, sf_dir)
    return fusion.asof_nearest(primary, secondary, TOLERANCE_NS, how="left_anti").select("seq")


@query
def asof_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairing by sensor in arrival order, with a buffer of 4 secondaries."""
    primary, secondary = _pairing(spark, sf_dir)
    union = primary.withColumn("kind", F.lit("p")).unionByName(secondary.withColumn("kind", F.lit("s")))
    return fusion.asof_arrival(union, BY_SENSOR, 500 * TOLERANCE_NS, 4).select("sensor_id", "seq", "secondary_seq", "time_diff")


@query
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, secondary = _pairing(spark, sf_dir)
    got = fusion.asof_nearest(primary, secondary, TOLERANCE_NS)
    return got.select("seq", fusion.weighted_average(F.col("value"), F.col("secondary.value"), 3, 1).alias("fused"), fusion.weighted_average(F.col("value"), F.col("secondary.value")).alias("mean"))


@query
def sample_every_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.sample_every(in_range(spark, sf_dir).select("seq", "value"), GLOBAL, 4)


@query
def drop_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 readings of each sensor."""
    return admission.drop_newest(in_range(spark, sf_dir).select("sensor_id", "seq"), BY_SENSOR, 15)


@query
def drop_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.drop_oldest(in_range(spark, sf_dir).select("sensor_id", "seq"), BY_SENSOR, 15)


@query
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = folds.folded(in_range(spark, sf_dir).select("sensor_id", "seq", "timestamp_ns"), BY_SENSOR, BUCKET)
    return got.select("sensor_id", "seq", "accepted", F.round("tokens", 6).alias("tokens"))


@query
def adaptive_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_range(spark, sf_dir).select("sensor_id", "seq", (F.col("value") / 100).alias("utilization"))
    return folds.folded(rows, BY_SENSOR, CONTROLLER).select("sensor_id", "seq", "quality", "accepted")


@query
def admission_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    return admission.admission_stats(in_range(spark, sf_dir), ("sensor_id",), accepted=e.isin("view", "click"), dropped=e == "error", blocked=e == "signup", sampled_out=e == "purchase")


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_range(spark, sf_dir).withColumn("latency_ns", F.round(F.col("value") * 1000).cast("long"))


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.latency(_latencies(spark, sf_dir), keys=("event_type",))
    return got.select("event_type", "count", "mean_ns", "min_ns", "max_ns", *metrics.PERCENTILES)


@query
def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.latency_histogram(_latencies(spark, sf_dir))
    return got.withColumn("reported_ns", metrics.bucket_value(F.col("bucket")))


@query
def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the milliseconds between readings of a sensor; rounded, as sums run in any order."""
    t = F.col("timestamp_ns")
    rows = in_range(spark, sf_dir).withColumn("timestamp_ms", F.round((t - F.pmod(t, F.lit(1_000_000))) / 1_000_000).cast("long"))
    got = metrics.jitter(metrics.intervals(rows, BY_SENSOR, "timestamp_ms", "interval"), "interval", ("sensor_id",))
    return got.select("sensor_id", "count", F.round("mean_ns", 3).alias("mean"), F.round("std_dev_ns", 3).alias("std_dev"), F.col("min_ns").alias("least"), F.col("max_ns").alias("most"), F.col("range_ns").alias("range"), F.round("coefficient_of_variation", 6).alias("variation"))


@query
def stage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(in_range(spark, sf_dir).withColumn("kind", kinds("event_type", COUNTER_KINDS)), keys=("sensor_id",))


@query
def event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.event_rate(in_range(spark, sf_dir), keys=("sensor_id",))


@query
def target_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.stage_metrics(_stages(spark, sf_dir), keys=("name",))
    both = got.select(F.col("name").alias("event_type"), F.col("input_count").cast("double").alias("throughput"), F.col("latency.p99_ns").alias("p99_ns"), F.round("jitter.std_dev_ns").alias("std_dev_ns"))
    return metrics.Targets(throughput=1000, p99_us=200, jitter_ms=0.05).check(both)


@query
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_range(spark, sf_dir).select("seq", kinds("event_type", QUEUE_KINDS).alias("kind"))
    return metrics.queue_depth(rows, GLOBAL)


@query
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_range(spark, sf_dir).select("sensor_id", "seq", kinds("event_type", QUEUE_KINDS).alias("kind"))
    return metrics.queue_metrics(rows, BY_SENSOR, capacity=10)


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.element_at(F.array(*map(F.lit, ("output", "output", "filtered", "dropped", "error"))), (F.col("seq") % 5 + 1).cast("int"))
    return _latencies(spark, sf_dir).select(F.col("event_type").alias("name"), outcome.alias("outcome"), "latency_ns", F.lit(8).alias("bytes"), "timestamp_ns", "seq")


@query
def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rates, exact latency and jitter of each stage; spreads rounded, as sums run in any order."""
    got = metrics.stage_metrics(_stages(spark, sf_dir))
    plain = ("name", "input_count", "output_count", "filtered_count", "dropped_count", "error_count", "bytes_processed", "total_ns", "elapsed_secs", "throughput_ratio", "filter_rate", "drop_rate", "avg_processing_ns", "throughput", "bytes_per_sec")
    return got.select(*plain, *(F.col(f"latency.{c}").alias(c) for c in metrics.LATENCY if c != "count"), F.col("jitter.range_ns").alias("range_ns"), F.round("jitter.std_dev_ns", 3).alias("std_dev_ns"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _stages(spark, sf_dir)
    whole = items.select("timestamp_ns", F.when(F.col("outcome") == "output", F.col("latency_ns")).alias("latency_ns"))
    return metrics.pipeline_snapshot(metrics.stage_metrics(items), whole)


@query
def snapshot_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's rows: the whole pipeline and each stage."""
    return export.to_csv_rows(_snapshot(spark, sf_dir))


@query
def snapshot_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.to_json(_snapshot(spark, sf_dir)).select("json")


@query
def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a snapshot for each kind of event."""
    rows = _latencies(spark, sf_dir)
    each = rows.groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("throughput"), F.max("latency_ns").alias("p99_ns"), F.min("latency_ns").cast("double").alias("std_dev_ns"), F.count(F.lit(1)).alias("total_input"), F.count_if(F.col("seq") % 2 == 0).alias("total_output"))
    return metrics.snapshot_summary(each)


@query
def recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 3 readings of each sensor."""
    return metrics.latest(in_range(spark, sf_dir).select("sensor_id", "seq", "value"), 3, "seq", ("sensor_id",))


@query
def token_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading starts; views never end."""
    rows = in_range(spark, sf_dir)
    ends = rows.filter("event_type <> 'view'").select("seq", (F.col("timestamp_ns") + F.col("seq")).alias("timestamp_ns"))
    return metrics.token_latency(rows.select("seq", "timestamp_ns"), ends)


@query
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of each stage, observed while the rows pass."""
    chain = core.Pipeline().filter(F.col("value") > 0).map(value=F.col("value") * 2).filter(F.col("value") < 60)
    out, counts = chain.measured(in_range(spark, sf_dir))
    out.write.format("noop").mode("overwrite").save()
    rows = [(i, c["name"], c["input_count"], c["output_count"], c["filtered_count"]) for i, c in enumerate(counts())]
    return spark.createDataFrame(rows, "stage long, name string, input_count long, output_count long, filtered_count long")


@query
def rotation_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product of rotations, its transpose, and the same matrix brought along by each row."""
    both = vectors.Rotation.z(EULER[0]) @ vectors.Rotation.x(EULER[2])
    there = both.apply(F.col("accel"))
    back = both.transpose().apply(there)
    by_row = vectors.rotate_by_array(F.array(*(F.array(*map(F.lit, r)) for r in both.rows)), F.col("accel"))
    return schema.imu(spark, sf_dir).select("seq", *vector("there", there, exact=False), *vector("back", back, exact=False), *vector("by_row", by_row, exact=False))


@query
def scan_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    geometry = lidar.ScanGeometry.full_rotation(65, 100.0).columns()
    return schema.scans(spark, sf_dir).select("seq", *(rounded(c).alias(k) for k, c in geometry.items()))


@query
def scaled_unbiased(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.Pipeline().then(core.quantity_scaled("value", 2.5))(in_range(spark, sf_dir).select("seq", "value"))
    return rows.select("seq", "value", vectors.correct_bias(F.col("value"), 0.75).alias("unbiased"))


@query
def imu_six_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of nine axes, from arrays, without the last three; and a zero reading."""
    wide = schema.imu(spark, sf_dir).withColumn("mag", F.col("accel"))
    as_array = lambda c: F.array(*(F.col(c)[x] for x in "xyz"))
    six = vectors.to_6dof(F.struct(vectors.imu_from_arrays(as_array("accel"), as_array("gyro"))["accel"].alias("accel"), F.col("gyro"), F.col("mag")))
    return wide.select("seq", *vector("accel", six["accel"]), *vector("gyro", six["gyro"]), F.size(F.map_keys(F.from_json(F.to_json(six), "map<string,string>"))).cast("long").alias("parts"), vectors.imu_zero()["gyro"]["z"].alias("zero"))


@query
def fused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synchronised pairs, fused by a stage of the user's."""
    primary, secondary = _pairing(spark, sf_dir)
    pairs = fusion.asof_nearest(primary, secondary, TOLERANCE_NS)
    pairs = pairs.select("seq", fusion.pair(F.col("value"), F.col("secondary.value"), F.col("timestamp_ns"), F.col("secondary.timestamp_ns")).alias("pair"))
    fused = core.Pipeline().map(fused=F.col("pair.primary") - F.col("pair.secondary"))(pairs)
    return fused.select("seq", "fused", F.col("pair.time_diff_ns").alias("time_diff_ns"), F.col("pair.timestamp_ns").alias("timestamp_ns"))


@query
def admission_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each strategy admits, by sensor."""
    rows, capacity = in_range(spark, sf_dir).select("sensor_id", "seq", "value"), 5
    chosen = (admission.Strategy.BLOCK, admission.Strategy.SAMPLE, admission.Strategy.DROP_NEWEST, admission.Strategy.DROP_OLDEST)
    kept = [s.apply(rows, BY_SENSOR, capacity=capacity, rate=3).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("kept"), F.min("seq").alias("first"), F.max("seq").alias("last")).withColumn("strategy", F.lit(s.value)) for s in chosen]
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


@query
def sequence_source(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: ARG001
    held = sensors.sequence(spark, [1, 2, 3, 4, 5], 20).withColumn("mode", F.lit("hold"))
    return held.unionByName(sensors.sequence(spark, [1, 2, 3], 20, repeat=True).withColumn("mode", F.lit("repeat")))


@query
def mock_imu(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: ARG001
    imu = sensors.MockImu().with_motion(1.0, (0.5, 0.0, 0.0)).with_noise(sensors.Noise.low())
    return imu.read(spark, 2000).select("seq", "timestamp_ns", *vector("accel", F.col("accel")), *vector("gyro", F.col("gyro")))


@query
def sensor_generators(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: ARG001
    demo = sensors.demo_stream(spark, 1000).select(F.lit("demo").alias("source"), "seq", rounded(F.col("value")).alias("value"))
    return demo.unionByName(sensors.barometer(spark, 1000).select(F.lit("barometer").alias("source"), "seq", rounded(F.col("pressure_pa")).alias("value")))



@query
def token_bucket_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few long streams, one for each type of event, in blocks. Times that go back bring no tokens."""
    rows = in_range(spark, sf_dir).select("event_type", "seq", "timestamp_ns")
    return folds.folded(rows, BY_TYPE, BUCKET).select("event_type", "seq", "accepted", F.round("tokens", 6).alias("tokens"))


@query
def adaptive_controller_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_range(spark, sf_dir).select("event_type", "seq", (F.col("value") / 100).alias("utilization"))
    return folds.folded(rows, BY_TYPE, CONTROLLER).select("event_type", "seq", "quality", "accepted")


@query
def admission_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the adaptive strategy admits, by sensor."""
    rows = in_range(spark, sf_dir).select("sensor_id", "seq", (F.col("value") / 100).alias("utilization"))
    return admission.Strategy.ADAPTIVE.apply(rows, BY_SENSOR).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("kept"), F.max("seq").alias("last"))


@query
def hot_types_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running status by type of event; types with a fifth of all rows are found hot and spread."""
    rows = in_range(spark, sf_dir).select("event_type", "seq", "value")
    return ordered.by_size(rows, Stream(("event_type",), ("seq",)), ordered.running_status, hot_rows=max(1, rows.count() // 5))


@query
def median_101(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame too long to sort for each row."""
    return ordered.median_filter(in_range(spark, sf_dir).select("event_type", "seq", "value"), BY_TYPE, "value", 101)


@query
def latency_percentiles_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all readings, in blocks of values."""
    return metrics.latency(_latencies(spark, sf_dir), spread=True).select(*metrics.LATENCY)


@query
def latency_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States by type and sensor, merged by type, told by buckets."""
    parts = percentiles.states(_latencies(spark, sf_dir), "latency_ns", ("event_type", "sensor_id"))
    got = percentiles.told(percentiles.merged(parts, ("event_type",)))
    return got.select("event_type", "count", "least", "most", *(F.round(c, 3).alias(c) for c in ("mean", "std_dev")), *percentiles.PERCENTILES)


def _halved(value: float) -> tuple:
    if value < 5:
        raise errors.ReadFailed("too small")
    return (value / 2,)


@query
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading's error, by a check and a stage, and the stage's output where there is none."""
    steps = (letters.Check(F.col("event_type") != "error", errors.InvalidData, "an error event"), letters.Guarded("half", _halved, ("value",), {"half": "double"}))
    got = letters.passed(in_range(spark, sf_dir).select("seq", "event_type", "value"), *steps)
    return got.select("seq", "half", F.col("error.kind").alias("kind"), F.col("error.message").alias("message"), F.col("error.stage").alias("stage"))


IDLE_NS = 3600 * 10**9


def _as_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows as a stream, with an end far behind them of each kind, seq -1, that moves the watermark."""
    ends = rows.groupBy("event_type").agg((F.max("timestamp_ns") + 10**18).alias("timestamp_ns")).withColumn("seq", F.lit(-1).cast("long"))
    path = shared_path(spark, "stream")
    rows.unionByName(ends, allowMissingColumns=True).write.parquet(path)
    for k, v in engine.ROCKSDB.items():
        spark.conf.set(k, v)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _drained(df: DataFrame) -> DataFrame:
    """What a stream gives over all that is there now, through a table in the shared folder."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "drained")
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", shared_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query
def stream_asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asof_nearest over two streams, by timers."""
    rows = _as_stream(spark, in_range(spark, sf_dir).filter("event_type in ('purchase', 'view')").select("seq", "timestamp_ns", "value", "event_type"))
    primary, secondary = (rows.filter(F.col("event_type") == kind).drop("event_type") for kind in ("purchase", "view"))
    got = _drained(engine.asof_nearest(primary, secondary, TOLERANCE_NS, "1 hour").select("seq", F.col("secondary.seq").alias("secondary_seq"), "time_diff"))
    return got.filter("seq >= 0")


@query
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last reading of each burst of a sensor, told by a tick once it has been idle for an hour."""
    rows = _as_stream(spark, in_range(spark, sf_dir).select("sensor_id", "seq", "timestamp_ns", "value", "event_type"))
    machine = machines.Debounce(("seq", "value"), {"last_seq": "long", "value": "double"}, idle_ns=IDLE_NS)
    return _drained(engine.spoken(rows, ("sensor_id",), ("timestamp_ns", "seq"), machine, "1 hour")).filter("last_seq >= 0")


@query
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_debounce over a table."""
    machine = machines.Debounce(("seq", "value"), {"last_seq": "long", "value": "double"}, idle_ns=IDLE_NS)
    return machines.spoken(in_range(spark, sf_dir), Stream(("sensor_id",), ("timestamp_ns", "seq")), machine)


@query
def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ema over a stream, its state in the state store."""
    rows = _as_stream(spark, in_range(spark, sf_dir).select("sensor_id", "seq", "timestamp_ns", "value", "event_type")).filter("seq >= 0").select("sensor_id", "seq", "value")
    return _drained(engine.streamed(rows, ("sensor_id",), ("seq",), folds.Ema(("value",), {"ema": "double"}, ALPHA)))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_range(spark, sf_dir).withColumn("event_time", clock.event_time(F.col("timestamp_ns")))


def _bounds(window: str) -> list[Column]:
    return [F.unix_micros(f"{window}.{end}").alias(f"{end}_us") for end in ("start", "end")]


@query
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each type of event, sliding by half a day."""
    got = engine.windowed(_timed(spark, sf_dir), "event_time", "1 hour", "1 day", "12 hours", ("event_type",), n=F.count(F.lit(1)), most=F.max("value"))
    return got.select("event_type", *_bounds("window"), "n", "most")


@query
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a sensor: readings less than a day apart."""
    got = engine.sessions(_timed(spark, sf_dir), "event_time", "1 hour", "1 day", ("sensor_id",), n=F.count(F.lit(1)), least=F.min("value"))
    return got.select("sensor_id", *_bounds("session_window"), "n", "least")


@query
def snapshot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).select(export.summary_line().alias("text"))


@query
def inspected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two inspections of a pipeline have seen, told once its result is counted."""
    seen = [Observation(name) for name in ("before", "after")]
    sums = (F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first"), F.max("value").alias("most"))
    chain = core.Pipeline().inspect(seen[0], *sums).filter(F.col("value") < 50).inspect(seen[1], *sums)
    passed = chain(in_range(spark, sf_dir).select("seq", "value")).count()
    return spark.createDataFrame([(o, passed, *(s.get[c] for c in ("rows", "first", "most"))) for o, s in zip(("before", "after"), seen, strict=True)], "place string, passed long, rows long, first long, most double")


@query
def callback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callback for each micro-batch adds up its rows by type; a batch that runs again replaces its own."""
    rows = _as_stream(spark, in_range(spark, sf_dir).select("seq", "timestamp_ns", "value", "event_type")).filter("seq >= 0")
    path = shared_path(spark, "callback")
    sink = letters.batches(path, lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")))
    engine.callback(rows, sink, checkpointLocation=shared_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return letters.read(spark, path).groupBy("event_type").agg(F.sum("n").alias("n"), F.max("most").alias("most"))


@query
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad readings apart; null and NaN are not good."""
    good, bad = errors.quarantine(schema.readings(spark, sf_dir).select("seq", "value"), ~F.isnan("value") & F.col("value").between(20, 60))
    return good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False)))


@query
def stage_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rates and latency of each stage, observed while the rows pass."""
    chain = core.Pipeline().filter(F.col("value") > 0).map(value=F.col("value") * 2).filter(F.col("value") < 60)
    out, told = chain.measured(_latencies(spark, sf_dir), F.col("latency_ns"))
    out.write.format("noop").mode("overwrite").save()
    columns = ("name", "input_count", "output_count", "throughput_ratio", "filter_rate", "total_ns", "min_ns", "max_ns", *percentiles.PERCENTILES)
    rows = [(i, *(t[c] for c in columns), round(t["std_dev_ns"], 3)) for i, t in enumerate(told())]
    kinds_of = ("string", "long", "long", "double", "double", *["long"] * 7)
    return spark.createDataFrame(rows, ", ".join(["stage long", *(f"{c} {k}" for c, k in zip(columns, kinds_of, strict=True)), "std_dev_ns double"]))
