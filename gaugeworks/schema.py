"""Record schemas and the adapters that read test tables as sensor readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VEC3 = T.StructType([T.StructField(c, T.FloatType()) for c in "xyz"])
IMU = T.StructType([T.StructField("accel", VEC3), T.StructField("gyro", VEC3)])
IMU9 = T.StructType([*IMU.fields, T.StructField("mag", VEC3)])
CALIBRATION = T.StructType([T.StructField(c, VEC3) for c in ("accel_bias", "accel_scale", "gyro_bias", "gyro_scale")])
LIDAR_2D = T.StructType([T.StructField(c, T.FloatType()) for c in ("range", "angle", "intensity")])
LIDAR_3D = T.StructType([T.StructField(c, T.FloatType()) for c in ("range", "azimuth", "elevation", "intensity")])
SCAN_2D = T.StructType(
    [T.StructField("points", T.ArrayType(LIDAR_2D)), T.StructField("valid_count", T.IntegerType())]
    + [T.StructField(c, T.FloatType()) for c in ("angle_min", "angle_max", "angle_increment", "range_min", "range_max")]
)
SCAN_FIXED = T.StructType(
    [T.StructField(c, T.ArrayType(T.FloatType())) for c in ("ranges", "intensities")] + [T.StructField(c, T.FloatType()) for c in ("angle_min", "angle_increment")]
)
ROTATION = T.ArrayType(T.ArrayType(T.FloatType()))
SENSOR_INFO = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("sample_rate_hz", T.DoubleType()), T.StructField("sensor_type", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)


def timestamped(data: T.DataType) -> T.StructType:
    """Envelope of a reading: nanoseconds of its clock, sequence number, payload."""
    return T.StructType([T.StructField("timestamp_ns", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("data", data)])


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as readings: sensor_id, seq, event_time, timestamp_ns, event_type, value."""
    at = F.col("ts").cast("timestamp")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("sensor_id"), F.col("event_id").alias("seq"), at.alias("event_time"), (F.unix_micros(at) * 1000).alias("timestamp_ns"), "event_type", "value"
    )


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as inertial readings: seq, accel, gyro (structs of doubles)."""
    e = lambda i: F.col("embedding")[i].cast("double")
    vec = lambda i: F.struct(e(i).alias("x"), e(i + 1).alias("y"), e(i + 2).alias("z"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("seq"), vec(0).alias("accel"), vec(3).alias("gyro"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as fixed lidar scans: seq, ranges."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("seq"), F.transform("embedding", lambda x: x.cast("double")).alias("ranges"))
