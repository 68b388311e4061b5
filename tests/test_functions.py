import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import clock, lidar, vectors
from gaugeworks.functions.vectors import NED_ENU, Rotation


def value(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def xyz(spark, v):
    return tuple(value(spark, v)[0])


V = vectors.vec3


def test_vectors(spark):
    a, b = V(1, 2, 3), V(4, 5, 6)
    assert xyz(spark, vectors.add(a, b)) == (5, 7, 9)
    assert xyz(spark, vectors.subtract(b, a)) == (3, 3, 3)
    assert xyz(spark, vectors.scale(a, 2.0)) == (2, 4, 6)
    assert value(spark, vectors.dot(a, b), vectors.magnitude(V(3, 4, 0)), vectors.magnitude_squared(a)) == (32, 5, 14)
    assert xyz(spark, vectors.cross(V(1, 0, 0), V(0, 1, 0))) == (0, 0, 1)
    assert xyz(spark, vectors.normalized(V(0, 0, 0))) == (0, 0, 0)
    assert xyz(spark, vectors.normalized(V(1e-8, 0, 0))) == (0, 0, 0)
    assert xyz(spark, vectors.normalized(V(0, 3, 4))) == (0, 0.6, 0.8)
    assert value(spark, vectors.as_array(vectors.from_array(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))))[0] == [1, 2, 3]


def test_rotations(spark):
    assert xyz(spark, Rotation.z(math.pi / 2).apply(V(1, 0, 0))) == pytest.approx((0, 1, 0), abs=1e-12)
    assert xyz(spark, Rotation.x(math.pi / 2).apply(V(0, 1, 0))) == pytest.approx((0, 0, 1), abs=1e-12)
    assert xyz(spark, Rotation.y(math.pi / 2).apply(V(0, 0, 1))) == pytest.approx((1, 0, 0), abs=1e-12)
    r = Rotation.euler_zyx(0.5, 0.3, 0.1)
    for row, want in zip((r @ r.transpose()).rows, Rotation().rows, strict=True):
        assert row == pytest.approx(want, abs=1e-12)
    assert (NED_ENU @ NED_ENU).rows == Rotation().rows
    assert xyz(spark, NED_ENU.apply(V(1, 2, 3))) == (2, 1, -3)
    matrix = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in NED_ENU.rows))
    assert xyz(spark, vectors.rotate_by_array(matrix, V(1, 2, 3))) == (2, 1, -3)


def test_units_and_calibration(spark):
    r = vectors.g_degrees_to_si(vectors.imu(V(1, 0, 0), V(180, 0, 0)))
    assert value(spark, r["accel"]["x"], r["gyro"]["x"]) == pytest.approx((9.80665, math.pi))
    back = vectors.si_to_g_degrees(r)
    assert value(spark, back["accel"]["x"], back["gyro"]["x"]) == pytest.approx((1, 180))
    c = F.struct(V(0.1, 0.1, 0.1).alias("accel_bias"), F.lit(None).cast("struct<x:double,y:double,z:double>").alias("accel_scale"), V(0.01, 0.01, 0.01).alias("gyro_bias"), V(1, 1, 1).alias("gyro_scale"))
    done = vectors.calibrated_imu(vectors.imu(V(1, 2, 3), V(0.1, 0.2, 0.3)), c)
    assert value(spark, done["accel"]["x"], done["gyro"]["x"]) == pytest.approx((0.9, 0.09))
    assert value(spark, vectors.to_6dof(F.struct(V(1, 2, 3).alias("accel"), V(4, 5, 6).alias("gyro"), V(7, 8, 9).alias("mag")))["gyro"]["x"]) == (4,)
    assert vectors.MILLIGAUSS_TO_TESLA * vectors.TESLA_TO_MILLIGAUSS == 1


def test_lidar(spark):
    ok = [value(spark, lidar.is_valid(F.lit(x).cast("double")))[0] for x in (1.0, 0.0, -1.0, math.inf, math.nan, None)]
    assert ok == [True, False, False, False, False, False]
    assert xy(spark, lidar.to_cartesian_2d(F.lit(1.0), F.lit(math.pi / 2))) == pytest.approx((0, 1), abs=1e-9)
    assert xy(spark, lidar.to_cartesian_3d(F.lit(2.0), F.lit(0.0), F.lit(math.pi / 2))) == pytest.approx((0, 0, 2), abs=1e-9)
    assert value(spark, lidar.angle_at(180, 0.0, lidar.fixed_increment(360)))[0] == pytest.approx(math.pi, abs=1e-9)
    assert lidar.ScanGeometry.full_rotation(1, 10).angle_increment == 0
    assert lidar.ScanGeometry.of(3, 0, 2, 0.1, 9).angle_increment == 1
    points = lidar.points_of(F.array(F.lit(1.0), F.lit(math.nan), F.lit(2.0)), F.array(F.lit(5.0)), 0.0, 0.5)
    assert value(spark, lidar.count_valid(points)) == (2,)
    assert [tuple(p) for p in value(spark, lidar.valid_points(points))[0]] == [(1, 0, 5), (2, 1, None)]
    assert value(spark, lidar.point_at(9, F.array(F.lit(1.0)), F.array(F.lit(1.0)), 0.0, 1.0)) == (None,)


def xy(spark, v):
    return tuple(value(spark, v)[0])


def test_clock(spark):
    near = [value(spark, clock.within_tolerance(F.lit(a), F.lit(b), 10))[0] for a, b in ((100, 105), (100, 120), (100, 110))]
    assert near == [True, False, True]
    assert [value(spark, clock.dropped_since(F.lit(10), F.lit(e)))[0] for e in (10, 5, 15)] == [0, 5, 0]
    assert value(spark, clock.time_since(F.lit(5), F.lit(3)), clock.time_since(F.lit(3), F.lit(5))) == (2, None)
    assert value(spark, clock.timestamp_diff(F.lit(3), F.lit(5))) == (2,)
    big = 1_700_000_000_123_456_789
    assert value(spark, F.unix_micros(clock.event_time(F.lit(big)))) == (big // 1000,)
