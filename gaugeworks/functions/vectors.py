"""Three-vectors, rotations, units and calibration as Column expressions, computed in double."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magnitudes up to this are zero when normalising (single precision epsilon).
EPSILON = 1.1920929e-07
GRAVITY = 9.80665
G_TO_MS2, MS2_TO_G = GRAVITY, 1 / GRAVITY
DEG_TO_RAD, RAD_TO_DEG = math.pi / 180, 180 / math.pi
MILLIGAUSS_TO_TESLA, TESLA_TO_MILLIGAUSS = 1e-7, 1e7


def vec3(x: Column | float, y: Column | float, z: Column | float) -> Column:
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(as_col(x).alias("x"), as_col(y).alias("y"), as_col(z).alias("z"))


def zero() -> Column:
    return vec3(0, 0, 0)


def as_array(v: Column) -> Column:
    return F.array(v["x"], v["y"], v["z"])


def from_array(a: Column) -> Column:
    return vec3(a[0], a[1], a[2])


def add(a: Column, b: Column) -> Column:
    return vec3(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def subtract(a: Column, b: Column) -> Column:
    return vec3(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def scale(v: Column, factor: Column | float) -> Column:
    return vec3(v["x"] * factor, v["y"] * factor, v["z"] * factor)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec3(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def magnitude_squared(v: Column) -> Column:
    return dot(v, v)


def magnitude(v: Column) -> Column:
    return F.sqrt(magnitude_squared(v))


def normalized(v: Column) -> Column:
    """Unit vector; the zero vector where the magnitude is at most EPSILON."""
    size = magnitude(v)
    part = lambda c: F.when(size > EPSILON, v[c] / size).otherwise(F.lit(0.0))
    return vec3(part("x"), part("y"), part("z"))


@dataclass(frozen=True)
class Rotation:
    """A row-major 3 x 3 matrix, folded on the driver and inlined as literals."""

    rows: tuple[tuple[float, float, float], ...] = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))

    @classmethod
    def x(cls, angle: float) -> Rotation:
        c, s = math.cos(angle), math.sin(angle)
        return cls(((1.0, 0.0, 0.0), (0.0, c, -s), (0.0, s, c)))

    @classmethod
    def y(cls, angle: float) -> Rotation:
        c, s = math.cos(angle), math.sin(angle)
        return cls(((c, 0.0, s), (0.0, 1.0, 0.0), (-s, 0.0, c)))

    @classmethod
    def z(cls, angle: float) -> Rotation:
        c, s = math.cos(angle), math.sin(angle)
        return cls(((c, -s, 0.0), (s, c, 0.0), (0.0, 0.0, 1.0)))

    @classmethod
    def euler_zyx(cls, yaw: float, pitch: float, roll: float) -> Rotation:
        return cls.z(yaw) @ cls.y(pitch) @ cls.x(roll)

    def __matmul__(self, other: Rotation) -> Rotation:
        columns = list(zip(*other.rows, strict=True))
        return Rotation(tuple(tuple(sum(a * b for a, b in zip(row, col, strict=True)) for col in columns) for row in self.rows))

    def transpose(self) -> Rotation:
        return Rotation(tuple(zip(*self.rows, strict=True)))

    def apply(self, v: Column) -> Column:
        return vec3(*(v["x"] * r[0] + v["y"] * r[1] + v["z"] * r[2] for r in self.rows))


#: North-east-down to east-north-up and back.
NED_ENU = Rotation(((0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, -1.0)))


def rotate_by_array(matrix: Column, v: Column) -> Column:
    """Rotation by a matrix that each row brings along, as an array of rows."""
    return vec3(*(matrix[i][0] * v["x"] + matrix[i][1] * v["y"] + matrix[i][2] * v["z"] for i in range(3)))


def imu(accel: Column, gyro: Column) -> Column:
    return F.struct(accel.alias("accel"), gyro.alias("gyro"))


def imu_zero() -> Column:
    return imu(zero(), zero())


def imu_from_arrays(accel: Column, gyro: Column) -> Column:
    return imu(from_array(accel), from_array(gyro))


def to_6dof(reading: Column) -> Column:
    return imu(reading["accel"], reading["gyro"])


def rotate_imu(reading: Column, rotation: Rotation) -> Column:
    return imu(rotation.apply(reading["accel"]), rotation.apply(reading["gyro"]))


def convert_imu(reading: Column, accel_factor: float, gyro_factor: float) -> Column:
    return imu(scale(reading["accel"], accel_factor), scale(reading["gyro"], gyro_factor))


def g_degrees_to_si(reading: Column) -> Column:
    return convert_imu(reading, G_TO_MS2, DEG_TO_RAD)


def si_to_g_degrees(reading: Column) -> Column:
    return convert_imu(reading, MS2_TO_G, RAD_TO_DEG)


def correct_bias(value: Column, bias: Column | float) -> Column:
    return value - bias


def calibrated(v: Column, bias: Column, factor: Column) -> Column:
    """(v - bias) * factor, axis by axis."""
    return vec3(*((v[c] - bias[c]) * factor[c] for c in "xyz"))


def calibrated_imu(reading: Column, calibration: Column) -> Column:
    """Missing biases are 0 and missing scales 1."""
    part = lambda name, other: F.coalesce(calibration[name], vec3(other, other, other))
    return imu(*(calibrated(reading[s], part(f"{s}_bias", 0), part(f"{s}_scale", 1)) for s in ("accel", "gyro")))
