"""Lidar points and scans as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cartesian_2d(distance: Column, angle: Column) -> Column:
    return F.struct((distance * F.cos(angle)).alias("x"), (distance * F.sin(angle)).alias("y"))


def to_cartesian_3d(distance: Column, azimuth: Column, elevation: Column) -> Column:
    flat = distance * F.cos(elevation)
    return F.struct((flat * F.cos(azimuth)).alias("x"), (flat * F.sin(azimuth)).alias("y"), (distance * F.sin(elevation)).alias("z"))


def is_valid(distance: Column) -> Column:
    """Finite and positive; NaN, infinities and null are not."""
    return F.coalesce(~F.isnan(distance) & (distance > 0) & (distance < F.lit(float("inf"))), F.lit(False))


@dataclass(frozen=True)
class ScanGeometry:
    angle_min: float
    angle_max: float
    angle_increment: float
    range_min: float
    range_max: float

    @classmethod
    def of(cls, points: int, angle_min: float, angle_max: float, range_min: float, range_max: float) -> ScanGeometry:
        step = (angle_max - angle_min) / (points - 1) if points > 1 else 0.0
        return cls(angle_min, angle_max, step, range_min, range_max)

    @classmethod
    def full_rotation(cls, points: int, range_max: float) -> ScanGeometry:
        return cls.of(points, 0.0, 2 * math.pi, 0.05, range_max)

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(v) for k, v in vars(self).items()}


def valid_points(points: Column) -> Column:
    return F.filter(points, lambda p: is_valid(p["range"]))


def count_valid(points: Column) -> Column:
    return F.size(valid_points(points))


def angle_at(i: Column | int, angle_min: Column | float, increment: Column | float) -> Column:
    i = i if isinstance(i, Column) else F.lit(i)
    return angle_min + i * increment


def fixed_increment(points: int) -> float:
    return 2 * math.pi / points


def points_of(ranges: Column, intensities: Column, angle_min: Column | float, increment: Column | float) -> Column:
    """A fixed scan as an array of (range, angle, intensity)."""
    return F.transform(ranges, lambda r, i: F.struct(r.alias("range"), (angle_min + i * increment).alias("angle"), F.get(intensities, i).alias("intensity")))


def point_at(i: int, ranges: Column, intensities: Column, angle_min: Column | float, increment: Column | float) -> Column:
    """The i-th point, or null outside the scan."""
    point = F.struct(F.get(ranges, i).alias("range"), angle_at(i, angle_min, increment).alias("angle"), F.get(intensities, i).alias("intensity"))
    return F.when((F.lit(i) >= 0) & (F.lit(i) < F.size(ranges)), point)
