"""Timestamps and sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_time(timestamp_ns: Column) -> Column:
    """Microsecond timestamp for watermarks and windows; the nanoseconds stay the truth."""
    return F.timestamp_micros(((timestamp_ns - F.pmod(timestamp_ns, F.lit(1000))).cast("decimal(20,0)") / 1000).cast("long"))


def time_since(later: Column, earlier: Column) -> Column:
    """later - earlier, or null if that is negative."""
    return F.when(later >= earlier, later - earlier)


def timestamp_diff(earlier: Column, later: Column) -> Column:
    return time_since(later, earlier)


def dropped_since(seq: Column, expected: Column) -> Column:
    return F.greatest(seq - expected, F.lit(0))


def within_tolerance(a: Column, b: Column, tolerance: Column | int) -> Column:
    return F.abs(a - b) <= tolerance
