"""Errors of sources and pipelines. Bad rows don't raise: they go to a quarantine table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


class PipelineError(Exception):
    """Any failure of a pipeline."""


class BufferFull(PipelineError):
    pass


class BufferEmpty(PipelineError):
    pass


class StageError(PipelineError):
    pass


class TimestampError(PipelineError):
    pass


class Shutdown(PipelineError):
    pass


class SensorError(PipelineError):
    """A source can't give readings."""


class NotInitialized(SensorError):
    pass


class ReadFailed(SensorError):
    pass


class Disconnected(SensorError):
    pass


class InvalidData(SensorError):
    pass


class SensorTimeout(SensorError):
    pass


def quarantine(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for which `good` is true, all others); null counts as not good."""
    from pyspark.sql import functions as F

    ok = F.coalesce(good, F.lit(False))
    return df.filter(ok), df.filter(~ok)
