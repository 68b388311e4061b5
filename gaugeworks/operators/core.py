"""Pipelines: lazy chains of DataFrame transformations.

A stage gives at most one row for each row. Stages are expressions wherever they can be, so
Catalyst fuses them; nothing here runs anything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gaugeworks.operators.percentiles import PERCENTILES, Sums, bucket_of, histogram, moments

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stage:
    name: str
    apply: Transform

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


def mapped(name: str = "map", **columns: Column) -> Stage:
    """Adds or replaces columns."""
    return Stage(name, lambda df: df.withColumns(columns))


def projected(*columns: Column | str, name: str = "project") -> Stage:
    return Stage(name, lambda df: df.select(*columns))


def filtered(condition: Column, name: str = "filter") -> Stage:
    """Keeps rows for which the condition is true; null drops the row."""
    return Stage(name, lambda df: df.filter(condition))


def filter_mapped(column: str, value: Column, name: str = "filter_map") -> Stage:
    """Replaces a column and drops the rows where it comes out null."""
    return Stage(name, lambda df: df.withColumn(column, value).filter(F.col(column).isNotNull()))


def identity(name: str = "identity") -> Stage:
    return Stage(name, lambda df: df)


def inspected(observation: Observation | str, *aggregates: Column, name: str = "inspect") -> Stage:
    """Collects aggregates of the rows that pass, which stay as they are; works in streams too."""
    return Stage(name, lambda df: df.observe(observation, *aggregates))


def payload_mapped(value: Callable[[Column], Column], name: str = "payload") -> Stage:
    """Maps `data`; timestamp_ns and seq stay."""
    return Stage(name, lambda df: df.withColumn("data", value(F.col("data"))))


def quantity_scaled(column: str, factor: float) -> Stage:
    return Stage("scale", lambda df: df.withColumn(column, F.col(column) * factor))


@dataclass(frozen=True)
class Pipeline:
    """An immutable list of stages; each method gives a longer pipeline."""

    stages: tuple[Stage, ...] = ()

    def then(self, *stages: Stage | Transform) -> Pipeline:
        named = tuple(s if isinstance(s, Stage) else Stage(getattr(s, "__name__", "stage"), s) for s in stages)
        return Pipeline(self.stages + named)

    def chain(self, other: Pipeline) -> Pipeline:
        return Pipeline(self.stages + other.stages)

    def map(self, **columns: Column) -> Pipeline:
        return self.then(mapped(**columns))

    def filter(self, condition: Column) -> Pipeline:
        return self.then(filtered(condition))

    def filter_map(self, column: str, value: Column) -> Pipeline:
        return self.then(filter_mapped(column, value))

    def inspect(self, observation: Observation | str, *aggregates: Column) -> Pipeline:
        return self.then(inspected(observation, *aggregates))

    def __call__(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage(df)
        return df

    def measured(self, df: DataFrame, latency: Column | None = None) -> tuple[DataFrame, Callable[[], list[dict]]]:
        """The result, and a function that tells each stage's counts and rates once an action has run.

        latency: nanoseconds of a row, by columns that every stage keeps; the rows that leave a
        stage then also give their total, mean, least, most, deviation and bucket percentiles.
        """
        seen: list[Observation] = []

        def observed(rows: DataFrame) -> DataFrame:
            seen.append(Observation())
            count = F.count(F.lit(1)).alias("rows")
            if latency is None:
                return rows.observe(seen[-1], count)
            wide = rows.withColumn("_latency", latency).withColumn("_bucket", bucket_of(F.col("_latency")))
            return wide.observe(seen[-1], count, F.lit(0).alias("errors"), histogram("_bucket").alias("histogram"), moments("_latency").alias("moments")).drop("_latency", "_bucket")

        df = observed(df)
        for stage in self.stages:
            df = observed(stage(df))

        def told() -> list[dict]:
            found = [o.get for o in seen]
            out = []
            for stage, before, after in zip(self.stages, found, found[1:], strict=False):
                a, b = before["rows"], after["rows"]
                row = {"name": stage.name, "input_count": a, "output_count": b, "filtered_count": max(a - b, 0), "throughput_ratio": b / a if a else 0.0, "filter_rate": max(a - b, 0) / a if a else 0.0}
                if latency is not None:
                    sums = Sums()
                    sums.add(after)
                    n, mean, least, most, *ranks = sums.latency()
                    row |= {"total_ns": round(n * mean), "mean_ns": mean, "min_ns": least, "max_ns": most, **dict(zip(PERCENTILES, ranks, strict=True)), "std_dev_ns": sums.jitter()[3]}
                out.append(row)
            return out

        return df, told


@dataclass(frozen=True)
class FourStage:
    """The fixed four-slot pipeline; every slot must be there."""

    ingestion: Transform | None = None
    filtering: Transform | None = None
    aggregation: Transform | None = None
    output: Transform | None = None

    def build(self) -> Pipeline:
        slots = vars(self)
        if missing := [k for k, v in slots.items() if v is None]:
            raise ValueError(f"missing slots: {', '.join(missing)}")
        return Pipeline().then(*(Stage(k, v) for k, v in slots.items()))

    @classmethod
    def of(cls, *functions: Transform) -> Pipeline:
        return cls(*functions).build()
