"""Sinks that may run a micro-batch twice, and dead letters.

A batch is written to a folder of its own, by its number, over what an earlier try has left; a
reader of all folders sees each batch once. Dead letters are rows that a check or a stage
refuses: they go to a table beside the good rows', with the class of the error, its message and
where it arose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks import errors
from gaugeworks.errors import PipelineError, StageError

ERROR = "struct<kind:string,message:string,stage:string>"
Sink = Callable[[DataFrame, int], None]


def batches(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Sink:
    """A foreachBatch function that writes what transform makes of each batch, once however often it runs."""
    return lambda df, number: transform(df).write.mode("overwrite").parquet(f"{path}/batch={number}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All batches that were written."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


@dataclass(frozen=True)
class Check:
    """A condition that good rows meet (null does not), and the error of rows that don't."""

    good: Column
    kind: type[PipelineError] = errors.InvalidData
    message: str = "check failed"


@dataclass(frozen=True)
class Guarded:
    """A Python stage row by row, in batches: what it raises becomes the row's error and stops nothing.

    function: from the values of the inputs to a tuple of outputs; errors of other classes than
    PipelineError count as StageError.
    """

    name: str
    function: Callable[..., tuple]
    inputs: tuple[str, ...]
    outputs: dict[str, str] = field(default_factory=dict)


def checked(df: DataFrame, *checks: Check, stage: str = "check") -> DataFrame:
    """df with `error`, null for good rows: the first check that a row fails."""
    found = F.lit(None).cast(ERROR)
    for c in reversed(checks):
        failed = F.struct(F.lit(c.kind.__name__).alias("kind"), F.lit(c.message).alias("message"), F.lit(stage).alias("stage"))
        found = F.when(F.coalesce(c.good, F.lit(False)), found).otherwise(failed)
    return df.withColumn("error", found)


def guarded(df: DataFrame, stage: Guarded) -> DataFrame:
    """df with the stage's outputs and `error`. Rows that have an error already pass as they are, with null outputs."""
    if clash := {*df.columns} & {*stage.outputs}:
        raise ValueError(f"input already has the columns {', '.join(sorted(clash))}")
    df = df if "error" in df.columns else df.withColumn("error", F.lit(None).cast(ERROR))
    added = df.select(*(F.lit(None).cast(t).alias(k) for k, t in stage.outputs.items())).schema
    names = [c for c in df.columns if c != "error"]
    schema = T.StructType([*(df.schema[c] for c in names), *(T.StructField(f.name, f.dataType) for f in added.fields), T.StructField("error", df.schema["error"].dataType)])
    nothing = (None,) * len(stage.outputs)

    def one(error: dict | None, values: tuple) -> tuple[tuple, dict | None]:
        if error is not None:
            return nothing, error
        try:
            out = stage.function(*values)
            if len(out) != len(nothing):
                raise StageError(f"{len(out)} outputs, not {len(nothing)}")
            return tuple(out), None
        except Exception as e:  # noqa: BLE001  # the row's, not the query's
            kind = type(e).__name__ if isinstance(e, PipelineError) else StageError.__name__
            return nothing, {"kind": kind, "message": f"{e}" if isinstance(e, PipelineError) else f"{type(e).__name__}: {e}", "stage": stage.name}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for batch in parts:
            inputs = [batch.column(c).to_pylist() for c in stage.inputs]
            rows = zip(*inputs, strict=True) if inputs else [()] * batch.num_rows
            got = [one(e, v) for e, v in zip(batch.column("error").to_pylist(), rows, strict=True)]
            outs = [pa.array([o[i] for o, _ in got], types.field(name).type) for i, name in enumerate(stage.outputs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *outs, pa.array([e for _, e in got], types.field("error").type)], schema.names)

    return df.mapInArrow(run, schema)


def two_way(good: str, dead: str, *steps: Check | Guarded, latest: str | None = None) -> Sink:
    """A foreachBatch function: rows through checks and stages, good ones to one table and dead letters to another.

    Both are written by batch, so a batch that runs twice leaves one copy. Dead letters keep all
    input columns as JSON, with the error, and with the column named by `latest` if there is one.
    """

    def sink(df: DataFrame, number: int) -> None:
        whole = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        keep = [F.col(latest)] if latest else []
        rows = passed(df.withColumn("_letter", whole), *steps).persist()
        try:
            rows.filter("error is null").drop("error", "_letter").write.mode("overwrite").parquet(f"{good}/batch={number}")
            rows.filter("error is not null").select(F.col("_letter").alias("letter"), "error.*", *keep).write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            rows.unpersist()

    return sink


def passed(df: DataFrame, *steps: Check | Guarded) -> DataFrame:
    """df through checks and guarded stages, with `error` (the first) of each row."""
    df = df.withColumn("error", F.lit(None).cast(ERROR))

    def after(rows: DataFrame, step: Check | Guarded) -> DataFrame:
        if isinstance(step, Guarded):
            return guarded(rows, step)
        return checked(rows.withColumnRenamed("error", "_before"), step).withColumn("error", F.coalesce("_before", "error")).drop("_before")

    return reduce(after, steps, df)


def raised(kind: str, message: str) -> PipelineError:
    """The error that a dead letter stands for; of an unknown class a PipelineError."""
    known = getattr(errors, kind, PipelineError)
    return known(message) if isinstance(known, type) and issubclass(known, PipelineError) else PipelineError(message)
