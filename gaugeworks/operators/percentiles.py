"""Exact percentiles without buffers that grow, and states of latencies that merge.

Exact ones count the rows of each value first, then run through the values in order, so what is
sorted is a row for each distinct value, and sorting spills. A stream of its own (`spread`) is cut
into range-partitioned blocks of values, so no key is one task's.

States are of fixed size: 64 bucket counts and five moments. They merge over micro-batches,
partitions or files, in any order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.ordered import Stream, by_size, running

#: Name -> share of the percentiles that latencies are told by (fixed values).
PERCENTILES = {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99, "p999_ns": 0.999}
BUCKETS = 64


def bucket_of(value: Column) -> Column:
    """Number of the 64 logarithmic buckets that compatible histograms use; null has none."""
    log2 = F.length(F.bin(F.greatest(value, F.lit(1)).cast("long"))) - 1
    return F.when(value.isNotNull(), F.least(F.floor(log2 * 10 / 3), F.lit(BUCKETS - 1)).cast("int"))


def bucket_value(bucket: Column) -> Column:
    """What such a histogram reports for a bucket."""
    return F.pow(F.lit(2.0), F.floor(bucket * 3 / 10)).cast("long")


def rank_of(count: Column, share: float) -> Column:
    """Nearest rank: ceil(count * share), in decimals, at least 1."""
    return F.greatest(F.ceil(count.cast("decimal(20,0)") * F.lit(Decimal(str(share)))), F.lit(1)).cast("long")


def summary(df: DataFrame, column: str, keys: tuple[str, ...] = (), percentiles: dict[str, float] | None = None, spread: bool | str = False) -> DataFrame:
    """A row for each key: the keys, count, mean, least, most and the nearest-rank percentiles of a numeric column.

    Nulls are no values; a key without values has count 0 and nulls, and so has an empty table
    without keys. NaN is the largest value. spread: True, or "auto" for keys with many distinct values.
    """
    percentiles = PERCENTILES if percentiles is None else percentiles
    marks = {f"_p{i}": share for i, share in enumerate(percentiles.values())}
    counted = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(column).alias("_value"))
    parts = tuple(f"_k{i}" for i in range(len(keys)))
    counted = counted.groupBy(*parts, "_value").agg(F.count("_value").alias("_n"))
    if spread == "auto":
        ranked = by_size(counted, Stream(parts, ("_value",)), _ranked)
    else:
        ranked = _ranked(counted, Stream(parts, ("_value",), spread))
    value, n = F.col("_value"), F.col("_n")
    hit = lambda share: (F.col("_through") >= rank_of(F.col("_all"), share)) & (F.col("_through") - n < rank_of(F.col("_all"), share))
    got = ranked.groupBy(*parts).agg(
        F.coalesce(F.max("_all"), F.lit(0)).alias("count"),
        F.try_divide(F.sum(value.cast("double") * n), F.max("_all")).alias("mean"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        *(F.max(F.when(hit(share), value)).alias(name) for name, share in marks.items()),
    )
    return got.select(*(F.col(p).alias(k) for p, k in zip(parts, keys, strict=True)), "count", "mean", "least", "most", *(F.col(m).alias(name) for m, name in zip(marks, percentiles, strict=True)))


def _ranked(counted: DataFrame, stream: Stream) -> DataFrame:
    """Value counts with the rows up to each value and those of the whole key."""
    through = running(counted, stream, _through=("sum", F.col("_n")))
    if not stream.spread:
        return through.withColumn("_all", F.sum("_n").over(Window.partitionBy(*stream.keys)))
    # The blocks are written, so the rows of a whole key are read off them: those up to its greatest value.
    if not stream.keys:
        return through.withColumn("_all", F.lit(through.agg(F.max("_through")).first()[0] or 0).cast("long"))
    whole = through.groupBy(*(F.col(k).alias(f"_of{k}") for k in stream.keys)).agg(F.max("_through").alias("_all"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in stream.keys))
    return through.join(whole, same).select(*through.columns, "_all")


def histogram(bucket: str) -> Column:
    """Aggregate: counts by bucket, from a column of bucket numbers, so each is found once a row; nulls are in none."""
    return F.array(*(F.count_if(F.col(bucket) == i) for i in range(BUCKETS)))


def moments(column: str) -> Column:
    """Aggregate: count, mean, sum of squared deviations from it, least and most."""
    v = F.col(column)
    return F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).cast("double").alias("least"), F.max(v).cast("double").alias("most"))


def states(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The keys, `histogram` and `moments`; for streams too, in complete or update mode or by foreachBatch."""
    return df.withColumn("_bucket", bucket_of(F.col(column))).groupBy(*keys).agg(histogram("_bucket").alias("histogram"), moments(column).alias("moments"))


def merged(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """States of the same keys as one. Deviations are merged about the common mean, so nothing cancels."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    n, mean = F.col("moments.n"), F.coalesce("moments.mean", F.lit(0.0))
    # Few rows: a state for each part and key.
    common = F.try_divide(F.sum(n * mean).over(own), F.sum(n).over(own))
    whole = rows.withColumn("_mean", common)
    m2 = F.sum(F.coalesce("moments.m2", F.lit(0.0)) + n * F.pow(mean - F.col("_mean"), 2))
    return whole.groupBy(*keys).agg(
        F.array(*(F.sum(F.get("histogram", F.lit(i))) for i in range(BUCKETS))).alias("histogram"),
        F.struct(F.sum(n).alias("n"), F.first("_mean").alias("mean"), m2.alias("m2"), F.min("moments.least").alias("least"), F.max("moments.most").alias("most")).alias("moments"),
    )


def bucket_percentile(counts: Column, share: float) -> Column:
    """What compatible histograms report: the value of the bucket in which the rank ceil(n * share) falls; 0 without counts."""
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    through = lambda i: F.aggregate(F.slice(counts, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    hit = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: through(i) >= rank_of(n, share)))
    return F.when(n > 0, bucket_value(hit)).otherwise(F.lit(0).cast("long"))


def told(rows: DataFrame) -> DataFrame:
    """States as latency and jitter: count, mean, least, most, variance, std_dev and the bucket percentiles."""
    m = F.col("moments")
    variance = F.when(m["n"] > 1, m["m2"] / (m["n"] - 1)).otherwise(F.lit(0.0))
    columns = {"count": m["n"], "mean": F.coalesce(m["mean"], F.lit(0.0)), "least": m["least"], "most": m["most"], "variance": variance, "std_dev": F.sqrt(variance)}
    return rows.withColumns(columns | {name: bucket_percentile(F.col("histogram"), share) for name, share in PERCENTILES.items()}).drop("histogram", "moments")


@dataclass
class Sums:
    """Observed states of one place of a pipeline, added up: rows, errors, histogram and moments."""

    rows: int = 0
    errors: int = 0
    histogram: list[int] = field(default_factory=lambda: [0] * BUCKETS)
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    least: float | None = None
    most: float | None = None

    def add(self, seen) -> None:  # noqa: ANN001
        """A row or mapping of `rows`, `errors`, `histogram` and `moments`."""
        self.rows += seen["rows"]
        self.errors += seen["errors"]
        self.histogram = [a + b for a, b in zip(self.histogram, seen["histogram"], strict=True)]
        m = seen["moments"]
        if m["n"]:
            n, apart = self.n + m["n"], m["mean"] - self.mean
            self.m2 += m["m2"] + apart * apart * self.n * m["n"] / n
            self.mean += apart * m["n"] / n
            self.n = n
            self.least = m["least"] if self.least is None else min(self.least, m["least"])
            self.most = m["most"] if self.most is None else max(self.most, m["most"])

    def percentile(self, share: float) -> int:
        rank, through = max(1, math.ceil(self.n * share - 1e-9)), 0
        for i, count in enumerate(self.histogram):
            through += count
            if self.n and through >= rank:
                return 1 << (i * 3 // 10)
        return 0

    def latency(self) -> tuple:
        whole = lambda x: None if x is None else int(x)
        return (self.n, self.mean, whole(self.least), whole(self.most), *(self.percentile(p) for p in PERCENTILES.values()))

    def jitter(self) -> tuple:
        variance = self.m2 / (self.n - 1) if self.n > 1 else 0.0
        least, most = self.latency()[2:4]
        return self.n, self.mean, variance, math.sqrt(variance), least, most, None if least is None else most - least
