"""Ordered streams: windows over rows, gaps and running values.

A stream has keys (may be none) and an order, the arrival order unless said otherwise. The
plain form is one window partitioned by the keys. Where one key holds too many rows, or
there is no key, `spread` cuts the streams into range-partitioned blocks: running values of
a block start from the totals of the blocks before, of which there are few rows; bounded
frames see copies of the rows just before their cell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaugeworks.storage import materialize

#: Rows of a cell of a spread stream.
CELL = 1 << 16
#: Rows of a block of a spread stream, about.
BLOCK_ROWS = 1 << 16
#: Rows from which a key is hot, and hot keys that are broadcast at most.
HOT_ROWS, HOT_KEYS = 1 << 22, 1 << 16
AUTO = "auto"
#: Rows of a frame from which a median slides.
LONG_FRAME = 64


@dataclass(frozen=True)
class Stream:
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ("seq",)
    #: True, False, or AUTO: keys of HOT_ROWS rows and more are spread, the others not.
    spread: bool | str = False

    def window(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *more).orderBy(*self.order)

    @property
    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _clear_of(df: DataFrame, *names: str) -> None:
    """Raise if the input already has a column that an operator adds."""
    if clash := sorted({c.lower() for c in df.columns} & {n.lower() for n in names}):
        raise ValueError(f"input already has the columns {', '.join(clash)}")


def by_size(df: DataFrame, stream: Stream, operator: Callable[[DataFrame, Stream], DataFrame], hot_rows: int | None = None) -> DataFrame:
    """The operator over hot keys as spread streams and over the others as plain ones, in one result.

    Keys are counted first, in an action. An unkeyed stream is one key, and null is a key.
    """
    if not stream.keys:
        return operator(df, replace(stream, spread=df.count() >= (hot_rows or HOT_ROWS)))
    names = [f"_hot_{i}" for i in range(len(stream.keys))]
    hot = materialize(df.groupBy(*(F.col(k).alias(n) for k, n in zip(stream.keys, names, strict=True))).count().filter(F.col("count") >= (hot_rows or HOT_ROWS)).drop("count"), "hot-keys")
    found = hot.count()
    if not found:
        return operator(df, replace(stream, spread=False))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(stream.keys, names, strict=True)))
    few = F.broadcast(hot) if found <= HOT_KEYS else hot
    large = operator(df.join(few, same, "left_semi"), replace(stream, spread=True))
    return large.unionByName(operator(df.join(few, same, "left_anti"), replace(stream, spread=False)))


def running(df: DataFrame, stream: Stream, **values: tuple[str, Column]) -> DataFrame:
    """Adds running values: name=(kind, column), kind one of count, sum, max, min. Sums of integers are exact."""
    if stream.spread == AUTO:
        return by_size(df, stream, lambda rows, s: running(rows, s, **values))
    _clear_of(df, *values, *(["_block", "_at", *(f"_{name}" for name in values)] if stream.spread else []))
    kinds = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}
    if not stream.spread:
        return df.withColumns({name: kinds[kind](col).over(stream.running) for name, (kind, col) in values.items()})
    joint = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}
    cut = blocks(df, stream)
    inner = stream.window("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cut.groupBy(*stream.keys, "_block").agg(*(kinds[kind](col).alias(f"_{name}") for name, (kind, col) in values.items()))
    before = Window.partitionBy(*stream.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"_key_{k}") for k in stream.keys), F.col("_block").alias("_at"), *(joint[kind](f"_{name}").over(before).alias(f"_{name}") for name, (kind, _) in values.items()))
    same = F.col("_block") == F.col("_at")
    for k in stream.keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = cut.withColumns({name: kinds[kind](col).over(inner) for name, (kind, col) in values.items()}).join(totals, same)

    def whole(name: str, kind: str) -> Column:
        here, ahead = F.col(name), F.col(f"_{name}")
        if kind in ("count", "sum"):
            return F.when(ahead.isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + ahead)
        return (F.greatest if kind == "max" else F.least)(here, ahead)

    return out.withColumns({name: whole(name, kind) for name, (kind, _) in values.items()}).select(*df.columns, *values)


def blocks(df: DataFrame, stream: Stream) -> DataFrame:
    """df range-partitioned by keys and order, with the partition's number as `_block`; written, so that it stays so.

    Rows are counted first: blocks grow in number with the stream, whatever its bytes, and tasks with them. Spark
    chooses for what one block would hold.
    """
    many = -(-df.count() // BLOCK_ROWS)
    dealt = df.repartitionByRange(*([many] if many > 1 else []), *stream.keys, *stream.order)
    return materialize(dealt.withColumn("_block", F.spark_partition_id()), "blocks")


def numbered(df: DataFrame, stream: Stream, name: str = "n") -> DataFrame:
    """Adds the number of each row in its stream, from 0."""
    return running(df, stream, **{name: ("count", F.lit(1))}).withColumn(name, F.col(name) - 1)


def framed(df: DataFrame, stream: Stream, size: int, **values: Column | None) -> DataFrame:
    """Adds values that are aggregates over the last `size` rows, this one included."""
    if stream.spread == AUTO:
        return by_size(df, stream, lambda rows, s: framed(rows, s, size, **values))
    _clear_of(df, *values, *(["_n", "_cell", "_own"] if stream.spread else []))
    frame = lambda w: w.rowsBetween(-(size - 1), Window.currentRow)
    if not stream.spread:
        return df.withColumns({name: v.over(frame(stream.window())) for name, v in values.items()})
    rows = _celled(df, stream, size)
    over = frame(Window.partitionBy(*stream.keys, "_cell").orderBy("_n"))
    return rows.withColumns({name: v.over(over) for name, v in values.items()}).filter("_own").select(*df.columns, *values)


def _celled(df: DataFrame, stream: Stream, size: int) -> DataFrame:
    """Numbered rows by cell; a row is copied to every later cell that a frame reaches back from, to be seen there and then left out."""
    rows = numbered(df, stream, "_n")
    cell = F.floor(F.col("_n") / F.lit(CELL))
    reached = F.sequence(cell, F.floor((F.col("_n") + F.lit(size - 1)) / F.lit(CELL)))
    return rows.withColumn("_cell", F.explode(reached)).withColumn("_own", F.col("_cell") == cell)


def moving_average(df: DataFrame, stream: Stream, column: str, size: int, out: str = "average") -> DataFrame:
    """Mean of the last min(n, size) values."""
    return framed(df, stream, size, **{out: F.avg(column)})


def median_filter(df: DataFrame, stream: Stream, column: str, size: int, out: str = "median") -> DataFrame:
    """Upper median of the last min(n, size) values; NaN counts as the largest, null rows as no value.

    Short frames are lists that are sorted for each row; long ones slide through sorted buckets.
    """
    if size > LONG_FRAME:
        return _slid(df, stream, column, size, out)
    lists = framed(df, stream, size, _values=F.collect_list(column))
    middle = F.get(F.sort_array("_values"), F.floor(F.size("_values") / F.lit(2)).cast("int"))
    return lists.withColumn(out, middle).drop("_values")


def _slid(df: DataFrame, stream: Stream, column: str, size: int, out: str) -> DataFrame:
    from gaugeworks.operators.folds import folded
    from gaugeworks.operators.sliding import SlidingMedian

    if stream.spread == AUTO:
        return by_size(df, stream, lambda rows, s: _slid(rows, s, column, size, out))
    kind = df.schema[column].dataType
    numbers = df.withColumn("_number", F.col(column).cast("double"))
    fold = SlidingMedian(("_number",), {out: "double"}, size)
    if stream.spread:
        cells = Stream((*stream.keys, "_cell"), ("_n",))
        got = folded(_celled(numbers, stream, size), cells, fold).filter("_own")
    else:
        got = folded(numbers, stream, fold)
    return got.withColumn(out, F.col(out).cast(kind)).select(*df.columns, out)


def with_previous(df: DataFrame, stream: Stream, column: str, out: str) -> DataFrame:
    """Adds the value of the row before; null for the first."""
    if stream.spread == AUTO:
        return by_size(df, stream, lambda rows, s: with_previous(rows, s, column, out))
    if not stream.spread:
        return df.withColumn(out, F.lag(column).over(stream.window()))
    two = framed(df, stream, 2, _rows=F.count(F.lit(1)), _first=F.first(column))
    return two.withColumn(out, F.when(F.col("_rows") == 2, F.col("_first"))).drop("_rows", "_first")


def sequence_gaps(df: DataFrame, stream: Stream, seq: str = "seq", out: str = "dropped") -> DataFrame:
    """Missing sequence numbers just before each row; 0 for the first."""
    gap = F.greatest(F.col(seq) - (F.col("_previous") + 1), F.lit(0))
    return with_previous(df, stream, seq, "_previous").withColumn(out, F.coalesce(gap, F.lit(0))).drop("_previous")


def stamped(df: DataFrame, stream: Stream, raw: str, out: str = "timestamp_ns", seq: str = "seq") -> DataFrame:
    """A clock that never goes back and numbers its readings from 0."""
    got = running(df, stream, **{"_top": ("max", F.col(raw)), "_count": ("count", F.lit(1))})
    return got.withColumn(out, F.col("_top")).withColumn(seq, F.col("_count") - 1).drop("_top", "_count")


def running_status(df: DataFrame, stream: Stream, column: str = "value", scale: int = 100) -> DataFrame:
    """Adds count, mean and status of the stream so far.

    The sum runs over whole units of 1/scale, so it is exact whatever the partitioning.
    HIGH is above 1.5 times the mean, LOW below half of it.
    """
    units = F.round(F.col(column) * scale).cast("long")
    _clear_of(df, "mean", "status")
    got = running(df, stream, count=("count", F.lit(1)), _sum=("sum", units))
    mean = F.col("_sum") / F.lit(float(scale)) / F.col("count")
    status = F.when(F.col(column) > 1.5 * F.col("mean"), "HIGH").when(F.col(column) < 0.5 * F.col("mean"), "LOW").otherwise("NORMAL")
    return got.withColumn("mean", mean).withColumn("status", status).drop("_sum")
