"""Fusing two streams by time: nearest as-of joins and weighted averages."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.folds import Fold, folded
from gaugeworks.operators.ordered import Stream

#: Tolerances that a time cell spans: at most 2 / CELL_SPANS of the secondaries are copied, and an
#: unkeyed stream is as many tasks as it has cells.
CELL_SPANS = 16


def asof_nearest(
    primary: DataFrame,
    secondary: DataFrame,
    tolerance: int,
    keys: tuple[str, ...] = (),
    time: str = "timestamp_ns",
    seq: str = "seq",
    how: str = "inner",
    cell_spans: int | None = None,
) -> DataFrame:
    """Pairs each primary with the nearest secondary at most `tolerance` away, ties to the lower seq.

    Gives primary's columns and `secondary` (a struct of its columns) and `time_diff`. how:
    inner, left (both null where nothing is near) or left_anti (primaries without partner,
    their columns only). A null time is never near. Both inputs are tagged, cut into time
    cells (secondaries are copied to the cells they can reach) and sorted once forward and once
    backward, so the work is linear however dense the streams are and no key or lack of keys
    puts a whole stream into one task.
    """
    width = max(1, tolerance) * (cell_spans or CELL_SPANS)
    cell = lambda at: F.floor(at.cast("decimal(38,0)") / F.lit(width)).cast("long")
    left = primary.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(time).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(secondary.schema[seq].dataType).alias("_seq"), F.struct(*primary.columns).alias("_p"), F.lit(None).cast(secondary.schema).alias("_s"), cell(F.col(time)).alias("_cell"))
    reach = F.array_distinct(F.array(cell(F.col(time) - tolerance), cell(F.col(time) + tolerance)))
    near = secondary.filter(F.col(time).isNotNull())
    right = near.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.col(seq).alias("_seq"), F.lit(None).cast(primary.schema).alias("_p"), F.struct(*secondary.columns).alias("_s"), F.explode(reach).alias("_cell"))
    both = left.unionByName(right).withColumn("_hit", F.when(F.col("_kind") == 1, F.struct("_t", "_seq", "_s")))
    part = Window.partitionBy(*(f"_k{i}" for i in range(len(keys))), "_cell")
    # Of secondaries with one time, the lowest seq is nearest in either direction: forward it comes last, backward last too.
    ahead = part.orderBy(F.asc("_t"), F.desc("_kind"), F.desc_nulls_first("_seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = part.orderBy(F.desc("_t"), F.desc("_kind"), F.desc_nulls_first("_seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_before", F.last("_hit", True).over(ahead)).withColumn("_after", F.last("_hit", True).over(behind)).filter("_kind = 0")
    gap = lambda c: F.when(F.abs(F.col(f"{c}._t") - F.col("_t")) <= tolerance, F.abs(F.col(f"{c}._t") - F.col("_t")))
    best = lambda c: F.when(gap(c).isNotNull(), F.struct(gap(c).alias("d"), F.col(f"{c}._seq").alias("q"), F.col(f"{c}._s").alias("s")))
    pair = F.when(best("_after").isNull(), best("_before")).when(best("_before").isNull(), best("_after"))
    closer = (gap("_after") < gap("_before")) | ((gap("_after") == gap("_before")) & (F.col("_after._seq") < F.col("_before._seq")))
    pair = F.coalesce(pair, F.when(closer, best("_after")).otherwise(best("_before")))
    out = found.withColumn("_pair", pair)
    if how == "left_anti":
        return out.filter("_pair is null").select("_p.*")
    out = out.filter("_pair is not null") if how == "inner" else out
    return out.select("_p.*", F.col("_pair.s").alias("secondary"), F.col("_pair.d").alias("time_diff"))


@dataclass(frozen=True)
class ArrivalSync(Fold):
    """Nearest pairing in arrival order over a tagged union (kind 'p' or 's', time, seq).

    Only the last `capacity` secondaries that came before a primary are seen; a match prunes
    those older than its time less the tolerance, a miss prunes nothing. Ties go to the one
    that came first. Outputs are null for secondaries and for primaries without a partner.
    """

    tolerance: int = 0
    capacity: int = 64
    state_type: ClassVar[str] = "held array<struct<t:bigint,s:bigint>>"

    def pack(self, state):  # noqa: ANN001, ANN201
        return (list(state),)

    def unpack(self, stored):  # noqa: ANN001, ANN201
        return deque((tuple(x) for x in stored[0] or []), maxlen=self.capacity)

    def start(self):  # noqa: ANN201
        return deque(maxlen=self.capacity)

    def run(self, state, kinds, times, seqs):  # noqa: ANN001, ANN201
        found: tuple[list, list, list] = ([], [], [])
        for kind, t, s in zip(kinds, times, seqs, strict=True):
            hit = None
            if kind == "s":
                if t is not None:
                    state.append((t, s))
            elif t is not None:
                hit = min((x for x in state if abs(x[0] - t) <= self.tolerance), key=lambda x: abs(x[0] - t), default=None)
                if hit is not None:
                    state = deque((x for x in state if x[0] >= t - self.tolerance), maxlen=self.capacity)
            for have, new in zip(found, (hit[0], hit[1], abs(hit[0] - t)) if hit else (None, None, None), strict=True):
                have.append(new)
        return state, found


def asof_arrival(events: DataFrame, stream: Stream, tolerance: int, capacity: int = 64, kind: str = "kind", time: str = "timestamp_ns", seq: str = "seq") -> DataFrame:
    """Primaries of a tagged union with secondary_time, secondary_seq and time_diff, paired in arrival order."""
    fold = ArrivalSync((kind, time, seq), {"secondary_time": "long", "secondary_seq": "long", "time_diff": "long"}, tolerance, capacity)
    return folded(events, stream, fold).filter(F.col(kind) == "p")


def pair(primary: Column, secondary: Column, primary_time: Column, secondary_time: Column) -> Column:
    """A synchronised pair; its reference time is the primary's."""
    return F.struct(primary.alias("primary"), secondary.alias("secondary"), F.abs(primary_time - secondary_time).alias("time_diff_ns"), primary_time.alias("timestamp_ns"))


def weighted_average(a: Column, b: Column, weight_a: float = 1.0, weight_b: float = 1.0) -> Column:
    """Average with weights scaled to sum 1; null if they sum to 0."""
    total = weight_a + weight_b
    return F.lit(None).cast("double") if total == 0 else a * F.lit(weight_a / total) + b * F.lit(weight_b / total)
