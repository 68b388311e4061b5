"""Mixing sources to target weights by capped water-filling.

Sources, ordered by code point with null last, get the weights 3, 1, 2 in turn. They share
`share` times all words; a source's target stops at `max_epochs` times its own words, and
the excess goes to the others by weight, again and again until no target is above its cap.

A source then takes floor(target / size) whole repetitions of every document and, for the
rest, a seeded fractional repetition: its documents in the order of a seeded hash, up to the
one whose middle passes what is left. Prefix sums run over (source, hash block), so a source
that holds a third of all rows is dealt over as many tasks as it has blocks.

Null or empty texts have size 0 and take nothing. Repeated rows are separate documents. A
source without words has target 0. An empty table gives an empty mix. Sums are exact below 2^53 words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm._common import attach, clear_of, count_words, keyed, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-17:"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of (source, size): source, source_size, target.

    Sources are ranked by a distributed sort. Each round fixes the sources whose fair part
    reaches their cap; only sums come to the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = materialize(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("offset")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ordered.join(parts, "part").withColumn("rank", rank).withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs).select("source", "source_size", "w", "cap"), "mix-ranked")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    # Without fixed sources at first; a source once fixed stays fixed, as the level only rises.
    level, fixed_count = 0.0, -1
    while True:
        fixed = F.lit(False) if fixed_count < 0 else F.col("w") * F.lit(level) >= F.col("cap")
        row = ranked.agg(F.coalesce(F.sum(F.when(fixed, F.col("cap"))), F.lit(0)).alias("c"), F.coalesce(F.sum(F.when(~fixed, F.col("w"))), F.lit(0)).alias("w"), F.count(F.when(fixed, 1)).alias("n")).first()
        if not row["w"] or row["n"] == fixed_count:
            break
        level, fixed_count = (total - row["c"]) / row["w"], row["n"]
    fill = F.least(F.col("cap").cast("double"), F.col("w") * F.lit(level)) if row["w"] else F.col("cap").cast("double")
    return ranked.select("source", "source_size", fill.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the keys, source, size, source_size, target, repeats, taken."""
    # Rows without an id are drawn by their text, so they don't meet in one block.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.xxhash64("text").cast("string")))
    sized = materialize(docs.select("doc_id", *keys, "source", count_words().alias("size"), F.md5(F.concat(F.lit(SEED), name)).alias("_key")), "mix-sizes")
    keyed_rows = sized.withColumn("_block", F.substring("_key", 1, 3))
    blocks = keyed_rows.groupBy("source", "_block").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_words").over(ahead), F.lit(0)))
    goal = targets(sized.select("source", "size"), weights, share, max_epochs)
    blocks = blocks.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "_before", "source_size", "target")
    inside = Window.partitionBy("source", "_block").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = keyed_rows.withColumn("_ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ordered.join(blocks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    extra = (2 * (F.col("_before") + F.col("_ahead")) + F.col("size") <= 2 * rest).cast("long")
    repeats = F.when(F.col("size") > 0, F.least(F.col("_whole") + extra, F.lit(max_epochs).cast("long"))).otherwise(F.lit(0).cast("long"))
    return (
        joined.withColumn("_whole", whole)
        .withColumn("repeats", repeats)
        .select("doc_id", *keys, "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))
    )


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, repeats and taken. Texts move once."""
    clear_of(docs, "size", "source_size", "target", "repeats", "taken")
    whole, keys = keyed(docs), ("_k1", "_k2")
    chosen = materialize(mix(whole, weights, share, max_epochs, keys).select(*keys, "size", "source_size", "target", "repeats", "taken"), "mix-chosen")
    counts = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return attach(whole, chosen.filter("repeats > 0").join(counts, [*keys]))
