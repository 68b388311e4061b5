"""Shared helpers: tables, bounded Arrow slices, keys of rows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.storage import for_workers, materialize, shared_path  # noqa: F401

#: Bytes of text that one step of a Python operator holds at a time.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch, one row at least.
BATCH_BYTES = 8 << 20
#: Longs of a sieve's bitmap at most.
WORDS = 1 << 20


def lean(spark: SparkSession) -> None:
    """Arrow batches of few bytes from here on: whatever the length of texts, a batch stands in memory several times."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Returns memory that is free in this Python worker to the system, for the executor's other processes."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch that hold about `limit` bytes of text, one row at least. Frees what they leave."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def clear_of(df: DataFrame, *names: str) -> None:
    """Raise if the input already has a column that an operator adds."""
    clash = sorted({c.lower() for c in df.columns} & {n.lower() for n in names})
    if clash:
        raise ValueError(f"input already has the columns {', '.join(clash)}")


def count_words(text: str = "text") -> F.Column:
    """Number of runs of characters other than space and \\t \\n \\v \\f \\r; null has none.

    Each run becomes one letter and the rest goes, so no list of words is built for a long text.
    """
    letters = F.regexp_replace(F.col(text), r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.char_length(F.regexp_replace(letters, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a 128-bit key (_k1, _k2) of the whole row: equal only for repeated rows, but for hash collisions.

    Spark's hashes pass over nulls and refuse maps, so the places of nulls are part of the key,
    and nested columns go in as JSON with their nulls and with map entries in order of keys.
    """
    clear_of(docs, "_k1", "_k2", "_c")
    parts = [F.to_json(F.struct(_in_order(F.col(f"`{f.name}`"), f.dataType)), {"ignoreNullFields": "false"}) if _nested(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    nulls = F.concat_ws("", *(F.when(F.col(f"`{f.name}`").isNull(), F.lit("0")).otherwise(F.lit("1")) for f in docs.schema.fields))
    return docs.withColumns({"_k1": F.xxhash64(F.lit(1), nulls, *parts), "_k2": F.xxhash64(F.lit(2), *reversed(parts), nulls)})


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.MapType, T.StructType, T.ArrayType, T.VariantType))


def _in_order(x: F.Column, kind: T.DataType) -> F.Column:
    """x with every map in it as an array of its entries, sorted by their JSON; null stays null."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(x), lambda e: F.to_json(F.struct(_in_order(e["key"], kind.keyType).alias("k"), _in_order(e["value"], kind.valueType).alias("v")), {"ignoreNullFields": "false"}))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType) and _nested(kind.elementType):
        return F.transform(x, lambda e: _in_order(e, kind.elementType))
    if isinstance(kind, T.StructType) and any(_nested(f.dataType) for f in kind.fields):
        return F.when(x.isNotNull(), F.struct(*(_in_order(x[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return x


def attach(whole: DataFrame, decided: DataFrame) -> DataFrame:
    """Keyed rows with what was decided on them; decided: (_k1, _k2, _c, ...), _c the number of rows of the key.

    Keys of one row stream past a hash table of decisions, unsorted. Of repeated rows one is
    kept, before they move, and stands for each of the key's decisions.
    """
    keys, names = ["_k1", "_k2"], [c for c in whole.columns if c not in ("_k1", "_k2")]
    more = [c for c in decided.columns if c not in ("_k1", "_k2", "_c")]
    once = whole.join(decided.filter("_c = 1").hint("shuffle_hash"), keys).select(*names, *more)
    several = decided.filter("_c > 1")
    rows = whole.join(several.select(*keys).distinct().hint("shuffle_hash"), keys, "left_semi")
    rows = rows.groupBy(*keys).agg(F.any_value(F.struct(*names)).alias("_row"))
    return once.unionByName(rows.join(several, keys).select("_row.*", *more))


def sieve(rows: DataFrame, wanted: DataFrame, key: str = "_k1") -> DataFrame:
    """rows with `_maybe`: false only where the row's key, a long hash, is no key of wanted.

    A bitmap of 16 bits for each wanted key, at most WORDS longs, so what is broadcast is bounded.
    A full one lets more rows through, which costs the join that follows and nothing else.
    """
    words = min(WORDS, 1 << max(6, (wanted.count() // 4).bit_length()))
    bit = f"cast(shiftrightunsigned(`{key}`, 40) & 63 as int)"
    place = F.pmod(F.col(key), F.lit(words)).alias("_word")
    table = wanted.select(place, F.expr(f"shiftleft(1L, {bit})").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.join(F.broadcast(table), F.pmod(F.col(key), F.lit(words)) == F.col("_word"), "left")
    return found.withColumn("_maybe", F.expr(f"(shiftrightunsigned(coalesce(_bits, 0L), {bit}) & 1) = 1")).drop("_word", "_bits")


def without(whole: DataFrame, odd: DataFrame) -> DataFrame:
    """Keyed rows without the ones decided against: odd has (_k1, _k2, _c, _keep) of all keys that go or repeat.

    Most keys are not odd, and a sieve keeps their rows where they are; only the others are dealt
    by key. Of repeated rows that stay, one does.
    """
    names = [c for c in whole.columns if c not in ("_k1", "_k2")]
    sorted_out = sieve(whole, odd)
    met = sorted_out.filter("_maybe").drop("_maybe").join(odd, ["_k1", "_k2"], "left")
    once = met.filter("_c is null").select(*names)
    several = met.filter("_keep and _c > 1").groupBy("_k1", "_k2").agg(F.any_value(F.struct(*names)).alias("_row")).select("_row.*")
    return sorted_out.filter("not _maybe").select(*names).unionByName(once).unionByName(several)
