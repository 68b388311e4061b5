"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint has a bit set if it is set in over half of the XXH64 hashes (seed 42) of the
text's word shingles. Two fingerprints link at `bits` or fewer differing bits.

Pigeonring: the 64 bits form a ring of m = 2 * bits + 1 segments. If two fingerprints differ
in at most `bits` bits, some ring position starts chains of every length l whose differences
stay within floor(l * bits / m). Chains of length 2 then have none, so equal pairs of
neighbouring segments are the join key; the longer chains prune before the full check.

Keys with over `hot` distinct fingerprints are made longer before anything is paired: the longest
chain whose budget is one bit (4 segments for bits = 2) is the join key, each fingerprint under
every form of it with one further bit blanked out. Chains that differ in at most one bit share
such a form, and few bits are left free within it, so a group's size doesn't grow with the data.

Only distinct fingerprints are compared. Nulls and texts without words have fingerprint 0 and
link like any other; repeated rows share a class; null doc_ids never name one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._common import as_bytes, attach, clear_of, keyed, materialize, text_slices
from gaugeworks.llm.components import components

SHINGLE = 3
BITS = 2
HOT = 32


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - k + 1].tolist()
    h64 = xxhash.xxh64_intdigest
    h = np.array([h64(joined[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        set_in += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep_text: bool = False) -> DataFrame:
    """docs with `fp`, the fingerprint as a signed long; without `text` unless keep_text."""
    clear_of(docs, "fp")
    names = [c for c in docs.columns if keep_text or c != "text"]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                fp = np.array([fingerprint(t, shingle) for t in as_bytes(part)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(fp.view(np.int64))], [*names, "fp"])

    return docs.mapInArrow(run, schema)


def segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the 2 * bits + 1 segments of the ring."""
    m = 2 * bits + 1
    cuts = [round(64 * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(shift: int, width: int) -> int:
    x = ((1 << width) - 1) << shift
    return x - (1 << 64) if x >= 1 << 63 else x


def _within_chains(diff: Column, start: int, bits: int) -> Column:
    """The chains of length 3 and more from a ring position stay within their budgets."""
    ring, m, ok = segments(bits), 2 * bits + 1, F.lit(True)
    for length in range(3, m + 1):
        mask = 0
        for j in range(length):
            mask |= _mask(*ring[(start + j) % m])
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(signed))) <= length * bits // m)
    return ok


def links(fps: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) that connect exactly what differs in at most `bits` bits; fps: distinct longs `fp`."""
    ring = segments(bits)
    m = len(ring)
    keys = [F.col("fp").bitwiseAND(F.lit(_mask(*ring[i]) | _mask(*ring[(i + 1) % m]))) for i in range(m)]
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), k.alias("key")) for i, k in enumerate(keys)))).alias("c")).select("fp", "c.i", "c.key")
    shared = materialize(keyed.groupBy("i", "key").count().filter("count > 1"), "simhash-keys")
    member = materialize(keyed.join(shared, ["i", "key"]), "simhash-members")
    small = member.filter(F.col("count") <= hot).select("fp", "i", "key", F.lit(-1).alias("blank"))
    few = small.union(_longer(member.filter(F.col("count") > hot), bits))
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    chain = F.lit(False)
    for i in range(m):
        chain = chain | ((F.col("x.i") == i) & _within_chains(diff, i, bits))
    pairs = (
        few.alias("x")
        .join(few.alias("y"), (F.col("x.i") == F.col("y.i")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.blank") == F.col("y.blank")) & (F.col("x.fp") < F.col("y.fp")) & chain & (F.bit_count(diff) <= bits))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    return pairs.distinct()


def _longer(member: DataFrame, bits: int) -> DataFrame:
    """Rows (fp, i, key) under longer keys: the longest chain from i that may have one bit, without the bit `blank`."""
    ring = segments(bits)
    m = len(ring)
    length = max(n for n in range(2, m + 1) if n * bits // m <= 1)
    out = F.array().cast("array<struct<key:bigint,blank:int>>")
    for i in range(m):
        chain = [ring[(i + j) % m] for j in range(length)]
        mask = sum(((1 << w) - 1) << a for a, w in chain)
        free = [bit for a, w in chain[2:] for bit in range(a, a + w)]
        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        forms = F.array(*(F.struct(F.col("fp").bitwiseAND(F.lit(signed(mask & ~(1 << bit)))).alias("key"), F.lit(bit).alias("blank")) for bit in free))
        out = F.when(F.col("i") == i, forms).otherwise(out)
    return member.select("fp", "i", F.explode(out).alias("c")).select("fp", "i", "c.key", "c.blank")


def _rooted(groups: DataFrame, bits: int) -> DataFrame:
    """groups, one row per fingerprint, with `root`: the smallest fingerprint of its class."""
    found = components(links(groups.select("fp"), bits)).withColumnRenamed("node", "fp")
    return groups.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def classes(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """docs without `text`, with fp (long) and component_id, the smallest doc_id reachable by links."""
    clear_of(docs, "component_id")
    marked = materialize(fingerprints(docs, shingle), "simhash-fp")
    groups = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups")
    rooted = materialize(_rooted(groups, bits), "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = rooted.join(ids, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(label, F.col("fp") == F.col("_fp")).drop("_fp")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One document of each class, unchanged: the one with the smallest doc_id (null last), one row of repeated ones.

    Texts are fingerprinted where they are read, and move once, to meet the keys that stay.
    """
    whole = keyed(docs)
    marked = materialize(fingerprints(whole.select("doc_id", "_k1", "_k2", "text"), shingle), "simhash-fp")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")
    groups = materialize(marked.groupBy("fp").agg(F.min(first).alias("first")), "simhash-groups")
    kept = _rooted(groups, bits).groupBy("root").agg(F.min("first").alias("first")).select("first._k1", "first._k2")
    counts = marked.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_c"))
    return attach(whole, counts.join(kept, ["_k1", "_k2"], "left_semi")).select(*docs.columns)


def hex_digits(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
