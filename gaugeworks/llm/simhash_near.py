"""SimHash near-duplicates at a text similarity, with pigeonring filtering.

Texts link if the sets of their five-word shingles (ASCII case and white space folded, shorter
texts whole) have a Jaccard similarity of NEAR = 4 / 5 or more. Each distinct set has a SimHash
fingerprint of 128 bits, a ring of 8 segments. Sets this near differ in 19 to 24 bits on
average (standard deviation 4); BUDGET = 48 bits leave 5 deviations and more.

1. Candidates. A budget this wide leaves ring segments no equal neighbours to join on, so
   candidates share a rare shingle: under any one order of all shingles the first
   n - ceil(4 n / 5) + 1 shingles of two near sets meet. Shingles common in a sample of texts
   come last, then by hash; the sample moves boilerplate out of these prefixes, any order finds
   the same links.
2. Pigeonring. Some ring position must start chains of 1, 2 and 3 consecutive segments whose
   differences stay within 6 bits a segment; then the full Hamming distance within the budget.
3. The whole sets of what is left decide.

Large groups make no pairs: first each text of a shingle meets the smallest one, and of those
candidates each text is checked against the closest. Shingles whose texts are then of one class
are done. In the others, texts that follow each other when their fingerprints are sorted, from
each of four places of the ring, are checked too, which joins most of what is left of a large
class in linear work. After that the texts outside the largest class are compared in blocks, with each
other and with that class. What leaves a block has passed the ring and a bound that is exact:
each shingle flips one of PARITIES bits, so sets differ in as many shingles as bits at least,
and near ones in few. Shingles that stand in the same texts are compared once, and a pair that
several shingles bring together leaves the block of the smallest one they know of. Texts of four fifths boilerplate that are still no copies of each other
are the worst case: their comparisons in blocks, not what leaves them, grow with their square.

Only distinct sets are compared (64-bit hashes of shingles and sets). Nulls and texts without
words have the empty set and are of one class; repeated rows are one; null doc_ids never name
a class. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._common import as_bytes, clear_of, keyed, materialize, sieve, text_slices, without
from gaugeworks.llm.components import components

SHINGLE = 5
#: Least similarity, as a fraction.
NEAR = (4, 5)
#: Segments of 16 bits of the ring, differing bits that a pair may have, longest chain before the full check.
SEGMENTS, BUDGET, CHAIN = 8, 48, 3
#: Bits of a set's parities.
PARITIES = 512
#: About so many texts are sampled for common shingles, which occur in so many of them at least.
SAMPLE, COMMON = 10_000, 8
#: Most common shingles that are put last.
LAST = 1 << 16
#: Texts of a shingle that are sorted by their fingerprints, at least.
FEW = 8
#: Smallest shingles of a text's rows that its blocks know.
FIRSTS = 16
#: Fingerprints of a side of a block, and texts that meet one copy of a text.
BLOCK, COPIES = 1024, 256
_NONE = np.empty(0, dtype=np.uint64)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_FP = [T.StructField("n", T.LongType()), T.StructField("f0", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("parity", T.BinaryType())]


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of one UTF-8 text as sorted hashes."""
    words = text.lower().split()
    if not words:
        return _NONE
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(shingle, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * _P1 + h[i : i + len(out)]
        out ^= out >> np.uint64(29)
    out *= _P2
    return np.unique(out ^ (out >> np.uint64(32)))


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: set where they are set in over half of its hashes, or of those mixed once more."""
    more = (found ^ (found >> np.uint64(31))) * _P1
    out = []
    for h in (found, more ^ (more >> np.uint64(32))):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 1 << 15):
            part = h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]))
    return out[0], out[1]


def parity(found: np.ndarray) -> bytes:
    """Bit i is set if an odd number of the set's hashes falls on it."""
    falls = np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits((falls & 1).astype(np.uint8)).tobytes()


def prefix(found: np.ndarray, last: np.ndarray = _NONE) -> np.ndarray:
    """The part of a set that it shares with every set near enough; `last`, sorted, ends the order."""
    n = len(found)
    size = n - -(-NEAR[0] * n // NEAR[1]) + 1 if n else 0
    if not len(last):
        return found[:size]
    late = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
    return np.concatenate([found[~late], found[late]])[:size]


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes are near duplicates."""
    p, q = NEAR
    both = len(np.intersect1d(a, b, assume_unique=True))
    return q * both >= p * (len(a) + len(b) - both)


def within_ring(diff: np.ndarray) -> np.ndarray:
    """For rows of two differing words: whether chains up to CHAIN and the whole ring stay within their budgets."""
    each = np.bitwise_count(np.ascontiguousarray(diff).view(np.uint16).reshape(-1, SEGMENTS)).astype(np.int64)
    ring, ok = np.concatenate([each, each[:, : CHAIN - 1]], axis=1).cumsum(axis=1), np.ones((len(each), SEGMENTS), dtype=bool)
    ring = np.concatenate([np.zeros((len(each), 1), np.int64), ring], axis=1)
    for length in range(1, CHAIN + 1):
        ok &= (ring[:, length : length + SEGMENTS] - ring[:, :SEGMENTS]) * SEGMENTS <= length * BUDGET
    return ok.any(axis=1) & (each.sum(axis=1) <= BUDGET)


def _pruned(pairs: DataFrame) -> DataFrame:
    """Pairs with n, f0, f1 of both (x_ and y_) whose sizes, chains and fingerprints may be near, with their distance."""
    p, q = NEAR
    diffs = [F.col("x_f0").bitwiseXOR(F.col("y_f0")), F.col("x_f1").bitwiseXOR(F.col("y_f1"))]
    each = [F.bit_count(F.shiftrightunsigned(d, 16 * i).bitwiseAND(F.lit(0xFFFF))) for d in diffs for i in range(4)]
    sized = pairs.filter(F.least("x_n", "y_n") * q >= F.greatest("x_n", "y_n") * p).withColumn("_d", F.array(*each))
    at: list[Column] = [F.col("_d")[i] for i in range(SEGMENTS)]
    starts = [reduce(Column.__and__, [sum(at[(s + j) % SEGMENTS] for j in range(length)) * SEGMENTS <= length * BUDGET for length in range(1, CHAIN + 1)]) for s in range(SEGMENTS)]
    return sized.filter(reduce(Column.__or__, starts)).withColumn("dist", sum(at)).filter(F.col("dist") <= BUDGET).drop("_d")


def _sig(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _common(whole: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of at least COMMON sampled texts, sorted."""
    every = max(1, whole.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                for text in as_bytes(part):
                    yield pa.RecordBatch.from_arrays([pa.array(shingles(text, shingle).view(np.int64))], ["h"])

    seen = whole.filter(F.pmod("_k1", F.lit(every)) == 0).select("text").mapInArrow(run, "h long")
    rows = seen.groupBy("h").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(LAST).select("h").collect()
    return np.sort(np.array([r.h for r in rows], dtype=np.int64).view(np.uint64))


def _marked(whole: DataFrame, last: np.ndarray, shingle: int) -> DataFrame:
    """Keyed rows without text, with sig, size, fingerprint and prefix; of equal sets that a task meets, one has the prefix."""
    names = ["doc_id", "_k1", "_k2"]
    added = [T.StructField("sig", T.LongType()), *_FP, T.StructField("prefix", T.ArrayType(T.LongType()))]
    schema = T.StructType([whole.schema[c] for c in names] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int, bytes]] = {}
        for batch in batches:
            for part in text_slices(batch):
                sigs, sizes, heads, fps = [], [], [], []
                for text in as_bytes(part):
                    found = shingles(text, shingle)
                    sigs.append(sig := _sig(found))
                    sizes.append(len(found))
                    heads.append(_NONE if sig in seen else prefix(found, last))
                    if sig not in seen:
                        seen[sig] = (*fingerprint(found), parity(found))
                    fps.append(seen[sig])
                if len(seen) > 1 << 17:
                    seen.clear()
                ends = np.cumsum([0] + [len(x) for x in heads]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*heads, _NONE]).view(np.int64)))
                cols = [*(part.column(c) for c in names), _longs(sigs), pa.array(sizes, pa.int64()), *(_longs([f[i] for f in fps]) for i in (0, 1)), pa.array([f[2] for f in fps], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return whole.select(*names, "text").mapInArrow(run, schema)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, a, sig) of rows (h, sig) in order: a is the first sig of h, sig each other one."""
    held_h = held_a = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, sig = (batch.column(i).to_numpy() for i in range(2))
        fresh = np.concatenate([[held_h is None or h[0] != held_h], h[1:] != h[:-1]])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), -1))
        a = np.where(first >= 0, sig[np.maximum(first, 0)], 0 if held_a is None else held_a)
        more = np.concatenate([[True], (sig[1:] != sig[:-1]) | fresh[1:]]) & (sig != a)
        held_h, held_a = h[-1], a[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in (h, a, sig)], ["h", "a", "sig"])


def _following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (h, sig) in order: neighbours within an h."""
    held = np.empty((0, 2), dtype=np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1)])
        held = rows[-1:]
        same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] != rows[:-1, 1])
        a, b = rows[:-1, 1][same], rows[1:, 1][same]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _one_each(rows: DataFrame) -> DataFrame:
    """rows (h, sig) with one shingle, the smallest, of those that stand in the same texts: the others give the same pairs."""
    texts = rows.groupBy("h").agg(F.bit_xor(F.xxhash64("sig")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("_y"), F.count(F.lit(1)).alias("_n"))
    return rows.join(texts.groupBy("_x", "_y", "_n").agg(F.min("h").alias("h")).select("h"), "h")


def _firsts(rows: DataFrame) -> DataFrame:
    """(sig, firsts) of rows (h, sig): the FIRSTS smallest h of each sig."""
    return rows.groupBy("sig").agg(F.slice(F.array_sort(F.collect_list("h")), 1, FIRSTS).alias("firsts"))


def _padded(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of FIRSTS longs; shorter lists end in the greatest long."""
    parts = [np.empty((0, FIRSTS), dtype=np.int64)]
    for chunk in lists.chunks:
        part = np.full((len(chunk), FIRSTS), np.iinfo(np.int64).max)
        part[np.arange(FIRSTS) < chunk.value_lengths().to_numpy()[:, None]] = chunk.flatten().to_numpy()
        parts.append(part)
    return np.concatenate(parts)


def _neighbours(rows: DataFrame, groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) across classes whose fingerprints are next to each other under some shingle; rows: (h, sig, root)."""
    sizes = rows.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("_n")).filter(F.col("lo") < F.col("hi")).filter(F.col("_n") >= FEW)
    held = materialize(rows.join(sizes.select("h"), "h").join(groups.select("sig", "f0", "f1"), "sig").select("h", "sig", "f0", "f1"), "near-sorted")
    keys = [F.col("f0"), F.expr("shiftleft(f0, 32) | shiftrightunsigned(f0, 32)"), F.col("f1"), F.expr("shiftleft(f1, 32) | shiftrightunsigned(f1, 32)")]
    orders = [held.select("h", "sig", k.alias("_key")).repartitionByRange("h", "_key", "sig").sortWithinPartitions("h", "_key", "sig") for k in keys]
    pairs = reduce(DataFrame.union, [o.select("h", "sig").mapInArrow(_following, "a long, b long") for o in orders]).distinct()
    pairs = _with_roots(pairs, roots).select("a", "b")
    return materialize(_pruned(pairs.join(_side(groups, "a", "x"), "a").join(_side(groups, "b", "y"), "b")).select("a", "b"), "near-neighbours")


def _side(groups: DataFrame, name: str, of: str) -> DataFrame:
    return groups.select(F.col("sig").alias(name), *(F.col(c).alias(f"{of}_{c}") for c in ("n", "f0", "f1")))


def _twos(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, dist) of the shingles of two texts; rows: (h, sig). One of them may be closest to a third."""
    two = rows.groupBy("h").agg(F.min("sig").alias("a"), F.max("sig").alias("b"), F.count(F.lit(1)).alias("_n")).filter("_n = 2").select("a", "b").distinct()
    return _pruned(two.join(_side(groups, "a", "x"), "a").join(_side(groups, "b", "y"), "b")).select("a", "b", "dist")


def _across(left: pa.Table, right: pa.Table) -> pa.Table:
    """The pairs (a, b, dist) of a block (h, sig, root, n, f0, f1, parity, firsts) across classes that the ring and the parities let through.

    A pair that has a smaller shingle in both its firsts is left to that shingle's block, which it is in as well.
    """
    p, q = NEAR
    out = [np.empty((0, 3), dtype=np.int64)]
    if left.num_rows and right.num_rows:
        (s, r, n), (t, u, m) = ([x.column(c).to_numpy() for c in ("sig", "root", "n")] for x in (left, right))
        f, g = (np.stack([x.column(c).to_numpy() for c in ("f0", "f1")], axis=1) for x in (left, right))
        odd, even = (np.frombuffer(b"".join(x.column("parity").to_pylist()), np.uint64).reshape(-1, PARITIES // 64) for x in (left, right))
        before, after, h = _padded(left.column("firsts")), _padded(right.column("firsts")), left.column("h")[0].as_py()
        for i in range(len(s)):
            j = np.flatnonzero((u != r[i]) & (np.minimum(n[i], m) * q >= np.maximum(n[i], m) * p))
            diff = f[i] ^ g[j]
            ok = within_ring(diff)
            j, diff = j[ok], diff[ok]
            # Sets of n and m that are near differ in (q - p) / (q + p) of n + m shingles at most.
            ok = np.bitwise_count(odd[i] ^ even[j]).sum(axis=1).astype(np.int64) * (q + p) <= (q - p) * (n[i] + m[j])
            j, diff = j[ok], diff[ok]
            ok = ~np.isin(after[j], before[i][before[i] < h]).any(axis=1)
            j, diff = j[ok], diff[ok]
            a, b = np.full(len(j), s[i]), t[j]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.bitwise_count(diff.view(np.uint64)).sum(axis=1).astype(np.int64)], axis=1))
    return pa.table(dict(zip(("a", "b", "dist"), np.concatenate(out).T, strict=True)))


def _in_blocks(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidate pairs across the classes of shingles; rows: (h, sig, root). A shingle of many texts is many blocks.

    A shingle's largest class is compared with the other texts only, so it is dealt once for each block of those.
    """
    per = rows.groupBy("h", "root").agg(F.count(F.lit(1)).alias("_n"))
    sizes = per.groupBy("h").agg(F.max_by("root", F.struct("_n", "root")).alias("_main"), F.max("_n").alias("_in"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_classes")).filter("_classes > 1 and _n > 2")
    parts = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sizes = sizes.select("h", "_main", parts(F.col("_n") - F.col("_in")).alias("_others"), parts(F.col("_in")).alias("_mains"))
    mixed = rows.join(sizes, "h").join(groups.select("sig", "n", "f0", "f1", "parity"), "sig").join(_firsts(rows), "sig").withColumn("_own", F.xxhash64("sig"))
    main = F.col("root") == F.col("_main")
    mixed = materialize(mixed.withColumn("_own", F.when(main, F.col("_others") + F.pmod("_own", "_mains")).otherwise(F.pmod("_own", "_others")).cast("int")), "near-mixed")
    names = ["h", "sig", "root", "n", "f0", "f1", "parity", "firsts"]
    # Parts of other texts come first. Each of them meets itself, those behind it and the parts of the largest class.
    left = mixed.filter("_own < _others").select(*names, F.col("_own").alias("i"), F.explode(F.sequence(F.col("_own"), F.col("_others") + F.col("_mains") - 1)).alias("j"))
    right = mixed.select(*names, F.explode(F.sequence(F.lit(0), F.least("_own", F.col("_others") - 1))).alias("i"), F.col("_own").alias("j"))
    return left.groupBy("h", "i", "j").cogroup(right.groupBy("h", "i", "j")).applyInArrow(_across, "a long, b long, dist long")


def _verified(whole: DataFrame, groups: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) that are near, by their whole sets. A text that meets many others is copied for each COPIES of them."""
    met = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = materialize(groups.join(met, "sig").select("sig", "first._k1", "first._k2"), "near-wanted")
    texts = sieve(whole.select("_k1", "_k2", "text"), wanted).filter("_maybe").join(wanted, ["_k1", "_k2"]).dropDuplicates(["sig"]).select("sig", "text")
    texts = materialize(texts, "near-texts")
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(COPIES)).cast("int").alias("_copies"))
    # Each copy of a text stands before the texts it meets, so a task holds one set and streams the others past it.
    left = texts.select(F.col("sig").alias("a"), "text").join(copies, "a")
    left = left.select("a", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"), F.lit(None).cast("long").alias("b"), "text")
    right = pairs.select("a", "b").join(copies, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_copies")).cast("int").alias("_copy"), "b")
    right = right.join(texts.select(F.col("sig").alias("b"), "text"), "b").select("a", "_copy", "b", "text")
    rows = left.union(right).repartition("a", "_copy").sortWithinPartitions("a", "_copy", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _NONE
        for batch in batches:
            for part in text_slices(batch):
                ok = []
                for b, text in zip(part.column("b").to_pylist(), as_bytes(part), strict=True):
                    found = shingles(text, shingle)
                    if b is None:
                        of = found
                    ok.append(b is not None and near(of, found))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialize(rows.select("a", "b", "text").mapInArrow(run, "a long, b long"), "near-links")


def _with_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs with ra and rb, the classes of their ends, where those differ."""
    for end in ("a", "b"):
        side = roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
        pairs = pairs.join(side, end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    return pairs.filter("ra <> rb")


def _roots(whole: DataFrame, marked: DataFrame, groups: DataFrame, shingle: int) -> DataFrame:
    """(node, root) of the sets that link."""
    heads = marked.select(F.explode("prefix").alias("h"), "sig").repartition("h").sortWithinPartitions("h", "sig")
    member = materialize(heads.mapInArrow(_stars, "h long, a long, sig long"), "near-members")
    star = member.select("a", F.col("sig").alias("b")).distinct().join(_side(groups, "a", "x"), "a").join(_side(groups, "b", "y"), "b")
    closest = _pruned(star).groupBy("b").agg(F.min(F.struct("dist", "a")).alias("best"))
    tried = materialize(closest.select("best.a", "b"), "near-stars")
    links = _verified(whole, groups, tried, shingle)
    found = materialize(components(links), "near-roots")
    # Shingles whose texts are of several classes yet: the other pairs across classes, the closest of each class first.
    rows = member.select("h", "sig").union(member.select("h", F.col("a").alias("sig")).distinct())
    rooted = lambda x, found: x.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rows = materialize(_one_each(rows), "near-rows")
    beside = _neighbours(rooted(rows, found), groups, found).join(tried, ["a", "b"], "left_anti")
    links = links.union(_verified(whole, groups, beside, shingle))
    tried = tried.union(beside).distinct()
    found = materialize(components(links), "near-roots")
    others = _in_blocks(materialize(rooted(rows, found), "near-rooted"), groups).union(_twos(rows, groups)).distinct()
    left = materialize(others.join(tried, ["a", "b"], "left_anti"), "near-across")
    for first in (True, False):
        now = _with_roots(left, found)
        if first:
            now = now.groupBy("a", "rb").agg(F.min(F.struct("dist", "b")).alias("best")).select("a", "best.b")
        now = materialize(now.select("a", "b"), "near-pairs")
        if now.isEmpty():
            break
        links = links.union(_verified(whole, groups, now, shingle))
        found = materialize(components(links), "near-roots")
        left = left.join(now, ["a", "b"], "left_anti")
    return found


def keep_first(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One document of each class, unchanged: the one with the smallest doc_id (null last), one row of repeated ones."""
    clear_of(docs, "_maybe", "_keep", "_word", "_bits")
    whole = keyed(docs)
    marked = materialize(_marked(whole, _common(whole, shingle), shingle), "near-marked")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")
    groups = materialize(marked.groupBy("sig").agg(F.min(first).alias("first"), *(F.any_value(c).alias(c) for c in ("n", "f0", "f1", "parity"))), "near-groups")
    roots = _roots(whole, marked, groups, shingle).withColumnRenamed("node", "sig")
    rooted = groups.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first._k1", "first._k2", F.lit(True).alias("_kept"))
    counts = marked.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_c")).join(kept, ["_k1", "_k2"], "left")
    odd = counts.select("_k1", "_k2", "_c", F.coalesce("_kept", F.lit(False)).alias("_keep")).filter("not _keep or _c > 1")
    return without(whole, materialize(odd, "near-odd")).select(*docs.columns)
