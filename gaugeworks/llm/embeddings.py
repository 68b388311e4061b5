"""Embedding near-duplicates by product quantisation.

Vectors are normalised, identical ones are one representative with a multiplicity. A coarse
k-means puts each into an inverted list; its residual is coded by sub-quantisers. Every
vector is a query against the PROBES nearest lists: asymmetric distances from lookup tables,
with each code's own error as slack, so that ADC prunes but never loses a near pair of a
probed list; then exact cosines in double precision decide. A pair counts for both of its
vectors whichever of them probes the other's list, and once if both do.

Lists grow with the table, one for LIST_ROWS vectors up to MAX_LISTS; beyond FLAT lists the
quantiser has two levels, the second fitted on the executors for each part of the first, and
a vector probes the nearest lists of its nearest parts. The index is fitted on rows drawn by
hash, about SAMPLE_PER_LIST for a list of the first level (MAX_SAMPLE at most) and PART_SAMPLE
for a list of the second (MOST_OF_PART at most for a part's lists); all rows are indexed. What is broadcast is at most MAX_LISTS centres and CENTRE_BYTES of them.

Without a number of probes the search is whole at any cosine: a vector is sent to all lists
whose ball, the centre and the distance of the furthest vector, comes near enough, and of two
lists it is sent from the first to the second only. Lists have about WHOLE_ROWS vectors then.
At low cosines all balls are near, and the work is that of all pairs, in cells of bounded size.

Lists meet their queries in cells of about BLOCK x BLOCK vectors (WHOLE_ROWS squared in a whole
search), so a hot list is many tasks. A cell returns counts and a spanning forest of its links,
never pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
nor do vectors of different lengths. Components are compared as doubles. Repeated rows are
copies that link with each other. A null vec_id is never a component's id; alone, its
component_id is null and it is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._common import materialize
from gaugeworks.llm.components import components

COSINE = 0.95
PROBES = 16
LIST_ROWS = 128
#: Lists in all, and those of a quantiser of one level.
MAX_LISTS, FLAT = 1 << 18, 1024
#: Bytes of all centres at most, as they are broadcast: MAX_LISTS of 64 dimensions.
CENTRE_BYTES = 64 << 20
SAMPLE_PER_LIST = 40
MAX_SAMPLE = 65_536
#: Rows for each list that the second level is fitted on, and those of a part at most.
PART_SAMPLE, MOST_OF_PART = 24, 32_768
#: Parts of the first level that a vector looks for its lists in.
PARTS = 12
SUBSPACES = 8
CODES = 64
BLOCK = 1024
#: Vectors of a list, and of a side of a cell, in a whole search.
WHOLE_ROWS = 4096
#: Where more than one of so many pairs passes the codes, or cosines in single precision, the next means takes whole strips.
DENSE = 16
_EPS = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        label = nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        counts = np.bincount(label, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centres of each row, nearest first."""
    out = []
    norms = (centres**2).sum(axis=1)
    for at in range(0, len(x), 2048):
        d = norms - 2 * x[at : at + 2048] @ centres.T
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(d), 1))
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.zeros((0, n), dtype=np.int64)


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Index:
    """Coarse centres, of one level or of parts with centres of their own, and residual codebooks."""

    def __init__(self, sample: np.ndarray, centres: np.ndarray, part_of: np.ndarray | None = None, parts: np.ndarray | None = None) -> None:
        self.tops, self.part_of, self.centres = parts, part_of, centres.astype(np.float32)
        #: Lists of part p are from of[p] to of[p + 1].
        self.of = None if parts is None else np.searchsorted(part_of, np.arange(len(parts) + 1))
        rest = sample - self.centres[self.probes(sample, 1)[:, 0]]
        dim = sample.shape[1]
        self.cuts = [int(c) for c in np.linspace(0, dim, min(SUBSPACES, dim) + 1)]
        rest = rest[:16_384]
        self.books = [kmeans(rest[:, a:b], min(CODES, len(rest)), rounds=6) for a, b in self.subspaces]

    @property
    def subspaces(self) -> list[tuple[int, int]]:
        return list(zip(self.cuts, self.cuts[1:], strict=False))

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the n nearest lists of each row, nearest first; of two levels, those of its nearest parts."""
        n = min(n, len(self.centres))
        if self.tops is None:
            return nearest(x, self.centres, n)
        tops = nearest(x, self.tops, min(PARTS, len(self.tops)))
        best, which = np.full((len(x), n), np.inf), np.full((len(x), n), -1, dtype=np.int64)
        for p in np.unique(tops):
            lo, hi = self.of[p], self.of[p + 1]
            rows = np.flatnonzero((tops == p).any(axis=1))
            for at in range(0, len(rows) if hi > lo else 0, 2048):
                r = rows[at : at + 2048]
                c = self.centres[lo:hi]
                d = np.concatenate([best[r], (c.astype(np.float64) ** 2).sum(axis=1) - 2 * x[r] @ c.T], axis=1)
                at_all = np.concatenate([which[r], np.tile(np.arange(lo, hi), (len(r), 1))], axis=1)
                take = np.argsort(d, axis=1, kind="stable")[:, :n]
                best[r], which[r] = np.take_along_axis(d, take, axis=1), np.take_along_axis(at_all, take, axis=1)
        return which

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error): the error is the distance of a vector from what its code stands for."""
        rest = x - self.centres[home]
        codes = np.stack([nearest(rest[:, a:b], book, 1)[:, 0] for (a, b), book in zip(self.subspaces, self.books, strict=True)], axis=1).astype(np.uint8)
        error = np.sqrt(sum(((rest[:, a:b] - book[codes[:, j]]) ** 2).sum(axis=1) for j, ((a, b), book) in enumerate(zip(self.subspaces, self.books, strict=True))))
        return codes, error

    def distances(self, queries: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to the coded vectors of one list."""
        rest, out = queries - self.centres[home], np.zeros((len(queries), len(codes)))
        for j, ((a, b), book) in enumerate(zip(self.subspaces, self.books, strict=True)):
            table = (rest[:, a:b] ** 2).sum(axis=1)[:, None] - 2 * rest[:, a:b] @ book.T + (book**2).sum(axis=1)
            out += table[:, codes[:, j]]
        return out


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def valid(column: str = "embedding") -> F.Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _drawn(reps: DataFrame, total: int, want: int) -> DataFrame:
    """About `want` rows, by hash."""
    return reps if total <= want else reps.filter(F.shiftright(F.xxhash64("embedding"), 1) < int(want / total * (1 << 63)) - (1 << 62))


def fit(reps: DataFrame, dim: int, total: int, lists: int) -> Index | None:
    """The index of representatives (embedding) of one length."""
    flat = lists <= FLAT
    tops = lists if flat else int(np.ceil(np.sqrt(lists)))
    sample = _drawn(reps, total, min(tops * SAMPLE_PER_LIST, MAX_SAMPLE)).orderBy(F.xxhash64("embedding"), "embedding").select("embedding").toArrow()["embedding"]
    points = unit(_vectors(sample, dim))
    if not len(points):
        return None
    centres = kmeans(points, min(tops, len(points)))
    if flat:
        return Index(points, centres)
    shared = reps.sparkSession.sparkContext.broadcast(centres)

    def place(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            x = unit(_vectors(batch.column("embedding"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(nearest(x, shared.value, 1)[:, 0], pa.int32()), batch.column("embedding")], ["part", "embedding"])

    def split(group: pa.Table) -> pa.Table:
        x = unit(_vectors(group["embedding"], dim))
        found = kmeans(x, max(1, round(len(x) / PART_SAMPLE)))
        return pa.table({"part": pa.array([group["part"][0].as_py()] * len(found), pa.int32()), "centre": pa.array([c.astype("<f4").tobytes() for c in found], pa.binary())})

    drawn = _drawn(reps, total, lists * PART_SAMPLE).select("embedding").mapInArrow(place, reps.select(F.lit(0).alias("part"), "embedding").schema)
    drawn = materialize(drawn, "pq-sample")
    most = drawn.groupBy("part").count()  # a row for each part
    drawn = drawn.join(F.broadcast(most), "part").filter(F.pmod(F.xxhash64(F.lit(5), "embedding"), F.col("count")) < MOST_OF_PART).drop("count")
    inner = drawn.groupBy("part").applyInArrow(split, "part int, centre binary").toArrow()
    part_of = inner["part"].to_numpy()
    order = np.argsort(part_of, kind="stable")
    below = np.frombuffer(b"".join(inner["centre"].to_pylist()), "<f4").reshape(-1, dim)
    return Index(points, below[order], part_of[order], centres)


def search(reps: DataFrame, dim: int, cosine: float = COSINE, probes: int | None = PROBES, lists: int | None = None) -> DataFrame:
    """(rid, n, other) for representatives (rid, embedding, mult) of one length.

    Rows with n: so many other rows link with rid, of one cell. Rows with other: a link.
    """
    spark = reps.sparkSession
    total = reps.count()
    whole = probes is None
    rows, block = (WHOLE_ROWS, WHOLE_ROWS) if whole else (LIST_ROWS, BLOCK)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    lists = lists or int(min(max(total // rows, 16), MAX_LISTS, max(16, CENTRE_BYTES // (4 * dim))))
    index = fit(reps, dim, total, lists)
    if index is None:
        return spark.createDataFrame([], "rid long, n long, other long")
    shared = spark.sparkContext.broadcast(index)

    def encode(batches):  # noqa: ANN001, ANN202
        held: Index = shared.value
        for batch in batches:
            x = unit(_vectors(batch.column("embedding"), dim))
            near = held.probes(x, probes or 1)
            home = near[:, 0]
            codes, error = held.encode(x, home)
            if whole:
                near = np.zeros((len(x), 0), dtype=np.int64)  # told by `reached`, when all balls are known
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("embedding"), batch.column("mult"), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array([[i for i in r if i >= 0] for r in near.tolist()], pa.list_(pa.int32()))],
                ["rid", "embedding", "mult", "home", "codes", "error", "probes"],
            )

    kind = reps.schema["embedding"].dataType.simpleString()
    coded = materialize(reps.select("rid", "embedding", "mult").mapInArrow(encode, f"rid long, embedding {kind}, mult long, home int, codes binary, error double, probes array<int>"), "pq-codes")
    if whole:
        far = coded.select("home", "embedding").mapInArrow(offsets(shared, dim), "home int, off double").groupBy("home").agg(F.max("off").alias("off")).toArrow()  # a row for each list
        radii = np.full(len(index.centres), -np.inf)
        radii[far["home"].to_numpy()] = far["off"].to_numpy()
        coded = coded.mapInArrow(reached(shared, dim, radii, reach), coded.schema)
    sent = coded.select(F.col("rid").alias("qid"), F.col("embedding").alias("vector"), F.col("mult").alias("times"), F.col("home").alias("from"), F.explode("probes").alias("home"))
    blocks = lambda df, name: df.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name))
    sized = F.broadcast(blocks(coded, "nd").join(blocks(sent, "nq"), "home"))  # MAX_LISTS rows of three numbers at most
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    data = coded.join(sized, "home").select("home", own("rid", "nd").alias("db"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), "rid", "embedding", "mult", "codes", "error", *(() if whole else ("probes",)))
    queries = sent.join(sized, "home").select("home", F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("db"), own("qid", "nq").alias("qb"), "qid", "vector", "times", "from")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        rid, n, other = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if left.num_rows and right.num_rows:
            d, q = unit(_vectors(left["embedding"], dim)), unit(_vectors(right["vector"], dim))
            d_ids, q_ids = left["rid"].to_numpy(), right["qid"].to_numpy()
            codes = np.frombuffer(b"".join(left["codes"].to_pylist()), dtype=np.uint8).reshape(len(d), -1)
            near = linked(shared.value, left["home"][0].as_py(), d, codes, left["error"].to_numpy(), d_ids, q, q_ids, reach, cosine)
            back, home = np.zeros(len(d), np.int64), right["from"].to_numpy()
            if whole:
                # Only one side of a pair from two lists is a query.
                times = np.where(home == left["home"][0].as_py(), 0, right["times"].to_numpy())
                for at in range(0, len(q), 256):
                    back += times[at : at + 256] @ near[at : at + 256]
            else:
                # A vector of this list that probes its partner's list counts the pair there, as a query.
                i, j = np.nonzero(near)
                lists_of = left["probes"].to_pylist()
                both = np.full((len(d), max(map(len, lists_of))), -1)
                for k, x in enumerate(lists_of):
                    both[k, : len(x)] = x
                for at in range(0, len(i), 1 << 18):
                    a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                    one = ~(both[b] == home[a, None]).any(axis=1)
                    np.add.at(back, b[one], right["times"].to_numpy()[a[one]])
            counted = np.concatenate([near[at : at + 256] @ left["mult"].to_numpy() for at in range(0, len(q), 256)])
            rid, n = np.concatenate([q_ids[counted > 0], d_ids[back > 0]]), np.concatenate([counted[counted > 0], back[back > 0]])
            other = forest(near, q_ids, d_ids)
        return pa.table(
            {
                "rid": pa.array([*rid.tolist(), *(a for a, _ in other)], pa.int64()),
                "n": pa.array([*n.tolist(), *([None] * len(other))], pa.int64()),
                "other": pa.array([*([None] * len(rid)), *(b for _, b in other)], pa.int64()),
            }
        )

    keys = ["home", "db", "qb"]
    return data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(cell, "rid long, n long, other long")


def offsets(shared, dim: int):  # noqa: ANN001, ANN201
    """The distance of each vector from its list's centre."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            home = batch.column("home").to_numpy()
            off = np.sqrt(((unit(_vectors(batch.column("embedding"), dim)) - shared.value.centres[home]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("home"), pa.array(off)], ["home", "off"])

    return run


def reached(shared, dim: int, radii: np.ndarray, reach: float):  # noqa: ANN001, ANN201
    """For each vector its own list and the later ones whose balls may hold a vector within reach."""

    def run(batches):  # noqa: ANN001, ANN202
        centres = shared.value.centres.astype(np.float64)
        norms = (centres**2).sum(axis=1)
        for batch in batches:
            x, home = unit(_vectors(batch.column("embedding"), dim)), batch.column("home").to_numpy()
            lists: list[list[int]] = []
            for at in range(0, len(x), 2048):
                off = np.sqrt(np.maximum(0, 1 + norms - 2 * x[at : at + 2048] @ centres.T))
                own = home[at : at + 2048, None]
                to = ((off <= radii + reach + _EPS) & (np.arange(len(radii)) > own)) | (np.arange(len(radii)) == own)
                lists += [np.flatnonzero(r).tolist() for r in to]
            yield batch.set_column(batch.schema.get_field_index("probes"), "probes", pa.array(lists, pa.list_(pa.int32())))

    return run


def linked(index: Index, home: int, d: np.ndarray, codes: np.ndarray, error: np.ndarray, d_ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, reach: float, cosine: float) -> np.ndarray:
    """By query and vector of a list, whether they link."""
    near = np.zeros((len(q), len(d)), dtype=bool)
    limit = (reach + error + _EPS) ** 2
    # What single precision may be off by, at unit lengths.
    single, off, dense = d.astype(np.float32), (d.shape[1] + 4) * 2.0**-23, False
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        other = q_ids[at : at + 256, None] != d_ids
        if not dense:
            found = (index.distances(part, home, codes) <= limit) & other
            dense = np.count_nonzero(found) * DENSE > found.size
        if dense:
            # The codes tell little in this cell; nor do they lose a pair.
            found = (part.astype(np.float32) @ single.T >= np.float32(cosine - off - 2.0**-22)) & other
            if np.count_nonzero(found) * DENSE > found.size:
                cosines = part @ d.T
                near[at : at + 256] = found & (cosines >= cosine + _EPS)
                found &= np.abs(cosines - cosine) < _EPS  # the same sum decides as below
        i, j = np.nonzero(found)
        for k in range(0, len(i), 32_768):
            a, b = i[k : k + 32_768], j[k : k + 32_768]
            ok = np.einsum("ij,ij->i", part[a], d[b]) >= cosine
            near[at + a[ok], b[ok]] = True
    return near


def forest(near: np.ndarray, q_ids: np.ndarray, d_ids: np.ndarray) -> list[tuple[int, int]]:
    """Breadth-first trees over the two sides of a cell."""
    edges: list[tuple[int, int]] = []
    q_left, d_left = near.any(axis=1), np.ones(len(d_ids), dtype=bool)
    for s in np.flatnonzero(q_left):
        if not q_left[s]:
            continue
        q_left[s], todo, root = False, [s], int(q_ids[s])
        while todo:
            reached = np.flatnonzero(near[todo].any(axis=0) & d_left)
            d_left[reached] = False
            edges += [(root, int(x)) for x in d_ids[reached]]
            todo = np.flatnonzero(near[:, reached].any(axis=1) & q_left).tolist() if len(reached) else []
            q_left[todo] = False
            edges += [(root, int(x)) for x in q_ids[todo]]
    return edges


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, probes: int | None = PROBES, lists: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. Without probes no link is lost."""
    held = vectors.schema["embedding"].dataType.elementType
    wide = F.col("embedding") if isinstance(held, T.FloatType) else F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    good = vectors.filter(valid()).select("vec_id", wide)
    reps = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("mult"))
    reps = materialize(reps.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    found = None
    for (dim,) in sorted(reps.select(F.size("embedding")).distinct().collect()):
        part = search(reps.filter(F.size("embedding") == dim), dim, cosine, probes, lists)
        found = part if found is None else found.union(part)
    if found is None:
        return _alone(vectors)
    found = materialize(found, "vector-links")
    counts = found.filter("n is not null").groupBy("rid").agg(F.sum("n").alias("n"))
    rooted = components(found.filter("other is not null").select(F.col("rid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rid")
    marked = reps.join(rooted, "rid", "left").join(counts, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    ids = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    marked = marked.join(ids, "root").select("embedding", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = good.join(marked, "embedding").select("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).union(_alone(vectors.filter(~valid())))


def _alone(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
