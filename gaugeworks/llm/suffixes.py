"""Removal of repeated byte strings by longest-previous-factor arrays, over partitioned suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a
smaller doc_id: the suffix that starts there has a longest previous factor (over the
documents before its own) of at least LENGTH. Suffix order is built where a match is possible:

1. Documents are packed into chunks, files in the shared folder.
2. The anchor of a suffix is the least hash of the K-byte strings within its first LENGTH
   bytes, so suffixes with equal LENGTH bytes have equal anchors. Neighbouring suffixes with
   one anchor form a window (its bytes are the suffixes' first LENGTH ones). Copies of a window
   within a chunk, compared as bytes, are one entry: the one with the smallest doc_id.
3. Each chunk sends its anchors, dealt by their hash, without documents or bytes. An anchor of
   one document only has no match; the others' entries are asked for.
4. Entries are dealt by anchor with their bytes. Entries of an anchor with over `hot` of them
   are dealt suffix by suffix, by the hash of its LENGTH bytes and once from each chunk, so no
   anchor is one task's.
   Each bucket puts its suffixes in suffix order with their common prefixes, and the previous
   and next smaller documents in that order give the longest previous factors.
5. Each chunk takes the answers and cuts its documents.

Texts are UTF-8 bytes, whole; null is empty. Documents with a null doc_id are neither cut nor
a reason to cut. Rows that repeat a doc_id don't cut one another. Spans are byte offsets.
Hashes only deal the work: what is removed has been compared as bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._common import as_bytes, for_workers, materialize, shared_path

LENGTH = 50
K = 25
STEP = 1 << 20
#: Suffixes that a bucket sorts at a time, by whole anchors.
SORTED = 1 << 20
#: Entries of an anchor that are dealt together at most.
HOT = 1 << 14
#: Bytes of text of a chunk and of the windows that a bucket gathers, (least, most): both grow
#: with the corpus, so that a chunk has the windows of some 2700 bytes for each bucket.
CHUNK, CHUNK_PARTS = (4 << 20, 64 << 20), 20_000
BUCKET, SHARE = (4 << 20, 128 << 20), 2700
#: Tasks of a shuffle at most.
TASKS = 50_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TOP = np.uint64(16)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-byte strings, by doubling."""
    with np.errstate(over="ignore"):
        n, power, size = len(data) - k + 1, {1: _A}, 1
        by = {1: data.astype(np.uint64) + np.uint64(1)}
        while size * 2 <= k:
            h = by[size]
            by[size * 2] = h[:-size] * power[size] + h[size:]
            power[size * 2] = power[size] * power[size]
            size *= 2
        out, done = by[size][:n].copy(), size
        while done < k:
            size = 1 << ((k - done).bit_length() - 1)
            out *= power[size]
            out += by[size][done : done + n]
            done += size
        return out


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    m, size = h, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Windows:
    """The windows of a chunk: anchor, hash, first suffix, number of suffixes and document of each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int = LENGTH, k: int = K) -> None:
        parts = [self._step(data, starts, at, min(at + STEP, len(data) - length + 1), length, k) for at in range(0, max(0, len(data) - length + 1), STEP)]
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        self.anchor, self.hash, self.first, self.count, self.doc = cols

    @staticmethod
    def _step(data: np.ndarray, starts: np.ndarray, lo: int, hi: int, length: int, k: int) -> tuple[np.ndarray, ...]:
        grams = rolling(data[lo : hi + length - 1], k)
        least = sliding_least(mix(grams), length - k + 1)[: hi - lo]
        fresh = np.ones(hi - lo, dtype=bool)
        fresh[1:] = least[1:] != least[:-1]
        inside = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)]
        fresh[inside - lo] = True
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], hi - lo) - 1
        doc = np.searchsorted(starts, first + lo, "right") - 1
        last = np.minimum(last, starts[doc + 1] - length - lo)
        keep = first <= last
        first, last, doc = first[keep], last[keep], doc[keep]
        # A repeated K-byte string can make long windows: none has more than length - k + 1 suffixes.
        most = length - k + 1
        pieces = (last - first) // most + 1
        if (pieces > 1).any():
            doc, base, end = np.repeat(doc, pieces), np.repeat(first, pieces), np.repeat(last, pieces)
            first = base + most * (np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            last = np.minimum(first + most - 1, end)
        # The first and last suffix overlap and cover the window: their hashes and its size tell it.
        with np.errstate(over="ignore"):
            ends = lambda p: grams[p] * _B + mix(grams[p + length - k])
            whole = mix(mix(ends(first)) + ends(last) * _C + (last - first).astype(np.uint64))
        return mix(least[first] * _A + _C) >> _TOP, whole >> _TOP, first + lo, last - first + 1, doc


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as big-endian numbers; 7 bytes of data make none."""
    return np.ndarray(max(len(data) - 7, 0), ">u8", data, strides=(1,))


def differing(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Members of groups that aren't copies of one string: those are to stand alone. A fresh string begins a group; all have LENGTH bytes."""
    out = np.zeros(len(fresh), dtype=bool)
    of = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
    copies, words = np.flatnonzero(~fresh), words_at(data)
    for at in range(0, len(copies), STEP):
        i = copies[at : at + STEP]
        a, b, last = first[i], first[of[i]], sizes[i] - 8
        differ = sizes[i] != sizes[of[i]]
        for offset in range(0, 2 * LENGTH - K, 8):
            o = np.minimum(offset, last)
            differ |= words[a + o] != words[np.minimum(b + o, len(words) - 1)]
        out[i] = differ
    group = np.cumsum(fresh) - 1
    return np.isin(group, group[out]) if out.any() else out


class Chunk:
    """Texts and ids of one file, and its entries, distinct windows in the order of (bucket, anchor, hash)."""

    def __init__(self, blob: bytes) -> None:
        n = int.from_bytes(blob[:8], "little")
        self.ids, self.has_id = np.frombuffer(blob, np.int64, n, 8), np.frombuffer(blob, np.uint8, n, 8 + 8 * n).astype(bool)
        sizes = np.frombuffer(blob, np.int64, n, 8 + 9 * n)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(zstandard.decompress(blob[8 + 17 * n :]), np.uint8) if self.starts[-1] else np.zeros(0, np.uint8)

    @staticmethod
    def packed(ids: list[int | None], texts: list[bytes]) -> bytes:
        n, order = len(ids), sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k]))
        ids, texts = [ids[k] for k in order], [texts[k] for k in order]
        head = np.array([i or 0 for i in ids], np.int64).tobytes() + np.array([i is not None for i in ids], np.uint8).tobytes()
        return n.to_bytes(8, "little") + head + np.array([len(t) for t in texts], np.int64).tobytes() + zstandard.compress(b"".join(texts), 3)

    def index(self, buckets: int) -> None:
        w = Windows(self.data, self.starts)
        keep = self.has_id[w.doc]
        anchor, code, first, count, ids = (c[keep] for c in (w.anchor, w.hash, w.first, w.count, self.ids[w.doc]))
        # Texts stand in the order of their ids, so a stable sort puts each entry's first document first.
        key = anchor << _TOP | code >> np.uint64(32)
        order = np.argsort(key, kind="stable")
        self.first, self.count, self.ids_of, anchor, key = first[order], count[order], ids[order], anchor[order], key[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        fresh |= differing(self.data, self.first, self.count + LENGTH - 1, fresh)
        #: The first window of each entry, for each window its entry, and each entry's anchor by number.
        self.heads = np.flatnonzero(fresh)
        self.entry = np.cumsum(fresh) - 1
        new = np.ones(len(self.heads), dtype=bool)
        new[1:] = anchor[self.heads[1:]] != anchor[self.heads[:-1]]
        self.of_anchor, heads = np.cumsum(new) - 1, self.heads[new]
        self.anchors = anchor[heads]
        self.cuts = np.searchsorted(bucket_of(self.anchors, buckets), np.arange(buckets + 1))
        self.buckets = np.flatnonzero(np.diff(self.cuts)).tolist()
        #: Of each anchor: its entries, and whether these are of several documents.
        self.entries = np.diff(np.append(np.flatnonzero(new), len(new)))
        self.several = np.minimum.reduceat(self.ids_of, heads) < np.maximum.reduceat(self.ids_of, heads) if len(heads) else np.zeros(0, bool)

    def bytes_of(self, first: np.ndarray, sizes: np.ndarray) -> bytes:
        return self.data[_ranges(first, sizes)].tobytes()


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of their anchors, hashes of 48 bits."""
    return ((anchor >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers, split into byte planes and compressed."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.compress(planes, 1)


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in raw]


def store(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Packs (doc_id, text) into chunk files; returns the materialised list (chunk, path, bytes)."""
    folder = for_workers(shared_path(docs.sparkSession, "suffix-chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        ids: list[int | None] = []
        texts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            # Names are never used twice; files of lost attempts are listed nowhere.
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(Chunk.packed(ids, texts))
            size = sum(map(len, texts))
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": pa.array([size], pa.int64())})

        held = 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), as_bytes(batch), strict=True):
                if ids and held + len(t) > chunk_bytes:
                    yield flush()
                    held = 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "path string, bytes long")
    return materialize(rows.withColumn("chunk", F.monotonically_increasing_id()), "suffix-list")


def _load(path: str) -> Chunk:
    fs, place = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(place, compression=None) as f:
        return Chunk(f.read())


#: Kinds: 0 anchors of a chunk, 1 which of them are asked for, 2 entries by anchor and 3 suffixes of hot anchors, and the answers to those.
_BLOB = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_BLOB_SQL = "chunk long, bucket int, kind int, blob binary"


def _blobs(chunks: list[int], buckets: list[int], kinds: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table([pa.array(chunks, pa.int64()), pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], schema=_BLOB)


def _sent(buckets: int):  # noqa: ANN202
    """Step 3: a chunk's anchors by bucket, with the number of entries, doubled, plus one for several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(batch.column("chunk").to_pylist(), batch.column("path").to_pylist(), strict=True):
                c = _load(path)
                c.index(buckets)
                told = (2 * c.entries + c.several).astype(np.uint64)
                for at in range(0, len(c.buckets), 1024):
                    to = c.buckets[at : at + 1024]
                    blobs = [pack(np.diff(c.anchors[lo:hi], prepend=np.uint64(0)), told[lo:hi]) for lo, hi in zip(c.cuts[to], c.cuts[[b + 1 for b in to]], strict=True)]
                    yield from _blobs([number] * len(to), to, [0] * len(to), blobs).to_batches()

    return run


def _answered(hot: int):  # noqa: ANN202
    """Step 3, a bucket's side: two bits for each anchor of a chunk, asked for and hot."""

    def run(group: pa.Table) -> pa.Table:
        chunks, parts = group["chunk"].to_pylist(), [unpack(b, 2) for b in group["blob"].to_pylist()]
        sizes = np.array([len(p[0]) for p in parts])
        anchor = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        told = np.concatenate([p[1] for p in parts]).view(np.int64)
        del parts
        order = np.argsort(anchor, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(anchor[order]) != 0))
        met, entries = np.diff(np.append(heads, len(order))), np.add.reduceat(told[order] >> 1, heads)
        asked = (met > 1) | np.bitwise_or.reduceat(told[order] & 1, heads).astype(bool)
        bits = np.empty((len(order), 2), dtype=bool)
        bits[order] = np.repeat(np.stack([asked, asked & (entries > hot)], axis=1), met, axis=0)
        blobs = [zstandard.compress(np.packbits(b).tobytes(), 1) for b in np.split(bits, np.cumsum(sizes)[:-1])]
        return _blobs(chunks, [group["bucket"][0].as_py()] * len(blobs), [1] * len(blobs), blobs)

    return run


def _asked_of(c: Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """By entry: asked for together with its anchor, and suffix by suffix."""
    bits = np.zeros((len(c.anchors), 2), dtype=bool)
    for b, kind, blob in zip(answers["bucket"].to_pylist(), answers["kind"].to_pylist(), answers["blob"].to_pylist(), strict=True):
        if kind == 1:
            n = c.cuts[b + 1] - c.cuts[b]
            bits[c.cuts[b] : c.cuts[b + 1]] = np.unpackbits(np.frombuffer(zstandard.decompress(blob), np.uint8), count=2 * n).reshape(n, 2)
    asked, hot = bits[c.of_anchor].T if len(c.heads) else (np.zeros(0, bool), np.zeros(0, bool))
    return asked & ~hot, hot


class HotSuffixes:
    """The hot anchors' suffixes by bucket and key, a hash of their bytes; copies stand for the first, with the smallest doc_id."""

    def __init__(self, c: Chunk, hot: np.ndarray, buckets: int) -> None:
        e = np.flatnonzero(hot)
        at, entry = _ranges(c.first[c.heads[e]], c.count[c.heads[e]]), np.repeat(e, c.count[c.heads[e]])
        key, words, offsets = np.zeros(len(at), np.uint64), words_at(c.data), (*range(0, LENGTH - 8, 8), LENGTH - 8)
        with np.errstate(over="ignore"):
            for offset in offsets:
                key = mix(key * _A + words[at + offset].astype(np.uint64))
        ids, key = c.ids_of[c.heads[entry]], key >> _TOP
        order = np.lexsort((ids, key))
        self.at, self.entry, self.ids, key = at[order], entry[order], ids[order], key[order]
        fresh = np.append(True, np.diff(key) != 0) if len(key) else np.zeros(0, bool)
        fresh |= differing(c.data, self.at, np.full(len(key), LENGTH), fresh)
        #: Places of the first ones, for each suffix the number of its first one, and (bucket, from, to) of the first ones.
        self.heads, self.head = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        self.key, bucket = key[self.heads], bucket_of(key[self.heads], buckets)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
        self.parts = [(int(bucket[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bundle(anchor: np.ndarray, ids: np.ndarray, sizes: np.ndarray, text: bytes) -> bytes:
    head = pack(np.diff(anchor, prepend=np.uint64(0)), ids, sizes)
    return len(head).to_bytes(8, "little") + head + zstandard.compress(text, 3)


def _asked(buckets: int):  # noqa: ANN202
    """Step 4, a chunk's side: the bytes that were asked for."""

    def run(files: pa.Table, answers: pa.Table) -> pa.Table:
        to: list[int] = []
        kinds: list[int] = []
        blobs: list[bytes] = []
        if not files.num_rows or not answers.num_rows:
            return _blobs([], to, kinds, blobs)
        c, number = _load(files["path"][0].as_py()), files["chunk"][0].as_py()
        c.index(buckets)
        together, hot = _asked_of(c, answers)
        entry_cuts = np.searchsorted(c.of_anchor, c.cuts)
        for b in c.buckets:
            e = np.flatnonzero(together[entry_cuts[b] : entry_cuts[b + 1]]) + entry_cuts[b]
            if len(e):
                at = c.heads[e]
                sizes = c.count[at] + LENGTH - 1
                to.append(b)
                kinds.append(2)
                blobs.append(_bundle(c.anchors[c.of_anchor[e]], c.ids_of[at], sizes, c.bytes_of(c.first[at], sizes)))
        x = HotSuffixes(c, hot, buckets)
        for b, lo, hi in x.parts:
            at, sizes = x.heads[lo:hi], np.full(hi - lo, LENGTH)
            to.append(b)
            kinds.append(3)
            blobs.append(_bundle(x.key[lo:hi], x.ids[at], sizes, c.bytes_of(x.at[at], sizes)))
        return _blobs([number] * len(to), to, kinds, blobs)

    return run


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def suffix_order(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the positions, by group and then their first `length` bytes: (order, common).

    common[i] is the length of the prefix that the suffix has in common with the one before it in the
    order, `length` at most, 0 where a group begins. Equal ones stay in the order of their positions.
    Data must have `length` + 8 bytes from every position on. Ties are refined by 8 bytes a pass.
    """
    order, words = np.argsort(group, kind="stable"), words_at(data)
    n = len(order)
    common = np.full(n, length, np.int64)
    edge = np.append(True, np.diff(group[order]) != 0) if n else np.zeros(0, bool)
    common[edge] = 0
    run = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    live = np.arange(n)
    for depth in range(0, length, 8):
        size = np.bincount(run[live], minlength=n)
        live = live[size[run[live]] > 1]
        if not len(live):
            break
        take = min(8, length - depth)
        word = words[at[order[live]] + depth].astype(np.uint64) >> np.uint64(64 - 8 * take)
        inner = np.lexsort((word, run[live]))
        order[live], word, old = order[live[inner]], word[inner], run[live]
        step = np.append(True, (old[1:] != old[:-1]) | (word[1:] != word[:-1]))
        # Where a tie breaks, the words tell how many of their bytes are common.
        broken = np.flatnonzero(step & np.append(False, old[1:] == old[:-1]))
        apart = word[broken] ^ word[broken - 1]
        common[live[broken]] = depth + sum((apart < np.uint64(1 << (8 * (take - b)))).astype(np.int64) for b in range(1, take))
        run[live] = live[np.maximum.accumulate(np.where(step, np.arange(len(live)), 0))]
    return order, common


def longest_previous(common: np.ndarray, doc: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest-previous-factor array in suffix order: how long a prefix of each suffix starts in a smaller document too.

    The nearest smaller documents before and after it in the order have the longest common
    prefixes; chains of smaller neighbours lead there. Prefixes shorter than `least` count as 0.
    """
    after = np.append(common[1:], 0)
    return np.maximum(_smaller(common, doc, least), _smaller(after[::-1], doc[::-1], least)[::-1])


def _smaller(common: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Common prefix with the previous smaller document of each place."""
    n = len(doc)
    before, prefix = np.arange(n) - 1, common.copy()
    live = np.arange(n)
    while len(live := live[(before[live] >= 0) & (prefix[live] >= least)]):
        live = live[doc[before[live]] >= doc[live]]
        q = before[live]
        prefix[live], before[live] = np.minimum(prefix[live], prefix[q]), before[q]
    return np.where((before >= 0) & (prefix >= least), prefix, 0)


def _matched(group: pa.Table) -> pa.Table:
    """Step 4, for one bucket: for each entry, a bit for each suffix with an earlier match."""
    anchors, ids, sizes, texts, counts = [], [], [], [], []
    for blob in group["blob"].to_pylist():
        n = int.from_bytes(blob[:8], "little")
        a, i, s = unpack(blob[8 : 8 + n], 3)
        anchors.append(np.cumsum(a, dtype=np.uint64))
        ids.append(i.view(np.int64))
        sizes.append(s.view(np.int64))
        texts.append(zstandard.decompress(blob[8 + n :]))
        counts.append(len(a))
    anchor, doc, size = np.concatenate(anchors), np.concatenate(ids), np.concatenate(sizes)
    kind = np.repeat(group["kind"].to_numpy(), counts)
    data = np.frombuffer(b"".join(texts) + bytes(LENGTH + 8), np.uint8)
    del texts
    place, mask = np.cumsum(size) - size, np.zeros(len(size), np.uint64)
    # Copies of one entry, next to each other by a hash of their bytes, stand for the one of the smallest document.
    key, words = anchor * _A + kind.astype(np.uint64), words_at(data)
    for offset in range(0, 2 * LENGTH - K, 8):
        key = mix(key * _B + words[place + np.minimum(offset, size - 8)].astype(np.uint64))
    by = np.lexsort((doc, key, anchor, kind))
    fresh = np.ones(len(by), dtype=bool)
    fresh[1:] = (key[by[1:]] != key[by[:-1]]) | (anchor[by[1:]] != anchor[by[:-1]]) | (kind[by[1:]] != kind[by[:-1]])
    fresh |= differing(data, place[by], size[by], fresh)
    e = by[fresh]
    e = e[np.lexsort((doc[e], anchor[e], kind[e]))]
    # Entries by anchor, then document: equal suffixes stand in the order of their documents. An anchor of one entry has no match.
    new = np.append(True, (np.diff(anchor[e]) != 0) | (np.diff(kind[e]) != 0))
    number = np.cumsum(new) - 1
    several = (np.bincount(number) > 1)[number]
    e, number = e[several], number[several]
    ends, total = np.flatnonzero(np.diff(number, append=-1)) + 1, np.cumsum(size[e] - LENGTH + 1)
    lo = 0
    while lo < len(e):
        most = (total[lo - 1] if lo else 0) + SORTED
        hi = int(ends[max(int(np.searchsorted(total[ends - 1], most, "right")) - 1, int(np.searchsorted(ends, lo, "right")))])
        part = e[lo:hi]
        n = size[part] - LENGTH + 1
        at, of = _ranges(place[part], n), np.repeat(part, n)
        order, common = suffix_order(data, at, np.repeat(number[lo:hi], n))
        at, of = at[order], of[order]
        hit = longest_previous(common, doc[of], LENGTH) >= LENGTH
        at, of = at[hit], of[hit]
        np.bitwise_or.at(mask, of, np.uint64(1) << (at - place[of]).astype(np.uint64))
        lo = hi
    head = by[np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))]
    mask[by] = np.where(doc[by] > doc[head], np.uint64((1 << (LENGTH - K + 1)) - 1), mask[head])
    return _blobs(group["chunk"].to_pylist(), [group["bucket"][0].as_py()] * len(counts), group["kind"].to_pylist(), [pack(m) for m in np.split(mask, np.cumsum(counts)[:-1])])


def _masks(c: Chunk, answers: pa.Table, buckets: int) -> np.ndarray:
    """By entry, a bit for each suffix that has an earlier match."""
    together, hot = _asked_of(c, answers)
    masks, entry_cuts = np.zeros(len(c.heads), np.uint64), np.searchsorted(c.of_anchor, c.cuts)
    found = {b: blob for b, kind, blob in zip(answers["bucket"].to_pylist(), answers["kind"].to_pylist(), answers["blob"].to_pylist(), strict=True) if kind == 3}
    for b, kind, blob in zip(answers["bucket"].to_pylist(), answers["kind"].to_pylist(), answers["blob"].to_pylist(), strict=True):
        if kind == 2:
            e = np.flatnonzero(together[entry_cuts[b] : entry_cuts[b + 1]]) + entry_cuts[b]
            masks[e] = unpack(blob, 1)[0]
    x = HotSuffixes(c, hot, buckets)
    earlier = np.concatenate([np.zeros(0, np.uint64), *(unpack(found[b], 1)[0] & np.uint64(1) for b, _, _ in x.parts)])[x.head]
    earlier |= (x.ids > x.ids[x.heads[x.head]]).astype(np.uint64)
    np.bitwise_or.at(masks, x.entry, earlier << (x.at - c.first[c.heads[x.entry]]).astype(np.uint64))
    return masks


def _cut(buckets: int, keep_text: bool):  # noqa: ANN202
    """Step 5: spans of removed bytes of a chunk's documents, and what remains."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(files: pa.Table, answers: pa.Table) -> pa.Table:
        c = _load(files["path"][0].as_py())
        c.index(buckets)
        # A copy of an entry of a smaller document has an earlier match whatever the answer.
        later = c.ids_of > c.ids_of[c.heads[c.entry]]
        mask = np.where(later, np.uint64((1 << (LENGTH - K + 1)) - 1), _masks(c, answers, buckets)[c.entry])
        hit = np.flatnonzero(mask)
        first, count, mask = c.first[hit], c.count[hit], mask[hit]
        edge = np.zeros(len(c.data) + 1, np.int32)  # a position is the start of one suffix only
        for o in range(LENGTH - K + 1):
            p = first[(o < count) & (mask >> np.uint64(o) & np.uint64(1)).astype(bool)] + o
            edge[p] += 1
            edge[p + LENGTH] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        ids, sizes, spans, kept, digests = [], [], [], [], []
        for d in range(len(c.ids)):
            lo, hi = int(c.starts[d]), int(c.starts[d + 1])
            g = gone[lo:hi]
            turn = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
            rest = c.data[lo:hi][~g].tobytes()
            ids.append(int(c.ids[d]) if c.has_id[d] else None)
            sizes.append(hi - lo)
            spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
            kept.append(rest if keep_text else None)
            digests.append(hashlib.sha256(rest).hexdigest())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "removed": pa.array(spans, span), "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array(digests, pa.string())})

    return run


def dedup(docs: DataFrame, chunk_bytes: int | None = None, bucket_bytes: int | None = None, keep_text: bool = True, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, removed (byte spans), kept (bytes; null unless keep_text), kept_sha256.

    A document's windows are held by one task at a time, some 12 bytes for each byte of its chunk.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk_bytes = chunk_bytes or min(max(total // CHUNK_PARTS, CHUNK[0]), CHUNK[1])
    bucket_bytes = bucket_bytes or min(max(SHARE * total // chunk_bytes, BUCKET[0]), BUCKET[1])
    buckets = max(16, -(-total // bucket_bytes))
    files = store(docs, chunk_bytes)
    chunks = min(max(1, files.count()), TASKS)
    spread = files.repartitionByRange(chunks, "chunk")
    by_bucket = lambda df: df.repartition(min(buckets, TASKS), "bucket").groupBy("bucket")
    by_chunk = lambda df: files.select("chunk", "path").repartition(chunks, "chunk").groupBy("chunk").cogroup(df.repartition(chunks, "chunk").groupBy("chunk"))
    sent = spread.select("chunk", "path").mapInArrow(_sent(buckets), _BLOB_SQL)
    answers = materialize(by_bucket(sent).applyInArrow(_answered(hot), _BLOB_SQL), "suffix-answers")
    entries = by_chunk(answers).applyInArrow(_asked(buckets), _BLOB_SQL)
    matches = materialize(by_bucket(entries).applyInArrow(_matched, _BLOB_SQL), "suffix-matches")
    return by_chunk(answers.union(matches)).applyInArrow(_cut(buckets, keep_text), "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary, kept_sha256 string")


def digest(cut: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
