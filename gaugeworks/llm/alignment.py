"""Cross-tokenizer alignment: which tokens of one tokenizer lie over which of another.

A text, with a space before it, is encoded by a byte-level BPE (A) and a SentencePiece BPE (B).
Both cut the same bytes, so the union of their token ends cuts them into elementary intervals,
each owned by one token of A and one of B: an interval is an overlap. Where both have an end a
group closes, and the product of a group's tokens tells what may stand for what.

How often a pair of ids is linked is a count of documents of the whole corpus. Tasks count in
chunks of CHUNK_BYTES of text, so what is shuffled is a row for each distinct pair of a chunk.
Chunks are written once, with each document's pairs as places in its chunk's list; the counts
come back by chunk. Only each A id's highest count is broadcast: at most a row for each entry of
A's vocabulary.

Texts are encoded in segments, cut before a space that follows a visible ASCII character or one
of two bytes. No token of either tokenizer reaches over such a place, so the ids are those of the
whole text; a bounded memory of segments saves encoding them again. A text that is null or empty, or that a tokenizer
doesn't give back byte by byte, has no tokens. Repeated rows are documents of their own. Long texts
are taken piece by piece; a stretch without any such space is one piece, however long.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._common import clear_of, materialize, text_slices

TOKENIZERS = "/opt/tokenizers"
#: Text of a chunk, text that is aligned at a time, and entries of a task's memory of segments.
CHUNK_BYTES = 8 << 20
SLICE_BYTES = 2 << 20
MEMORY = 1 << 19
#: Segments that any version of the pattern's character classes cuts alike, without long runs of white space.
_USUAL = re.compile(r"[ \n]{0,8}[\x21-\x7eÀ-ɏ]{1,200}[\x21-\x7eÀ-ɏ\n]{0,8}")
COUNTED = ("n_a", "n_b", "n_groups", "n_links")
_ADDED = (*COUNTED, "groups_sha256", "n_best", "count_sum")


@dataclass(frozen=True)
class Tokenizers:
    """Vocabulary files, by the same path on the driver and the executors."""

    byte_bpe: str = f"{TOKENIZERS}/byte_bpe_50k.json"
    piece_bpe: str = f"{TOKENIZERS}/piece_bpe_32k.model"


def byte_characters() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """A. Usual segments go through a faster engine for the same merges, if the file lists them in order of their ids."""

    def __init__(self, path: str) -> None:
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of, vocabulary = byte_characters(), model["vocab"]
        size = 1 + max([*vocabulary.values(), *self.whole.get_vocab().values()])
        self.bytes: list[bytes] = [b""] * size
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes(of[c] for c in entry)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        self.fast = None
        if all(vocabulary[m] == 256 + i for i, m in enumerate(merged)) and len(vocabulary) == 256 + len(merged):
            import tiktoken

            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={})

    def encode(self, segments: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [self.fast.encode_ordinary(s) if self.fast and _USUAL.fullmatch(s) else None for s in segments]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.whole.encode_batch_fast([segments[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class PieceBpe:
    """B. It puts a space before what it encodes, so a segment's first space is left to it."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.whole.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = pieces.index("▁")

    def encode(self, segments: list[str]) -> list[list[int]]:
        out = self.whole.encode([s[1:] for s in segments], num_threads=1)
        # A lone space at the end of a text is a token; encoding nothing gives none.
        return [ids if s != " " else [self.space] for s, ids in zip(segments, out, strict=True)]


class Segments:
    """Known segments: their tokens of both kinds, one behind the other, and whether their bytes come back."""

    def __init__(self, files: Tokenizers) -> None:
        self.sides = (ByteBpe(files.byte_bpe), PieceBpe(files.piece_bpe))
        self.sizes = [np.array([len(b) for b in s.bytes], np.int64) for s in self.sides]
        #: Ids as decimals behind what stands before them: a first token of a group, or a further one.
        self.told = [[np.array([f"{mark}{i}" for i in range(len(s.bytes))], object) for mark in marks] for s, marks in zip(self.sides, (";,", "|,"), strict=True)]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.tokens = [np.zeros(0, np.int32)] * 2
        self.starts = [np.zeros(1, np.int64)] * 2
        self.whole = np.zeros(0, bool)
        self.length = np.zeros(0, np.int64)

    def look_up(self, segments: pa.Array) -> np.ndarray:
        """Places of segments, strings, in the memory."""
        if len(self.index) > MEMORY:
            self.forget()
        coded = segments.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if new := [s for s in distinct if s not in self.index]:
            self._learn(new)
        return np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def _learn(self, new: list[str]) -> None:
        raw = [s.encode() for s in new]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        whole, text = np.ones(len(new), bool), b"".join(raw)
        for side, coder in enumerate(self.sides):
            ids = coder.encode(new)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
            ends = np.concatenate([[0], np.cumsum(self.sizes[side][flat])])
            stops = np.cumsum(counts)
            # Equal lengths and equal bytes altogether mean equal segments; else they are compared one by one.
            if not np.array_equal(ends[stops] - ends[stops - counts], length) or b"".join([coder.bytes[i] for i in flat.tolist()]) != text:
                whole &= np.fromiter((b"".join([coder.bytes[i] for i in x]) == r for x, r in zip(ids, raw, strict=True)), bool, len(new))
            self.starts[side] = np.concatenate([self.starts[side], self.starts[side][-1] + stops])
            self.tokens[side] = np.concatenate([self.tokens[side], flat])
        self.whole = np.concatenate([self.whole, whole])
        self.length = np.concatenate([self.length, length])
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))

    def gathered(self, side: int, known: np.ndarray) -> np.ndarray:
        """The tokens of segments, one behind the other."""
        start, count = self.starts[side][known], np.diff(self.starts[side])[known]
        before = np.cumsum(count) - count
        return self.tokens[side][np.repeat(start - before, count) + np.arange(int(count.sum()))]


@lru_cache(maxsize=2)
def _segments(files: Tokenizers) -> Segments:
    return Segments(files)


def _cut_after() -> np.ndarray:
    """By the two bytes before a space (the first as row): whether a segment may end there."""
    table = np.zeros((256, 256), bool)
    table[:, 0x21:0x7F] = True
    table[0xC3:0xE0, 0x80:0xC0] = True
    return table


_CUTS = _cut_after()


def segmented(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all segments of texts with a space before each, the text of each). Null and empty texts have none."""
    text = text.cast(pa.large_string())
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    filled = pc.fill_null(pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(space, text, nothing)), "")
    bounds = np.frombuffer(filled.buffers()[1], np.int64, len(filled) + 1, 8 * filled.offset)
    data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)
    at = bounds[0] + np.flatnonzero(data[bounds[0] : bounds[-1]] == 32)
    inner = at[at > bounds[0] + 1]
    cuts = inner[_CUTS[data[inner - 2], data[inner - 1]]]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts = np.concatenate([heads, cuts])
    starts.sort(kind="stable")
    starts = starts[np.append(True, np.diff(starts) > 0)[: len(starts)]]
    edges = np.append(starts, bounds[-1])
    segments = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(edges), filled.buffers()[2]])
    return segments, np.searchsorted(bounds, starts, "right") - 1


@dataclass
class Aligned:
    """The alignment of a run of texts. counts: tokens of either side, groups and intervals of each text; owner: of each interval; group: of each token, over the run."""

    counts: np.ndarray
    owner: list[np.ndarray]
    ids: list[np.ndarray]
    group: list[np.ndarray]

    @property
    def groups(self) -> int:
        return int(self.counts[:, 2].sum())


def aligned(ids: list[np.ndarray], sizes: list[np.ndarray], lengths: np.ndarray) -> Aligned:
    """Texts of `lengths` bytes, one behind the other, and the ids that both sides cut them into."""
    ends = [np.cumsum(sizes[s][ids[s]]) for s in (0, 1)]
    cuts = _union(*ends)
    owner = [np.searchsorted(e, cuts) for e in ends]
    ended = [e[o] == cuts for e, o in zip(ends, owner, strict=True)]
    shared = ended[0] & ended[1]
    number = np.cumsum(shared) - shared  # of the group that an interval lies in
    texts = np.cumsum(lengths)
    counts = np.stack([np.diff(np.searchsorted(x, texts, "right"), prepend=0) for x in (*ends, cuts[shared], cuts)], axis=1)
    return Aligned(counts, owner, ids, [number[e] for e in ended])


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """union1d of two sorted arrays: a stable sort merges them."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[np.append(True, both[1:] != both[:-1])[: len(both)]]


def written_groups(found: Aligned, told: list[list[np.ndarray]]) -> list[str]:
    """Each text's groups, every one behind a semicolon: ids of A, a bar, ids of B."""
    a, b = found.group
    na, nb = (np.bincount(g, minlength=found.groups) for g in found.group)
    place = [np.arange(len(a)) + (np.cumsum(nb) - nb)[a], np.arange(len(b)) + np.cumsum(na)[b]]
    out = np.empty(len(a) + len(b), object)
    for side in (0, 1):
        g = found.group[side]
        first = np.append(True, g[1:] != g[:-1])[: len(g)]
        out[place[side]] = np.where(first, told[side][0][found.ids[side]], told[side][1][found.ids[side]])
    counts = found.counts[:, 0] + found.counts[:, 1]
    stops, out = np.cumsum(counts), out.tolist()
    return ["".join(out[stop - n : stop]) for n, stop in zip(counts.tolist(), stops.tolist(), strict=True)]


def products(found: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens of a group: their places on either side, over the run."""
    na, nb = (np.bincount(g, minlength=found.groups) for g in found.group)
    start = [np.cumsum(n) - n for n in (na, nb)]
    pairs = na * nb
    inside = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    across = np.repeat(nb, pairs)
    return np.repeat(start[0], pairs) + inside // across, np.repeat(start[1], pairs) + inside % across


class Chunk:
    """What a run of documents adds up to, while they pass slice by slice."""

    def __init__(self, known: Segments) -> None:
        self.known, self.width = known, len(known.sides[1].bytes)
        self.sha: list = []
        self.counts = np.zeros((0, len(COUNTED)), np.int64)
        self.bad = np.zeros(0, bool)
        self.links: list[np.ndarray] = []
        self.bytes, self.several = 0, False

    def add(self, text: pa.Array) -> None:
        first, segments, doc = len(self.sha), *segmented(text)
        self.sha += [hashlib.sha256() for _ in range(len(text))]
        self.counts = np.concatenate([self.counts, np.zeros((len(text), len(COUNTED)), np.int64)])
        self.bad = np.concatenate([self.bad, pc.fill_null(pc.equal(pc.binary_length(text), 0), True).to_numpy(zero_copy_only=False)])
        size = pc.binary_length(segments).to_numpy()
        self.bytes += int(size.sum())
        # A long text is a slice of its own and passes in several windows of segments.
        window = np.cumsum(size) // (2 * SLICE_BYTES) if len(size) else size
        edges = np.searchsorted(window, np.arange(int(window[-1]) + 2 if len(size) else 0))
        self.several |= len(edges) > 2
        for lo, hi in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            if lo < hi:
                self._window(segments[lo:hi], first + doc[lo:hi])

    def _window(self, segments: pa.Array, doc: np.ndarray) -> None:
        places = self.known.look_up(segments)
        self.bad[doc[~self.known.whole[places]]] = True
        good = ~self.bad[doc]
        places, doc = places[good], doc[good]
        if not len(doc):
            return
        docs = doc[np.append(True, doc[1:] != doc[:-1])]
        lengths = np.bincount(np.searchsorted(docs, doc), self.known.length[places]).astype(np.int64)
        found = aligned([self.known.gathered(s, places) for s in (0, 1)], self.known.sizes, lengths)
        begun = self.counts[docs, 0] > 0
        for d, told, before in zip(docs.tolist(), written_groups(found, self.known.told), begun.tolist(), strict=True):
            self.sha[d].update((told if before else told[1:]).encode())
        self.counts[docs] += found.counts
        pair = found.ids[0][found.owner[0]].astype(np.int64) * self.width + found.ids[1][found.owner[1]]
        span = len(self.known.sides[0].bytes) * self.width
        key = np.repeat(docs, found.counts[:, 3]) * span + pair
        key.sort()
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.links.append(np.stack([key[heads] // span, key[heads] % span, np.diff(np.append(heads, len(key)))]))

    def ended(self) -> dict[str, object]:
        """The chunk's columns: by document, and by distinct pair."""
        doc, pair, times = np.concatenate(self.links, axis=1) if self.links else np.zeros((3, 0), np.int64)
        if self.several:  # a document's pieces may link a pair in more than one slice
            order = np.lexsort((pair, doc))
            doc, pair, times = doc[order], pair[order], times[order]
            heads = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(pair) != 0))[: len(doc)])
            doc, pair, times = doc[heads], pair[heads], np.add.reduceat(times, heads) if len(heads) else times
        good = ~self.bad
        doc, pair, times = doc[good[doc]], pair[good[doc]], times[good[doc]]
        distinct, place, held_by = np.unique(pair, return_inverse=True, return_counts=True)
        return {
            "counts": self.counts * good[:, None],
            "sha": [h.hexdigest() if g else "" for h, g in zip(self.sha, good.tolist(), strict=True)],
            "pairs": np.bincount(doc, minlength=len(self.sha)),
            "place": _packed(np.diff(place, prepend=0)),
            "times": _packed(times),
            "a": distinct // self.width,
            "b": distinct % self.width,
            "docs": held_by,
        }


def _packed(numbers: np.ndarray) -> bytes:
    """The fewest bytes a number that hold all of them, told by the first byte."""
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not len(numbers) or (numbers.min() >= np.iinfo(t).min and numbers.max() <= np.iinfo(t).max))
    return bytes([np.dtype(kind).itemsize]) + numbers.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64) if len(data) > 1 else np.zeros(0, np.int64)


def chunks(docs: DataFrame, files: Tokenizers) -> DataFrame:
    """A row for each chunk: its documents (without text), their pairs and the chunk's distinct pairs."""
    names = [c for c in docs.columns if c != "text"]
    inner = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in (*COUNTED, "pairs")), T.StructField("groups_sha256", T.StringType())])
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("members", T.ArrayType(inner)), T.StructField("place", T.BinaryType()), T.StructField("times", T.BinaryType()), *(T.StructField(c, ints) for c in ("a", "b", "docs"))])

    def row(number: int, chunk: Chunk, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        out = chunk.ended()
        kept = pa.Table.from_batches(rows).combine_chunks()
        fields = [*(kept.column(c).chunk(0) if kept.column(c).num_chunks else pa.array([], kept.schema.field(c).type) for c in names), *(pa.array(x, pa.int64()) for x in (*out["counts"].T, out["pairs"])), pa.array(out["sha"], pa.string())]
        members = pa.StructArray.from_arrays(fields, inner.names)
        listed = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, len(members)], members), pa.array([out["place"]], pa.binary()), pa.array([out["times"]], pa.binary()), *(listed(out[c]) for c in ("a", "b", "docs"))], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = _segments(files), TaskContext.get().partitionId() << 32
        chunk, rows = Chunk(known), []
        for batch in batches:
            for part in text_slices(batch, limit=SLICE_BYTES):
                chunk.add(part.column("text"))
                rows.append(part)
                if chunk.bytes >= CHUNK_BYTES:
                    yield row(number, chunk, rows)
                    number, chunk, rows = number + 1, Chunk(known), []
        if rows:
            yield row(number, chunk, rows)

    return docs.mapInArrow(run, schema)


def pair_counts(chunked: DataFrame) -> DataFrame:
    """a, b, count (documents of the corpus that link the ids) and best (whether no count of a is higher)."""
    each = chunked.select(F.inline(F.arrays_zip("a", "b", "docs")))
    counted = materialize(each.groupBy("a", "b").agg(F.sum("docs").alias("count")), "alignment-counts")
    highest = counted.groupBy(F.col("a").alias("_a")).agg(F.max("count").alias("_most"))  # a row for each entry of a vocabulary at most
    return counted.join(F.broadcast(highest), F.col("a") == F.col("_a")).select("a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


def align(docs: DataFrame, files: Tokenizers | None = None) -> DataFrame:
    """docs without text, with n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose count is the highest of their A id) and count_sum."""
    clear_of(docs, *_ADDED)
    chunked = materialize(chunks(docs, files or Tokenizers()), "alignment-chunks")
    each = chunked.select("chunk", F.posexplode(F.arrays_zip("a", "b")).alias("place", "pair")).select("chunk", "place", "pair.a", "pair.b")
    told = each.join(pair_counts(chunked), ["a", "b"]).select("chunk", "place", "count", "best")
    names = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.StringType() if c == "groups_sha256" else T.LongType()) for c in _ADDED)])

    def joined(scores: pa.Table, rows: pa.Table) -> pa.Table:
        # Both sides of one chunk.
        members = rows.column("members").combine_chunks()
        members = (members.chunk(0) if isinstance(members, pa.ChunkedArray) else members).flatten()
        sizes = members.field("pairs").to_numpy()
        weight = np.zeros((2, scores.num_rows), np.int64)
        at = scores.column("place").to_numpy()
        weight[0, at], weight[1, at] = scores.column("best").to_numpy().astype(np.int64), scores.column("count").to_numpy()
        place, times = _unpacked(rows.column("place")[0].as_py()), _unpacked(rows.column("times")[0].as_py())
        run = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(weight[:, np.cumsum(place)] * times, axis=1)], axis=1)
        stops = np.cumsum(sizes)
        best, total = run[:, stops] - run[:, stops - sizes]
        fields = {c: members.field(c) for c in (*names, *COUNTED, "groups_sha256")} | {"n_best": pa.array(best), "count_sum": pa.array(total)}
        return pa.table([fields[c] for c in schema.names], schema.names)

    return told.groupBy("chunk").cogroup(chunked.select(F.col("chunk").alias("of"), "members", "place", "times").groupBy("of")).applyInArrow(joined, schema)


def digest(made: DataFrame) -> DataFrame:
    """The contract's columns."""
    return made.select("doc_id", *COUNTED, "n_best", "count_sum", "groups_sha256")


def alignments(docs: DataFrame, files: Tokenizers | None = None, kind: str = "overlap") -> DataFrame:
    """docs with the alignment of each text: a_ids, b_ids, a_groups, b_groups (the group of each token) and links (places of linked tokens).

    kind: overlap for the intervals, product for all pairs of a group. Without tokens all are empty.
    """
    if kind not in ("overlap", "product"):
        raise ValueError(f"no kind of links {kind}")
    added = ("a_ids", "b_ids", "a_groups", "b_groups", "links")
    clear_of(docs, *added)
    files = files or Tokenizers()
    ints = T.ArrayType(T.IntegerType())
    link = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, ints) for c in added[:4]), T.StructField("links", link)])
    arrow = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _segments(files)
        for batch in batches:
            columns: list[list] = [[] for _ in added]
            for i in range(batch.num_rows):
                segments = known.look_up(segmented(batch.column("text").slice(i, 1))[0])
                if not known.whole[segments].all():
                    segments = segments[:0]
                found = aligned([known.gathered(s, segments) for s in (0, 1)], known.sizes, known.length[segments].sum(keepdims=True))
                pairs = products(found) if kind == "product" else found.owner
                for have, new in zip(columns, (*found.ids, *found.group, [{"a": a, "b": b} for a, b in zip(*(p.tolist() for p in pairs), strict=True)]), strict=True):
                    have.append(new)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.list_(pa.int32())) for c in columns[:4]), pa.array(columns[4], arrow)], schema.names)

    return docs.mapInArrow(run, schema)
