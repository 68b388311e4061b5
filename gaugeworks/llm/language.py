"""Language identification with spans for mixed-language texts.

Words are runs of letters and marks, lower-cased by code point. The script of a word's first
character (by code point ranges) narrows the candidates to the languages that use it. A word
scores by language with smoothed log probabilities of its letter n-grams (2 to 4, with word
ends) and of the whole word, in a hashed table of fixed size. Viterbi over the words, with a
penalty for each switch, labels spans; the language with most letters under its label is the
prediction, and its part of the letters the score. All of it runs on arrays of code points.

Fitting takes a documented sample of texts: about SAMPLE of all labelled rows, and of each
language LEAST at least if there are so many, drawn by a seeded hash; a text that repeats is one.
Counting runs on the executors. There is no bound on languages: the model has BUCKETS numbers
for each, and what is held while texts are scored is bounded by words times languages. Texts
too long for that are labelled in pieces, which hand on the Viterbi scores.

Null texts and texts without letters are `und` with score 0. Without labelled rows every
text is. Ties go to the language first in code point order. Repeated rows count each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._common import clear_of, text_slices

BUCKETS = 1 << 16
#: Texts that a model is fitted on, and those of a language at least.
SAMPLE, LEAST = 8000, 50
SWITCH = 6.0
UNKNOWN = "und"
#: Scores computed at a time, characters that words are taken from, characters times languages that are labelled together.
_SCORED, _SLICE, _LABELLED = 1 << 20, 1 << 20, 1 << 24
#: Characters of a piece of a long text, whatever the number of languages.
_LEAST_PIECE = 1 << 17
#: Languages whose counts a task holds at a time.
_HELD = 64
_CODE_POINTS = 0x110000
_SPACE = re.compile(r"\s")
#: Scripts by code point ranges (start, end exclusive).
SCRIPTS = {
    "latin": [(0x41, 0x250), (0x1E00, 0x1F00), (0x2C60, 0x2C80), (0xA720, 0xA800)],
    "greek": [(0x370, 0x400), (0x1F00, 0x2000)],
    "cyrillic": [(0x400, 0x530), (0x1C80, 0x1C90), (0x2DE0, 0x2E00), (0xA640, 0xA6A0)],
    "armenian": [(0x530, 0x590)],
    "hebrew": [(0x590, 0x600)],
    "arabic": [(0x600, 0x700), (0x750, 0x780), (0x8A0, 0x900)],
    "devanagari": [(0x900, 0x980)],
    "bengali": [(0x980, 0xA00)],
    "tamil": [(0xB80, 0xC00)],
    "thai": [(0xE00, 0xE80)],
    "georgian": [(0x10A0, 0x1100)],
    "hangul": [(0x1100, 0x1200), (0xAC00, 0xD7B0)],
    "kana": [(0x3040, 0x3100)],
    "han": [(0x3400, 0xA000), (0x20000, 0x32000)],
}
_SCRIPT_NAMES = [*SCRIPTS, "other"]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 1 for letters and 2 for marks, the lower case, and the script's number."""
    kind, lower, script = np.zeros(_CODE_POINTS, np.uint8), np.arange(_CODE_POINTS, dtype=np.uint32), np.full(_CODE_POINTS, len(SCRIPTS), np.uint8)
    for c in range(0x33480):
        x = chr(c)
        if x.isalpha():
            kind[c] = 1
            if len(y := x.lower()) == 1:
                lower[c] = ord(y)
        elif unicodedata.category(x)[0] == "M":
            kind[c] = 2
    for i, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a:b] = i
    return kind, lower, script


class Words:
    """The words of some texts: place, length, letters, script and text of each."""

    def __init__(self, texts: list[str | None]) -> None:
        kind, lower, script = _tables()
        points = [np.frombuffer(f"\n{t or ''}".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.text_starts = np.cumsum([1, *(len(p) for p in points)])
        points = np.concatenate([*points, np.full(5, 10, np.uint32)])
        kinds = kind[points]
        self.inside = kinds > 0
        self.points = np.where(self.inside, lower[points], 0).astype(np.uint64)
        edge = np.flatnonzero(self.inside[1:] != self.inside[:-1]) + 1
        self.first, self.end = edge[::2], edge[1::2]
        letters = np.concatenate([[0], np.cumsum(kinds == 1)])
        self.letters = letters[self.end] - letters[self.first]
        self.script = script[points[self.first]]
        self.text = np.searchsorted(self.text_starts, self.first, "right") - 1
        #: Words of text i are from starts[i] to starts[i + 1].
        self.starts = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def blocks(self, most: int = 1 << 17) -> Iterator[tuple[slice, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
        """(words, place of each word's first n-gram, [(bucket, valid) of the n-grams from every place], bucket of each whole word), words of about `most` characters at a time."""
        at = 0
        while at < len(self.first):
            to = max(at + 1, int(np.searchsorted(self.end, self.first[at] + most, "right")))
            lo, hi = int(self.first[at]) - 1, int(self.end[to - 1])
            x, ok = self.points[lo : hi + 4], self.inside[lo : hi + 4]
            n = hi - lo
            with np.errstate(over="ignore"):
                two = x[:-1] * _M1 + x[1:]
                three = two[:-1] * _M1 + x[2:]
                four = three[:-1] * _M1 + x[3:]
                grams = [(_bucket(two[:n]), None), (_bucket(three[:n] ^ _M2), ok[1 : n + 1]), (_bucket(four[:n] ^ _M3), ok[1 : n + 1] & ok[2 : n + 2])]
                place = self.first[at:to] - 1 - lo
                index = np.arange(n, dtype=np.uint64) - np.repeat(place, np.diff(np.append(place, n))).astype(np.uint64)
                whole = np.add.reduceat(_mixed(x[:n] + index * _M2) * (x[:n] > 0), place)
            yield slice(at, to), place, grams, _bucket(whole)
            at = to


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def _bucket(x: np.ndarray) -> np.ndarray:
    return ((x ^ (x >> np.uint64(32))) * _M1 >> np.uint64(64 - 16)).astype(np.int64)


class Model:
    """Log probabilities by bucket and language, and the scripts that each language uses."""

    def __init__(self, languages: list[str], log: np.ndarray, scripts: np.ndarray) -> None:
        self.languages, self.log = languages, log
        share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        self.allowed = share >= 0.01
        self.allowed[~self.allowed.any(axis=1)] = True

    def scores(self, words: Words) -> np.ndarray:
        """By word and language: mean log probability times the word's length up to 8, best language 0; other scripts' languages are out."""
        out = np.zeros((len(words.first), len(self.languages)), np.float32)
        for part, place, grams, whole in words.blocks(max(256, _SCORED // max(len(self.languages), 1))):
            total = self.log[grams[0][0]]
            number = np.ones(len(total), np.float32)
            for bucket, valid in grams[1:]:
                total += self.log[bucket] * valid[:, None]
                number += valid
            length = (words.end - words.first)[part]
            mean = (np.add.reduceat(total, place, axis=0) + self.log[whole]) / (np.add.reduceat(number, place) + 1)[:, None]
            out[part] = mean * np.minimum(length, 8)[:, None]
        out -= out.max(axis=1, keepdims=True) if len(self.languages) else 0
        out[~self.allowed[words.script]] = -50.0
        return out

    def label(self, words: Words, switch: float = SWITCH) -> np.ndarray:
        """Viterbi labels of all words."""
        return viterbi(self.scores(words), words.starts, switch)

    def predict(self, texts: list[str | None], switch: float = SWITCH) -> tuple[list[str], list[float]]:
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        # Texts are labelled together while their scores are few; a text of too many is labelled piece by piece.
        n, most = len(self.languages), max(_LEAST_PIECE, _LABELLED // len(self.languages))
        best, part, at = np.zeros(len(texts), np.int64), np.zeros(len(texts)), 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (held + len(texts[to] or "") <= most or to == at):
                held += len(texts[to] or "")
                to += 1
            mass = self._mass(texts[at:to], switch) if held <= most else self._mass_of_long(texts[at], switch, most)
            total = mass.sum(axis=1)
            best[at:to] = np.where(total > 0, mass.argmax(axis=1), n)
            part[at:to] = mass.max(axis=1) / np.maximum(total, 1)
            at = to
        return [[*self.languages, UNKNOWN][b] for b in best], part.tolist()

    def _mass(self, texts: list[str | None], switch: float) -> np.ndarray:
        """By text and language, the letters under its label."""
        n, parts = len(self.languages), []
        for of, pieces in slices(texts):
            words = Words(pieces)
            parts.append((of[words.text], words.letters, self.scores(words)))
        text, letters, scores = (np.concatenate(c) for c in zip(*parts, strict=True))
        labels = viterbi(scores, np.searchsorted(text, np.arange(len(texts) + 1)), switch)
        return np.bincount(text * n + labels, weights=letters, minlength=len(texts) * n).reshape(-1, n)

    def _mass_of_long(self, text: str, switch: float, most: int) -> np.ndarray:
        """The same of one text: forward over its pieces for the scores at each one's start, then back over them for the labels."""
        n, fronts = len(self.languages), [np.zeros(len(self.languages), np.float32)]
        pieces = [p for _, ps in slices([text], most) for p in ps]
        for piece in pieces:
            fronts.append(advanced(self.scores(Words([piece])), fronts[-1], switch)[0])
        mass, state = np.zeros(n), int(fronts[-1].argmax())
        for piece, front in zip(reversed(pieces), reversed(fronts[:-1]), strict=True):
            words = Words([piece])
            came, labels = advanced(self.scores(words), front, switch)[1], np.empty(len(words.first), np.int64)
            for t in range(len(labels) - 1, -1, -1):
                labels[t], state = state, int(came[t, state])
            mass += np.bincount(labels, weights=words.letters, minlength=n)
        return mass[None]


def advanced(scores: np.ndarray, front: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi over some words of one text from the scores before them: (scores after them, by word and label the label before)."""
    came, own = np.empty(scores.shape, np.int32), np.arange(scores.shape[1], dtype=np.int32)
    for t in range(len(scores)):
        best = int(front.argmax())
        top = front[best] - np.float32(switch)
        came[t] = np.where(front >= top, own, best)
        front = np.maximum(front, top) + scores[t]
    return front, came


def slices(texts: list[str | None], limit: int = _SLICE) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """(number of its text, piece) lists of about `limit` characters; longer texts are cut at white space."""
    of, pieces, held = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            cut = _SPACE.search(t, at + limit) if t and len(t) - at > limit else None
            piece = t if t is None else t[at : cut.start() if cut else None]
            if pieces and held + len(piece or "") > limit:
                yield np.array(of), pieces
                of, pieces, held = [], [], 0
            of.append(i)
            pieces.append(piece)
            held += len(piece or "")
            if cut is None:
                break
            at = cut.start()
    if pieces:
        yield np.array(of), pieces


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float) -> np.ndarray:
    """Best label path of each text; all texts advance together, longest first, so a step is one slice of words."""
    n_words, n = scores.shape
    if n_words == 0:
        return np.zeros(0, dtype=np.int64)
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(1, lengths.max() + 1))
    offset = np.concatenate([[0], np.cumsum(active)])
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = offset[np.arange(n_words) - starts[text]] + rank[text]
    stepped = np.empty_like(scores)
    stepped[place] = scores
    came = np.empty((n_words, n), dtype=np.int32)
    own, v, state = np.arange(n, dtype=np.int32), np.zeros((len(lengths), n), np.float32), np.zeros(len(lengths), dtype=np.int64)
    sizes, offsets = [*active.tolist(), 0], offset.tolist()
    for t in range(len(sizes) - 1):
        k, o = sizes[t], offsets[t]
        prev = v[:k]
        top = prev.max(axis=1, keepdims=True) - np.float32(switch)
        came[o : o + k] = np.where(prev >= top, own, prev.argmax(axis=1)[:, None])
        np.maximum(prev, top, out=prev)
        prev += stepped[o : o + k]
        if (left := sizes[t + 1]) < k:
            state[left:k] = v[left:k].argmax(axis=1)
    rows, labels = np.arange(len(lengths)), np.empty(n_words, dtype=np.int64)
    for t in range(len(sizes) - 2, -1, -1):
        k, o = sizes[t], offsets[t]
        labels[o : o + k] = now = state[:k]
        state[:k] = came[o : o + k][rows[:k], now]
    return labels[place]


def fit(labelled: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> Model:
    """A model from the rows of (text, lang) whose text and lang aren't null."""
    rows = labelled.filter("lang is not null and text is not null").select("text", "lang")
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages, total = sorted(per), sum(per.values())
    number = {x: i for i, x in enumerate(languages)}
    if total:
        limits = [(x, min(int(max(sample / total, least / n) * (1 << 63)), 1 << 63) - (1 << 62) - 1) for x, n in per.items()]
        # A row for each language, of which the model holds far more.
        limit = labelled.sparkSession.createDataFrame(limits, "lang string, _limit long")
        drawn = rows.withColumn("_hash", F.xxhash64(F.lit("language"), F.xxhash64("text"), "lang")).join(F.broadcast(limit), "lang")
        drawn = drawn.filter(F.shiftright("_hash", 1) <= F.col("_limit"))
        rows = drawn.dropDuplicates(["_hash", "lang"]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for k, x in got.items():
                f = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), k), pa.int32()), pa.array(f, pa.int32()), pa.array(x[f], pa.int64())], ["k", "f", "n"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for rows_of, pieces in slices(batch.column("text").to_pylist()):
                for i, piece in zip(rows_of.tolist(), pieces, strict=True):
                    words, x = Words([piece]), got.setdefault(number[langs[i]], np.zeros(BUCKETS + len(_SCRIPT_NAMES), np.int64))
                    x[BUCKETS:] += np.bincount(words.script, minlength=len(_SCRIPT_NAMES))
                    for _, _, grams, whole in words.blocks():
                        for bucket in (whole, *(b if valid is None else b[valid] for b, valid in grams)):
                            np.add.at(x, bucket, 1)
                    if len(got) > _HELD:
                        yield from told()
                        got.clear()
        yield from told()

    def scaled(group: pa.Table) -> pa.Table:
        x = np.zeros(BUCKETS + len(_SCRIPT_NAMES))
        x[group["f"].to_numpy()] = group["n"].to_numpy()
        log = np.log((x[:BUCKETS] + 0.5) / (x[:BUCKETS].sum() + 0.5 * BUCKETS)).astype("<f4")
        return pa.table({"k": pa.array([group["k"][0].as_py()], pa.int32()), "log": pa.array([log.tobytes()], pa.binary()), "scripts": pa.array([x[BUCKETS:].tolist()], pa.list_(pa.float64()))})

    summed = rows.mapInArrow(count, "k int, f int, n long").groupBy("k", "f").agg(F.sum("n").alias("n"))
    got = summed.groupBy("k").applyInArrow(scaled, "k int, log binary, scripts array<double>").toArrow()
    log, scripts = np.full((BUCKETS, len(languages)), -np.log(BUCKETS), np.float32), np.zeros((len(_SCRIPT_NAMES), len(languages)))
    for k, x, y in zip(got["k"].to_pylist(), got["log"], got["scripts"].to_pylist(), strict=True):
        log[:, k], scripts[:, k] = np.frombuffer(x.as_buffer(), "<f4"), y
    return Model(languages, log, scripts)


def predict(docs: DataFrame, model: Model, switch: float = SWITCH, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score; without `text` unless keep_text."""
    clear_of(docs, "lang_pred", "score")
    names = [c for c in docs.columns if keep_text or c != "text"]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Model = shared.value
        for batch in batches:
            for part in text_slices(batch):
                langs, scores = held.predict(part.column("text").to_pylist(), switch)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def spans(text: str, model: Model, switch: float = SWITCH) -> list[tuple[int, int, str]]:
    """(start, end, language) of the labelled stretches of one text, in code points."""
    words, out = Words([text]), []
    for a, b, k in zip((words.first - 1).tolist(), (words.end - 1).tolist(), model.label(words, switch).tolist(), strict=True):
        if out and out[-1][2] == model.languages[k]:
            out[-1] = (out[-1][0], b, out[-1][2])
        else:
            out.append((a, b, model.languages[k]))
    return out
