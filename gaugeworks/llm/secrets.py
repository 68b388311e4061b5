"""Secret scans with multipart credential linking.

Base spans (leftmost, non-overlapping, per kind): assign, access and hex, as patterns below.
Linking adds weak candidates that mean nothing alone: a login name (`login`), an endpoint
(`endpoint`: scheme://host...) and a bare token (`bare`: 20 or more characters with letters of
both cases and a digit, or letters and digits alone with LEAST_DIGITS of them). A scope is a
paragraph, text between blank lines. Parts and scopes are intervals, and the join pairs the
parts that begin in one scope with at most `reach` code points between them (None: no bound).
A bare token is reported if it pairs with an identifier (access or login) or an endpoint; a
login or an endpoint if it pairs with a secret (assign, hex, or a reported bare token).
Candidates that overlap a base span are left out.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Every row is
scanned whole and alone, so ties, repeated rows and other columns don't matter.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._common import as_bytes, clear_of

KINDS = ("assign", "access", "hex", "login", "bare", "endpoint")
#: Code points between linked parts: a few lines of a settings file, not a page of prose. None: the scope alone
#: bounds them. On the test data either finds the same spans (README).
REACH: int | None = 200
#: Digits of a bare token of letters of one case.
LEAST_DIGITS = 4
MASK = "[SECRET]"
# Keywords are sought in text with A-Z lower-cased; non-ASCII bytes are in none of the classes.
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([a-z0-9+/_.=-]+)")
_KEYWORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_LOGIN = re.compile(rb"(?<![a-z0-9])(?:user(?:name)?|login|account|client_?id)[\"']? *[:=] *[\"']?([a-z0-9@+/_.-]{3,})")
_LOGIN_WORDS = (b"user", b"login", b"account", b"client")
_ENDPOINT = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'<>]+")
_TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
_BREAK = re.compile(rb"\n[ \t\r]*\n")

Span = tuple[int, int, str]


def base_spans(text: bytes) -> list[Span]:
    """Byte spans of the base kinds."""
    out: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(lower) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def linked_spans(text: bytes, base: list[Span], reach: int | None = REACH) -> list[Span]:
    """Byte spans of weak candidates whose complement stands in the same scope."""
    lower = text.lower()
    logins = [(m.start(1), m.end(1)) for m in _LOGIN.finditer(lower)] if any(k in lower for k in _LOGIN_WORDS) else []
    ends = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)] if b"://" in text else []
    access = [(a, b) for a, b, k in base if k == "access"]
    if not (logins or ends or access):
        return []
    strong = _merged([(a, b) for a, b, _ in base])
    logins, ends = ([s for s in spans if not _overlaps(s, strong)] for spans in (logins, ends))
    taken = _merged([*strong, *ends, *logins])
    bare = [m.span() for m in _TOKEN.finditer(text) if _random(m[0]) and not _overlaps(m.span(), taken)]
    if not (logins or ends or bare):
        return []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    between = _distance(text) if reach is not None else None
    bare = _paired(bare, access + logins + ends, breaks, reach, between)
    known = [(a, b) for a, b, k in base if k != "access"] + bare
    return [
        *((a, b, "login") for a, b in _paired(logins, known, breaks, reach, between)),
        *((a, b, "bare") for a, b in bare),
        *((a, b, "endpoint") for a, b in _paired(ends, known, breaks, reach, between)),
    ]


def _random(token: bytes) -> bool:
    """Whether a token looks drawn, not written."""
    digits = sum(48 <= c <= 57 for c in token)
    both = token.upper() != token and token.lower() != token
    return digits > 0 and (both or (digits >= LEAST_DIGITS and digits < len(token) and token.isalnum()))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same bytes as sorted spans that don't meet."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _overlaps(span: tuple[int, int], merged: list[tuple[int, int]]) -> bool:
    """Whether a span meets one of merged ones: only the last that begins before its end can."""
    i = bisect.bisect_left(merged, (span[1], 0))
    return i > 0 and merged[i - 1][1] > span[0]


def _distance(text: bytes) -> Callable[[int, int], int]:
    """Code points between two byte offsets."""
    if text.isascii():
        return lambda a, b: b - a
    starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(starts)])
    return lambda a, b: int(points[b] - points[a])


def _paired(spans: list[tuple[int, int]], others: list[tuple[int, int]], breaks: list[int], reach: int | None, between: Callable[[int, int], int] | None) -> list[tuple[int, int]]:
    """Interval join: the spans that begin in a scope with one of the others, within reach if there is one.

    Of a scope's others, in order, the last one that begins before the span's end and the furthest
    end of those up to it tell the distance before it; the next one tells that behind.
    """
    out, others, reached = [], sorted(others), []
    starts, scopes = [a for a, _ in others], [bisect.bisect_right(breaks, a) for a, _ in others]
    for i, (_, y) in enumerate(others):
        reached.append(max(y, reached[-1]) if i and scopes[i] == scopes[i - 1] else y)
    for a, b in spans:
        scope = bisect.bisect_right(breaks, a)
        i = bisect.bisect_left(starts, b)
        before, behind = i > 0 and scopes[i - 1] == scope, i < len(others) and scopes[i] == scope
        if reach is not None:
            before = before and (reached[i - 1] >= a or between(reached[i - 1], a) <= reach)
            behind = behind and between(b, starts[i]) <= reach
        if before or behind:
            out.append((a, b))
    return out


def find(text: bytes, reach: int | None = REACH) -> tuple[list[Span], list[Span]]:
    """(base, all) spans in code points, by start, then kind as listed."""
    base = base_spans(text)
    both = base + linked_spans(text, base, reach)
    if not both:
        return [], []
    if not text.isascii():
        at, n, where = 0, 0, {}
        for x in sorted({p for a, b, _ in both for p in (a, b)}):
            n += len(text[at:x].decode("utf-8", "ignore"))
            at, where[x] = x, n
        base, both = ([(where[a], where[b], k) for a, b, k in spans] for spans in (base, both))
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return sorted(base, key=order), sorted(both, key=order)


def scan(docs: DataFrame, reach: int | None = REACH, keep_text: bool = True) -> DataFrame:
    """docs with `base_spans` and `secret_spans`, arrays of (kind, start, end); without `text` unless keep_text."""
    clear_of(docs, "base_spans", "secret_spans")
    names = [c for c in docs.columns if keep_text or c != "text"]
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("base_spans", kind), T.StructField("secret_spans", kind)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]
        for batch in batches:
            found = [find(t, reach) for t in as_bytes(batch)]
            cols = [pa.array([rows(x[i]) for x in found], arrow) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], [*names, "base_spans", "secret_spans"])

    return docs.mapInArrow(run, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS[:3]]
    return scanned.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("secret_spans").alias("spans"))


def redact(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """All documents; every span in `text` is replaced by a mask, and `n_chars`, if there, follows."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else mask(t, reach) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def mask(text: str, reach: int | None = REACH) -> str:
    spans, out, last = find(text.encode(), reach)[1], [], 0
    for a, b, _ in spans:
        if b > last:
            out += [text[last:a], MASK] if a >= last else []
            last = b
    return "".join([*out, text[last:]]) if spans else text
