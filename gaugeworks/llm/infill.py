"""Fill-in-middle: texts cut at drawn places and put in another order behind sentinels.

A kernel works on the UTF-8 buffer of a whole batch: a table gives each byte its class, a mask
over adjacent bytes tells where units begin, sums of the mask that start anew at each text
number the units, and one search places the cuts of all rows. Parts are then slices of the same
buffer, joined as columns. Units are code points, words (a run of white space and the run that
follows it) or lines (each with its end).

The draw of a row hangs on its key and a seed alone, so reruns and any partitioning agree. Texts
that hold a sentinel, and empty or null ones, stay plain. Rows with one key are cut alike; rows
with a null key are drawn as if it were empty. Batches are taken in slices of SLICE_BYTES of text;
a longer text is a slice of its own, of some ten bytes of work space for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._common import clear_of, text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
_ADDED = ("n_units", "form", "prefix_units", "middle_units", "output")


@dataclass(frozen=True)
class Units:
    """A class for each byte, and whether a unit begins at a byte of one class (column) behind one of another (row)."""

    classes: np.ndarray
    begins: np.ndarray


def _units(classes: dict[int, list[int]], begins: list[list[int]]) -> Units:
    table = np.zeros(256, np.uint8)
    for kind, members in classes.items():
        table[members] = kind
    return Units(table, np.array(begins, bool))


_CONTINUES = list(range(0x80, 0xC0))
#: Classes: 0 what starts a character, 1 a byte that continues one, 2 white space or, of lines, their end.
UNITS = {
    "chars": _units({1: _CONTINUES}, [[1, 0], [1, 0]]),
    "words": _units({1: _CONTINUES, 2: [*b"\t\n\v\f\r "]}, [[0, 0, 1], [0, 0, 1], [0, 0, 0]]),
    "lines": _units({2: [*b"\n"]}, [[0, 0, 0], [0, 0, 0], [1, 1, 1]]),
}


@dataclass(frozen=True)
class Recipe:
    """Which texts are cut (percent), and how many of those have the suffix first."""

    cut_percent: int = 90
    suffix_first_percent: int = 20
    seed: int = 1
    units: str = "chars"

    def __post_init__(self) -> None:
        if self.units not in UNITS:
            raise ValueError(f"no units {self.units}; there are {', '.join(UNITS)}")
        if not (0 <= self.cut_percent <= 100 and 0 <= self.suffix_first_percent <= 100):
            raise ValueError("shares are percents")

    def draws(self, key: Column) -> list[Column]:
        """Four unsigned 32-bit draws of a key: groups of eight digits of a SHA-256."""
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
        return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def parts(text: pa.Array, first: np.ndarray, second: np.ndarray, units: str = "chars") -> tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray]:
    """([prefix, middle, suffix] of all rows, their units, units of the prefixes, units of the middles).

    A text of n units is cut behind the smaller and the larger of first % (n + 1) and second % (n + 1).
    """
    kind = UNITS[units]
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if text.offset:
        text = pa.concat_arrays([text])
    rows = len(text)
    bounds = np.frombuffer(text.buffers()[1], np.int64, rows + 1)
    low = int(bounds[0])
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[low : int(bounds[-1])]
    bounds = bounds - low
    found = kind.classes[data]
    begins = np.zeros(len(data) + 1, bool)
    if len(data):
        begins[1:-1] = kind.begins[found[:-1], found[1:]]
        begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True  # whatever stands before a text
    # Units that begin before each byte, over the batch; less those before its text they start anew.
    sums = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(begins[:-1], out=sums[1:])
    before = sums[bounds[:-1]].astype(np.int64)
    n = sums[bounds[1:]] - before
    a, b = first % (n + 1), second % (n + 1)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    # The cut behind k units is where unit k + 1 begins, or where the text ends. Where several bytes
    # have a sum, the last of them is the one at which the next unit begins.
    cuts = np.searchsorted(sums, np.concatenate([before + lo, before + hi]), "right") - 1
    ends = np.concatenate([bounds[1:], bounds[1:]])
    cuts = np.where(np.concatenate([lo, hi]) >= np.concatenate([n, n]), ends, np.minimum(cuts, ends))
    edges = np.empty(3 * rows + 1, np.int64)
    edges[0::3], edges[1::3], edges[2::3] = bounds, cuts[:rows], cuts[rows:]
    every = pa.Array.from_buffers(pa.large_string(), 3 * rows, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    return [every.take(pa.array(np.arange(i, 3 * rows, 3))) for i in range(3)], n, lo, hi - lo


def transform(docs: DataFrame, recipe: Recipe | None = None, key: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """docs with n_units, form (plain, psm, spm), prefix_units and middle_units (null if plain) and output.

    psm is prefix, suffix, middle; spm is suffix, prefix, middle. Null texts give an empty output.
    """
    recipe = recipe or Recipe()
    draws = ("_h1", "_h2", "_h3", "_h4")
    clear_of(docs, *_ADDED, *draws)
    names = [c for c in docs.columns if keep_text or c != "text"]
    added = dict(zip(_ADDED, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()), strict=True))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(k, t) for k, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                h = [part.column(c).to_numpy(zero_copy_only=False) for c in draws]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *_transformed(part.column("text"), h, recipe)], schema.names)

    return docs.withColumns(dict(zip(draws, recipe.draws(F.col(key)), strict=True))).mapInArrow(run, schema)


def _transformed(text: pa.Array, h: list[np.ndarray], recipe: Recipe) -> list[pa.Array]:
    text = pc.fill_null(text.cast(pa.large_string()), "")
    (prefix, middle, suffix), n, lo, between = parts(text, h[0], h[1], recipe.units)
    marked = np.zeros(len(text), bool)
    for s in SENTINELS:
        marked |= pc.match_substring(text, s).to_numpy(zero_copy_only=False)
    plain = marked | (n == 0) | (h[2] % 100 >= recipe.cut_percent)
    form = np.where(plain, PLAIN, np.where(h[3] % 100 < recipe.suffix_first_percent, SPM, PSM)).astype(object)
    psm, spm = _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), _joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    output = pc.if_else(pa.array(plain), text, pc.if_else(pa.array(form == SPM), spm, psm))
    return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(lo, pa.int64(), mask=plain), pa.array(between, pa.int64(), mask=plain), output.cast(pa.string())]


def _joined(*columns: str | pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(c, pa.large_string()) if isinstance(c, str) else c for c in (*columns, "")))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form. No cut text holds a sentinel, so the first of each kind is the one that was put there.

    A part that ends like a sentinel's start can't form an earlier one: `<` begins a sentinel only.
    """
    of = lambda a, b: F.regexp_replace(output, f"(?s)^{a}(.*?){b}(.*?){MIDDLE}(.*)$", "$1$3$2" if a == PREFIX else "$2$3$1")
    return F.when(form == PSM, of(PREFIX, SUFFIX)).when(form == SPM, of(SUFFIX, PREFIX)).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
