"""License scans by diagonal voting.

Templates are phrases, which stand whole or not at all, and texts, of which a share must stand.
All rolling word grams of the documents (of two words, and of five for templates that have as
many) are joined by hash to their places in the templates. A match votes for its diagonal, the
word of the document at which the template would begin; neighbouring diagonals, which insertions
and deletions shift apart, are merged. What stands on them is then verified word by word, so a
hash collision costs a look and changes nothing.

Words are runs of 0-9, a-z (after lower-casing A-Z) and non-ASCII characters; offsets are words
from 0, ends exclusive. Null and empty texts have no words and no spans. Repeated rows have equal
spans. Votes of a row are told apart from those of its repeats, and only rows that may have
candidates are dealt. The template grams are broadcast up to BROADCAST_GRAMS of them; beyond that
Spark joins them as it joins any table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._common import as_bytes, clear_of, keyed, materialize, sieve, text_slices
from gaugeworks.llm.decontaminate import FOLD, _hashed, _rolling

SHORT, LONG = 2, 5
#: Words between merged diagonals at most, and the words of a template for each of them.
SLACK, WORDS_A_SLACK = 8, 8
BROADCAST_GRAMS = 1 << 20
#: One word or more of the documents, before A-Z are lower-cased.
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OTHERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPANS = "array<struct<label:string,base:boolean,start:bigint,end:bigint,share:double>>"


@dataclass(frozen=True)
class Template:
    """share: of the words that must stand; base: a phrase whose places are counted."""

    label: str
    text: str
    share: float = 0.8
    base: bool = False

    def __post_init__(self) -> None:
        if len(self.words) < SHORT:
            raise ValueError(f"a template has {SHORT} words at least")
        if not 0 < self.share <= 1:
            raise ValueError("a share is above 0 and at most 1")

    @property
    def words(self) -> list[bytes]:
        return self.text.encode().translate(FOLD).split()

    @property
    def gram(self) -> int:
        return SHORT if self.base or len(self.words) < LONG else LONG

    @property
    def slack(self) -> int:
        return 0 if self.share == 1 else min(SLACK, len(self.words) // WORDS_A_SLACK)

    @property
    def votes(self) -> int:
        """Votes that a candidate needs: all grams of what must stand whole, else one."""
        return len(self.words) - self.gram + 1 if self.share == 1 else 1


#: The phrases of the base scan.
BASE = (Template("mit", "mit license", 1, True), Template("apache", "apache license", 1, True), Template("gpl", "general public license", 1, True))
#: Notices, which name a version and so must stand whole.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", 1),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", 1),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", 1),
    Template("mit-notice", "released under the mit license", 1),
    Template("mit-notice", "licensed under the mit license", 1),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", 1),
)
#: Paragraphs of the licenses themselves.
PARAGRAPHS = (
    Template(
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions",
    ),
    Template("isc-text", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    Template("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    Template("gpl-text", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("public-domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
TEMPLATES = (*BASE, *NOTICES, *PARAGRAPHS)


def grams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, offsets by text) of the hashes of all rolling grams of SHORT and of LONG words."""
    words = [t.translate(FOLD).split() for t in texts]
    # A word of no text ends each one; grams that reach over it are left out.
    flat = np.concatenate([np.append(_hashed(w), np.uint64(0)) for w in words]) if words else np.zeros(0, np.uint64)
    counts = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(counts + 1) - (counts + 1)
    rolled, out = _rolling(flat, [SHORT, LONG], LONG), []
    for size in (SHORT, LONG):
        n = np.maximum(counts - size + 1, 0)
        offsets = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(starts - offsets[:-1], n) + np.arange(int(offsets[-1]))
        out.append((rolled[size][place].view(np.int64) if len(place) else np.zeros(0, np.int64), offsets))
    return out


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """gram, size, template (its number), place and what its candidates are judged by: a row for each gram of each template."""
    rows = []
    for number, t in enumerate(templates):
        values, _ = grams([t.text.encode()])[0 if t.gram == SHORT else 1]
        rows += [(int(g), t.gram, number, place, t.slack, t.votes) for place, g in enumerate(values.tolist())]
    table = spark.createDataFrame(rows, "gram long, size int, template int, place long, slack int, needed long")
    return F.broadcast(table) if len(rows) <= BROADCAST_GRAMS else table


def _grams_of(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named columns and the grams of text, as lists."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("short", longs), T.StructField("long", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v)) for v, o in grams(as_bytes(part))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *lists], schema.names)

    return rows.mapInArrow(run, schema)


def candidates(whole: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """Of keyed rows, those with merged diagonals that have the votes: _k1, _k2, found (template, diagonals)."""
    keys = ["_k1", "_k2"]
    rows = whole.select(*keys, "text").withColumn("_row", F.monotonically_increasing_id())
    every = _grams_of(rows, [*keys, "_row"]).select(*keys, "_row", F.size("short").alias("_shorts"), F.posexplode(F.concat("short", "long")).alias("_at", "gram"))
    met = every.join(template_grams(whole.sparkSession, templates), "gram").withColumn("_at", F.col("_at") - F.when(F.col("_at") >= F.col("_shorts"), F.col("_shorts")).otherwise(0))
    stream = [*keys, "_row", "template"]
    votes = met.groupBy(*stream, (F.col("_at") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.first("slack").alias("slack"), F.first("needed").alias("needed"))
    ordered = Window.partitionBy(*stream).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(ordered) > F.col("slack"), F.lit(True))
    merged = votes.withColumn("_apart", apart.cast("int")).withColumn("_group", F.sum("_apart").over(ordered))
    merged = merged.groupBy(*stream, "_group").agg(F.sum("votes").alias("votes"), F.first("needed").alias("needed"), F.sort_array(F.collect_list("diagonal")).alias("diagonals")).filter("votes >= needed")
    return merged.groupBy(*keys).agg(F.collect_set(F.struct("template", "diagonals")).alias("found"))


def verified(words: list[bytes], template: list[bytes], diagonals: list[int]) -> tuple[float, int, int]:
    """(share of the template's words that stand on one of the diagonals, first word, end)."""
    met, at = set(), []
    for d in diagonals:
        for t in range(max(0, -d), min(len(template), len(words) - d)):
            if words[d + t] == template[t]:
                met.add(t)
                at.append(d + t)
    return len(met) / len(template), min(at, default=0), max(at, default=-1) + 1


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, keep_text: bool = True) -> DataFrame:
    """docs with n_words and license_spans (label, base, start, end, share; by start, end, label); without text unless keep_text."""
    clear_of(docs, "n_words", "license_spans", "found", "_maybe", "_word", "_bits", "_row")
    names = [c for c in docs.columns if keep_text or c != "text"]
    whole, keys = keyed(docs), ["_k1", "_k2"]
    told = materialize(candidates(whole, templates), "licenses")
    state = sieve(whole, told)
    met = state.filter("_maybe").join(told.hint("shuffle_hash"), keys, "left").select(*docs.columns, "found")
    none = state.filter("not _maybe").select(*names, _count_words().alias("n_words"), F.array().cast(_SPANS).alias("license_spans"))
    return none.unionByName(_verify(met, names, templates))


def _count_words() -> Column:
    """Words of text, natively: each becomes one letter and the rest goes."""
    letters = F.regexp_replace(F.regexp_replace("text", _WORDS, "w"), _OTHERS, "")
    return F.coalesce(F.char_length(letters), F.lit(0)).cast("long")


def _verify(rows: DataFrame, names: list[str], templates: tuple[Template, ...]) -> DataFrame:
    schema = rows.select(*names, F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("license_spans")).schema
    known = [(t.label, t.base, t.share, t.words) for t in templates]
    arrow = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def spans(words: list[bytes], found: list[dict] | None) -> list[dict]:
        out = []
        for f in found or ():
            label, base, least, template = known[f["template"]]
            share, start, end = verified(words, template, f["diagonals"])
            if share >= least:
                out.append({"label": label, "base": base, "start": start, "end": end, "share": share})
        return sorted(out, key=lambda s: (s["start"], s["end"], s["label"], s["base"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.translate(FOLD).split() for t in as_bytes(batch)]
            found = [spans(w, f) for w, f in zip(words, batch.column("found").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([len(w) for w in words], pa.int64()), pa.array(found, arrow)], schema.names)

    return rows.mapInArrow(run, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns; score is the highest share of a template that stands (a phrase's is 1), 0 without one."""
    base = F.filter("license_spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels("license_spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("license_spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
