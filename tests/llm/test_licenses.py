"""License scans against a plain scan: every place of every template, word by word."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import licenses
from gaugeworks.llm.licenses import BASE, PARAGRAPHS, TEMPLATES, Template

MIT, BSD = PARAGRAPHS[0].text, PARAGRAPHS[2].text
SPACED = "Released\n under THE mit--License!"


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text, templates=TEMPLATES):
    """(label, base, start, end, share) of a text, without grams: all diagonals, those that share a gram merged."""
    words, out = plain_words(text), []
    for t in templates:
        template, k = [w.decode() for w in t.words], t.gram
        voted = {}
        for d in range(-len(template), len(words)):
            n = sum(d + p >= 0 and words[d + p : d + p + k] == template[p : p + k] for p in range(len(template) - k + 1))
            if n:
                voted[d] = n
        groups = []
        for d in sorted(voted):
            if groups and d - groups[-1][-1] <= t.slack:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            if sum(voted[d] for d in g) < t.votes:
                continue
            met = {(p, d + p) for d in g for p in range(len(template)) if 0 <= d + p < len(words) and words[d + p] == template[p]}
            share = len({p for p, _ in met}) / len(template)
            if share >= t.share:
                out.append((t.label, t.base, min(w for _, w in met), max(w for _, w in met) + 1, share))
    return sorted(out, key=lambda s: (s[2], s[3], s[0], s[1]))


def edited(text, seed, rate=0.04):
    """Words changed, dropped and put in."""
    rng, out = random.Random(seed), []
    for w in text.split():
        x = rng.random()
        out += [] if x < rate / 3 else [w, "extra"] if x < 2 * rate / 3 else ["other"] if x < rate else [w]
    return " ".join(out)


TEXTS = [
    None, "", " ", "mit", "mit license", "MIT License, mit license. The MIT license", "permit license", "GNU General Public License and general public licenses", SPACED,
    "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.1.", "This work is licensed under the GNU General Public License, version 3.", "ñmit license", "mit licenseé",
    f"head {MIT} tail {MIT}", *(f"some prose before {edited(MIT, i)} and behind" for i in range(6)), *(edited(BSD, i, 0.15) for i in range(4)), " ".join(MIT.split()[:25]), "mit license " * 300, (MIT + " ") * 20,
]


def frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, "mit license", "x"), (4, "mit license", "x"), (None, MIT, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(5)


def test_against_plain_scan(spark):
    got = licenses.scan(frame(spark)).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        assert r.n_words == len(plain_words(r.text)), r.text
        assert [tuple(s) for s in r.license_spans] == plain(r.text), r.text
    shares = [s.share for r in got for s in r.license_spans if s.label == "mit-text"]
    assert max(shares) == 1 and any(0.8 <= s < 1 for s in shares)  # edits were met, across merged diagonals


def test_digest(spark):
    rows = {r.doc_id: r for r in licenses.digest(licenses.scan(frame(spark), keep_text=False)).collect()}
    assert (rows[5].n_base, rows[5].first_word, rows[5].last_word, rows[5].base_labels, rows[5].labels, rows[5].score) == (3, 0, 5, "mit", "mit", 1.0)
    assert rows[9].labels == "apache,apache-2.0" and rows[10].labels == "apache" and rows[11].labels == "gpl,gpl-3.0"
    assert rows[0].n_words == 0 and rows[0].labels == "" and rows[0].first_word is None and rows[0].score == 0


def test_without_broadcast(spark, monkeypatch):
    want = licenses.scan(frame(spark)).orderBy("doc_id", "text").collect()
    monkeypatch.setattr(licenses, "BROADCAST_GRAMS", 3)
    assert licenses.scan(frame(spark)).orderBy("doc_id", "text").collect() == want


def test_planted_in_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.concat("text", F.lit("\n" + MIT)).alias("text")).limit(20)
    for r in licenses.scan(docs).collect():
        assert [tuple(s) for s in r.license_spans] == plain(r.text)


def test_empty_table_clashes_and_templates(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_words int")
    assert licenses.scan(docs.drop("n_words")).count() == 0
    with pytest.raises(ValueError, match="n_words"):
        licenses.scan(docs)
    with pytest.raises(ValueError, match="words"):
        Template("one", "license")
    assert all(t.votes == len(t.words) - 1 and t.slack == 0 for t in BASE)
