"""Alignment against the tokenizers' own output, compared token by token."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeworks.llm import alignment

FILES = alignment.Tokenizers()
ODD = "ab c  d\n\t'sS1é中😀!?\xa0　\x1c\x85 "


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(FILES.byte_bpe)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES.piece_bpe)


def plain(text, coders):
    """(A ids, B ids, groups as lists of places, overlapping places) of one text, by brute force."""
    a, b = coders
    ids = [a.encode(f" {text}", add_special_tokens=False).ids if text else [], b.encode(text) if text else []]
    of = alignment.byte_characters()
    raw = [[bytes(of[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids[1])]]
    if not text or any(b"".join(r) != f" {text}".encode() for r in raw):
        return [], [], [], []
    spans = []
    for side in raw:
        at, out = 0, []
        for t in side:
            out.append((at, at + len(t)))
            at += len(t)
        spans.append(out)
    links = [(i, j) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if p < s and r < q]
    ends = sorted({y for _, y in spans[0]} & {y for _, y in spans[1]})
    groups, low = [], 0
    for end in ends:
        groups.append([[i for i, (_, y) in enumerate(side) if low < y <= end] for side in spans])
        low = end
    return *ids, groups, links


def plain_rows(rows, coders):
    found = [plain(t, coders) for _, t in rows]
    counts = Counter(p for a, b, _, links in found for p in {(a[i], b[j]) for i, j in links})
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (doc, _), (a, b, groups, links) in zip(rows, found, strict=True):
        told = ";".join(",".join(str(a[i]) for i in g[0]) + "|" + ",".join(str(b[j]) for j in g[1]) for g in groups)
        each = [counts[a[i], b[j]] for i, j in links]
        best = sum(counts[a[i], b[j]] == most[a[i]] for i, j in links)
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(each), hashlib.sha256(told.encode()).hexdigest() if a else ""))
    return out


ROWS = [
    (1, "The quick brown fox don't jump."), (2, "The quick brown fox"), (3, None), (4, ""), (5, " "), (6, "a  b "), (7, "lower ▁ one eighth block"), (8, "<|endoftext|> <s> </s> <0x41>"),
    (9, "中文 😀 naïve  café x　y"), (10, "\n\n\t \r\n z"), (11, "\x00 nul"), (12, "aaaa " * 60), (12, "aaaa " * 60), (13, "The quick"), (None, "The quick brown"), (14, "x" * 3000),
]


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, coders, parts):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(parts)
    got = sorted(map(tuple, alignment.digest(alignment.align(docs)).collect()), key=str)
    assert got == sorted(plain_rows(ROWS, coders), key=str)


def test_documents(spark, coders):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect() if len(r.text or "") < 1500][:60]
    some = spark.createDataFrame(rows, docs.schema)
    assert sorted(map(tuple, alignment.digest(alignment.align(some)).collect())) == sorted(plain_rows(rows, coders))


@pytest.mark.parametrize("slice_bytes", [64, 1 << 22])
def test_long_texts_in_windows(spark, coders, monkeypatch, slice_bytes):
    """A text taken in windows, in chunks with others, gives what it gives as a whole."""
    monkeypatch.setattr(alignment, "SLICE_BYTES", slice_bytes)
    known, text = alignment._segments(FILES), "the cat sat on the mat, naïve the  cat " * 40
    chunk = alignment.Chunk(known)
    chunk.add(pa.array([text, None, "the cat", "bad ▁ one " + text]))
    out = chunk.ended()
    [(_, *sums, _, _, sha)] = plain_rows([(1, text)], coders)
    assert out["counts"][0].tolist() == sums and out["sha"][0] == sha
    assert out["counts"][1].tolist() == out["counts"][3].tolist() == [0] * 4 and out["sha"][3] == ""
    assert alignment._unpacked(out["times"])[: out["pairs"][0]].sum() == sums[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(ODD, max_size=60))
def test_segments_encode_like_the_text(text):
    known = alignment._segments(FILES)
    segments = alignment.segmented(pa.array([text]))[0].to_pylist()
    assert "".join(segments) == (f" {text}" if text else "")
    wanted = (known.sides[0].whole.encode(f" {text}", add_special_tokens=False).ids if text else [], known.sides[1].whole.encode(text))
    assert tuple([i for x in side.encode(segments) for i in x] for side in known.sides) == wanted


def test_alignments(spark, coders):
    text = "The café don't"
    a, b, groups, links = plain(text, coders)
    docs = spark.createDataFrame([(1, text, 5), (2, None, 6)], "doc_id long, text string, extra int")
    [one, none] = sorted(alignment.alignments(docs).collect())
    assert (one.a_ids, one.b_ids, sorted(map(tuple, one.links))) == (a, b, sorted(links)) and none.links == none.a_ids == []
    assert one.a_groups == [k for k, g in enumerate(groups) for _ in g[0]] and one.b_groups == [k for k, g in enumerate(groups) for _ in g[1]]
    every = alignment.alignments(docs, kind="product").filter("doc_id = 1").first().links
    assert sorted(map(tuple, every)) == sorted((i, j) for g in groups for i in g[0] for j in g[1])


def test_empty_table_and_clashes(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_a int")
    assert alignment.align(docs.drop("n_a")).count() == 0
    with pytest.raises(ValueError, match="n_a"):
        alignment.align(docs)
    with pytest.raises(ValueError, match="kind"):
        alignment.alignments(docs, kind="other")
