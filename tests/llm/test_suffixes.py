import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from gaugeworks.llm import queries, suffixes

L = suffixes.LENGTH


def brute(rows):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} by a table of all strings of L bytes."""
    least = {}
    for i, t in rows:
        if i is not None:
            for p in range(len(t) - L + 1):
                g = t[p : p + L]
                if least.get(g, i) >= i:
                    least[g] = i
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, dtype=int)
        for p in range(len(t) - L + 1):
            if i is not None and least[t[p : p + L]] < i:
                gone[p] += 1
                gone[p + L - 1 + 1] -= 1
        mask = np.cumsum(gone[:-1]) > 0 if len(t) else np.zeros(0, bool)
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
        spans = int(np.sum(np.diff(np.concatenate([[0], mask.astype(int)])) == 1))
        out.append((i, len(t), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op10_suffixes(spark, sf).collect()), key=str)
    want = brute(rows)
    assert got == want
    assert sum(x[2] for x in want) > 10_000


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed):
    rnd = random.Random(seed)
    source = "".join(rnd.choice("ab é\n") for _ in range(400)) + "x" * 200 + "ab" * 100
    rows = []
    for i in range(60):
        parts = [source[a : a + rnd.randrange(20, 150)] for a in (rnd.randrange(len(source)) for _ in range(rnd.randrange(4)))]
        rows.append((rnd.choice([i, i, i, 7, None]), "".join(parts)))
    rows += [(100, None), (101, ""), (102, source * 3), (102, source * 3), (3, source), (99, "z" * 49), (98, "z" * 49), (97, "z" * 50), (96, "z" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, suffixes.digest(suffixes.dedup(docs, chunk_bytes=2000)).collect()), key=str)
    assert got == brute([(i, (t or "").encode()) for i, t in rows])


def test_long_text_in_steps(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "STEP", 512)
    text = bytes(np.random.default_rng(1).integers(97, 123, 5000, dtype=np.uint8))
    w = suffixes.Windows(np.frombuffer(text * 2, np.uint8), np.array([0, 5000, 10_000]))
    assert w.count.sum() == 2 * (5000 - L + 1)
    assert w.count.max() <= L - suffixes.K + 1


def test_empty(spark):
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_bytes(spark):
    a = "The first sentence is shared by both of these documents, all of it."
    cut = {r.doc_id: bytes(r.kept) for r in suffixes.dedup(spark.createDataFrame([(2, a + " Two."), (1, a)], "doc_id long, text string")).collect()}
    assert cut == {1: a.encode(), 2: b" Two."}


def brute_lpf(texts):
    """{(document, position): longest prefix that also starts in an earlier document}."""
    out = {}
    for d, t in enumerate(texts):
        for p in range(len(t)):
            out[d, p] = max((k for k in range(1, len(t) - p + 1) if any(t[p : p + k] in x for x in texts[:d])), default=0)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_longest_previous_factors(seed):
    rnd, size = random.Random(seed), 12
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 12))) for _ in range(8)]
    # A pad byte of its own ends each text, so no match crosses it.
    data, at, doc, place = b"", [], [], []
    for d, t in enumerate(texts):
        place += [(d, p) for p in range(len(t))]
        at += [len(data) + p for p in range(len(t))]
        doc += [d] * len(t)
        data += t + bytes([128 + d]) * 24
    order, common = suffixes.suffix_order(np.frombuffer(data, np.uint8), np.array(at), np.zeros(len(at), np.int64), size)
    of = [data[at[i] : at[i] + size] for i in order]
    assert of == sorted(of)
    for i in range(1, len(of)):
        assert common[i] == next((k for k in range(size) if of[i][k] != of[i - 1][k]), size)
    got = suffixes.longest_previous(common, np.array(doc)[order])
    want = brute_lpf(texts)
    assert {place[i]: n for i, n in zip(order.tolist(), got.tolist(), strict=True)} == want


@pytest.mark.parametrize("hot", [1, 40])
def test_boilerplate_with_differing_neighbours(spark, hot):
    rnd = random.Random(7)
    line = "all rights reserved by the publisher of this page"
    words = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) for _ in range(n))
    rows = [(i, f"{words(9)} {line if i % 10 == 0 or i < 30 else ''} {words(9)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, suffixes.digest(suffixes.dedup(docs, chunk_bytes=3000, hot=hot)).collect()), key=str)
    assert got == brute([(i, t.encode()) for i, t in rows])


@pytest.mark.parametrize("hot", [2, 1 << 14])
@pytest.mark.parametrize("same", ["hash", "anchor", "both"])
def test_colliding_hashes(tmp_path, monkeypatch, hot, same):
    class Colliding(suffixes.Windows):
        def __init__(self, *args):
            super().__init__(*args)
            for name in ("hash", "anchor") if same == "both" else (same,):
                setattr(self, name, np.zeros_like(getattr(self, name)))

    monkeypatch.setattr(suffixes, "Windows", Colliding)
    monkeypatch.setattr(suffixes, "SORTED", 300)
    rnd, buckets = random.Random(3), 4
    source = bytes(rnd.choice(b"abcdefgh ") for _ in range(900))
    rows = [(i, b"".join(source[a : a + rnd.randrange(30, 130)] for a in (rnd.randrange(800) for _ in range(3)))) for i in range(24)]
    files = []
    for k in range(3):
        path = tmp_path / str(k)
        path.write_bytes(suffixes.Chunk.packed(*map(list, zip(*rows[k::3], strict=True))))
        files.append(pa.table({"chunk": [k], "path": [f"file://{path}"]}))

    def by(column, tables):
        whole = pa.concat_tables(tables)
        return {k: whole.filter(pa.compute.equal(whole[column], k)) for k in set(whole[column].to_pylist())}

    sent = [pa.Table.from_batches([b]) for f in files for b in suffixes._sent(buckets)(f.to_batches())]
    answers = by("chunk", [suffixes._answered(hot)(g) for g in by("bucket", sent).values()])
    entries = [suffixes._asked(buckets)(files[k], answers[k]) for k in range(3)]
    matches = by("chunk", [suffixes._matched(g) for g in by("bucket", entries).values()])
    cut = pa.concat_tables([suffixes._cut(buckets, False)(files[k], pa.concat_tables([answers[k], matches[k]])) for k in range(3)]).to_pylist()
    got = sorted([(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), r["kept_sha256"]) for r in cut], key=str)
    assert got == brute(rows)
    assert sum(x[2] for x in got) > 500
