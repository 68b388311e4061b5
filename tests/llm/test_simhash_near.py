"""The near-dedup stage of the pipeline against all pairs."""

import random
import re

import corpus_pipeline
from gaugeworks.llm import simhash_near

SF = "/root/testdata/sf0.01"


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def all_pairs(texts):
    """(the first id of each class, the number of links of different sets) by comparing all pairs."""
    sets, root, links = {i: five_words(t) for i, t in texts.items()}, {i: i for i in texts}, 0
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links += sets[i] != sets[j]
                a, b = sorted((root[i], root[j]))
                root = {n: a if r == b else r for n, r in root.items()}
    return {*root.values()}, links


def kept(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}


def test_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want, links = all_pairs(texts)
    assert links >= 12
    assert kept(spark, texts) == want


def test_edited_copies_and_common_passages(spark, monkeypatch):
    monkeypatch.setattr(simhash_near, "COMMON", 40)
    rnd, texts = random.Random(5), {}
    word = lambda: f"w{rnd.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    for _ in range(8):
        base = [word() for _ in range(rnd.randrange(5, 200))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randrange(5)):
                copy[rnd.randrange(len(copy))] = word()
            texts[len(texts)] = " ".join(copy)
    for _ in range(60):
        texts[len(texts)] = " ".join(passage + [word() for _ in range(rnd.randrange(10, 60))])
    texts |= {1000: None, 1001: "", 1002: "a b", 1003: "A  b", 1004: "a b c"}
    want, links = all_pairs(texts)
    assert links > 20 and kept(spark, texts) == want


def test_blocks_and_copies(spark, monkeypatch):
    """Many texts of one passage, in blocks smaller than the group, with a text copied for its partners."""
    for name, value in (("BLOCK", 8), ("COPIES", 3), ("COMMON", 10**6)):
        monkeypatch.setattr(simhash_near, name, value)
    rnd, texts = random.Random(8), {}
    word = lambda: f"v{rnd.randrange(10**6)}"
    passage = [word() for _ in range(100)]
    for _ in range(50):
        texts[len(texts)] = " ".join(passage[: rnd.randrange(60, 101)] + [word() for _ in range(rnd.randrange(25))])
    want, links = all_pairs(texts)
    assert links > 20 and 1 < len(want) < 50
    assert kept(spark, texts) == want


def test_ring_loses_no_near_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (5, 6, 10, 50, 400):
        for _ in range(200):
            base = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            gone = (n - -(-4 * n // 5)) // 2
            other = np.unique(np.concatenate([base[gone:], rng.integers(0, 1 << 64, gone, dtype=np.uint64)])) if gone else base[1:]
            assert simhash_near.near(base, other) or n < 6
            f, g = (np.array(simhash_near.fingerprint(x), dtype=np.uint64) for x in (base, other))
            assert simhash_near.within_ring((f ^ g)[None, :]).all()


def test_swapped_nulls_and_maps(spark):
    rows = [(1, "one two three four five six", None, {"a": 1}), (2, None, "one two three four five six", {"a": 1}), (3, "seven eight nine ten eleven", None, None)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, m map<string,int>")
    got = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == rows
    same = spark.createDataFrame([(7, "a b c", {"x": 1}), (7, "a b c", {"x": 2})], "doc_id long, text string, m map<string,int>")
    assert corpus_pipeline.near_dedup(spark, same, SF).count() == 1
    deep = spark.createDataFrame([(1, None, ({"x": 1}, [None, 1])), (1, None, ({"x": 1}, [1, None]))], "doc_id long, text string, s struct<m:map<string,int>,l:array<int>>")
    assert corpus_pipeline.near_dedup(spark, deep, SF).count() == 1


def test_shingles_of_two_texts(spark):
    """A pair that only a shingle of two texts brings together is a candidate, whatever is closest to its ends."""
    groups = spark.createDataFrame([(i, 50, 0, i, bytearray(64)) for i in (1, 2, 3)], "sig long, n long, f0 long, f1 long, parity binary")
    rows = spark.createDataFrame([(7, 1), (7, 3), (8, 1), (8, 3), (9, 2), (9, 3), (10, 1), (10, 2), (10, 3), (11, 2)], "h long, sig long")
    assert sorted(tuple(r) for r in simhash_near._twos(rows, groups).collect()) == [(1, 3, 1), (2, 3, 1)]
