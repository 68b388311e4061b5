"""The pipeline against a plain version of each stage."""

import re

import corpus_pipeline
from gaugeworks.llm import language, mixing, secrets
from tests.llm.test_simhash_near import all_pairs

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen.append((name, {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}))
        if name != "mixing":
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    model = language.fit(spark.createDataFrame(list(a.values())))
    langs, _ = model.predict([r.text for r in a.values()])
    assert {*b} == {i for i, lang in zip(a, langs, strict=True) if lang != "und"}
    assert len(b) >= 0.98 * len(a)
    assert {*c} == all_pairs({i: r.text for i, r in b.items()})[0]
    bench = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + min(10, len(w))]) for w in bench if w for i in range(len(w) - min(10, len(w)) + 1)}
    assert all(len(g) == 10 for g in grams)
    clean = {i for i, r in c.items() if not any(tuple((w := words(r.text))[k : k + 10]) in grams for k in range(len(words(r.text)) - 9))}
    assert {*d} == clean and len(clean) < len(c)
    assert {*e} == {*d} and all(e[i].text == secrets.mask(d[i].text) for i in d)
    assert sum(e[i].text != d[i].text for i in d) > 5 and all(e[i].n_chars == len(e[i].text) for i in e)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in e.items()}
    assert all(f[i].size == sizes[i] and f[i].taken == f[i].repeats * sizes[i] and f[i].repeats in (1, 2) for i in f)
    taken = sum(r.taken for r in f.values())
    assert abs(taken - mixing.SHARE * sum(sizes.values())) < 0.05 * taken


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 50 and "repeats" in got.columns


def test_odd_documents(spark):
    from tests.llm.test_documents import DOCS, ODD

    docs = spark.createDataFrame(ODD, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert name == "mixing" or docs.columns == [x.split()[0] for x in DOCS.split(", ")]
    assert sorted(r.doc_id for r in docs.collect() if r.doc_id) == [1, 4]
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
