"""The language stage keeps clean texts that mix languages."""

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_three_languages_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, by = docs.filter("lang is not null").orderBy("doc_id").collect(), {}
    for r in rows:
        by.setdefault(r.lang, "")
        by[r.lang] += " " + r.text[:3000]
    mixed = " ".join(text[:6000] for _, text in sorted(by.items())[:4])
    more = spark.createDataFrame([rows[0].asDict() | {"doc_id": -1, "text": mixed}, rows[0].asDict() | {"doc_id": -2, "text": "123 !!"}], docs.schema)
    got = {r.doc_id for r in corpus_pipeline.identify(spark, docs.unionByName(more), SF).select("doc_id").collect()}
    assert -1 in got and -2 not in got
