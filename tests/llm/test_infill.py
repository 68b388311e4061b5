import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.llm import infill

TEXTS = st.lists(st.one_of(st.none(), st.text("ab <>PSM\n\té中😀", max_size=30)), max_size=12)


def plain_units(text, units):
    if units == "chars":
        return list(text)
    if units == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"[\t\n\v\f\r ]+[^\t\n\v\f\r ]*|^[^\t\n\v\f\r ]+", text)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from(sorted(infill.UNITS)), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts(texts, units, x, y):
    h = [np.arange(len(texts)) * 977 + x, np.arange(len(texts)) * 31 + y]
    array = pa.array(["é", *texts, "z"], pa.string()).slice(1, len(texts))  # a slice, so offsets don't start at 0
    (prefix, middle, suffix), n, lo, between = infill.parts(array, *h, units)
    for i, text in enumerate(texts):
        whole = plain_units(text or "", units)
        a, b = sorted(int(v[i]) % (len(whole) + 1) for v in h)
        assert (n[i], lo[i], between[i]) == (len(whole), a, b - a)
        assert [p[i].as_py() for p in (prefix, middle, suffix)] == ["".join(whole[:a]), "".join(whole[a:b]), "".join(whole[b:])]


ROWS = [(1, "héllo wörld"), (2, None), (3, ""), (4, "has <S> inside"), (5, "a<"), (5, "a<"), (None, "<P"), (6, "中😀<M" * 40), (7, "\n"), (8, "x" * 300_000)]


@pytest.mark.parametrize("recipe", [infill.Recipe(100, 0), infill.Recipe(100, 100), infill.Recipe(0), infill.Recipe(100, 50, 7, "words"), infill.Recipe(100, 50, 7, "lines")])
def test_round_trip(spark, recipe):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = infill.transform(docs, recipe).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id is None, r.doc_id), r.back) for r in got) == sorted(((i is None, i), t or "") for i, t in ROWS)
    for r in got:
        plain = not r.text or any(s in r.text for s in infill.SENTINELS) or recipe.cut_percent == 0
        assert (r.form == infill.PLAIN) == plain and (r.prefix_units is None) == plain and (r.middle_units is None) == plain
        if not plain:
            assert r.form == (infill.SPM if recipe.suffix_first_percent == 100 else infill.PSM if recipe.suffix_first_percent == 0 else r.form)
            assert r.output.startswith(infill.PREFIX if r.form == infill.PSM else infill.SUFFIX)


def test_empty_table_and_clashes(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert infill.transform(docs).columns == ["doc_id", "text", "extra", "n_units", "form", "prefix_units", "middle_units", "output"]
    assert infill.transform(docs).count() == 0
    with pytest.raises(ValueError, match="form"):
        infill.transform(docs.withColumnRenamed("extra", "form"))
    with pytest.raises(ValueError, match="units"):
        infill.Recipe(units="bytes")
