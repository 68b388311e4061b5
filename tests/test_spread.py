"""Spread forms equal the plain ones: frames over many cells, all outputs of a Kalman filter."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import folds, ordered
from gaugeworks.operators.ordered import Stream


@pytest.mark.parametrize("size", [1, 8, 9, 10, 20, 100])
def test_frames_longer_than_cells(spark, monkeypatch, size):
    monkeypatch.setattr(ordered, "CELL", 8)
    rows = spark.createDataFrame([(i, float(i * i % 17)) for i in range(40)], "seq long, value double").repartition(3)
    plain, spread = (ordered.framed(rows, Stream((), ("seq",), s), size, total=F.sum("value"), n=F.count(F.lit(1))).orderBy("seq").collect() for s in (False, True))
    assert plain == spread


@pytest.mark.parametrize("q", [0.01, 0.0])
@pytest.mark.parametrize("first_null", [True, False])
def test_kalman_outputs(spark, q, first_null):
    rnd = random.Random(4)
    rows = [(k, i, None if rnd.random() < 0.2 or (first_null and i < 3) else rnd.gauss(5, 1)) for k in ("a", "b") for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, seq long, value double").repartition(4)
    fold = folds.Kalman(("value",), {"est": "double", "cov": "double", "gain": "double"}, q=q)
    plain, spread = (folds.folded(frame, Stream(("k",), ("seq",), s), fold).orderBy("k", "seq").collect() for s in (False, True))
    for a, b in zip(plain, spread, strict=True):
        assert (a.k, a.seq, a.value) == (b.k, b.seq, b.value)
        assert all((x is None and y is None) or x == pytest.approx(y, rel=1e-9) for x, y in zip(a[3:], b[3:], strict=True)), (a, b)


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 2.0)], "seq long, count double")
    with pytest.raises(ValueError, match="count"):
        ordered.running_status(rows, Stream(), "count")
