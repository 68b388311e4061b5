"""Every query against DuckDB, and what its plan must not hold."""

from collections import Counter

import duckdb
import pytest

from gaugeworks.plans.oracles import ORACLES
from gaugeworks.plans.queries import QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    got = duckdb.connect()
    for t in ("events", "embeddings"):
        got.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return got


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(want)


@pytest.mark.parametrize("name", sorted({*QUERIES} - {*ORACLES}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_have_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name not in ("snapshot_csv", "snapshot_json", "snapshot_text"):  # one row on either side
        assert "NestedLoop" not in plan
    assert "BatchEvalPython" not in plan


def test_filters_reach_the_scan(spark):
    plan = QUERIES["flagship_status"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value,-1000.0)" in plan
    assert "props" not in plan


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert {*entry.oracle_sql()} <= {*entry.queries()}


def test_nothing_else_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "gaugeworks"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "gaugeworks.llm" in p.read_text()]
