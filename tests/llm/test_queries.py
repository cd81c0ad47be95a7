"""The queries against their SQL, and that each is registered and runs."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry
from tallyspark.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(names) == sorted([f"op{i}" for i in range(1, 14)] + ["pipeline"])
    assert set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    ok, note = compare(spark, connect(FOLDER), FOLDER, name, queries.QUERIES[name], queries.SQL[name])
    assert ok, note


@pytest.mark.parametrize("name", ["op3_quality", "op9_decontamination"])
def test_native(spark, name):
    plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))
