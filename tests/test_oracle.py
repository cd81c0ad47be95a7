"""Every query of the catalog against its SQL on the smallest tables, and no plan with row-wise Python or a cross product."""

import duckdb  # noqa: F401
import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.QUERIES
SQL = {n: sql for n, sql in entry.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        ok, note = compare(spark, con, FOLDER, name, QUERIES[name], SQL[name])
        assert ok, note
    plan = plan_text(QUERIES[name](spark, FOLDER))
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, f"{node} in the plan of {name}"
    spark.catalog.clearCache()


def test_entry_is_the_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "cpm_usd" in df.columns


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_text(QUERIES["f03_filter_years"](spark, FOLDER))
    assert "PushedFilters: [Or(" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]
    plan = plan_text(QUERIES["m01_kpi_brand"](spark, FOLDER))
    assert "l_comment" not in plan and "p_retailprice" not in plan
