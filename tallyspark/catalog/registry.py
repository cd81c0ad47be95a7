"""Named queries: each pairs a DataFrame plan with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..plans.bindings import Views


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Views], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return finish(self.plan(Views(spark, folder)))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None) -> Callable:
    """Register a plan under a name. ``sql`` is None where no SQL can state the result."""

    def register(plan: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(name, plan, sql)
        return plan

    return register


def finish(df: DataFrame) -> DataFrame:
    """Decimals as doubles, and zero without a sign."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith("decimal"):
            out.append(f"CAST(`{name}` AS DOUBLE) AS `{name}`")
        elif kind == "double":
            out.append(f"CASE WHEN `{name}` = 0 THEN 0D ELSE `{name}` END AS `{name}`")
        else:
            out.append(f"`{name}`")
    return df.selectExpr(*out)


# SQL counterparts of ``finish`` and of the column helpers. Sums are decimal in both engines and ratios are one
# division of doubles, so results agree to the last digit; only sums of doubles are rounded.


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def unsigned_zero(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE {x} END"


def rounded(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def num(x: str) -> str:
    return f"CAST({x} AS INTEGER)"


def yr(x: str) -> str:
    return f"CAST(year({x}) AS INTEGER)"


def day(x: str) -> str:
    return f"CAST({x} AS DATE)"


def raw_ratio(a: str, b: str, scale: float = 1.0) -> str:
    n = f"CAST({a} AS DOUBLE)"
    if scale != 1.0:
        n = f"CAST({scale} AS DOUBLE) * {n}"
    return f"{n} / nullif(CAST({b} AS DOUBLE), 0)"


def rat(a: str, b: str, scale: float = 1.0) -> str:
    return f"({raw_ratio(a, b, scale)})"


def sums(*columns: str) -> str:
    """``sum(x) AS x`` for money columns."""
    return ", ".join(f"{dbl(f'sum({c})')} AS {c}" for c in columns)


def counts(*columns: str) -> str:
    """``sum(x) AS x`` for whole-number columns."""
    return ", ".join(f"{big(f'sum({c})')} AS {c}" for c in columns)
