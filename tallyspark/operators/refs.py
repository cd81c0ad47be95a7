"""Referential integrity and set comparison.

Distinct keys are taken before a join (combined before the shuffle), so hot keys weigh one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import union_all


def _policy(df: DataFrame, key: Sequence[str], nulls: str) -> DataFrame:
    if nulls not in ("report", "ignore"):
        raise ValueError("nulls must be 'report' or 'ignore'")
    return df.dropna(subset=list(key)) if nulls == "ignore" else df


def orphans(fact: DataFrame, dim: DataFrame, key: Sequence[str], nulls: str = "report") -> DataFrame:
    """Distinct fact keys that the dimension does not hold. A null key matches nothing."""
    keys = _policy(fact.select(*key), key, nulls).distinct()
    return keys.join(dim.select(*key).distinct(), list(key), "left_anti")


def orphan_rows(
    fact: DataFrame, dim: DataFrame, key: Sequence[str], context: Sequence[str] = (), nulls: str = "report"
) -> DataFrame:
    """Fact rows without a dimension row, with context columns."""
    kept = fact.select(*dict.fromkeys([*key, *context]))
    return _policy(kept, key, nulls).join(dim.select(*key).distinct(), list(key), "left_anti")


def missing_key_counts(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per dimension, fact rows and distinct keys without a dimension row."""
    out = []
    for name, (dim, key) in dims.items():
        per_key = fact.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
        lost = per_key.join(dim.select(*key).distinct(), list(key), "left_anti")
        out.append(
            lost.agg(F.count(F.lit(1)).alias("missing_keys"), F.coalesce(F.sum("__n"), F.lit(0)).alias("missing_rows"))
            .select(F.lit(name).alias("dim_name"), "missing_keys", "missing_rows")
        )
    return union_all(out)


def key_difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` does not have; a null equals a null."""
    return a.select(*key).distinct().subtract(b.select(*key).distinct())


def presence_matrix(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Every key of any table, with one flag per table (one shuffle for all tables together)."""
    tagged = union_all(df.select(key).distinct().withColumn("__t", F.lit(n)) for n, df in tables.items())
    return tagged.groupBy(key).agg(*[F.bool_or(F.col("__t") == n).alias(f"in_{n}") for n in tables])


def code_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every code of either side and where it occurs: ``both``, ``left_only`` or ``right_only``."""
    flags = presence_matrix({"a": a, "b": b}, key)
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "left_only").otherwise("right_only")
    return flags.select(key, side.alias("side"))


def full_outer_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that occur on one side only."""
    return code_overlap(a, b, key).filter(F.col("side") != "both")


def unmatched_in_plan(candidates: DataFrame, plan: DataFrame, key: Sequence[str]) -> DataFrame:
    """Candidate rows whose key has no plan row."""
    return candidates.join(plan.select(*key).distinct(), list(key), "left_anti")


def enrich_unmatched(
    rows: DataFrame, fact: DataFrame, key: Sequence[str], dims: Sequence[tuple[DataFrame, str]], grain: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """Attach fact measures and dimension attributes to unmatched entities and add them up by a grain."""
    df = rows.select(*key).distinct().join(fact, list(key), "left")
    for dim, dim_key in dims:
        df = df.join(dim, dim_key, "left")
    return df.groupBy(*grain).agg(*[F.sum(c).alias(c) for c in sums])


def code_filter_join(dim: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Dimension rows whose key is in a code list."""
    return dim.join(codes.select(key).distinct(), key, "left_semi")


def source_gap(df: DataFrame, source: str, a: str, b: str, attributes: Sequence[str]) -> DataFrame:
    """Distinct attribute values of source ``a`` that source ``b`` does not have."""
    side = df.filter(F.col(source).isin(a, b)).groupBy(*attributes).agg(
        F.bool_or(F.col(source) == a).alias("__a"), F.bool_or(F.col(source) == b).alias("__b")
    )
    return side.filter(F.col("__a") & ~F.col("__b")).drop("__a", "__b")
