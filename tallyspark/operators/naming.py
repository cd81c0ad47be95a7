"""Naming-convention compliance.

A codebook is the long table (entity, attribute, code). Flags are made by one left join per attribute against that
attribute's codes: a codebook below the broadcast threshold costs no shuffle however large the dimension is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, normalise_token, ratio
from .complete import null_counts

FLAG = "calculated_flag"


def _codes(codebook: DataFrame, entity: str, attribute: str, mode: str, out: str) -> DataFrame:
    own = codebook.filter((F.col("entity") == entity) & (F.col("attribute") == attribute))
    return own.select(normalise_token("code", mode).alias(out)).filter(F.col(out).isNotNull()).distinct()


def _with_accepted(
    dim: DataFrame, codebook: DataFrame | Mapping[str, Sequence[str]], entity: str, attributes: Sequence[str], mode: str
) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """The dim with, per attribute, a condition that is true when its token is accepted (false for null)."""
    if isinstance(codebook, Mapping):
        tests = {}
        for a in attributes:
            accepted = [normalise_token(F.lit(c), mode) for c in codebook[a]]
            tests[a] = F.coalesce(normalise_token(F.col(a).cast("string"), mode).isin(*accepted), F.lit(False))
        return dim, tests, []
    tests, extra = {}, []
    for i, a in enumerate(attributes):
        code = f"__code{i}"
        dim = dim.join(
            _codes(codebook, entity, a, mode, code), normalise_token(F.col(a).cast("string"), mode) == F.col(code), "left"
        )
        tests[a] = F.col(code).isNotNull()
        extra.append(code)
    return dim, tests, extra


def compliance_flag(
    dim: DataFrame,
    codebook: DataFrame | Mapping[str, Sequence[str]],
    entity: str,
    attributes: Sequence[str],
    mode: str = "strict",
    out: str = FLAG,
) -> DataFrame:
    """0 when the tokens of all attributes are accepted, else 1; a null token is not accepted.

    Both sides are normalised the same way. The codebook is a table or, for short lists, a dict of codes.
    """
    joined, tests, extra = _with_accepted(dim, codebook, entity, attributes, mode)
    return joined.withColumn(out, F.when(all_of(tests.values()), 0).otherwise(1)).drop(*extra)


def mask_accepted(
    dim: DataFrame, codebook: DataFrame | Mapping[str, Sequence[str]], entity: str, attributes: Sequence[str], mode: str = "strict"
) -> DataFrame:
    """Accepted tokens become null, so that only offending ones are left."""
    joined, tests, extra = _with_accepted(dim, codebook, entity, attributes, mode)
    return joined.withColumns({a: F.when(~tests[a], F.col(a)) for a in attributes}).drop(*extra)


def flag_mismatch(df: DataFrame, stored: str, calculated: str = FLAG) -> DataFrame:
    return df.filter(F.col(stored) != F.col(calculated))


def exclude_exceptions(dim: DataFrame, exceptions: DataFrame, entity: str, name: str) -> DataFrame:
    own = exceptions.filter(F.col("entity") == entity).select(F.col("name").alias("__name"))
    return dim.join(own, F.col(name) == F.col("__name"), "left_anti")


def only_exceptions(dim: DataFrame, exceptions: DataFrame, entity: str, name: str) -> DataFrame:
    own = exceptions.filter(F.col("entity") == entity).select(F.col("name").alias("__name"))
    return dim.join(own, F.col(name) == F.col("__name"), "left_semi")


def attach_platform(dim: DataFrame, fact: DataFrame, key: str, platform: Sequence[str]) -> DataFrame:
    """Each dim row with the distinct platforms its key has in the fact."""
    return dim.join(fact.select(key, *platform).distinct(), key, "left")


def unknown_codes(df: DataFrame, codebook: DataFrame, entity: str, attributes: Sequence[str], mode: str = "strict") -> DataFrame:
    """Distinct (attribute, value) of the rows that the codebook does not hold; all attributes in one pass."""
    cells = df.select(
        F.inline(
            F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
        )
    ).distinct()
    own = codebook.filter(F.col("entity") == entity).select(
        F.col("attribute").alias("__a"), normalise_token("code", mode).alias("__c")
    )
    same = (F.col("attribute") == F.col("__a")) & (normalise_token("value", mode) == F.col("__c"))
    return cells.join(own, same, "left_anti")


def compliance_rollup(
    df: DataFrame, grain: Sequence[str], name: str, flag: str = FLAG, pct: bool = False, tasks: int | None = None
) -> DataFrame:
    """Distinct (grain, name, flag): total, following, not following, and whole percentages.

    With ``tasks`` the rows are dealt by name to so many tasks before they are made distinct.
    """
    names = df.select(*grain, name, flag)
    names = (names.repartition(tasks, name) if tasks else names).distinct()
    out = names.groupBy(*grain).agg(
        F.count(name).alias("total_count"),
        F.count_if(F.col(flag) == 0).alias("following"),
        F.count_if(F.col(flag) == 1).alias("not_following"),
    )
    if pct:
        out = out.withColumns(
            {f"{c}_pct": F.round(ratio(c, "total_count", 100), 0) for c in ("following", "not_following")}
        )
    return out


def staged_compliance(
    flagged: DataFrame, exceptions: DataFrame, entity: str, name: str, stored: str, grain: Sequence[str], calculated: str = FLAG,
    tasks: int | None = None,
) -> DataFrame:
    """Rollups by the stored flag (stage 1), the calculated flag (2), and the calculated flag without exceptions (3).

    The stages are laid out per row and rolled up together, so the dimension and its joins are run once.
    """
    own = exceptions.filter(F.col("entity") == entity).select(F.col("name").alias("__name")).distinct()
    marked = flagged.join(own, F.col(name) == F.col("__name"), "left")
    stages = F.array(
        F.struct(F.lit(1).alias("stage"), F.col(stored).alias("__flag")),
        F.struct(F.lit(2).alias("stage"), F.col(calculated).alias("__flag")),
        F.struct(F.when(F.col("__name").isNull(), 3).alias("stage"), F.col(calculated).alias("__flag")),
    )
    rows = marked.select(*grain, name, F.inline(stages)).filter(F.col("stage").isNotNull())
    return compliance_rollup(rows, ["stage", *grain], name, "__flag", pct=True, tasks=tasks)


def exception_summary(
    dim: DataFrame, exceptions: DataFrame, entity: str, name: str, grain: Sequence[str]
) -> DataFrame:
    """Exception names that occur, counted by grain."""
    found = only_exceptions(dim, exceptions, entity, name)
    return found.groupBy(*grain).agg(F.count(name).alias("n_names"))


def flat_export(fact: DataFrame, dim: DataFrame, key: str, dims: Sequence[tuple[DataFrame, str, str]], columns: Sequence[str]) -> DataFrame:
    """Distinct wide rows of an entity with the attributes of the facts that use it."""
    fact_columns = [key, *[k for _, k, _ in dims], *[c for c in columns if c in fact.columns]]
    df = fact.select(*dict.fromkeys(fact_columns)).distinct().join(dim, key)
    for other, other_key, how in dims:
        df = df.join(other, other_key, how)
    return df.select(*columns).distinct()


def flagged_rows(df: DataFrame, flag: str, columns: Sequence[str]) -> DataFrame:
    return df.filter(F.col(flag) == 1).select(*columns)


def flagged_null_counts(df: DataFrame, flag: str, columns: Sequence[str]) -> DataFrame:
    """Nulls per token column among the flagged rows."""
    return null_counts(df.filter(F.col(flag) == 1).select(*columns))
