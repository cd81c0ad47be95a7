"""Filters and projections that bring tables into the scope of a check."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of


def filter_keys(
    tables: Mapping[str, DataFrame], key: str, include: Sequence = (), exclude: Sequence = ()
) -> dict[str, DataFrame]:
    """Apply one key list to every table. An empty list means no restriction."""

    def scoped(df: DataFrame) -> DataFrame:
        if include:
            df = df.filter(F.col(key).isin(*include))
        if exclude:
            df = df.filter(~F.col(key).isin(*exclude))
        return df

    return {n: scoped(df) for n, df in tables.items()}


def filter_vendor(df: DataFrame, column: str, vendor: str) -> DataFrame:
    return df.filter(F.col(column) == vendor)


def in_years(date: str, years: Iterable[int]) -> Column:
    """Date ranges rather than ``year(date)``, so that the condition is pushed into the scan."""
    return any_of(
        (F.col(date) >= F.lit(dt.date(y, 1, 1))) & (F.col(date) < F.lit(dt.date(y + 1, 1, 1))) for y in sorted(set(years))
    )


def filter_years(df: DataFrame, date: str, years: Iterable[int]) -> DataFrame:
    return df.filter(in_years(date, years))


def as_of(df: DataFrame, date: str, last: dt.date) -> DataFrame:
    """Rows up to and including the day ``last``."""
    return df.filter(F.col(date) < F.lit(last + dt.timedelta(days=1)))


def between_dates(df: DataFrame, date: str, first: dt.date, last: dt.date) -> DataFrame:
    """Rows from day ``first`` to day ``last``, both included."""
    return as_of(df.filter(F.col(date) >= F.lit(first)), date, last)


def exclude_values(df: DataFrame, column: str, values: Sequence, keep_nulls: bool = False) -> DataFrame:
    keep = ~F.col(column).isin(*values)
    return df.filter(keep | F.col(column).isNull() if keep_nulls else keep)


def sql_filter(df: DataFrame, condition: str) -> DataFrame:
    return df.where(condition)


def default_region(df: DataFrame, column: str, default: str) -> DataFrame:
    """Empty or missing code becomes a constant."""
    return df.withColumn(column, F.when(F.col(column) != "", F.col(column)).otherwise(F.lit(default)))


def scope_dim(
    dim: DataFrame, fact: DataFrame, key: str, date: str, since: dt.date, attributes: Sequence[str] = ()
) -> DataFrame:
    """Dimension rows that a fact has used since a date, with attributes taken from the fact."""
    used = fact.filter(F.col(date) >= F.lit(since)).select(key, *attributes).distinct()
    return dim.join(used, key)


def allow_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(*values))


def drill(df: DataFrame, column: str, names: Sequence) -> DataFrame:
    """Rows of the named entities."""
    return allow_values(df, column, names)


def match_text(df: DataFrame, column: str, any_of_texts: Sequence[str] = (), pattern: str | None = None) -> DataFrame:
    """Rows that contain one of the texts or match the regex."""
    tests = [F.col(column).contains(t) for t in any_of_texts]
    if pattern is not None:
        tests.append(F.col(column).rlike(pattern))
    return df.filter(any_of(tests))


def pick_dates(df: DataFrame, date: str, dates: Sequence[dt.date]) -> DataFrame:
    days = [(F.col(date) >= F.lit(d)) & (F.col(date) < F.lit(d + dt.timedelta(days=1))) for d in dates]
    return df.filter(any_of(days))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def suffix_columns(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename all but the kept columns, to avoid clashes in a join."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keep})


def project(df: DataFrame, columns: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    return df.select(*columns).drop(*drop)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast; text that does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def fill_missing(df: DataFrame, value, columns: Sequence[str]) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def order_desc(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in columns])
