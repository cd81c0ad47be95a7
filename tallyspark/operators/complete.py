"""Completeness and freshness."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import any_of
from ..sources.tables import union_all


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table and whether the table is empty."""
    return union_all(
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(n).alias("table_name"), "n_rows", (F.col("n_rows") == 0).alias("is_empty")
        )
        for n, df in tables.items()
    )


def _counts(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[F.count_if(t).alias(c) for c, t in tests.items()])


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One wide row: nulls per column."""
    return _counts(df, {c: F.col(c).isNull() for c in columns or df.columns})


def null_counts_long(df: DataFrame, table: str) -> DataFrame:
    """Nulls per column as rows (table_name, column_name, n_nulls)."""
    return null_counts(df).unpivot([], df.columns, "column_name", "n_nulls").select(
        F.lit(table).alias("table_name"), "column_name", "n_nulls"
    )


def null_counts_cast(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column as a sum of 0/1; null on an empty table."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns or df.columns])


def sentinel_counts(df: DataFrame, sentinel: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per text column that hold a sentinel text instead of a value."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return _counts(df, {c: F.col(c) == sentinel for c in columns or texts})


def nullish_counts(df: DataFrame, columns: Sequence[str] | None = None, null_text: str = "NULL") -> DataFrame:
    """Per column: null, NaN, empty text, or a text that contains ``NULL``."""
    kinds = {f.name: f.dataType for f in df.schema}

    def test(c: str) -> Column:
        found = F.col(c).isNull()
        if isinstance(kinds[c], T.StringType):
            return found | (F.col(c) == "") | F.col(c).contains(null_text)
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            return found | F.isnan(c)
        return found

    return _counts(df, {c: test(c) for c in columns or df.columns})


def null_attribute(df: DataFrame, column: str, show: Sequence[str]) -> DataFrame:
    """Distinct entities that miss an attribute."""
    return df.filter(F.col(column).isNull()).select(*show).distinct()


def min_distinct(df: DataFrame, column: str, threshold: int) -> DataFrame:
    """One row when a column has fewer distinct values than expected, none otherwise."""
    return (
        df.agg(F.countDistinct(column).alias("n_distinct"))
        .filter(F.col("n_distinct") < threshold)
        .select(F.lit(column).alias("column_name"), "n_distinct", F.lit(threshold).cast("bigint").alias("threshold"))
    )


def coverage_matrix(df: DataFrame, key: str, date: str, years: Sequence[int]) -> DataFrame:
    """Rows per key and year, for every key and every given year; a missing cell is null.

    Counts are folded into one map per key (as many entries as years), so the years are laid out without a join.
    """
    counts = df.groupBy(key, F.year(date).alias("year")).agg(F.count(date).alias("n_rows"))
    cell = F.when(F.col("year").isNotNull(), F.struct("year", "n_rows"))
    by_key = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(cell)).alias("m"))
    return by_key.select(key, "m", F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("year")).select(
        key, "year", F.try_element_at("m", F.col("year")).alias("n_rows")
    )


def _days_present(df: DataFrame, key: Sequence[str], date: str, first: dt.date, last: dt.date) -> DataFrame:
    """Key and ``days``: the days of the closed range on which it has a row, in order, as numbers from 0.

    Equal days are combined before the shuffle, so a key with a large part of all rows brings one row per task and day.
    A key without a row in the range has no days.
    """
    at = F.datediff(F.col(date).cast("date"), F.lit(first))
    at = F.when(at.between(0, (last - first).days), at)
    found = df.select(*key, at.alias("__at")).distinct()
    return found.groupBy(*key).agg(F.array_sort(F.collect_list("__at")).alias("days"))


def _spans(df: DataFrame, key: Sequence[str], date: str, first: dt.date, last: dt.date) -> DataFrame:
    """Key and ``__span``: the numbers ``a`` and ``b`` of two days with no row between them and some day.

    A gap lies between neighbouring days of a key (or the ends of the range), so the work follows the days that are
    there, not the length of the range.
    """
    before = F.concat(F.array(F.lit(-1)), F.col("days"))
    after = F.concat(F.col("days"), F.array(F.lit((last - first).days + 1)))
    pairs = F.explode(F.arrays_zip(before.alias("a"), after.alias("b"))).alias("__span")
    return _days_present(df, key, date, first, last).select(*key, pairs).filter("__span.b - __span.a > 1")


def calendar_gaps(df: DataFrame, key: Sequence[str], date: str, first: dt.date, last: dt.date) -> DataFrame:
    """Days of a closed range on which a key has no row, one row per day."""
    days = F.explode(F.sequence(F.col("__span.a") + 1, F.col("__span.b") - 1)).alias("__at")
    rows = _spans(df, key, date, first, last).select(*key, days)
    return rows.select(*key, F.date_add(F.lit(first), F.col("__at")).alias("missing_day"))


def calendar_gap_spans(df: DataFrame, key: Sequence[str], date: str, first: dt.date, last: dt.date) -> DataFrame:
    """The same gaps as closed intervals: key, gap_start, gap_end, n_days; as many rows as gaps, however long they are."""
    return _spans(df, key, date, first, last).select(
        *key,
        F.date_add(F.lit(first), F.col("__span.a") + 1).alias("gap_start"),
        F.date_add(F.lit(first), F.col("__span.b") - 1).alias("gap_end"),
        (F.col("__span.b") - F.col("__span.a") - 1).cast("bigint").alias("n_days"),
    )


def freshness(df: DataFrame, key: Sequence[str], first: str, last: str | None = None) -> DataFrame:
    """First date, last date and row count per key."""
    return df.groupBy(*key).agg(
        F.min(first).cast("date").alias("first_date"),
        F.max(last or first).cast("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def year_bounds(df: DataFrame, key: Sequence[str], date: str) -> DataFrame:
    return df.groupBy(*key).agg(F.year(F.min(date)).alias("first_year"), F.year(F.max(date)).alias("last_year"))


def missing_in_period(df: DataFrame, key: Sequence[str], in_period: Column) -> DataFrame:
    """Keys of the table without a row in the period (one pass: a flag per key)."""
    seen = df.groupBy(*key).agg(F.coalesce(F.bool_or(in_period), F.lit(False)).alias("seen"))
    return seen.filter(~F.col("seen")).drop("seen")


def rows_per_period(df: DataFrame, key: Sequence[str], date: str) -> DataFrame:
    return df.groupBy(*key, F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_per_period(df: DataFrame, date: str, key: str) -> DataFrame:
    return df.groupBy(F.col(date).cast("date").alias("day")).agg(F.countDistinct(key).alias("n_distinct"))


def unparseable(df: DataFrame, column: str, kind: str, show: Sequence[str]) -> DataFrame:
    """Rows whose text is there but does not parse as the type."""
    return df.filter(F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull()).select(*show, column)


def presence_share(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Rows, rows without a value, and their share, per key."""
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(column).isNull()).alias("n_missing"),
    ).withColumn("missing_share", F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows").cast("double")))


def blank_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a null in any of the columns."""
    return df.filter(any_of(F.col(c).isNull() for c in columns))
