"""Identifiers and tokens inside names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import last_number_after, token_at, tokens_in


def id_from(columns: Sequence[str], markers: Sequence[str], ignore_case: bool = False) -> Column:
    """First id found, trying the markers in order and, for each, the columns in order."""
    return F.coalesce(*[last_number_after(c, m, ignore_case) for m in markers for c in columns])


def extract_id(df: DataFrame, columns: Sequence[str], markers: Sequence[str], out: str = "extracted_id", ignore_case: bool = False) -> DataFrame:
    return df.withColumn(out, id_from(columns, markers, ignore_case))


def _id_counts(df: DataFrame, group: Sequence[str], id_column: str) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(id_column).isNull()).alias("n_without_id")
    )


def entities_without_id(df: DataFrame, group: Sequence[str], id_column: str) -> DataFrame:
    """Entities none of whose rows has an id."""
    return _id_counts(df, group, id_column).filter(F.col("n_rows") == F.col("n_without_id"))


def entities_with_id(df: DataFrame, group: Sequence[str], id_column: str) -> DataFrame:
    """Entities with an id on at least one row."""
    return _id_counts(df, group, id_column).filter(F.col("n_rows") != F.col("n_without_id"))


def id_coverage(df: DataFrame, group: Sequence[str], id_column: str) -> DataFrame:
    """One row: entities, entities without an id, and their share."""
    per_entity = _id_counts(df, group, id_column)
    without = F.count_if(F.col("n_rows") == F.col("n_without_id"))
    return per_entity.agg(F.count(F.lit(1)).alias("n_entities"), without.alias("n_without_id")).withColumn(
        "share_without_id", F.try_divide(F.col("n_without_id").cast("double"), F.col("n_entities").cast("double"))
    )


def without_id_details(df: DataFrame, group: Sequence[str], id_column: str) -> DataFrame:
    """All rows of the entities without an id."""
    return df.join(entities_without_id(df, group, id_column).select(*group), list(group), "left_semi")


def split_token(df: DataFrame, column: str, separator: str, index: int, out: str) -> DataFrame:
    return df.withColumn(out, token_at(column, separator, index))


def token_count(df: DataFrame, column: str, separator: str, out: str = "n_tokens") -> DataFrame:
    return df.withColumn(out, tokens_in(column, separator))


def join_on_token(names: DataFrame, token: str, df: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key text occurs among the extracted tokens."""
    wanted = names.select(F.col(token).alias("__token")).filter(F.col("__token").isNotNull()).distinct()
    return df.join(wanted, F.col(key).cast("string") == F.col("__token"), "left_semi")


def year_of(df: DataFrame, date: str, out: str = "year") -> DataFrame:
    """Year of a date, or of a date text that starts with four digits."""
    text = dict(df.dtypes)[date] == "string"
    return df.withColumn(out, F.substring(date, 1, 4).try_cast("int") if text else F.year(date))


def value_alias(df: DataFrame, column: str, aliases: Mapping[str, str]) -> DataFrame:
    """Replace whole values of a column."""
    return df.replace(dict(aliases), subset=[column])
