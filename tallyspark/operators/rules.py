"""Value rules. Most are one filter over one scan; rules about a group aggregate first and join the small result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, any_of, days_inclusive, differs, or_null, ratio
from .reconcile import join_groups


def out_of_range(df: DataFrame, column: str, low, high, nulls: str = "ignore") -> DataFrame:
    """Values outside a closed range."""
    return df.filter(or_null(~F.col(column).between(low, high), column, nulls))


def not_in_set(df: DataFrame, column: str, allowed: Sequence, nulls: str = "ignore") -> DataFrame:
    return df.filter(or_null(~F.col(column).isin(*allowed), column, nulls))


def paired_zero(df: DataFrame, a: str, b: str) -> DataFrame:
    """One of two amounts is zero while the other is not; ``reason`` names the zero one."""
    zero_a = (F.col(a) == 0) & (F.col(b) != 0)
    zero_b = (F.col(b) == 0) & (F.col(a) != 0)
    return df.filter(zero_a | zero_b).withColumn("reason", F.when(zero_a, f"{a}_zero").otherwise(f"{b}_zero"))


def paired_null(df: DataFrame, a: str, b: str) -> DataFrame:
    """One of two amounts is missing while the other is there."""
    null_a = F.col(a).isNull() & F.col(b).isNotNull()
    null_b = F.col(b).isNull() & F.col(a).isNotNull()
    return df.filter(null_a | null_b).withColumn("reason", F.when(null_a, f"{a}_null").otherwise(f"{b}_null"))


def negative(df: DataFrame, columns: Sequence[str], zeros: Sequence[str] = ()) -> DataFrame:
    """Rows with a negative amount, or a zero in ``zeros``; ``reason`` lists the columns. Text is cast to a number."""
    tests = [(c, F.col(c).try_cast("double") < 0) for c in columns] + [(c, F.col(c).try_cast("double") == 0) for c in zeros]
    reason = F.concat_ws(",", *[F.when(t, F.lit(c)) for c, t in tests])
    return df.filter(any_of(t for _, t in tests)).withColumn("reason", reason)


def rate_zero_amount_nonzero(df: DataFrame, rate: str, amount: str) -> DataFrame:
    return paired_zero(df, rate, amount)


def even_allocation(df: DataFrame, total: str, rate: str, start: str, end: str, tolerance: float = 0.0) -> DataFrame:
    """Rows whose daily rate is not total / days.

    Both rates are rounded to cents and their ratio, again rounded to cents, must be 1.00. A reversed span has no
    days; it and a zero total give no ratio and are not reported here.
    """
    days = days_inclusive(start, end)
    daily = F.round(ratio(total, F.when(days > 0, days)), 2)
    share = F.round(ratio(F.round(F.col(rate).cast("double"), 2), daily), 2)
    return (
        df.withColumn("calculated_rate", daily)
        .withColumn("rate_ratio", share)
        .filter(F.abs(F.col("rate_ratio") - 1.0) > tolerance)
    )


def date_out_of_bounds(df: DataFrame, date: str, start: str, end: str, slack: int = 0) -> DataFrame:
    """Rows dated before the start or more than ``slack`` days after the end."""
    return df.filter(~F.col(date).between(F.col(start), F.date_add(F.col(end), slack)))


def declared_vs_observed_span(
    df: DataFrame, grain: Sequence[str], date: str, start: str, end: str, mode: str = "any"
) -> DataFrame:
    """Declared start and end per grain against the first and last date of its data.

    ``any`` reports one wrong end, ``both`` only spans with two wrong ends. The fact is reduced to one row per grain
    and declared span; the first and last date of each grain are taken from these rows and joined back to them, so a
    grain with many declared spans is never held in one row.
    """
    if mode not in ("any", "both"):
        raise ValueError("mode must be 'any' or 'both'")
    spans = df.groupBy(*grain, start, end).agg(F.min(date).alias("__lo"), F.max(date).alias("__hi"))
    per_grain = spans.groupBy(*grain).agg(F.min("__lo").alias("first_date"), F.max("__hi").alias("last_date"))
    wrong = [differs(start, "first_date"), differs(end, "last_date")]
    both = join_groups(spans.select(*grain, start, end), per_grain, grain)
    return both.select(*grain, "first_date", "last_date", start, end).filter(any_of(wrong) if mode == "any" else all_of(wrong))


def status_vs_latest(df: DataFrame, status: str, end: str, key: str, active: str, inactive: str) -> DataFrame:
    """Active rows that end before the key's latest date, and inactive rows that end on it."""
    latest = df.groupBy(key).agg(F.max(end).alias("latest"))
    wrong = ((F.col(status) == active) & (F.col(end) != F.col("latest"))) | (
        (F.col(status) == inactive) & (F.col(end) == F.col("latest"))
    )
    return df.join(latest, key).filter(wrong)


def prefix_mismatch(df: DataFrame, name: str, key: str, n: int = 2) -> DataFrame:
    """Rows whose name does not start with the (upper-cased) key prefix."""
    return df.withColumn("prefix", F.upper(F.substring(name, 1, n))).filter(F.col("prefix") != F.col(key))


def one_name_many_keys(df: DataFrame, name: str, key: str) -> DataFrame:
    """Names that go with several keys: one row per name and key, with the number of keys."""
    pairs = df.select(name, key).distinct().filter(F.col(key).isNotNull())
    repeated = pairs.groupBy(name).agg(F.count(key).alias("n_keys")).filter(F.col("n_keys") > 1)
    return pairs.join(repeated, name)


def zero_metric_for_type(
    fact: DataFrame, dim: DataFrame, key: str, of_type: Column, metric: str, how: str = "inner"
) -> DataFrame:
    """Fact rows of a type with a zero metric. ``how='left'`` also keeps rows of every other type."""
    return fact.filter(F.col(metric) == 0).join(dim.filter(of_type), key, how)


def subset_by_attribute(fact: DataFrame, dim: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """Fact rows whose dimension attribute is one of the values, in any letter case."""
    folded = sorted({v.lower() for v in values})
    return fact.join(dim.filter(F.lower(column).isin(*folded)), key)


def attribute_disagreement(
    fact: DataFrame, left: tuple[DataFrame, str], right: tuple[DataFrame, str], pairs: Sequence[tuple[str, str]], null_safe: bool = False
) -> DataFrame:
    """Distinct fact keys for which two dimensions disagree on an attribute."""
    (dim_a, key_a), (dim_b, key_b) = left, right
    links = fact.select(key_a, key_b).distinct()
    joined = links.join(dim_a, key_a, "left").join(dim_b, key_b, "left")
    return joined.filter(any_of(differs(a, b, null_safe) for a, b in pairs))


def equal_columns(df: DataFrame, a: str, b: str, group: Sequence[str]) -> DataFrame:
    """Rows with equal values in two columns, and both totals, per group."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(a) == F.col(b)).alias("n_equal"),
        F.sum(a).alias(f"sum_{a}"),
        F.sum(b).alias(f"sum_{b}"),
    )


def parity_for_keys(
    df: DataFrame, key: str, keys: Sequence, year: str, from_year: int, pairs: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Keys that book in dollars: per key and year, local over dollar sums, where one of them is not 1."""
    scoped = df.filter(F.col(key).isin(*keys) & (F.col(year) >= from_year))
    sums = scoped.groupBy(key, year).agg(*[F.sum(c).alias(c) for p in pairs.values() for c in p])
    ratios = sums.select(key, year, *[ratio(a, b).alias(n) for n, (a, b) in pairs.items()])
    return ratios.filter(any_of(F.col(n) != 1.0 for n in pairs))


def column_disagreement(df: DataFrame, a: str, b: str, null_safe: bool = False) -> DataFrame:
    return df.filter(differs(a, b, null_safe))


def span_order(df: DataFrame, start: str, end: str, day: str) -> DataFrame:
    """Spans that end before they start, and days outside of their span, with the first reason that holds."""
    reason = (
        F.when(F.col(start) > F.col(end), "start_after_end")
        .when(F.col(start) > F.col(day), "day_before_start")
        .when(F.col(end) < F.col(day), "day_after_end")
    )
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def nonzero_in_channel(df: DataFrame, channels: Column, grain: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Groups in the given channels whose sums of all metrics are non-zero (video metrics off video channels)."""
    sums = df.filter(channels).groupBy(*grain).agg(*[F.sum(m).alias(m) for m in metrics])
    return sums.filter(all_of(F.col(m) != 0 for m in metrics))
