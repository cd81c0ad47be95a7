"""KPI rollups and dashboard tables.

Sums are taken before ratios. Another fact is first brought to the join key (plan lines once each, reach once per
campaign), so that no join multiplies rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, ratio
from ..functions.kpis import kpi_columns, measures_for


def join_dims(fact: DataFrame, dims: Sequence[tuple[DataFrame, str | Sequence[str], str]]) -> DataFrame:
    """Chain of joins (dim, key, how). Every dim must hold its key once; small ones are broadcast by the planner."""
    for dim, key, how in dims:
        fact = fact.join(dim, key, how)
    return fact


def sum_by(df: DataFrame, grain: Iterable[str | Column], measures: Iterable[str]) -> DataFrame:
    return df.groupBy(*[col(g) for g in grain]).agg(*[F.sum(m).alias(m) for m in measures])


def sum_through(
    fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]], grain: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Sums by a grain whose columns come from the fact and from a chain of dims (dim, key, how).

    The fact is added up by what is still needed (the next key, grain columns, later keys) before each join. The
    sums are combined before they are shuffled, so a key with a large part of all rows meets its dim as few rows,
    and where only the key is needed the shuffle of the sums is also the one of the join.
    """
    for i, (dim, key, how) in enumerate(dims):
        later = {k for _, k, _ in dims[i + 1 :]}
        kept = [c for c in fact.columns if c in grain or c in later or c == key]
        fact = sum_by(fact, kept, measures).join(dim, key, how)
    return sum_by(fact, grain, measures)


def kpi_rollup(
    fact: DataFrame,
    grain: Sequence[str],
    kpis: Sequence[str],
    measures: Sequence[str] | None = None,
    dedup: Sequence[str] | None = None,
    dims: Sequence[tuple[DataFrame, str, str]] = (),
) -> DataFrame:
    """Sums per grain and the KPIs on them. Grain columns may come from ``dims`` (see ``sum_through``).

    ``dedup`` names columns on which equal rows are counted once before they are summed, as some dashboards do;
    it is off by default because it also removes genuine equal rows. Rows that agree in a dim's key agree in its
    columns, so a dim whose key is among ``dedup`` is met by the sums; others are joined before.
    """
    measures = list(measures or measures_for(kpis))
    if dedup is not None:
        keys = [key for _, key, _ in dims]
        if not set(keys) <= set(dedup):
            raise ValueError("join the dims whose key is not compared before equal rows are dropped")
        own = [g for g in grain if g in fact.columns]
        fact = fact.select(*dict.fromkeys([*own, *measures, *dedup])).dropDuplicates()
    return sum_through(fact, dims, grain, measures).select("*", *kpi_columns(kpis))


def grand_total(rollup: DataFrame, measures: Sequence[str]) -> DataFrame:
    return rollup.agg(*[F.sum(m).alias(f"total_{m}") for m in measures])


def distinct_lines(plan: DataFrame, grain: Sequence[str], amounts: Sequence[str], line: str = "plan_line_id") -> DataFrame:
    return plan.select(*dict.fromkeys([*grain, line, *amounts])).dropDuplicates()


def planned_summary(plan: DataFrame, grain: Sequence[str], amounts: Sequence[str], line: str = "plan_line_id") -> DataFrame:
    """Budgets per grain, each distinct plan line (with its amounts) once."""
    return sum_by(distinct_lines(plan, grain, amounts, line), grain, amounts)


def measures_by(
    fact: DataFrame, grain: Sequence[str], date: str, measures: Sequence[str], dim: tuple[DataFrame, str, str] | None = None
) -> DataFrame:
    """Last date, rows and all sums per grain. Grain columns may come from ``dim``, which is met by sums per key."""
    columns = (F.max(date).alias("last_date"), F.count(F.lit(1)).alias("n_rows"), *[F.sum(m).alias(m) for m in measures])
    if dim is None:
        return fact.groupBy(*grain).agg(*columns)
    table, key, how = dim
    rolled = fact.groupBy(*dict.fromkeys([key, *(g for g in grain if g in fact.columns)])).agg(*columns).join(table, key, how)
    return rolled.groupBy(*grain).agg(F.max("last_date").alias("last_date"), *[F.sum(m).alias(m) for m in ("n_rows", *measures)])


def reach_per_campaign(reach: DataFrame, key: str = "campaign_id", value: str = "value") -> DataFrame:
    """Reach at campaign grain: average, sum and number of rows, one row per campaign."""
    return reach.groupBy(key).agg(
        ratio(F.sum(value), F.count(value)).alias("avg_reach"), F.sum(value).alias("sum_reach"), F.count(F.lit(1)).alias("reach_rows")
    )


def campaign_reach(fact: DataFrame, reach: DataFrame, grain: Sequence[str], kpis: Sequence[str], key: str = "campaign_id") -> DataFrame:
    """KPIs and average reach for campaigns that have reach. Grain must contain the campaign key."""
    rolled = kpi_rollup(fact, grain, kpis)
    return rolled.join(reach_per_campaign(reach, key).select(key, "avg_reach"), key)


def campaign_pacing(fact: DataFrame, plan: DataFrame, grain: Sequence[str], kpis: Sequence[str], key: str = "campaign_id") -> DataFrame:
    """Actual sums with the campaign's planned budget and pacing."""
    budget = planned_summary(plan, [key], ["budget_usd"])
    measures = [m for m in measures_for(kpis) if m != "budget_usd"]
    return sum_by(fact, grain, measures).join(budget, key, "left").select("*", *kpi_columns(kpis))


def window_totals(fact: DataFrame, where: Column, measures: Sequence[str]) -> DataFrame:
    return fact.filter(where).agg(*[F.sum(m).alias(m) for m in measures])


def distinct_with_count(df: DataFrame, group: Sequence[str], member: str, out: str) -> DataFrame:
    return df.groupBy(*group).agg(F.countDistinct(member).alias(out))


def pass_counts(base: DataFrame, status: str, value: str, grain: Sequence[str], pass_value=1) -> DataFrame:
    """Rows that pass, by flight status and grain; one scan serves all statuses."""
    return base.filter(F.col(value) == pass_value).groupBy(status, *grain).agg(F.count(F.lit(1)).alias("n_pass"))


def avg_score(base: DataFrame, score: str, grain: Sequence[str]) -> DataFrame:
    """Mean score, from a decimal sum: the result does not depend on the order in which tasks finish."""
    exact = F.col(score).cast("decimal(28,10)")
    return base.groupBy(*grain).agg(ratio(F.sum(exact), F.count(score)).alias("avg_score"))


def tier_counts(base: DataFrame, creative: str | Sequence[str], grain: Sequence[str]) -> DataFrame:
    """Distinct creatives per grain."""
    keys = [creative] if isinstance(creative, str) else list(creative)
    return base.select(*dict.fromkeys([*grain, *keys])).distinct().groupBy(*grain).agg(F.count(F.lit(1)).alias("n_creatives"))


def tier_spend(base: DataFrame, creative: str | Sequence[str], spend: str, grain: Sequence[str]) -> DataFrame:
    """Spend per grain over distinct (creative, grain, spend) rows."""
    keys = [creative] if isinstance(creative, str) else list(creative)
    return sum_by(base.select(*dict.fromkeys([*grain, *keys, spend])).distinct(), grain, [spend])


def status_intersection(base: DataFrame, status: str, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """Keys present under both statuses."""
    flags = base.filter(F.col(status).isin(a, b)).groupBy(*keys).agg(
        F.bool_or(F.col(status) == a).alias("__a"), F.bool_or(F.col(status) == b).alias("__b")
    )
    return flags.filter(F.col("__a") & F.col("__b")).drop("__a", "__b")


def wide_join(
    fact: DataFrame, dims: Sequence[tuple[DataFrame, str | Sequence[str], str]], reach: DataFrame, plan: DataFrame,
    calendar: DataFrame, date: str, key: str = "campaign_id",
) -> DataFrame:
    """Fact rows with dims, campaign reach, campaign budget and calendar week; one row per fact row, equal ones included."""
    wide = join_dims(fact, dims)
    wide = wide.join(reach_per_campaign(reach, key).select(key, "avg_reach"), key, "left")
    wide = wide.join(planned_summary(plan, [key], ["budget_usd"]), key, "left")
    return wide.join(calendar, F.col(date) == F.col("calendar_date")).drop("calendar_date")

