"""Reconciliation between tables, versions and currencies; spreading; windows.

Both sides are aggregated to the common grain before they are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import all_of, any_of, col, days_inclusive, ratio
from ..sources.scratch import measured, scratch_path
from ..sources.tables import union_all
from .keys import duplicate_row_count
from .kpi import distinct_lines, planned_summary, sum_by

BUDGETS = ("budget_usd", "budget_lc")
SPENDS = ("spend_usd", "spend_lc")
#: Amounts that are divided and summed up again: a sum of decimals does not depend on the order of tasks.
EXACT = "decimal(20,6)"
#: Groups times pairs of columns whose moments a task holds before it sends them.
CELLS = 1 << 20


def join_groups(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables of groups; a null in a key is a value like any other. Keys come first, then the rest of both."""
    theirs = {k: f"__right_{i}" for i, k in enumerate(keys)}
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in theirs.items()]
    joined = a.join(b.withColumnsRenamed(theirs), same, how)
    own = [F.coalesce(F.col(k), F.col(n)).alias(k) if how == "full" else F.col(k) for k, n in theirs.items()]
    rest = [c for x in (a, b) for c in x.columns if c not in theirs]
    return joined.select(*own, *rest)


def fx_ratio_consistency(plan: DataFrame, actual: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Local/dollar ratio of plan and of actual, and the ratio of the two."""
    planned = planned_summary(plan, grain, BUDGETS).withColumn("planned_ratio", ratio("budget_lc", "budget_usd"))
    spent = sum_by(actual, grain, SPENDS).withColumn("actual_ratio", ratio("spend_lc", "spend_usd"))
    return join_groups(spent, planned, grain).withColumn("ratio", ratio("planned_ratio", "actual_ratio"))


def fx_vs_reference(ratios: DataFrame, fx: DataFrame, country: str, rate: str = "latest_value") -> DataFrame:
    """Observed ratios next to an external rate; a country without a rate keeps its row."""
    return join_groups(ratios, fx, [country], "left").withColumn("vs_reference", ratio("actual_ratio", rate))


def plan_vs_actual(plan: DataFrame, actual: DataFrame, grain: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Actual in percent of plan, in both currencies.

    With ``tasks`` both sides are dealt by the grain to so many tasks and added up there together, so that groups that are
    nearly as many as the rows are held once, and by as many tasks as that takes.
    """
    if tasks is None:
        both = join_groups(sum_by(actual, grain, SPENDS), planned_summary(plan, grain, BUDGETS), grain)
    else:
        lines = distinct_lines(plan, grain, BUDGETS).withColumn("__plan", F.lit(True))
        sides = actual.select(*grain, *SPENDS, F.lit(False).alias("__plan")).unionByName(lines.drop("plan_line_id"), allowMissingColumns=True)
        sums = [F.sum(c).alias(c) for c in (*SPENDS, *BUDGETS)]
        both = sides.repartition(tasks, *grain).groupBy(*grain).agg(*sums, F.bool_or("__plan").alias("__any"), F.bool_and("__plan").alias("__all"))
        both = both.filter("__any and not __all").drop("__any", "__all")
    return both.withColumns(
        {"variance_usd": ratio("spend_usd", "budget_usd", 100), "variance_lc": ratio("spend_lc", "budget_lc", 100)}
    )


def is_outlier(variance: str = "variance_lc", low: float = 30, high: float = 110) -> Column:
    return (F.col(variance) > high) | (F.col(variance) < low)


def plan_vs_actual_outliers(plan: DataFrame, actual: DataFrame, grain: Sequence[str], low: float = 30, high: float = 110) -> DataFrame:
    return plan_vs_actual(plan, actual, grain).filter(is_outlier("variance_lc", low, high))


def violation_share(df: DataFrame, violation: Column) -> DataFrame:
    """One row: violations, rows, share; a single pass."""
    return df.agg(F.count_if(violation).alias("violations"), F.count(F.lit(1)).alias("base_rows")).withColumn(
        "share", ratio("violations", "base_rows")
    )


def relative_variance(df: DataFrame, a: str, b: str, out: str = "variance_pct") -> DataFrame:
    """(a - b) / b in percent."""
    return df.withColumn(out, ratio(F.col(a) - F.col(b), b, 100))


def yearly_sides(plan: DataFrame, actual: DataFrame, grain: Sequence[str], only_zero: bool = False) -> DataFrame:
    """Actual sums with plan sums beside them; ``only_zero`` keeps rows where one is zero or missing."""
    both = join_groups(sum_by(actual, grain, SPENDS), sum_by(plan, grain, BUDGETS), grain, "left")
    if only_zero:
        both = both.filter(any_of(F.coalesce(F.col(c), F.lit(0)) == 0 for c in (*SPENDS, *BUDGETS)))
    return both


def recompute_ratio(df: DataFrame, num: str, den: str, stored: str, digits: int = 2) -> DataFrame:
    """Rows whose stored ratio differs from the recomputed one, both rounded, with the difference."""
    return (
        df.withColumn("recomputed", F.round(ratio(num, den), digits))
        .withColumn("difference", F.round(F.col("recomputed") - F.round(F.col(stored).cast("double"), digits), digits))
        .filter(F.col("difference") != 0)
    )


def compare_sums(
    a: DataFrame, b: DataFrame, grain: Sequence[str], pairs: Mapping[str, tuple[str, str]], how: str = "inner"
) -> DataFrame:
    """Sums of two tables at one grain and, per named pair, the ratio of the measure of ``a`` to that of ``b``.

    A measure of ``b`` with the name of one of ``a`` gets the suffix ``_b``.
    """
    left = sum_by(a, grain, dict.fromkeys(p[0] for p in pairs.values()))
    names = {p[1]: p[1] if p[1] not in left.columns else f"{p[1]}_b" for p in pairs.values()}
    right = sum_by(b, grain, names).withColumnsRenamed(names)
    return join_groups(left, right, grain, how).withColumns({n: ratio(x, names[y]) for n, (x, y) in pairs.items()})


def ratio_of_ratios(df: DataFrame, grain: Sequence[str], totals: tuple[str, str], rates: tuple[str, str]) -> DataFrame:
    """Ratio of totals, ratio of daily rates, and the ratio of both."""
    sums = sum_by(df, grain, dict.fromkeys([*totals, *rates]))
    return sums.select(*grain, ratio(*totals).alias("total_ratio"), ratio(*rates).alias("rate_ratio")).withColumn(
        "ratio", ratio("total_ratio", "rate_ratio")
    )


def sums_by_grain(df: DataFrame, grain: Sequence[str | Column], measures: Sequence[str], date: str) -> DataFrame:
    return df.groupBy(*[col(g) for g in grain]).agg(
        *[F.sum(m).alias(f"sum_{m}") for m in measures],
        F.min(date).cast("date").alias("first_date"),
        F.max(date).cast("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def version_compare(df: DataFrame, version: str, key: str, measures: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and sums per snapshot version."""
    return df.groupBy(version).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), *[F.sum(m).alias(f"sum_{m}") for m in measures]
    )


def only_in_latest(df: DataFrame, version: str, key: Sequence[str]) -> DataFrame:
    """Keys that first occur in the latest version."""
    first = df.groupBy(*key).agg(F.min(version).alias("__first"))
    latest = df.agg(F.max(version).alias("__first"))
    return first.join(latest, "__first").select(*key, F.col("__first").alias(version))


def environment_compare(a: DataFrame, b: DataFrame, grain: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Row counts and sums of one table in two environments, and the differences; groups of either side."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*grain).agg(
            F.count(F.lit(1)).alias(f"n_rows_{tag}"), *[F.sum(m).alias(f"{m}_{tag}") for m in measures]
        )

    both = join_groups(side(a, "a"), side(b, "b"), grain, "full")
    zero = F.lit(0)
    deltas = {f"{m}_delta": F.coalesce(F.col(f"{m}_a"), zero) - F.coalesce(F.col(f"{m}_b"), zero) for m in ("n_rows", *measures)}
    return both.withColumns(deltas)


def _snapshot_rows(spark: SparkSession, path: str, upper: Sequence[str]) -> DataFrame:
    """The rows, with the types that the upper columns have in the digests (names of folders are text)."""
    own = spark.read.parquet(f"{path}/rows").drop(*upper).schema
    kinds = {f.name: f for f in spark.read.parquet(f"{path}/digests").schema}
    return spark.read.schema(T.StructType([*own.fields, *[kinds[c] for c in upper]])).parquet(f"{path}/rows")


def store_snapshot(df: DataFrame, path: str, upper: Sequence[str]) -> None:
    """Keep a table of groups: its rows, in folders by the ``upper`` columns, and a digest of each folder.

    A digest is the number of rows and two sums of row hashes, so it does not depend on their order, and digests add up
    to that of the whole.
    """
    df.write.partitionBy(*upper).parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    # Two hashes over the columns in two orders. A sum of longs as decimals does not overflow.
    names = sorted(df.columns)
    hashes = [F.sum(F.xxhash64(*[F.col(c) for c in order], F.lit(i)).cast("decimal(38,0)")).alias(f"digest_{i}") for i, order in enumerate((names, names[::-1]))]
    rows.groupBy(*upper).agg(F.count(F.lit(1)).alias("n_rows"), *hashes).write.parquet(f"{path}/digests")


def changed_folders(spark: SparkSession, old: str, new: str, upper: Sequence[str]) -> DataFrame:
    """The ``upper`` groups whose digests differ between two snapshots, or that only one of them has."""
    a, b = (spark.read.parquet(f"{p}/digests") for p in (old, new))
    values = [c for c in a.columns if c not in upper]
    both = join_groups(a, b.withColumnsRenamed({v: f"{v}_new" for v in values}), upper, "full")
    return both.filter(any_of(~F.col(v).eqNullSafe(F.col(f"{v}_new")) for v in values)).select(*upper)


def compare_snapshots(
    spark: SparkSession, old: str, new: str, upper: Sequence[str], keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Groups (``upper`` and ``keys``) whose measures differ between two snapshots, or that only one of them has.

    The comparison goes from the top: digests of folders first, then only the folders that differ are read. ``old_m`` and
    ``new_m`` are null on the side that lacks the group.
    """
    changed = changed_folders(spark, old, new, upper)
    known = all_of(F.col(c).isNotNull() for c in upper)

    def side(path: str, tag: str) -> DataFrame:
        rows = _snapshot_rows(spark, path, upper).select(*upper, *keys, *[F.col(m).alias(f"{tag}_{m}") for m in measures], F.lit(True).alias(f"__{tag}"))
        # Equal keys prune the folders as the join runs; folders of a null are few and met null-safely.
        named = changed.filter(known)
        met = rows.filter(known).join(named, list(upper), "left_semi")
        nulls = rows.filter(~known).join(
            changed.filter(~known).withColumnsRenamed({c: f"__{c}" for c in upper}), all_of(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in upper), "left_semi"
        )
        return met.unionByName(nulls)

    both = join_groups(side(old, "old"), side(new, "new"), [*upper, *keys], "full")
    differs = any_of([~F.col("__old").eqNullSafe(F.col("__new")), *[~F.col(f"old_{m}").eqNullSafe(F.col(f"new_{m}")) for m in measures]])
    return both.filter(differs).drop("__old", "__new")


def compare_by_levels(a: DataFrame, b: DataFrame, levels: Mapping[str, Sequence[str]], measures: Sequence[str]) -> DataFrame:
    """Row counts and sums of two tables at several grains, and the differences; groups of either side at each level.

    ``levels`` names the columns of each grain. A column that is not of a row's level is null there; a null value of a
    column that is stays a group of its own. Each side is read once: it is added up by all columns, and these sums are
    added up again for the levels.
    """
    columns = list(dict.fromkeys(c for grain in levels.values() for c in grain))
    # A level's number has a bit for each column that it leaves out, the first column's highest.
    number = {sum(1 << i for i, c in enumerate(reversed(columns)) if c not in grain): name for name, grain in levels.items()}
    if len(number) < len(levels):
        raise ValueError("two levels have the same columns")
    level = F.coalesce(*[F.when(F.col("__level") == n, F.lit(name)) for n, name in number.items()]).alias("level")

    def side(df: DataFrame, tag: str) -> DataFrame:
        finest = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(m).alias(m) for m in measures])
        sums = [F.sum(m).alias(f"{m}_{tag}") for m in ("n_rows", *measures)]
        by_level = finest.groupingSets([list(g) for g in levels.values()], *columns).agg(F.grouping_id().alias("__level"), *sums)
        return by_level.select(level, *columns, *[f"{m}_{tag}" for m in ("n_rows", *measures)])

    both = join_groups(side(a, "a"), side(b, "b"), ["level", *columns], "full")
    zero = F.lit(0)
    return both.withColumns({f"{m}_delta": F.coalesce(F.col(f"{m}_a"), zero) - F.coalesce(F.col(f"{m}_b"), zero) for m in ("n_rows", *measures)})


def composed_key_reconcile(
    a: DataFrame, b: DataFrame, parts: Sequence[str | Column], measures: tuple[str, str], out: str = "plan_name", sep: str = "_"
) -> DataFrame:
    """Sums of two tables by a name composed of the same parts on both sides; names of either side.

    Groups are told apart by the parts, so that (a, null, b) and (a, b, null) stay two; the name, without the null
    parts, is for display.
    """
    keys = [f"__part_{i}" for i in range(len(parts))]
    named = [col(p).cast("string").alias(k) for p, k in zip(parts, keys)]
    left = a.groupBy(*named).agg(F.sum(measures[0]).alias(measures[0]))
    right = b.groupBy(*named).agg(F.sum(measures[1]).alias(measures[1]))
    both = join_groups(left, right, keys, "full")
    return both.select(F.concat_ws(sep, *keys).alias(out), *measures).withColumn("ratio", ratio(*measures))


def taxonomy_match(df: DataFrame, mapping: DataFrame, code: str, expected: str, mapped: str = "mapped") -> DataFrame:
    """Look a code up in a (code, mapped) table without regard to case and compare with the stored value.

    ``outcome`` is ``match``, ``mismatch``, ``unmapped``, or ``ambiguous`` for a code with several targets, which keeps
    its one row, with the smallest target.
    """
    targets = mapping.groupBy(F.lower("code").alias("__code")).agg(F.min(mapped).alias(mapped), F.max(mapped).alias("__last"))
    lookup = measured(targets)
    joined = df.join(lookup, F.lower(code) == F.col("__code"), "left")
    outcome = F.when(F.col(mapped).isNull(), "unmapped").when(F.col(mapped) != F.col("__last"), "ambiguous").when(F.col(mapped) == F.col(expected), "match").otherwise("mismatch")
    return joined.withColumn("outcome", outcome).drop("__code", "__last")


def wide_export(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]], columns: Sequence[str]) -> DataFrame:
    """Distinct rows of the chosen columns of a fact and its dims."""
    for dim, key, how in dims:
        fact = fact.join(dim, key, how)
    return fact.select(*columns).distinct()


def plan_actual_join(actual: DataFrame, plan: DataFrame, grain: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Actual and planned amounts per group, rounded to cents. ``on`` are the grain columns the plan has as well."""
    spent = sum_by(actual, grain, SPENDS)
    joined = join_groups(spent, planned_summary(plan, on, BUDGETS), on, "left")
    return joined.select(*grain, *[F.round(F.col(c).cast("decimal(38,4)"), 2).alias(c) for c in (*SPENDS, *BUDGETS)])


def reversed_spans(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(F.col(end) < F.col(start))


def spread_daily(df: DataFrame, start: str, end: str, amount: str, out: str = "daily_amount") -> DataFrame:
    """One row per day of each span with amount / days, as a decimal. Reversed spans are left out (see ``reversed_spans``)."""
    return (
        df.filter(F.col(end) >= F.col(start))
        .withColumn(out, F.try_divide(F.col(amount).cast(EXACT), days_inclusive(start, end)))
        .withColumn("day", F.explode(F.sequence(start, end, F.expr("interval 1 day"))))
    )


def daily_totals(df: DataFrame, start: str, end: str, amount: str, grain: Sequence[str] = (), out: str = "daily_amount") -> DataFrame:
    """The sum over all spans of amount / days, per grain and day that some span covers (column ``day``).

    A span is two rows, its share added at the start and taken off after the end; they are summed per date, and up to
    each date in order. Days are laid out from these steps, so there are never more of them than the result has.
    Shares are decimals, so the sums are those of ``spread_daily`` to the last digit. A null amount counts as a
    covered day; a day with null amounts alone has a null sum. Reversed spans are left out, as are null ends.
    """
    share = F.try_divide(F.col(amount).cast(EXACT), days_inclusive(start, end))
    spans = df.filter(F.col(end) >= F.col(start)).select(*grain, F.col(start).alias("__from"), F.date_add(end, 1).alias("__to"), share.alias("__share"))
    known = F.col("__share").isNotNull().cast("int")
    edge = [F.struct(F.col(d).alias("day"), (F.col("__share") * sign).alias("share"), F.lit(sign).alias("spans"), (known * sign).alias("known")) for d, sign in (("__from", 1), ("__to", -1))]
    steps = spans.select(*grain, F.inline(F.array(*edge))).groupBy(*grain, "day").agg(*[F.sum(c).alias(c) for c in ("share", "spans", "known")])
    # One row per date on which something begins or ends: the calendar bounds the rows of a window.
    upto = Window.partitionBy(*grain).orderBy("day")
    so_far = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = steps.select(
        *grain, "day", F.lead("day").over(upto).alias("__next"), *[F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(f"__{c}") for c in ("share", "spans", "known")]
    )
    laid = F.explode(F.sequence("day", F.date_sub("__next", 1), F.expr("interval 1 day"))).alias("day")
    return levels.filter("__spans > 0").select(*grain, F.when(F.col("__known") > 0, F.col("__share")).alias(out), laid)


def spread_monthly(df: DataFrame, start: str, end: str, amount: str, grain: Sequence[str], out: str = "monthly_amount") -> DataFrame:
    """Daily spreading summed per month end, without laying out the days.

    Each span is laid out per month it touches and weighted with its days in that month: about 30 times fewer
    rows than one per day.
    """
    month = F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))
    in_month = days_inclusive(F.greatest(F.col(start), F.col("__month")), F.least(F.col(end), F.last_day("__month")))
    return (
        df.filter(F.col(end) >= F.col(start))
        .select("*", month.alias("__month"))
        .groupBy(*grain, F.last_day("__month").alias("month_end"))
        .agg(F.sum(F.try_divide(F.col(amount).cast(EXACT), days_inclusive(start, end)) * in_month).alias(out))
    )


def monthly_actual(fact: DataFrame, date: str, grain: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return sum_by(fact, [*grain, F.last_day(date).alias("month_end")], measures)


def fiscal_calendar(df: DataFrame, date: str, weeks_per_period: int = 4, periods: int = 13) -> DataFrame:
    """Calendar over the dates of a table: calendar_date, cal_year, cal_week_of_year, fiscal_period."""
    period = F.least(F.lit(periods), F.floor((F.dayofyear("calendar_date") - 1) / (7 * weeks_per_period)).cast("int") + 1)
    return (
        df.agg(F.min(date).cast("date").alias("lo"), F.max(date).cast("date").alias("hi"))
        .select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("calendar_date"))
        .select(
            "calendar_date",
            F.year("calendar_date").alias("cal_year"),
            F.weekofyear("calendar_date").alias("cal_week_of_year"),
            F.concat(F.lit("P"), F.lpad(period.cast("string"), 2, "0")).alias("fiscal_period"),
        )
    )


def fiscal_rollup(fact: DataFrame, calendar: DataFrame, date: str, grain: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums per fiscal period. Facts are added up per day before they meet the calendar."""
    fact_grain = [g for g in grain if g in fact.columns]
    daily = sum_by(fact, [*fact_grain, date], measures)
    return sum_by(daily.join(calendar, F.col(date) == F.col("calendar_date")), grain, measures)


def _moments(columns: Sequence[str], by: Sequence[str], schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes of a task's rows, per group and pair of columns: rows with both values, their means, and sums of squares
    and products around these means. A batch is a matrix product; batches are merged by the shift of their means."""
    first, second = np.triu_indices(len(columns))

    def batch_moments(x: np.ndarray) -> np.ndarray:
        there = ~np.isnan(x)
        shift = np.where(there.any(axis=0), np.nansum(x, axis=0) / np.maximum(there.sum(axis=0), 1), 0)
        z, m = np.where(there, x - shift, 0), there.astype(float)
        n, sums, squares, products = m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z
        safe = np.maximum(n, 1)
        mean = sums / safe  # of the row's column over the rows that also have the other column
        spread = squares - sums * mean
        return np.stack([n, mean + shift[:, None], mean.T + shift, spread, spread.T, products - sums * mean.T])

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        weight = b[0] / np.maximum(n, 1)
        dx, dy = b[1] - a[1], b[2] - a[2]
        both = a[0] * weight
        return np.stack([n, a[1] + dx * weight, a[2] + dy * weight, a[3] + b[3] + dx * dx * both, a[4] + b[4] + dy * dy * both, a[5] + b[5] + dx * dy * both])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            keys = [k for k in state for _ in first]
            values = np.concatenate([v[:, first, second] for v in state.values()], axis=1)
            pairs = len(state)
            arrays = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(len(by))]
            arrays += [pa.array([columns[i] for i in first.tolist()] * pairs), pa.array([columns[i] for i in second.tolist()] * pairs)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(values[0].astype(np.int64)), *map(pa.array, values[1:])], schema=schema)

        for batch in batches:
            x = np.stack([batch.column(len(by) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], axis=1)
            if by:
                keys = pa.Table.from_batches([batch.select(range(len(by)))]).to_pylist()
                number: dict[tuple, int] = {}
                of = np.array([number.setdefault(tuple(k.values()), len(number)) for k in keys])
            else:
                number, of = {(): 0}, np.zeros(len(x), int)
            order = np.argsort(of, kind="stable")
            for key, rows in zip(number, np.split(order, np.cumsum(np.bincount(of, minlength=len(number)))[:-1])):
                found = batch_moments(x[rows])
                state[key] = merged(state[key], found) if key in state else found
            if len(state) * len(first) > CELLS:
                yield out()
                state.clear()
        if state:
            yield out()

    return run


def correlation_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns per group, in long form; null where a column is constant.

    Only rows with both values count for a pair. The table is read once, however many columns there are: each task
    multiplies the matrix of its rows with itself, with masks for missing values (numpy; no product of columns is a
    column of the plan), and the moments, one row per task, group and pair, are merged around their common means.
    A value that is not a number counts as missing.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    kinds = [StructField(c, StringType()) for c in ("column_a", "column_b")] + [StructField("__n", LongType())]
    kinds += [StructField(f"__{m}", DoubleType()) for m in ("x", "y", "xx", "yy", "xy")]
    schema = StructType([StructField(f.name, f.dataType) for f in df.select(*by).schema] + kinds)
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)])
    moments = rows.mapInArrow(_moments(list(columns), list(by), to_arrow_schema(schema)), schema)
    pair = Window.partitionBy(*by, "column_a", "column_b")
    mean = {m: F.try_divide(F.sum(F.col("__n") * F.col(m)).over(pair), F.sum("__n").over(pair)) for m in ("__x", "__y")}
    moments = moments.withColumns({f"{m}_off": F.col(m) - c for m, c in mean.items()})
    total = {
        "xx": F.sum(F.col("__xx") + F.col("__n") * F.col("__x_off") * F.col("__x_off")),
        "yy": F.sum(F.col("__yy") + F.col("__n") * F.col("__y_off") * F.col("__y_off")),
        "xy": F.sum(F.col("__xy") + F.col("__n") * F.col("__x_off") * F.col("__y_off")),
    }
    sums = moments.groupBy(*by, "column_a", "column_b").agg(*[x.alias(f"__{m}") for m, x in total.items()])
    value = F.when(F.col("column_a") == F.col("column_b"), F.when(F.col("__xx") > 0, 1.0)).otherwise(F.try_divide("__xy", F.sqrt("__xx") * F.sqrt("__yy")))
    return sums.select(*by, "column_a", "column_b", value.alias("correlation"))


def expected_rows_vs_days(df: DataFrame, grain: Sequence[str], date: str, start: Column, end: Column, offset: int | Column = 0) -> DataFrame:
    """Groups whose number of dated rows is not their days in flight (first and last day included) plus ``offset``.

    ``start`` and ``end`` are aggregates, such as ``F.min('start_date')`` for a declared span. ``offset`` may be a
    column of the grain, for instance one value on either side of a date.
    """
    days = F.datediff(end, start) + 1
    per_group = df.groupBy(*grain).agg(F.count(date).alias("n_rows"), days.cast("bigint").alias("expected_rows"))
    extra = F.lit(offset) if isinstance(offset, int) else offset
    per_group = per_group.withColumn("expected_rows", (F.col("expected_rows") + extra).cast("bigint"))
    return per_group.filter(F.col("n_rows") != F.col("expected_rows"))


def in_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` in the order of ``keys``, with ``__part`` (the range a row is in) and ``__place`` (its place there, from 0).

    One range shuffle puts the rows in order, whatever share a key has of them. Each range is written as one bucket, so
    windows and sums within the ranges shuffle nothing: only what crosses their ends is left to add.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranges")
    table = "ranges_" + path.rsplit("-", 1)[-1]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"__part": F.spark_partition_id(), "__place": place})
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered.write.bucketBy(buckets, "__part").option("path", path).saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog's entry; the files stay
    return rows


def non_monotonic(df: DataFrame, grain: Sequence[str], date: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is below the value of the row before, in the order (date, *order) within the grain.

    ``order`` must break ties within a date. Each range of rows (see ``in_ranges``) is scanned by itself; its first row is
    compared with the last one of the range before, of which one row per range is broadcast. No task holds a grain or a
    day, however many rows it has. A null before or now is no fall.
    """
    rows = in_ranges(df, [*grain, date, *order])
    row = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(grain)], F.col(value).alias("value"))
    ends = rows.groupBy("__part").agg(F.max_by(row, "__place").alias("__end"))
    carry = ends.select("__part", F.lag("__end").over(Window.orderBy("__part")).alias("__carry"))
    before = F.coalesce(F.lag(row).over(Window.partitionBy("__part").orderBy("__place")), F.col("__carry"))
    rows = rows.join(F.broadcast(carry), "__part").withColumn("__before", before)
    same = all_of(F.col(g).eqNullSafe(F.col(f"__before.g{i}")) for i, g in enumerate(grain))
    found = rows.filter(F.col("__before").isNotNull() & same & (F.col(value) < F.col("__before.value")))
    return found.select(*df.columns, F.col("__before.value").alias("previous_value"))


def daily_running_total(df: DataFrame, key: Sequence[str], date: str, value: str, out: str = "running_total") -> DataFrame:
    """One row per key and date: the sum up to and including that date. Dates bound the rows of a window."""
    daily = df.groupBy(*key, date).agg(F.sum(value).alias("__day"))
    upto = Window.partitionBy(*key).orderBy(date).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn(out, F.sum("__day").over(upto)).drop("__day")


def running_total(df: DataFrame, key: Sequence[str], date: str, value: str, out: str = "running_total") -> DataFrame:
    """Every row with the running sum of its key up to its date; rows of one date share it (range frame).

    Each range of rows (see ``in_ranges``) is summed up by itself. What is missing is broadcast, two rows per range: for the
    key a range begins with, the sum in the ranges before; for the date it ends with, the rest of that date behind.
    """
    rows = in_ranges(df, [*key, date])
    names = [*key, date]
    size = F.max("__place").over(Window.partitionBy("__part"))
    ends = rows.withColumn("__last", size).filter("__place = 0 or __place = __last").select("__part", *names).distinct()

    def at_ends(by: Sequence[str], frame, total: str) -> DataFrame:
        """Of the groups that a range begins or ends with: their sum in the ranges before or behind."""
        group = {n: f"__k{i}" for i, n in enumerate(by)}
        mine = rows.groupBy("__part", *by).agg(F.sum(value).alias("__sum")).withColumnsRenamed(group)
        edge = ends.select(F.col("__part").alias("__p"), *[F.col(n).alias(f"__e{i}") for i, n in enumerate(by)]).distinct()
        same = [F.col("__part") == F.col("__p"), *[F.col(f"__k{i}").eqNullSafe(F.col(f"__e{i}")) for i in range(len(by))]]
        mine = mine.join(F.broadcast(edge), same, "left_semi")
        return mine.withColumn(total, F.sum("__sum").over(frame(Window.partitionBy(*group.values()).orderBy("__part")))).drop("__sum")

    before = at_ends(key, lambda w: w.rowsBetween(Window.unboundedPreceding, -1), "__before")
    behind = at_ends(names, lambda w: w.rowsBetween(1, Window.unboundedFollowing), "__behind")
    upto = Window.partitionBy("__part", *key).orderBy(date).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn(out, F.sum(value).over(upto))
    kind = dict(rows.dtypes)[out]
    for more, by in ((before, key), (behind, names)):
        same = [rows["__part"] == F.col("__p"), *[rows[n].eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(by)]]
        rows = rows.join(F.broadcast(more.withColumnRenamed("__part", "__p")), same, "left").drop("__p", *[f"__k{i}" for i in range(len(by))])
    parts = [F.col(out), F.col("__before"), F.col("__behind")]
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    return rows.withColumn(out, F.when(F.coalesce(*parts).isNotNull(), total).cast(kind)).select(*df.columns, out)


def join_fanout(fact: DataFrame, steps: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Rows after each step of a join chain on fact keys, without producing them.

    ``steps`` are (name, right, key, how) with how ``left`` or ``inner``. The fact is reduced to one row per key
    combination with its row count, each right side to the rows per key; the counts are multiplied as decimals of 38
    digits (more rows than that raise an overflow).
    ``key_is_unique`` tells whether the right side holds its key once at most.
    """
    keys = list(dict.fromkeys(k for _, _, k, _ in steps))
    weights = fact.groupBy(*keys).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("__w0"))
    uniqueness = []
    for i, (name, right, key, how) in enumerate(steps, 1):
        per_key = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(f"__n{i}"))
        uniqueness.append(
            per_key.agg((F.coalesce(F.max(f"__n{i}"), F.lit(0)) <= 1).alias("key_is_unique")).select(F.lit(i).alias("step"), "key_is_unique")
        )
        matches = F.coalesce(F.col(f"__n{i}"), F.lit(1 if how == "left" else 0))
        weights = weights.join(per_key, key, "left").withColumn(f"__w{i}", (F.col(f"__w{i - 1}") * matches).cast("decimal(38,0)"))
    totals = weights.agg(*[F.sum(f"__w{i}").alias(f"__t{i}") for i in range(len(steps) + 1)])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.lit(name).alias("step_name"),
                F.coalesce(F.col(f"__t{i - 1}"), F.lit(0)).cast("decimal(38,0)").alias("rows_before"),
                F.coalesce(F.col(f"__t{i}"), F.lit(0)).cast("decimal(38,0)").alias("rows_after"),
            )
            for i, (name, _, _, _) in enumerate(steps, 1)
        ]
    )
    return totals.select(F.inline(rows)).join(union_all(uniqueness), "step")


def extract_shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and rows that repeat an earlier one."""
    found = duplicate_row_count({"extract": df})
    return found.select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "n_duplicates")


def profile_extract(df: DataFrame) -> DataFrame:
    """Rows, nulls and distinct values per column, in long form; nested columns are compared as text.

    Columns are turned into (column, value) pairs and counted by the SHA-256 of the value first, so each value is
    shuffled as 32 bytes once per task at most, and no column needs a pass of its own.
    """
    pairs = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in df.columns]))
    )
    per_value = pairs.select("column_name", F.unhex(F.sha2("v", 256)).alias("v")).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"),
        F.count("v").alias("n_distinct"),
    )
