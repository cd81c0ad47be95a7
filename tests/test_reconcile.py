import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import reconcile as rec

D = dt.date


@pytest.fixture(scope="module")
def sides(spark):
    dec = Decimal
    plan = spark.createDataFrame(
        [("US", 1, dec(100), dec(100)), ("US", 1, dec(100), dec(100)), ("US", 2, dec(50), dec(50)), ("DE", 3, dec(0), dec(0)), ("FR", 4, dec(9), None)],
        "c string, plan_line_id int, budget_usd decimal(18,4), budget_lc decimal(18,4)",
    )
    actual = spark.createDataFrame(
        [("US", dec(30), dec(30)), ("US", dec(150), dec(150)), ("DE", dec(5), dec(10)), ("FR", dec(1), dec(2)), ("XX", dec(0), dec(1))],
        "c string, spend_usd decimal(18,4), spend_lc decimal(18,4)",
    )
    return plan, actual


def test_plan_lines_count_once_and_zero_budget_gives_null(sides, rows):
    got = rows(rec.plan_vs_actual(*sides, ["c"]), "c", "budget_usd", "variance_usd", "variance_lc")
    assert got == [("DE", 0, None, None), ("FR", 9, pytest.approx(100 / 9), None), ("US", 150, 120.0, 120.0)]
    assert rows(rec.plan_vs_actual_outliers(*sides, ["c"]), "c") == [("US",)]


def test_violation_share_is_one_row(sides, rows):
    assert rows(rec.violation_share(rec.plan_vs_actual(*sides, ["c"]), rec.is_outlier())) == [(1, 3, pytest.approx(1 / 3))]


def test_fx_ratios(sides, spark, rows):
    ratios = rec.fx_ratio_consistency(*sides, ["c"])
    assert rows(ratios, "c", "actual_ratio", "planned_ratio", "ratio") == [("DE", 2.0, None, None), ("FR", 2.0, None, None), ("US", 1.0, 1.0, 1.0)]
    fx = spark.createDataFrame([("DE", 1.0), ("US", 0.0)], "c string, latest_value double")
    assert rows(rec.fx_vs_reference(ratios, fx, "c"), "c", "vs_reference") == [("DE", 2.0), ("FR", None), ("US", None)]


def test_yearly_sides(sides, rows):
    assert rows(rec.yearly_sides(*sides, ["c"], only_zero=True), "c") == [("DE",), ("FR",), ("XX",)]


def test_recompute_ratio(spark, rows):
    df = spark.createDataFrame([(100, 3, 33.33), (100, 3, 33.3), (1, 0, 5.0)], "n int, d int, f double")
    assert rows(rec.recompute_ratio(df, "n", "d", "f"), "f", "difference") == [(33.3, 0.03)]


def test_compare_sums_keeps_either_side_when_full(sides, spark, rows):
    plan, actual = sides
    full = rec.compare_sums(actual, plan.filter("c <> 'US'"), ["c"], {"r": ("spend_usd", "budget_usd")}, "full")
    assert rows(full, "c", "r") == [("DE", None), ("FR", pytest.approx(1 / 9)), ("US", None), ("XX", None)]


def test_compare_sums_of_equal_names(sides, rows):
    actual = sides[1]
    got = rec.compare_sums(actual, actual, ["c"], {"r": ("spend_usd", "spend_usd")})
    assert got.columns == ["c", "spend_usd", "spend_usd_b", "r"] and rows(got, "c", "r")[-1] == ("XX", None)


def test_versions(spark, rows):
    df = spark.createDataFrame([("v1", 1, 5), ("v2", 1, 6), ("v2", 2, 7), ("v2", 2, 1)], "v string, k int, m int")
    assert rows(rec.version_compare(df, "v", "k", ["m"])) == [("v1", 1, 1, 5), ("v2", 3, 2, 14)]
    assert rows(rec.only_in_latest(df, "v", ["k"])) == [(2, "v2")]


def test_environment_compare(spark, rows):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "g string, m int")
    b = spark.createDataFrame([("x", 3), ("z", 4)], "g string, m int")
    assert rows(rec.environment_compare(a, b, ["g"], ["m"]), "g", "n_rows_delta", "m_delta") == [("x", 1, 0), ("y", 1, 3), ("z", -1, -4)]


def test_taxonomy_has_three_outcomes(spark, rows):
    df = spark.createDataFrame([("AA", "one"), ("bb", "two"), ("cc", "x"), (None, "x")], "code string, brand string")
    mapping = spark.createDataFrame([("aa", "one"), ("BB", "zwei"), ("bb", "zwei")], "code string, mapped string")
    assert rows(rec.taxonomy_match(df, mapping, "code", "brand"), "code", "outcome") == [
        (None, "unmapped"), ("AA", "match"), ("bb", "mismatch"), ("cc", "unmapped")
    ]


SPANS = [
    (1, D(2024, 1, 20), D(2024, 2, 10), 220.0),  # over a month end
    (2, D(2024, 2, 29), D(2024, 2, 29), 5.0),  # one leap day
    (3, D(2023, 12, 15), D(2024, 3, 5), 82.0),  # over a year end
    (4, D(2024, 3, 2), D(2024, 3, 1), 7.0),  # reversed
]


def test_spreading_sums_back_to_the_amount(spark, rows):
    df = spark.createDataFrame(SPANS, "id int, s date, e date, amount double")
    daily = rec.spread_daily(df, "s", "e", "amount")
    back = daily.groupBy("id").agg(F.round(F.sum("daily_amount"), 6), F.count("day"))
    assert rows(back) == [(1, 220.0, 22), (2, 5.0, 1), (3, 82.0, 82)]
    assert rows(rec.reversed_spans(df, "s", "e"), "id") == [(4,)]


def test_monthly_spread_equals_the_daily_one_per_month(spark, rows):
    df = spark.createDataFrame(SPANS, "id int, s date, e date, amount double")
    daily = rec.spread_daily(df, "s", "e", "amount").groupBy("id", F.last_day("day").alias("m")).agg(F.round(F.sum("daily_amount"), 6))
    monthly = rec.spread_monthly(df, "s", "e", "amount", ["id"]).withColumn("monthly_amount", F.round("monthly_amount", 6))
    assert rows(daily) == rows(monthly)


def test_correlation_of_perfect_inverse_constant_and_single(spark, rows):
    data = [("p", 1.0, 2.0), ("p", 2.0, 4.0), ("i", 1.0, 4.0), ("i", 2.0, 2.0), ("c", 1.0, 7.0), ("c", 2.0, 7.0), ("s", 1.0, 1.0)]
    df = spark.createDataFrame(data, "g string, a double, b double")
    got = rec.correlation_matrix(df, ["a", "b"], ["g"]).filter("column_a <> column_b").withColumn("r", F.round("correlation", 9))
    assert rows(got, "g", "r") == [("c", None), ("i", -1.0), ("p", 1.0), ("s", None)]


def test_correlation_uses_rows_with_both_values(spark, rows):
    df = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 2.0), ("g", 900.0, None), ("g", None, 5.0)], "g string, a double, b double")
    got = rec.correlation_matrix(df, ["a", "b"], ["g"]).filter("column_a <> column_b").withColumn("r", F.round("correlation", 9))
    assert rows(got, "r") == [(1.0,)]


def test_expected_rows(spark, rows):
    d = D(2024, 1, 1)
    df = spark.createDataFrame([("a", d), ("a", D(2024, 1, 2)), ("b", d), ("b", D(2024, 1, 3))], "k string, d date")
    assert rows(rec.expected_rows_vs_days(df, ["k"], "d", F.min("d"), F.max("d"))) == [("b", 2, 3)]
    assert rows(rec.expected_rows_vs_days(df, ["k"], "d", F.min("d"), F.max("d"), offset=-1)) == [("a", 2, 1)]


def brute_force_falls(data):
    """Row by row in the order (grain, date, id)."""
    out, last = [], {}
    for k, d, i, v in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        before = last.get(k)
        if before is not None and v is not None and v < before:
            out.append((k, d, i, v, before))
        last[k] = v
    return sorted(out)


def test_non_monotonic_against_brute_force(spark):
    import random

    rng = random.Random(3)
    data = [
        (rng.choice("abb"), D(2024, 1, 1) + dt.timedelta(days=rng.randrange(6)), i, rng.choice([None, 1, 2, 3, 3, 4, 5]))
        for i in range(300)
    ]
    df = spark.createDataFrame(data, "k string, d date, id int, v int")
    got = rec.non_monotonic(df, ["k"], "d", ["id"], "v")
    assert sorted(tuple(r) for r in got.collect()) == brute_force_falls(data)


def test_running_total_shares_ties(spark, rows):
    data = [("a", 1, 10), ("a", 2, 5), ("a", 2, 7), ("a", 3, 1), ("b", 1, 4), (None, 1, 2)]
    df = spark.createDataFrame(data, "k string, d int, v int")
    assert rows(rec.running_total(df, ["k"], "d", "v")) == [(None, 1, 2, 2), ("a", 1, 10, 10), ("a", 2, 5, 22), ("a", 2, 7, 22), ("a", 3, 1, 23), ("b", 1, 4, 4)]


def test_join_fanout_equals_the_joins(spark, rows):
    fact = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (None, 3)], "a int, b int")
    left = spark.createDataFrame([(1,), (1,), (3,), (None,)], "a int")
    inner = spark.createDataFrame([(1,), (3,)], "b int")
    got = rows(rec.join_fanout(fact, [("left", left, "a", "left"), ("inner", inner, "b", "inner")]))
    first = fact.join(left, "a", "left")
    second = first.join(inner, "b")
    assert got == [(1, "left", 4, first.count(), False), (2, "inner", first.count(), second.count(), True)]


def test_profile_extract(spark, rows):
    df = spark.createDataFrame([("x", 1), ("x", None), (None, 2), ("y" * 100, 2)], "s string, n int")
    assert rows(rec.profile_extract(df)) == [("n", 4, 1, 2), ("s", 4, 1, 2)]


def test_fiscal_calendar_and_rollup(spark, rows):
    fact = spark.createDataFrame([(D(2024, 1, 1), 1), (D(2024, 1, 28), 2), (D(2024, 1, 29), 4), (D(2024, 12, 31), 8)], "d date, m int")
    calendar = rec.fiscal_calendar(fact, "d")
    assert calendar.count() == 366
    assert rows(rec.fiscal_rollup(fact, calendar, "d", ["fiscal_period"], ["m"])) == [("P01", 3), ("P02", 4), ("P13", 8)]


def test_small_reconciliations(spark, rows):
    df = spark.createDataFrame([("a", 120.0, 100.0), ("b", 1.0, 0.0)], "g string, x double, y double")
    assert rows(rec.relative_variance(df, "x", "y"), "g", "variance_pct") == [("a", 20.0), ("b", None)]
    assert rows(rec.ratio_of_ratios(df, ["g"], ("x", "y"), ("y", "x"))) == [("a", 1.2, pytest.approx(1 / 1.2), pytest.approx(1.44)), ("b", None, 0.0, None)]
    assert rows(rec.composed_key_reconcile(df, df.filter("g = 'a'"), ["g", F.lit("z")], ("x", "y")), "plan_name", "ratio") == [("a_z", 1.2), ("b_z", None)]


@pytest.fixture(scope="module")
def null_groups(spark):
    plan = spark.createDataFrame([(None, 1, 10, 20), ("a", 2, 5, 5)], "g string, plan_line_id int, budget_usd int, budget_lc int")
    actual = spark.createDataFrame([(None, 4, 10), ("a", 5, 5), (None, 1, 0)], "g string, spend_usd int, spend_lc int")
    return plan, actual


def test_null_groups_meet(null_groups, rows):
    plan, actual = null_groups
    assert rows(rec.plan_vs_actual(plan, actual, ["g"]), "g", "variance_usd") == [(None, 50.0), ("a", 100.0)]
    assert rows(rec.fx_ratio_consistency(plan, actual, ["g"]), "g", "ratio") == [(None, 1.0), ("a", 1.0)]
    assert rows(rec.yearly_sides(plan, actual, ["g"], only_zero=True)) == []
    pairs = {"r": ("spend_usd", "budget_usd")}
    for how in ("inner", "left", "full"):
        assert rows(rec.compare_sums(actual, plan, ["g"], pairs, how), "g", "r") == [(None, 0.5), ("a", 1.0)]
    assert rows(rec.plan_actual_join(actual, plan, ["g"], ["g"]), "g", "budget_usd") == [(None, 10), ("a", 5)]


def test_a_table_equals_itself_with_null_keys(null_groups, rows):
    _, actual = null_groups
    got = rec.environment_compare(actual, actual, ["g"], ["spend_usd"])
    assert rows(got, "g", "n_rows_delta", "spend_usd_delta") == [(None, 0, 0), ("a", 0, 0)]


def test_composed_keys_with_null_parts_stay_apart(spark, rows):
    a = spark.createDataFrame([("a", None, "b", 1), ("a", "b", None, 2)], "x string, y string, z string, v int")
    b = spark.createDataFrame([("a", "b", None, 4)], "x string, y string, z string, w int")
    assert rows(rec.composed_key_reconcile(a, b, ["x", "y", "z"], ("v", "w"))) == [("a_b", 1, None, None), ("a_b", 2, 4, 0.5)]


def test_a_code_with_two_targets_keeps_one_row(spark, rows):
    df = spark.createDataFrame([(1, "x", "m"), (2, "y", "m")], "id int, code string, stored string")
    mapping = spark.createDataFrame([("X", "m"), ("x", "n"), ("Y", "m"), ("y", "m")], "code string, mapped string")
    assert rows(rec.taxonomy_match(df, mapping, "code", "stored"), "id", "mapped", "outcome") == [(1, "m", "ambiguous"), (2, "m", "match")]


def test_fanout_beyond_a_long(spark):
    fact = spark.range(3_000_000).selectExpr("1 AS k")
    right = spark.range(3_000_000).selectExpr("1 AS k")
    out = rec.join_fanout(fact, [(f"s{i}", right, "k", "left") for i in range(3)]).orderBy("step").collect()
    assert [int(r.rows_after) for r in out] == [9 * 10**12, 27 * 10**18, 81 * 10**24]


def test_profile_tells_a_text_from_its_digest(spark, rows):
    long = "x" * 100
    df = spark.createDataFrame([(long,), (hashlib.sha256(long.encode()).hexdigest(),), (None,)], "v string")
    assert rows(rec.profile_extract(df)) == [("v", 3, 1, 2)]


def test_offsets_on_either_side(spark, rows):
    data = [(1, 1, dt.date(2020, 1, d)) for d in (1, 2)] + [(1, 2, dt.date(2020, 1, d)) for d in (5, 6)]
    df = spark.createDataFrame(data, "g int, side int, date date")
    got = rec.expected_rows_vs_days(df, ["g", "side"], "date", F.min("date"), F.max("date"), F.col("side") - 1)
    assert rows(got) == [(1, 2, 2, 3)]


def scans(df, table):
    return df._jdf.queryExecution().executedPlan().toString().count(table)


def test_levels_equal_a_group_by_each(spark, rows):
    a = spark.createDataFrame([("x", 1, "p", 5), ("x", 1, None, 2), ("x", 2, "p", 1), (None, 2, "q", 4), (None, 2, "q", 3)], "c string, y int, n string, v int")
    b = spark.createDataFrame([("x", 1, "p", 5), ("z", 9, "p", None)], "c string, y int, n string, v int")
    got = rec.compare_by_levels(a, b, {"name": ["c", "y", "n"], "year": ["c", "y"], "all": []}, ["v"])
    want = []
    for level, grain in (("name", ["c", "y", "n"]), ("year", ["c", "y"]), ("all", [])):
        one = rec.environment_compare(a, b, grain, ["v"]) if grain else None
        if one is not None:
            picked = [F.col(c) if c in grain else F.lit(None).alias(c) for c in ("c", "y", "n")]
            want += rows(one.select(F.lit(level), *picked, "n_rows_a", "n_rows_b", "n_rows_delta", "v_a", "v_b", "v_delta"))
    got = rows(got, "level", "c", "y", "n", "n_rows_a", "n_rows_b", "n_rows_delta", "v_a", "v_b", "v_delta")
    assert [r for r in got if r[0] == "all"] == [("all", None, None, None, 5, 2, 3, 15, 5, 10)]
    assert sorted(map(str, (r for r in got if r[0] != "all"))) == sorted(map(str, want))
    with pytest.raises(ValueError):
        rec.compare_by_levels(a, b, {"u": ["c"], "v": ["c"]}, ["v"])


def test_levels_read_each_side_once(spark, tmp_path):
    for side in "ab":
        spark.range(9).selectExpr("id % 2 AS c", "id % 3 AS y", "id AS v").write.parquet(str(tmp_path / side))
    a, b = (spark.read.parquet(str(tmp_path / side)) for side in "ab")
    plan = rec.compare_by_levels(a, b, {"fine": ["c", "y"], "c": ["c"], "y": ["y"]}, ["v"])
    assert scans(plan, "FileScan") == 2


def test_daily_totals_equal_the_laid_out_days(spark, rows):
    import random

    rng = random.Random(5)
    day = lambda: rng.choice([None] + [D(2024, 2, 1) + dt.timedelta(days=rng.randrange(60))] * 9)
    spans = [(rng.choice(["a", "b", None]), day(), day(), rng.choice([None, Decimal(7), Decimal(100), Decimal("0.01"), Decimal(-3)])) for _ in range(120)]
    df = spark.createDataFrame(spans, "g string, s date, e date, amount decimal(18,4)")
    for grain in ([], ["g"]):
        want = rec.spread_daily(df, "s", "e", "amount").groupBy(*grain, "day").agg(F.sum("daily_amount").alias("daily_amount"))
        got = rec.daily_totals(df, "s", "e", "amount", grain)
        columns = [*grain, "day", "daily_amount"]
        assert rows(got, *columns) == rows(want, *columns)
    plan = rec.daily_totals(df, "s", "e", "amount", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence") < plan.index("Aggregate")  # above it in the tree, so after it


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_ranges_cut_anywhere(spark, partitions):
    """A campaign with a third of the rows and a day with most of those, over many ranges."""
    import random

    rng = random.Random(partitions)
    hot = [("hot", D(2024, 1, 3) if rng.random() < 0.8 else D(2024, 1, 1) + dt.timedelta(days=rng.randrange(6)), i, rng.choice([None, 1, 2, 5])) for i in range(200)]
    rest = [(rng.choice("abcd") + str(i % 40), D(2024, 1, 1) + dt.timedelta(days=rng.randrange(6)), 1000 + i, rng.choice([None, 1, 2, 5])) for i in range(400)]
    data = hot + rest
    df = spark.createDataFrame(data, "k string, d date, id int, v int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        falls = rec.non_monotonic(df, ["k"], "d", ["id"], "v")
        totals = rec.running_total(df, ["k"], "d", "v")
        assert sorted(tuple(r) for r in falls.collect()) == brute_force_falls(data)
        want = []
        for k, d, i, v in data:
            upto = [x[3] for x in data if x[0] == k and x[1] <= d and x[3] is not None]
            want.append((k, d, i, v, sum(upto) if upto else None))
        assert sorted(map(str, (tuple(r) for r in totals.collect()))) == sorted(map(str, want))
        for frame in (falls, totals):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            # What is left behind the range shuffle: the carried rows, and no join of all rows with themselves.
            assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_falls_need_no_shuffle_behind_the_ranges(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "date'2024-01-01' AS d", "id", "id % 7 AS v")
    plan = rec.non_monotonic(df, ["k"], "d", ["id"], "v")._jdf.queryExecution().executedPlan().toString()
    # The only exchanges are those of one row per range: to one place, and back as a broadcast.
    assert plan.count("Exchange hashpartitioning") == 0 and plan.count("Exchange SinglePartition") == 1


def test_correlations_against_numpy(spark):
    import numpy as np

    r = np.random.default_rng(6)
    names = [f"c{i}" for i in range(20)]
    x = r.standard_normal((600, 20)) @ r.standard_normal((20, 20)) + 1e9 * (np.arange(20) % 3 == 0)
    x[r.random(x.shape) < 0.1] = np.nan
    groups = [r.choice(["a", "b", None]) for _ in x]
    data = [(g, *[None if np.isnan(v) else float(v) for v in row]) for g, row in zip(groups, x)]
    df = spark.createDataFrame(data, "g string, " + ", ".join(f"{n} double" for n in names)).repartition(6)
    got = {(t.g, t.column_a, t.column_b): t.correlation for t in rec.correlation_matrix(df, names, ["g"]).collect()}
    assert len(got) == 3 * 210
    for g in ("a", "b", None):
        mine = x[[h == g for h in groups]]
        for i in range(20):
            for j in range(i, 20):
                both = ~np.isnan(mine[:, i]) & ~np.isnan(mine[:, j])
                want = np.corrcoef(mine[both, i] - np.nanmean(mine[:, i]), mine[both, j] - np.nanmean(mine[:, j]))[0, 1]
                assert got[g, names[i], names[j]] == pytest.approx(want, abs=1e-5)


def test_correlations_read_the_table_once(spark, tmp_path):
    names = [f"c{i}" for i in range(20)]
    spark.range(50).select("id", *[(F.col("id") * i % 7).cast("double").alias(n) for i, n in enumerate(names)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    matrix = rec.correlation_matrix(df, names, [])
    assert scans(matrix, "FileScan") == 1 and matrix.count() == 210
    assert rec.correlation_matrix(df.limit(0), names, []).collect() == []


def test_snapshots_are_compared_from_the_top(spark, rows, tmp_path):
    schema = "c string, y int, ch int, v decimal(18,4), n int"
    base = [(c, y, ch, Decimal(ch or 0), y) for c in ("01", "US", None) for y in (2023, 2024) for ch in (1, 2, None)]
    new = [r for r in base if r[:3] != ("US", 2024, 2)] + [("US", 2025, 1, Decimal(5), 1)]
    new = [(*r[:3], Decimal(9), r[4]) if r[:3] in (("01", 2023, 1), (None, 2024, None)) else r for r in new]
    paths = [str(tmp_path / x) for x in ("old", "new", "same")]
    for data, path in zip((base, new, list(reversed(base))), paths):
        rec.store_snapshot(spark.createDataFrame(data, schema).repartition(3), path, ["c", "y"])
    assert rows(rec.changed_folders(spark, paths[0], paths[1], ["c", "y"])) == [(None, 2024), ("01", 2023), ("US", 2024), ("US", 2025)]
    got = rec.compare_snapshots(spark, paths[0], paths[1], ["c", "y"], ["ch"], ["v", "n"])
    assert rows(got, "c", "y", "ch", "old_v", "new_v", "old_n", "new_n") == [
        (None, 2024, None, 0, 9, 2024, 2024),
        ("01", 2023, 1, 1, 9, 2023, 2023),
        ("US", 2024, 2, 2, None, 2024, None),
        ("US", 2025, 1, None, 5, None, 1),
    ]
    # The order of rows and files does not count, and folders without a difference are not read.
    assert rec.changed_folders(spark, paths[0], paths[2], ["c", "y"]).count() == 0
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def test_plan_vs_actual_dealt_by_grain(spark, rows):
    """Both sides added up together: the same rows, null groups and repeated plan lines included."""
    plan = [(1, "a", 5, 10, 1), (1, "a", 5, 10, 1), (2, "a", 5, 20, 2), (3, None, 5, 30, 3), (4, "b", 5, 40, 4), (5, "d", None, None, 0)]
    actual = [("a", 5, 7, 1), ("a", 5, 8, 2), (None, 5, 9, 3), ("c", 5, 4, 4), ("d", None, None, 5)]
    p = spark.createDataFrame(plan, "plan_line_id long, g string, y int, budget_usd int, budget_lc int")
    a = spark.createDataFrame(actual, "g string, y int, spend_usd int, spend_lc int")
    want, got = rec.plan_vs_actual(p, a, ["g", "y"]), rec.plan_vs_actual(p, a, ["g", "y"], tasks=7)
    assert got.schema == want.schema and rows(got) == rows(want) and len(rows(got)) == 3


@pytest.mark.parametrize("name,steps", [("x03_plan_vs_actual_channel", 3), ("n12_rollup_year_brand", 2), ("n10_rollup_market_platform", 2)])
def test_tasks_follow_the_rows(spark, monkeypatch, name, steps):
    """What grows with the fact is dealt to more tasks than a shuffle has when the fact has more rows than these hold."""
    from tallyspark.catalog import QUERIES
    from tallyspark.sources import scratch

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(scratch, "TASK_ROWS", 500)
    n = -(-spark.read.parquet(f"{folder}/lineitem.parquet").count() // 500)
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len([x for x in plan.split("\n") if "hashpartitioning" in x and f", {n}), REPARTITION_BY_NUM" in x]) >= steps
    spark.catalog.clearCache()
