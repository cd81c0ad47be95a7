import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import complete
from tallyspark.operators.scope import in_years


@pytest.fixture(scope="module")
def mixed(spark):
    data = [(1, "ok", 1.0), (2, None, None), (3, "", float("nan")), (4, "NA", 2.0), (5, "is NULL", 3.0)]
    return spark.createDataFrame(data, "id int, s string, v double")


def test_null_counts_both_forms(mixed, rows):
    assert rows(complete.null_counts(mixed)) == [(0, 1, 1)]
    assert rows(complete.null_counts_cast(mixed)) == [(0, 1, 1)]
    assert rows(complete.null_counts_long(mixed, "t")) == [("t", "id", 0), ("t", "s", 1), ("t", "v", 1)]


def test_sentinel_and_nullish_counts(mixed, rows):
    assert rows(complete.sentinel_counts(mixed, "NA")) == [(1,)]
    assert rows(complete.nullish_counts(mixed)) == [(0, 3, 2)]


@pytest.fixture(scope="module")
def dated(spark):
    d = dt.date
    data = [("a", d(2022, 1, 1)), ("a", d(2022, 1, 5)), ("a", d(2024, 3, 1)), ("b", d(2023, 1, 2)), ("c", None)]
    return spark.createDataFrame(data, "k string, d date")


def test_coverage_matrix_has_every_cell(dated, rows):
    got = rows(complete.coverage_matrix(dated, "k", "d", [2022, 2023]))
    assert got == [("a", 2022, 2), ("a", 2023, None), ("b", 2022, None), ("b", 2023, 1), ("c", 2022, None), ("c", 2023, None)]


def test_calendar_gaps(dated, rows):
    d = dt.date
    got = rows(complete.calendar_gaps(dated, ["k"], "d", d(2022, 1, 1), d(2022, 1, 5)))
    assert [r for r in got if r[0] == "a"] == [("a", d(2022, 1, 2)), ("a", d(2022, 1, 3)), ("a", d(2022, 1, 4))]
    assert len([r for r in got if r[0] == "c"]) == 5


def test_gap_spans_are_the_gaps_by_day_in_runs(spark, rows):
    import random

    rng, first = random.Random(5), dt.date(2023, 12, 20)
    day = [first + dt.timedelta(i) for i in range(200)]
    # "a" holds most rows, "b" the ends and the ends of words, "c" all days, "d" none in the range, None is a key.
    data = [("a", rng.choice(day)) for _ in range(3000) if rng.random() < 0.1] + [("b", day[i]) for i in (0, 63, 64, 127, 199)]
    data += [("c", d) for d in day] * 2 + [("d", dt.date(2023, 12, 19)), ("d", None), (None, day[100])]
    df = spark.createDataFrame(data, "k string, d date")
    want, spans = [], []
    for k in sorted({k for k, _ in data}, key=lambda k: (k is not None, k)):
        have = {d for j, d in data if j == k}
        for d in (d for d in day if d not in have):
            new = not spans or spans[-1][0] != k or spans[-1][2] + dt.timedelta(1) != d
            want.append((k, d))
            spans = [*spans, (k, d, d, 1)] if new else [*spans[:-1], (k, spans[-1][1], d, spans[-1][3] + 1)]
    assert rows(complete.calendar_gaps(df, ["k"], "d", day[0], day[-1])) == want
    assert rows(complete.calendar_gap_spans(df, ["k"], "d", day[0], day[-1])) == spans
    assert complete.calendar_gap_spans(df.limit(0), ["k"], "d", day[0], day[-1]).count() == 0
    one_day = rows(complete.calendar_gap_spans(df, ["k"], "d", day[0], day[0]))
    assert ("d", day[0], day[0], 1) in one_day and not any(r[0] in ("b", "c") for r in one_day)


def test_gap_spans_do_not_walk_the_range(spark, rows):
    """Work follows the days that are there: no function runs over all days of the range."""
    d = dt.date
    df = spark.createDataFrame([("a", d(2000, 1, 2)), ("a", d(2000, 1, 2)), ("a", d(2000, 1, 4)), ("b", None)], "k string, d date")
    got = complete.calendar_gap_spans(df, ["k"], "d", d(1000, 1, 1), d(3000, 1, 1))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(__" not in plan and "getbit" not in plan and "sequence(" not in plan
    n = [(b - a).days + 1 for a, b in ((d(1000, 1, 1), d(2000, 1, 1)), (d(2000, 1, 5), d(3000, 1, 1)), (d(1000, 1, 1), d(3000, 1, 1)))]
    assert rows(got) == [
        ("a", d(1000, 1, 1), d(2000, 1, 1), n[0]), ("a", d(2000, 1, 3), d(2000, 1, 3), 1), ("a", d(2000, 1, 5), d(3000, 1, 1), n[1]), ("b", d(1000, 1, 1), d(3000, 1, 1), n[2]),
    ]


def test_freshness_year_bounds_and_missing(dated, rows):
    d = dt.date
    assert rows(complete.freshness(dated, ["k"], "d"))[0] == ("a", d(2022, 1, 1), d(2024, 3, 1), 3)
    assert rows(complete.year_bounds(dated, ["k"], "d")) == [("a", 2022, 2024), ("b", 2023, 2023), ("c", None, None)]
    assert rows(complete.missing_in_period(dated, ["k"], in_years("d", [2022]))) == [("b",), ("c",)]


def test_min_distinct(dated, rows):
    assert rows(complete.min_distinct(dated, "k", 4)) == [("k", 3, 4)]
    assert rows(complete.min_distinct(dated, "k", 3)) == []


def test_unparseable_and_presence(mixed, rows):
    texts = mixed.select("id", F.when(F.col("id") < 3, "12").when(F.col("id") == 3, "x").alias("t"))
    assert rows(complete.unparseable(texts, "t", "int", ["id"])) == [(3, "x")]
    assert rows(complete.presence_share(mixed.withColumn("k", F.lit("k")), ["k"], "s")) == [("k", 5, 1, 0.2)]


def test_counts_of_an_empty_table(spark, mixed, rows):
    empty = mixed.limit(0)
    assert rows(complete.row_counts({"e": empty, "m": mixed})) == [("e", 0, True), ("m", 5, False)]
    assert rows(complete.null_counts(empty)) == [(0, 0, 0)]
    assert rows(complete.blank_rows(mixed, ["s", "v"]), "id") == [(2,)]
