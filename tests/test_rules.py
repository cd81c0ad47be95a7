import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import rules

D = dt.date


def test_range_and_set_null_policies(spark, rows):
    v = spark.createDataFrame([(-0.1,), (0.0,), (1.0,), (1.1,), (None,)], "v double")
    assert rows(rules.out_of_range(v, "v", 0, 1)) == [(-0.1,), (1.1,)]
    assert rows(rules.out_of_range(v, "v", 0, 1, nulls="fail")) == [(None,), (-0.1,), (1.1,)]
    assert rules.out_of_range(v, "v", 0, 1, nulls="fail").count() + v.filter("v between 0 and 1").count() == v.count()
    s = spark.createDataFrame([("good",), ("bad",), (None,)], "s string")
    assert rows(rules.not_in_set(s, "s", ["good"])) == [("bad",)]
    assert rows(rules.not_in_set(s, "s", ["good"], nulls="fail")) == [(None,), ("bad",)]
    with pytest.raises(ValueError):
        rules.not_in_set(s, "s", ["good"], nulls="drop")


def test_paired_zero_and_null(spark, rows):
    df = spark.createDataFrame([(0, 5), (5, 0), (0, 0), (None, 5)], "a int, b int")
    assert rows(rules.paired_zero(df, "a", "b")) == [(0, 5, "a_zero"), (5, 0, "b_zero")]
    assert rows(rules.paired_null(df, "a", "b")) == [(None, 5, "a_null")]
    assert rules.rate_zero_amount_nonzero(df, "a", "b").count() == 2


def test_negative_lists_the_columns(spark, rows):
    df = spark.createDataFrame([("-1", "0.0"), ("2", "0.0"), ("x", "1"), ("3", None)], "a string, f string")
    assert rows(rules.negative(df, ["a"], zeros=["f"]), "a", "reason") == [("-1", "a,f"), ("2", "f")]


def test_even_allocation(spark, rows):
    data = [
        (1, 100.0, 10.0, D(2024, 1, 1), D(2024, 1, 10)),  # exact
        (2, 100.0, 10.004, D(2024, 1, 1), D(2024, 1, 10)),  # inside the rounding
        (3, 100.0, 10.2, D(2024, 1, 1), D(2024, 1, 10)),  # off
        (4, 7.0, 7.0, D(2024, 1, 1), D(2024, 1, 1)),  # one day
        (5, 7.0, 7.0, D(2024, 1, 2), D(2024, 1, 1)),  # reversed
        (6, 0.0, 1.0, D(2024, 1, 1), D(2024, 1, 2)),  # no total
    ]
    df = spark.createDataFrame(data, "id int, total double, rate double, s date, e date")
    assert rows(rules.even_allocation(df, "total", "rate", "s", "e"), "id", "rate_ratio") == [(3, 1.02)]


def test_date_bounds_with_slack(spark, rows):
    s, e = D(2024, 1, 1), D(2024, 1, 31)
    df = spark.createDataFrame([(s, e, s), (s, e, e), (s, e, D(2024, 2, 1)), (s, e, D(2023, 12, 31))], "s date, e date, d date")
    assert rows(rules.date_out_of_bounds(df, "d", "s", "e"), "d") == [(D(2023, 12, 31),), (D(2024, 2, 1),)]
    assert rows(rules.date_out_of_bounds(df, "d", "s", "e", slack=1), "d") == [(D(2023, 12, 31),)]


def test_span_modes(spark, rows):
    a, b, c = D(2024, 1, 1), D(2024, 1, 5), D(2024, 1, 9)
    data = [("ok", a, b, a), ("ok", a, b, b), ("start", a, c, b), ("start", a, c, c), ("both", a, c, b)]
    df = spark.createDataFrame(data, "k string, s date, e date, d date")
    args = (["k"], "d", "s", "e")
    assert rows(rules.declared_vs_observed_span(df, *args), "k") == [("both",), ("start",)]
    assert rows(rules.declared_vs_observed_span(df, *args, mode="both"), "k") == [("both",)]
    with pytest.raises(ValueError):
        rules.declared_vs_observed_span(df, *args, mode="none")


def test_status_vs_latest(spark, rows):
    data = [("US", "active", 5), ("US", "active", 4), ("US", "ended", 5), ("US", "ended", 1), ("GB", "active", 3)]
    df = spark.createDataFrame(data, "c string, status string, d int")
    assert rows(rules.status_vs_latest(df, "status", "d", "c", "active", "ended"), "c", "status", "d") == [("US", "active", 4), ("US", "ended", 5)]


def test_names_and_prefixes(spark, rows):
    df = spark.createDataFrame([("us_a", "US"), ("us_b", "GB"), ("us_b", "US"), ("de_c", None)], "name string, k string")
    assert rows(rules.prefix_mismatch(df, "name", "k"), "name", "k") == [("us_b", "GB")]
    assert rows(rules.one_name_many_keys(df, "name", "k")) == [("us_b", "GB", 2), ("us_b", "US", 2)]


def test_zero_metric_inner_and_left(spark, rows):
    fact = spark.createDataFrame([(1, 0), (2, 0), (1, 3)], "k int, views int")
    dim = spark.createDataFrame([(1, "video"), (2, "image")], "k int, t string")
    assert rows(rules.zero_metric_for_type(fact, dim, "k", F.col("t") == "video", "views")) == [(1, 0, "video")]
    assert rows(rules.zero_metric_for_type(fact, dim, "k", F.col("t") == "video", "views", "left")) == [(1, 0, "video"), (2, 0, None)]


def test_attribute_rules(spark, rows):
    dim = spark.createDataFrame([(1, "Awareness"), (2, "AWARENESS"), (3, "sales")], "k int, o string")
    fact = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert rows(rules.subset_by_attribute(fact, dim, "k", "o", ["awareness"]), "k") == [(1,), (2,)]
    links = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 9)], "a int, b int")
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "a int, ta string")
    right = spark.createDataFrame([(1, "x")], "b int, tb string")
    assert rows(rules.attribute_disagreement(links, (left, "a"), (right, "b"), [("ta", "tb")]), "a") == [(2,)]
    assert rows(rules.attribute_disagreement(links, (left, "a"), (right, "b"), [("ta", "tb")], null_safe=True), "a") == [(2,), (3,)]


def test_column_rules(spark, rows):
    one, two = Decimal(1), Decimal(2)
    df = spark.createDataFrame([("g", one, one), ("g", one, two), ("h", None, one)], "g string, a decimal(18,4), b decimal(18,4)")
    assert rows(rules.column_disagreement(df, "a", "b"), "g") == [("g",)]
    assert rows(rules.column_disagreement(df, "a", "b", null_safe=True), "g") == [("g",), ("h",)]
    assert rows(rules.equal_columns(df, "a", "b", ["g"]), "g", "n_rows", "n_equal") == [("g", 2, 1), ("h", 1, 0)]


def test_parity_for_keys(spark, rows):
    data = [("US", 2023, 10, 10), ("US", 2024, 11, 10), ("US", 2020, 9, 1), ("DE", 2024, 5, 1), ("PR", 2024, 1, 0)]
    df = spark.createDataFrame(data, "c string, y int, lc int, usd int")
    assert rows(rules.parity_for_keys(df, "c", ["US", "PR"], "y", 2023, {"r": ("lc", "usd")})) == [("US", 2024, 1.1)]


def test_span_order_gives_the_first_reason(spark, rows):
    df = spark.createDataFrame([(1, 5, 3), (5, 1, 3), (2, 5, 1), (1, 5, 6)], "s int, e int, d int")
    assert rows(rules.span_order(df, "s", "e", "d")) == [(1, 5, 6, "day_after_end"), (2, 5, 1, "day_before_start"), (5, 1, 3, "start_after_end")]


def test_nonzero_in_channel(spark, rows):
    df = spark.createDataFrame([("display", 1, 1, 1), ("display", 2, 0, 1), ("video", 3, 1, 1)], "c string, k int, v int, w int")
    assert rows(rules.nonzero_in_channel(df, F.col("c") != "video", ["k"], ["v", "w"]), "k") == [(1,)]
