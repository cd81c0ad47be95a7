import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.columns import date_text
from tallyspark.operators import scope, text


@pytest.fixture(scope="module")
def names(spark):
    data = [
        (1, "x-OPID-11", "y-OPID-22"),  # creative wins
        (2, "x-opid-33", "y-OPID-44"),  # upper case wins
        (3, "x-OPID-1_OPID-2", None),  # last one wins
        (4, "opid", "none"),
        (5, None, "y-opid-55"),
    ]
    return spark.createDataFrame(data, "c int, creative string, buy string")


def test_id_precedence(names, rows):
    got = text.extract_id(names, ["creative", "buy"], ["OPID-", "opid-"])
    assert rows(got, "c", "extracted_id") == [(1, "11"), (2, "44"), (3, "2"), (4, None), (5, "55")]
    folded = text.extract_id(names, ["creative", "buy"], ["Opid-"], ignore_case=True)
    assert rows(folded, "extracted_id") == [(None,), ("11",), ("2",), ("33",), ("55",)]


def test_ids_in_long_lines_take_linear_time(spark):
    import time

    df = spark.createDataFrame([("z" * 400_000,), ("z" * 400_000 + "\nid=7 id=8\nid=9",)], "s string")
    start = time.time()
    got = [r[0] for r in text.extract_id(df, ["s"], ["id="]).select("extracted_id").collect()]
    assert got == [None, "8"] and time.time() - start < 20


def test_id_coverage(names, spark, rows):
    ids = text.extract_id(names, ["creative", "buy"], ["OPID-"]).withColumn("g", F.when(F.col("c") < 4, "a").otherwise("b"))
    assert rows(text.entities_without_id(ids, ["g"], "extracted_id"), "g") == [("b",)]
    assert rows(text.entities_with_id(ids, ["g"], "extracted_id"), "g") == [("a",)]
    assert rows(text.id_coverage(ids, ["g"], "extracted_id")) == [(2, 1, 0.5)]
    assert rows(text.without_id_details(ids, ["g"], "extracted_id"), "c") == [(4,), (5,)]


def test_tokens(spark, rows):
    df = spark.createDataFrame([("a_b_c",), ("a",), (None,)], "s string")
    assert rows(text.split_token(df, "s", "_", 2, "t"), "t") == [(None,), (None,), ("c",)]
    assert rows(text.token_count(df.dropna(), "s", "_"), "n_tokens") == [(1,), (3,)]
    facts = spark.createDataFrame([(1, "b"), (2, "z")], "k int, name string")
    tokens = text.split_token(df, "s", "_", 1, "t")
    assert rows(text.join_on_token(tokens, "t", facts, "name")) == [(1, "b")]


def test_dates_and_aliases(spark, rows):
    df = spark.createDataFrame([("20240131", dt.date(2023, 5, 1)), ("31012024", None)], "t string, d date")
    assert rows(df.select(date_text("t", "yyyyMMdd", "dd/MM/yyyy"))) == [(None,), ("31/01/2024",)]
    years = text.year_of(text.year_of(df, "d"), "t", "text_year")
    assert rows(years, "year", "text_year") == [(None, 3101), (2023, 2024)]
    assert rows(text.value_alias(df, "t", {"20240131": "x"}), "t") == [("31012024",), ("x",)]


@pytest.fixture(scope="module")
def keyed(spark):
    d = dt.date
    data = [("US", d(2023, 12, 31), "a"), ("DE", d(2024, 1, 1), ""), ("FR", d(2024, 12, 31), None), (None, d(2025, 1, 1), "b")]
    return spark.createDataFrame(data, "k string, d date, r string")


def test_include_and_exclude_lists(keyed, rows):
    assert rows(scope.filter_keys({"t": keyed}, "k", exclude=["US"])["t"], "k") == [("DE",), ("FR",)]
    assert rows(scope.filter_keys({"t": keyed}, "k", include=["US", "DE"], exclude=["US"])["t"], "k") == [("DE",)]
    assert scope.filter_keys({"t": keyed}, "k")["t"].count() == 4


def test_date_scopes(keyed, rows):
    d = dt.date
    assert rows(scope.filter_years(keyed, "d", [2024]), "k") == [("DE",), ("FR",)]
    assert rows(scope.as_of(keyed, "d", d(2024, 1, 1)), "k") == [("DE",), ("US",)]
    assert rows(scope.between_dates(keyed, "d", d(2024, 1, 1), d(2024, 12, 31)), "k") == [("DE",), ("FR",)]
    assert rows(scope.pick_dates(keyed, "d", [d(2025, 1, 1)]), "k") == [(None,)]


def test_value_scopes(keyed, rows):
    assert rows(scope.exclude_values(keyed, "k", ["US"]), "k") == [("DE",), ("FR",)]
    assert rows(scope.exclude_values(keyed, "k", ["US"], keep_nulls=True), "k") == [(None,), ("DE",), ("FR",)]
    assert rows(scope.default_region(keyed, "r", "NORTH"), "r") == [("NORTH",), ("NORTH",), ("a",), ("b",)]
    assert rows(scope.match_text(keyed, "k", ["U"], "^D"), "k") == [("DE",), ("US",)]
    assert rows(scope.fill_missing(keyed, "-", ["k"]), "k") == [("-",), ("DE",), ("FR",), ("US",)]


def test_scope_dim_keeps_used_rows(spark, keyed, rows):
    dim = spark.createDataFrame([("DE", "Germany"), ("US", "States"), ("XX", "none")], "k string, n string")
    assert rows(scope.scope_dim(dim, keyed, "k", "d", dt.date(2024, 1, 1)), "n") == [("Germany",)]


def test_projections(keyed, spark):
    assert scope.suffix_columns(keyed, "_1", keep=["k"]).columns == ["k", "d_1", "r_1"]
    assert scope.rename_all(scope.project(keyed, ["k", "r"], drop=["r"]), ["key"]).columns == ["key"]
    texts = spark.createDataFrame([("1",), ("x",)], "s string")
    assert [r.s for r in scope.cast_columns(texts, {"s": "int"}).collect()] == [1, None]
    assert [r.k for r in scope.order_desc(keyed, "d").collect()] == [None, "FR", "DE", "US"]
