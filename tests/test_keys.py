import pytest
from pyspark.sql import functions as F

from tallyspark.operators import keys

SCHEMA = "id string, name string, amount decimal(18,4)"
PLANTED = [
    ("a", "x", 1), ("a", "x", 1),  # equal rows
    ("b", "x", 2), ("b", "y", 3),  # two names
    ("c", "x", 4), ("c", None, 5),  # a name and a null
    (None, "x", 6), (None, "z", 7),  # null id twice
    ("d", "x", 8),
]


@pytest.fixture(scope="module")
def planted(spark):
    from decimal import Decimal

    return spark.createDataFrame([(a, b, Decimal(c)) for a, b, c in PLANTED], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_duplicate_key_counts_include_the_null_key(planted, rows):
    assert rows(keys.duplicate_key_counts(planted, ["id"])) == [(None, 2), ("a", 2), ("b", 2), ("c", 2)]


def test_duplicate_keys_return_full_rows(planted, rows):
    got = rows(keys.duplicate_keys(planted, ["id"]), "id", "name", "key_count")
    assert got == rows(planted.filter("id is null or id <> 'd'").withColumn("n", F.lit(2)), "id", "name", "n")


def test_functional_dependency_null_policies(planted, rows):
    assert rows(keys.functional_dependency(planted, ["id"], ["name"])) == [(None, 2), ("b", 2)]
    assert rows(keys.functional_dependency(planted, ["id"], ["name"], count_nulls=True)) == [(None, 2), ("b", 2), ("c", 2)]


def test_duplicate_row_count_is_rows_minus_distinct_rows(planted, empty, rows):
    assert rows(keys.duplicate_row_count({"t": planted, "e": empty})) == [("e", 0, 0), ("t", 9, 1)]
    assert planted.count() - planted.distinct().count() == 1


def test_duplicate_row_count_with_digest_keeps_null_apart_from_empty(spark, rows):
    df = spark.createDataFrame([("",), (None,), (None,), ("x",)], "text string")
    assert rows(keys.duplicate_row_count({"t": df}, digest=["text"])) == [("t", 4, 1)]


def test_checks_of_an_empty_table_are_empty(empty):
    assert keys.duplicate_keys(empty, ["id"]).count() == 0
    assert keys.functional_dependency(empty, ["id"], ["name"]).count() == 0


def test_key_recomposition_reports_null_parts(spark, rows):
    df = spark.createDataFrame(
        [("v", "US", "1", "v_US_1"), ("v", "US", "2", "v_GB_2"), ("v", None, "3", "v__3"), (None, "US", "4", None)],
        "vendor string, country string, code string, id string",
    )
    # A null id for a null part agrees with it; the composed key is null as well.
    assert rows(keys.key_recomposition(df, "id", ["vendor", "country", "code"]), "code") == [("2",), ("3",)]


def test_name_recomposition_skips_null_tokens(spark, rows):
    df = spark.createDataFrame([("a_b", "a", "b"), ("a_c", "a", "b"), ("a", "a", None)], "name string, t1 string, t2 string")
    assert rows(keys.name_recomposition(df, "name", ["t1", "t2"]), "name", "expected") == [("a_c", "a_b")]


def test_one_to_one(spark, rows):
    df = spark.createDataFrame([(2024, "US", "p"), (2024, "US", "q"), (2023, "US", "r")], "y int, c string, stored string")
    assert rows(keys.one_to_one(df, ["y", "c"], "stored")) == [("2024_US", 2)]


def test_keep_one_per_key_follows_the_total_order(spark, rows):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 3, "b"), ("k", 3, "a"), ("m", 2, "only"), (None, 1, "n")], "k string, d int, v string")
    got = keys.keep_one_per_key(df, ["k"], [-F.col("d"), F.col("v")])
    assert got.columns == df.columns
    assert rows(got) == [(None, 1, "n"), ("k", 3, "a"), ("m", 2, "only")]


def test_keep_one_located_fetches_whole_rows_last(spark, rows, tmp_path):
    wide = F.concat(F.lit("w"), "id").alias("wide")
    # A third of the rows has one key; ties in d fall to the order's second column; one key is null.
    k = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 != 1, F.col("id") % 97).alias("k")
    spark.range(5000).select(k, (F.col("id") * 7 % 40).alias("d"), "id", wide).repartition(6).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    order = [-F.col("d"), F.col("id")]
    got = keys.keep_one_located(df, ["k"], order)
    assert got.columns == df.columns
    assert rows(got) == rows(keys.keep_one_per_key(df, ["k"], order))
    assert rows(keys.keep_one_located(df.filter("id < 10"), ["k"], order)) == rows(keys.keep_one_per_key(df.filter("id < 10"), ["k"], order))
    assert keys.keep_one_located(df.filter("id < 0"), ["k"], order).count() == 0
    # Without an order that tells rows apart, one row of each key stays.
    assert keys.keep_one_located(df, ["k"], [F.col("d") * 0]).count() == df.select("k").distinct().count()
    # The wide column is read by the scan that fetches rows and is not in the plan that finds their addresses.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    found = plan[plan.index("InMemoryRelation") :]
    assert "Join LeftSemi" in plan and "wide" not in found
    spark.catalog.clearCache()


def test_grain_duplicates_sql_equals_the_dataframe_form(planted, spark, rows):
    planted.createOrReplaceTempView("planted")
    assert rows(spark.sql(keys.grain_duplicates_sql("planted", ["id"]))) == rows(keys.grain_duplicates(planted, ["id"]))


def test_keys_per_name(planted, rows):
    assert rows(keys.keys_per_name(planted, ["name"], "id")) == [(None, 1), ("x", 4), ("y", 1), ("z", 0)]
