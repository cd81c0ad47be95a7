import pytest

from tallyspark.operators import refs


@pytest.fixture(scope="module")
def sides(spark):
    fact = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r"), (None, "n")], "k int, c string")
    dim = spark.createDataFrame([(1, "one"), (3, "three")], "k int, name string")
    return fact, dim


def test_orphans_and_null_policy(sides, rows):
    assert rows(refs.orphans(*sides, ["k"])) == [(None,), (2,)]
    assert rows(refs.orphans(*sides, ["k"], nulls="ignore")) == [(2,)]
    with pytest.raises(ValueError):
        refs.orphans(*sides, ["k"], nulls="drop")


def test_orphan_rows_show_context(sides, rows):
    assert rows(refs.orphan_rows(*sides, ["k"], ["c"])) == [(None, "n"), (2, "r")]


def test_missing_key_counts(sides, rows):
    fact, dim = sides
    assert rows(refs.missing_key_counts(fact, {"d": (dim, ["k"])})) == [("d", 2, 2)]


def test_key_difference_and_overlap(sides, rows):
    fact, dim = sides
    assert rows(refs.key_difference(fact, dim, ["k"])) == [(None,), (2,)]
    assert rows(refs.code_overlap(fact, dim, "k")) == [(None, "left_only"), (1, "both"), (2, "left_only"), (3, "right_only")]
    assert rows(refs.full_outer_keys(fact.dropna(), dim, "k")) == [(2, "left_only"), (3, "right_only")]


def test_presence_matrix(sides, rows):
    fact, dim = sides
    assert rows(refs.presence_matrix({"f": fact.dropna(), "d": dim}, "k")) == [(1, True, True), (2, True, False), (3, False, True)]


def test_unmatched_and_code_filter(sides, rows):
    fact, dim = sides
    assert rows(refs.unmatched_in_plan(fact.dropna(), dim, ["k"])) == [(2, "r")]
    assert rows(refs.code_filter_join(dim, fact, "k")) == [(1, "one")]


def test_source_gap(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "x")], "source string, name string")
    assert rows(refs.source_gap(df, "source", "a", "b", ["name"])) == [("x",)]


def test_enrich_unmatched(spark, sides, rows):
    lost = spark.createDataFrame([(2,), (2,), (9,)], "k int")
    fact = spark.createDataFrame([(2, 10, 5), (2, 10, 6), (1, 11, 7)], "k int, p int, v int")
    dim = spark.createDataFrame([(10, "brand")], "p int, b string")
    assert rows(refs.enrich_unmatched(lost, fact, ["k"], [(dim, "p")], ["b"], ["v"])) == [(None, None), ("brand", 11)]
