import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions.columns import normalise_token
from tallyspark.operators import naming

ATTRIBUTES = ["market", "media"]


@pytest.fixture(scope="module")
def book(spark):
    codes = [("campaign", "market", "US"), ("campaign", "market", "Öst"), ("campaign", "media", "on-line"), ("other", "media", "tv")]
    return spark.createDataFrame(codes, "entity string, attribute string, code string")


@pytest.fixture(scope="module")
def dim(spark):
    data = [
        ("n1", "EU", "US", "on-line", 0),
        ("n2", "EU", "us", "ON LINE", 0),
        ("n3", "EU", "US", None, 1),
        ("n4", "AP", "US", "tv", 1),
        ("n5", "AP", "XX", "zz", 0),
    ]
    return spark.createDataFrame(data, "name string, region string, market string, media string, stored int")


def test_flags_by_mode(dim, book, rows):
    strict = naming.compliance_flag(dim, book, "campaign", ATTRIBUTES)
    assert rows(strict, "name", naming.FLAG) == [("n1", 0), ("n2", 1), ("n3", 1), ("n4", 1), ("n5", 1)]
    loose = naming.compliance_flag(dim, book, "campaign", ATTRIBUTES, "alnum_lower")
    assert rows(loose, "name", naming.FLAG) == [("n1", 0), ("n2", 0), ("n3", 1), ("n4", 1), ("n5", 1)]


def test_lists_and_tables_agree(dim, book, rows):
    lists = {"market": ["US", "Öst"], "media": ["on-line"]}
    for mode in ("strict", "lower", "alnum_lower"):
        a = naming.compliance_flag(dim, book, "campaign", ATTRIBUTES, mode)
        b = naming.compliance_flag(dim, lists, "campaign", ATTRIBUTES, mode)
        assert rows(a) == rows(b)


def test_codes_that_fold_together_do_not_multiply_rows(spark, dim, rows):
    codes = [("campaign", "market", c) for c in ("US", "us", "U.S.")] + [("campaign", "media", "on-line")]
    book = spark.createDataFrame(codes, "entity string, attribute string, code string")
    assert naming.compliance_flag(dim, book, "campaign", ATTRIBUTES, "alnum_lower").count() == 5


def test_normalise_keeps_unicode_letters_and_null(spark, rows):
    df = spark.createDataFrame([("Ä-ß_9!",), (None,)], "s string")
    assert rows(df.select(normalise_token("s", "alnum_lower"))) == [(None,), ("äß9",)]
    with pytest.raises(ValueError):
        normalise_token("s", "upper")


def test_mismatch_unknown_and_masked(dim, book, rows):
    flagged = naming.compliance_flag(dim, book, "campaign", ATTRIBUTES)
    off = naming.flag_mismatch(flagged, "stored")
    assert rows(off, "name") == [("n2",), ("n5",)]
    unknown = rows(naming.unknown_codes(off, book, "campaign", ATTRIBUTES))
    assert unknown == [("market", "XX"), ("market", "us"), ("media", "ON LINE"), ("media", "zz")]
    masked = naming.mask_accepted(dim, book, "campaign", ATTRIBUTES)
    assert rows(masked, "name", "market", "media") == [
        ("n1", None, None), ("n2", "us", "ON LINE"), ("n3", None, None), ("n4", None, "tv"), ("n5", "XX", "zz")
    ]
    values = {v for r in rows(masked, *ATTRIBUTES) for v in r if v is not None}
    assert {v for _, v in unknown} <= values


def test_rollup_and_percentages(dim, book, rows):
    flagged = naming.compliance_flag(dim, book, "campaign", ATTRIBUTES).unionByName(
        naming.compliance_flag(dim, book, "campaign", ATTRIBUTES)
    )
    got = rows(naming.compliance_rollup(flagged, ["region"], "name", pct=True))
    assert got == [("AP", 2, 0, 2, 0.0, 100.0), ("EU", 3, 1, 2, 33.0, 67.0)]


def test_stages_and_exceptions(spark, dim, book, rows):
    exceptions = spark.createDataFrame([("campaign", "n5"), ("media", "n4"), ("campaign", "gone")], "entity string, name string")
    flagged = naming.compliance_flag(dim, book, "campaign", ATTRIBUTES)
    staged = naming.staged_compliance(flagged, exceptions, "campaign", "name", "stored", ["region"])
    assert rows(staged, "stage", "region", "total_count", "following") == [
        (1, "AP", 2, 1), (1, "EU", 3, 2), (2, "AP", 2, 0), (2, "EU", 3, 1), (3, "AP", 1, 0), (3, "EU", 3, 1)
    ]
    assert rows(naming.exception_summary(dim, exceptions, "campaign", "name", ["region"])) == [("AP", 1)]
    assert rows(naming.only_exceptions(dim, exceptions, "campaign", "name"), "name") == [("n5",)]


def test_platform_and_export(spark, dim, rows):
    fact = spark.createDataFrame([("n1", "p", 1), ("n1", "p", 2), ("n1", "q", 1)], "name string, platform string, x int")
    assert naming.attach_platform(dim, fact, "name", ["platform"]).count() == 6
    other = spark.createDataFrame([(1, "one")], "x int, label string")
    got = naming.flat_export(fact, dim, "name", [(other, "x", "left")], ["name", "region", "platform", "label"])
    assert rows(got) == [("n1", "EU", "p", None), ("n1", "EU", "p", "one"), ("n1", "EU", "q", "one")]


def test_flagged_rows_and_nulls(dim, book, rows):
    flagged = naming.compliance_flag(dim, book, "campaign", ATTRIBUTES)
    assert naming.flagged_rows(flagged, naming.FLAG, ["name"]).count() == 4
    assert rows(naming.flagged_null_counts(flagged, naming.FLAG, ATTRIBUTES)) == [(0, 1)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["US", "XX", None])), min_size=1, max_size=12))
def test_following_and_not_following_add_up(spark, data):
    df = spark.createDataFrame(data, "name string, market string")
    flagged = naming.compliance_flag(df, {"market": ["US"]}, "c", ["market"])
    row = naming.compliance_rollup(flagged.withColumn("g", F.lit(1)), ["g"], "name").first()
    assert row.following + row.not_following == row.total_count == flagged.select("name", naming.FLAG).distinct().count()
