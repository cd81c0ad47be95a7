import base64
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators import keys
from tallyspark.plans.suite import BREAKING, DATA_ISSUE, Check, Suite
from tallyspark.session import configure
from tallyspark.sources import extracts, scratch, sinks, tables


def test_split_jdbc_options():
    spec = tables.TableSpec(
        "dbo.fact", "jdbc", options={"url": "jdbc:x"}, partition_column="date", lower_bound="2023-01-01", upper_bound="2024-01-01", num_partitions=64
    )
    assert tables.reader_options(spec) == {
        "url": "jdbc:x", "dbtable": "dbo.fact", "pushDownPredicate": "true", "partitionColumn": "date",
        "lowerBound": "2023-01-01", "upperBound": "2024-01-01", "numPartitions": "64",
    }
    with pytest.raises(ValueError):
        tables.reader_options(tables.TableSpec("t", "jdbc", partition_column="date"))


def test_other_formats_pass_their_options_through():
    spec = tables.TableSpec("t", "com.example.connector", options={"host": "h"})
    assert tables.reader_options(spec) == {"host": "h"}


def write(path, text):
    path.write_text(text, encoding="utf-8")


HEAD = ["Brand", "Clicks", "Spend"]


def test_extracts_drop_the_preamble_by_position(spark, rows, tmp_path):
    top = "Report\tx\ty\nfree text\n\nUSD\n"
    write(tmp_path / "us.tsv", top + "Brand\tClicks\tSpend\nm\t1\t2.5\nn\t2\n")  # second row is short
    write(tmp_path / "de.tsv", top + "Brand\tClicks\tSpend\no\t\tx\n")
    got = extracts.load_extracts(spark, str(tmp_path), HEAD)
    assert rows(got, *HEAD, "source_file") == [("m", "1", "2.5", "us.tsv"), ("n", "2", None, "us.tsv"), ("o", None, "x", "de.tsv")]
    mapping = {"brand": ("Brand", "string"), "clicks": ("Clicks", "bigint"), "spend": ("Spend", "double")}
    conformed = extracts.conform_extract(got, mapping, {"country": "US"})
    assert rows(conformed) == [("US", "m", 1, 2.5), ("US", "n", 2, 0.0), ("US", "o", 0, 0.0)]


def test_extract_split_over_many_tasks(spark, tmp_path):
    body = "".join(f"brand{i}\t{i}\t{i}\n" for i in range(20_000))
    write(tmp_path / "big.tsv", "a\tb\tc\n1\n2\n3\nBrand\tClicks\tSpend\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = extracts.load_extracts(spark, str(tmp_path), HEAD)
        assert df.rdd.getNumPartitions() > 1
        assert df.agg(F.count("Brand"), F.sum("Clicks")).first() == (20_000, sum(range(20_000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_codebook_and_exceptions(spark, rows, tmp_path):
    (tmp_path / "c").mkdir()
    write(tmp_path / "c" / "codes.csv", 'entity,attribute,code\nc,m," US "\nc,m,US\nc,m,\nc,t, \n')
    assert rows(extracts.load_codebook(spark, str(tmp_path / "c"))) == [("c", "m", "US")]
    (tmp_path / "e").mkdir()
    write(tmp_path / "e" / "names.csv", "entity,name\nc,old one\nc,old one\nd,x\n")
    assert rows(extracts.load_exceptions(spark, str(tmp_path / "e"))) == [("c", "old one"), ("d", "x")]


def test_files_to_base64(spark, rows, tmp_path):
    content = bytes(range(256)) * 5
    (tmp_path / "a.pdf").write_bytes(content)
    assert rows(extracts.files_to_base64(spark, str(tmp_path))) == [("a.pdf", base64.b64encode(content).decode())]


def test_write_and_append(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    path = str(tmp_path / "out")
    sinks.write_result(df, path)
    sinks.write_result(df, path, mode="append")
    assert rows(tables.load_csv(spark, path, df.schema)) == [(1, "a"), (1, "a")]
    sinks.export_summary(df, path)
    assert tables.load_csv(spark, path, df.schema).count() == 1


def test_metastore_headings(spark, rows):
    spark.createDataFrame([("de", 1.1)], "`country ` string, `latest value` double").createOrReplaceTempView("fx")
    df = tables.load_metastore(spark, "fx", upper=["country"])
    assert df.columns == ["country", "latest value"] and rows(df) == [("DE", 1.1)]


def test_schema_check(spark, rows):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    want = T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.StringType())])
    got = rows(tables.schema_check(spark, {"t": df}, {"t": want}), "column_name", "expected", "actual", "matches")
    assert got == [("k", "bigint", "int", False), ("s", None, "string", False), ("x", "string", None, False)]


def test_spines_and_profiles(spark, rows):
    df = spark.createDataFrame([("2022-05-01",), ("2024-01-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    assert rows(tables.year_spine(df, "d")) == [(2022,), (2023,), (2024,)]
    assert rows(tables.year_values(spark, [2023])) == [(2023,)]
    assert rows(tables.table_profile({"t": df})) == [("t", 2, 1)]


class FakeSession:
    """A session with a given checkpoint setting on a given master."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_scratch_follows_the_session_setting():
    session = FakeSession("hdfs://shared/scratch/", "spark://cluster")
    a, b = scratch.scratch_path(session, "x"), scratch.scratch_path(session, "x")
    assert a.startswith("hdfs://shared/scratch/x-") and a != b


def test_no_local_scratch_on_a_cluster():
    with pytest.raises(RuntimeError):
        scratch.scratch_path(FakeSession(None, "spark://cluster"), "x")


def test_measured_lookup_is_broadcast_only_when_small(spark):
    big = spark.range(2_000_000).withColumn("k", F.col("id") % 50)
    # Without its true size the planner takes the lookup for as large as its source.
    lookup = scratch.measured(big.groupBy("k").count())
    plan = big.join(lookup, "k")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan
    wide = scratch.measured(big.select("id", F.repeat(F.col("id").cast("string"), 5).alias("s")))
    plan = big.join(wide, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    spark.catalog.clearCache()


def test_suite(spark, rows):
    tables_ = {
        "f": spark.createDataFrame([(1, -1), (1, 2), (2, None)], "k int, v int"),
        "e": spark.createDataFrame([], "k int"),
    }
    suite = Suite(
        [
            Check("neg", "d", DATA_ISSUE, "f", rule=lambda: F.col("v") < 0),
            Check("dup", "d", BREAKING, "f", frame=lambda t: keys.duplicate_key_counts(t["f"], ["k"])),
            Check("none", "d", BREAKING, "e", rule=lambda: F.col("k") < 0),
        ]
    )
    got = rows(suite.run(tables_), "check_id", "severity", "violations", "base_rows", "share", "passed")
    third = pytest.approx(1 / 3)
    assert got == [("dup", BREAKING, 1, 3, third, False), ("neg", DATA_ISSUE, 1, 3, third, False), ("none", BREAKING, 0, 0, None, True)]
    assert suite.checks[0].violations(tables_).count() == 1
    with pytest.raises(ValueError):
        Check("x", "d", DATA_ISSUE, "f")
    with pytest.raises(ValueError):
        Check("x", "d", "minor", "f", rule=lambda: F.lit(True))


def test_extracts_lose_no_line(spark, rows, tmp_path):
    write(tmp_path / "good.txt", "top\n\nBrand|Clicks|Spend\na|1|2|3|4\nb|1|x\n")
    write(tmp_path / "headless.txt", "top\nc|1|2\n")
    got = extracts.load_extracts(spark, str(tmp_path), HEAD, sep="|")
    assert rows(got, *HEAD, "surplus", "source_file") == [
        (None, None, None, "c|1|2", "headless.txt"),
        (None, None, None, "top", "headless.txt"),
        ("a", "1", "2", "3|4", "good.txt"),
        ("b", "1", "x", None, "good.txt"),
    ]


def test_settings_apply_to_a_running_session(spark):
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    assert configure(spark).conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"


def test_extract_fields_are_quoted(spark, rows, tmp_path):
    body = ['1\t"x\ty"\tz', '"a ""b"" c"\t\t""', '\t"open\t2', '"x"y\t"1"\t"2"\t"3\t4"', 'q"q\t"" \t"a""']
    write(tmp_path / "quoted.txt", "top\n\n" + "\t".join(["Brand", '"Clicks"', "Spend"]) + "\n" + "\n".join(body) + "\n")
    got = extracts.load_extracts(spark, str(tmp_path), HEAD)
    assert rows(got, *HEAD, "surplus") == sorted(
        [("1", "x\ty", "z", None), ('a "b" c', None, None, None), (None, '"open', "2", None), ('"x"y', "1", "2", "3\t4"), ('q"q', '"" ', '"a""', None)],
        key=lambda r: [(v is not None, str(type(v)), v) for v in r],
    )


@pytest.mark.parametrize("sep", ["|", "\t", ";;", "."])
def test_quoted_fields_round_trip(spark, sep):
    rng = random.Random(4)
    fields = [["".join(rng.choice(['"', sep, "a", " ", "é"]) for _ in range(rng.randrange(6))) for _ in range(4)] for _ in range(100)]
    fields.append(["x" * 50_000 + '"' + sep, '"' * 3000, "", ""])
    lines = [(sep.join('"' + f.replace('"', '""') + '"' for f in row),) for row in fields]
    df = spark.createDataFrame(lines, "value string")
    assert [r.f for r in df.select(extracts.quoted_fields("value", sep).alias("f")).collect()] == fields


def test_extracts_run_nothing_while_the_plan_is_built(spark, tmp_path):
    write(tmp_path / "good.txt", "top\nBrand\tClicks\tSpend\na\t1\t2\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        extracts.load_extracts(spark, str(tmp_path), HEAD)
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_suite_writes_what_it_counts(spark, rows, tmp_path):
    tables_ = {"f": spark.createDataFrame([(1, -1), (1, 2), (2, None), (3, -5)], "k int, v int"), "e": spark.createDataFrame([], "k int"), "g": spark.range(3)}
    suite = Suite(
        [
            Check("neg", "d", DATA_ISSUE, "f", rule=lambda: F.col("v") < 0),
            Check("dup", "d", BREAKING, "f", frame=lambda t: keys.duplicate_key_counts(t["f"], ["k"])),
            Check("low", "d", BREAKING, "f", rule=lambda: F.col("v") < -3),
            Check("none", "d", BREAKING, "e", rule=lambda: F.col("k") < 0),
            Check("few", "d", BREAKING, "g", frame=lambda t: t["g"].filter("id > 0")),
        ]
    )
    got = {r.check_id: (r.violations, r.base_rows, r.passed) for r in suite.write(tables_, str(tmp_path / "again")).collect()}
    assert got == {"neg": (2, 4, False), "dup": (1, 4, False), "low": (1, 4, False), "none": (0, 0, True), "few": (2, 3, False)}
    written = spark.read.parquet(str(tmp_path / "again" / "rows" / "f"))
    assert rows(written, "k", "v", F.concat_ws(",", "failed_checks")) == [(1, -1, "neg"), (3, -5, "neg,low")]
    assert spark.read.parquet(str(tmp_path / "again" / "checks" / "few")).count() == 2
    assert spark.read.parquet(str(tmp_path / "again" / "rows" / "e")).count() == 0
