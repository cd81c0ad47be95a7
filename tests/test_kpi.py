from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.catalog import QUERIES
from tallyspark.functions.kpis import REGISTRY
from tallyspark.operators import kpi


@pytest.fixture(scope="module")
def fact(spark):
    data = [
        (1, "p", 10, 1000, 10, 100, 50, Decimal(20)),
        (1, "p", 10, 1000, 10, 100, 50, Decimal(20)),  # equal row
        (2, "q", 11, 0, 0, 0, 0, Decimal(5)),  # nothing shown
        (3, "q", 99, 500, 5, 10, 0, Decimal(1)),  # product without a dim row
    ]
    return spark.createDataFrame(
        data, "campaign_id int, tier string, product_id int, impressions bigint, clicks bigint, views bigint, fully_played bigint, spend_usd decimal(18,4)"
    )


def test_zero_denominators_give_null(fact, rows):
    got = rows(kpi.kpi_rollup(fact, ["campaign_id"], ["ctr", "cpm_usd", "vcr_views", "cpcv_usd"]), "campaign_id", "ctr", "cpm_usd", "vcr_views", "cpcv_usd")
    assert got == [(1, 1.0, 20.0, 0.5, 0.4), (2, None, None, None, None), (3, 1.0, 2.0, 0.0, None)]


def test_dedup_is_an_option(fact, rows):
    kept = rows(kpi.kpi_rollup(fact, ["campaign_id"], ["ctr"]), "campaign_id", "clicks")
    once = rows(kpi.kpi_rollup(fact, ["campaign_id"], ["ctr"], dedup=["tier"]), "campaign_id", "clicks")
    assert kept[0] == (1, 20) and once[0] == (1, 10)


def test_every_kpi_has_an_id_of_its_own():
    assert len(REGISTRY) == 18 and all(k.name == n for n, k in REGISTRY.items())


def test_sums_through_dims_equal_join_then_sum(spark, fact, rows):
    products = spark.createDataFrame([(10, "brand", 1), (11, "other", 2)], "product_id int, brand string, maker int")
    makers = spark.createDataFrame([(1, "m1"), (2, "m2")], "maker int, maker_name string")
    dims = [(products, "product_id", "left"), (makers, "maker", "left")]
    grain, measures = ["tier", "brand", "maker_name"], ["clicks", "spend_usd"]
    through = kpi.sum_through(fact, dims, grain, measures)
    joined = kpi.sum_by(kpi.join_dims(fact, dims), grain, measures)
    assert rows(through, *grain, *measures) == rows(joined, *grain, *measures)
    with pytest.raises(ValueError):
        kpi.kpi_rollup(fact, ["brand"], ["ctr"], dedup=[], dims=dims)


@pytest.fixture(scope="module")
def plan(spark):
    data = [(1, 100, Decimal(50)), (1, 100, Decimal(50)), (1, 101, Decimal(30)), (3, 102, Decimal(0))]
    return spark.createDataFrame(data, "campaign_id int, plan_line_id int, budget_usd decimal(18,4)")


def test_pacing_counts_plan_lines_once(fact, plan, rows):
    got = kpi.campaign_pacing(fact, plan, ["campaign_id"], ["ctr", "spend_pacing"])
    assert rows(got, "campaign_id", "budget_usd", "spend_pacing") == [(1, 80, 50.0), (2, None, None), (3, 0, None)]


def test_reach_does_not_multiply_spend(spark, fact, rows):
    reach = spark.createDataFrame([(1, Decimal(10)), (1, Decimal(30)), (9, Decimal(1))], "campaign_id int, value decimal(18,4)")
    got = kpi.campaign_reach(fact, reach, ["campaign_id", "tier"], ["cpm_usd"])
    assert rows(got, "campaign_id", "spend_usd", "avg_reach") == [(1, 40, 20.0)]


def test_wide_join_keeps_one_row_per_fact_row(spark, fact, plan):
    reach = spark.createDataFrame([(1, Decimal(10)), (1, Decimal(30))], "campaign_id int, value decimal(18,4)")
    dated = fact.withColumn("date", F.lit("2024-01-01").cast("date"))
    calendar = dated.select(F.col("date").alias("calendar_date"), F.lit(1).alias("cal_week_of_year")).distinct()
    products = spark.createDataFrame([(10, "brand")], "product_id int, brand string")
    wide = kpi.wide_join(dated, [(products, "product_id", "left")], reach, plan, calendar, "date")
    assert wide.count() == dated.count()


def test_stored_buckets_join_without_a_shuffle(spark, rows, tmp_path):
    from tallyspark.sources.sinks import split_hot, write_bucketed

    # Campaign 7 and null hold a third of the rows each.
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 40).alias("campaign_id")
    day = F.lit("2024-01-01").cast("date")
    fact = spark.range(3000).select(key, "id", F.date_add(day, (F.col("id") % 9).cast("int")).alias("date"))
    reach = spark.range(500).select((F.col("id") % 30).cast("int").alias("campaign_id"), F.col("id").cast("decimal(18,4)").alias("value"))
    plan = spark.range(300).select(
        (F.col("id") % 50).cast("int").alias("campaign_id"), (F.col("id") % 200).alias("plan_line_id"), F.lit(2).cast("decimal(18,4)").alias("budget_usd")
    )
    calendar = fact.select(F.col("date").alias("calendar_date")).distinct().withColumn("cal_week_of_year", F.weekofyear("calendar_date"))
    dims = spark.range(45).select(F.col("id").cast("int").alias("campaign_id"), F.col("id").alias("country_id"))
    rest, hot = split_hot(fact, "campaign_id", 8)
    assert {r[0] for r in hot.select("campaign_id").distinct().collect()} == {7, None}
    assert rows(rest.union(hot)) == rows(fact)

    def stored(df, name):
        return write_bucketed(df, f"buckets_{name}", str(tmp_path / name), "campaign_id", 8)

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(campaign_id")

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = kpi.wide_join(rest, [(dims, "campaign_id", "left")], reach, plan, calendar, "date")
        a, b, c, d = stored(rest, "fact"), stored(dims, "dims"), stored(reach, "reach"), stored(plan, "plan")
        wide = kpi.wide_join(a, [(b, "campaign_id", "left")], c, d, calendar, "date")
        assert shuffles(plain) > 0 and shuffles(wide) == 0
        assert rows(wide, *plain.columns) == rows(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("fact", "dims", "reach", "plan"):
            spark.sql(f"DROP TABLE IF EXISTS buckets_{name}")
        spark.catalog.clearCache()


def test_creative_tables(spark, rows):
    data = [("pre", "t1", 1, 1.0, Decimal(5)), ("pre", "t1", 1, 0.0, Decimal(5)), ("in", "t1", 1, 1.0, Decimal(5)), ("in", "t2", 2, 1.0, Decimal(7))]
    base = spark.createDataFrame(data, "status string, tier string, creative int, v double, spend decimal(18,4)")
    assert rows(kpi.pass_counts(base, "status", "v", ["tier"])) == [("in", "t1", 1), ("in", "t2", 1), ("pre", "t1", 1)]
    assert rows(kpi.avg_score(base, "v", ["status"])) == [("in", 1.0), ("pre", 0.5)]
    assert rows(kpi.tier_counts(base, "creative", ["status", "tier"])) == [("in", "t1", 1), ("in", "t2", 1), ("pre", "t1", 1)]
    assert rows(kpi.tier_spend(base, "creative", "spend", ["status", "tier"])) == [("in", "t1", 5), ("in", "t2", 7), ("pre", "t1", 5)]
    assert rows(kpi.status_intersection(base, "status", "pre", "in", ["creative"])) == [(1,)]
    assert rows(kpi.distinct_with_count(base, ["status"], "creative", "n")) == [("in", 2), ("pre", 1)]


def test_totals(fact, rows):
    rollup = kpi.sum_by(fact, ["tier"], ["clicks"])
    assert rows(kpi.grand_total(rollup, ["clicks"])) == [(25,)]
    assert rows(kpi.window_totals(fact, F.col("tier") == "q", ["clicks"])) == [(5,)]
    assert rows(kpi.measures_by(fact, ["tier"], "product_id", ["clicks"])) == [("p", 10, 2, 20), ("q", 99, 2, 5)]


def test_all_definitions(spark):
    sums = {"clicks": 3, "impressions": 400, "spend_usd": 50, "spend_lc": 60, "fully_played": 20, "views": 80, "video_25": 64, "video_50": 40, "video_75": 24, "budget_usd": 200}
    # What each KPI must be.
    want = {
        "ctr": 0.75, "ctr_fraction": 0.0075, "cpm_usd": 125, "cpm_lc": 150, "cpcv_usd": 2.5, "cpcv_lc": 3, "vtr_views": 0.2,
        "vtr_views_pct": 20, "vtr_completions": 0.05, "vtr_completions_pct": 5, "vcr_views": 0.25, "vcr_views_pct": 25,
        "vcr_impressions": 0.05, "vcr_impressions_pct": 5, "vcr25": 0.8, "vcr50": 0.5, "vcr75": 0.3, "spend_pacing": 25,
    }
    row = spark.createDataFrame([tuple(sums.values())], ", ".join(f"{k} bigint" for k in sums)).select(*[REGISTRY[k].column() for k in want]).first()
    assert row.asDict() == pytest.approx(want) and set(want) == set(REGISTRY)


def test_given_kpis_vary_between_groups(spark):
    for name in ("m01_kpi_brand", "m01_kpi_campaign"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        kpis = [c for c in df.columns if c in REGISTRY]
        counts = df.agg(*[F.countDistinct(F.round(c, 9)).alias(c) for c in kpis]).first()
        assert all(counts[c] > 1 for c in kpis), counts


def test_sums_meet_their_dim_once_per_key(fact, spark, rows):
    dim = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "campaign_id int, country string")
    dated = fact.withColumn("date", F.lit("2020-01-01").cast("date"))
    through = kpi.measures_by(dated, ["country"], "date", ["clicks"], (dim, "campaign_id", "inner"))
    joined = kpi.measures_by(dated.join(dim, "campaign_id"), ["country"], "date", ["clicks"])
    assert rows(through) == rows(joined)


def test_dims_by_a_compared_key_are_met_by_the_sums(spark, rows):
    data = [(1, 5, 10, 100), (1, 5, 10, 100), (2, 5, 10, 100), (2, 6, 10, 100), (3, 5, 10, 100), (None, 5, 10, 100)]
    fact = spark.createDataFrame(data, "campaign int, day int, clicks long, impressions long")
    dim = spark.createDataFrame([(1, "US"), (2, "US"), (3, "DE")], "campaign int, country string")
    for how, want in (("inner", [("DE", 10), ("US", 30)]), ("left", [(None, 10), ("DE", 10), ("US", 30)])):
        got = kpi.kpi_rollup(fact, ["country"], ["ctr"], dedup=["campaign", "day"], dims=[(dim, "campaign", how)])
        joined = kpi.kpi_rollup(fact.join(dim, "campaign", how), ["country"], ["ctr"], dedup=["campaign", "day"])
        assert rows(got, "country", "clicks") == want and rows(got) == rows(joined.select(*got.columns))
