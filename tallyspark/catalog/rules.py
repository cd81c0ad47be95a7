"""V: value rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money
from ..operators import rules
from ..plans.bindings import Views, with_views
from ..sources.tables import union_all
from .registry import dbl, query, raw_ratio, unsigned_zero, yr


@query(
    "v01_out_of_range",
    f"SELECT l_orderkey, l_linenumber, {unsigned_zero('l_discount')} AS l_discount FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.05)",
)
def _(t: Views) -> DataFrame:
    return rules.out_of_range(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", 0, 0.05)


@query(
    "v01_out_of_range_nulls",
    f"{with_views('labelled')} SELECT doc_id, quality FROM labelled WHERE quality IS NULL OR NOT (quality BETWEEN 1 AND 1)",
)
def _(t: Views) -> DataFrame:
    return rules.out_of_range(t.labelled.select("doc_id", "quality"), "quality", 1, 1, nulls="fail")


@query(
    "v02_not_in_set",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')",
)
def _(t: Views) -> DataFrame:
    return rules.not_in_set(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])


@query(
    "v03_paired_zero",
    f"""SELECT l_orderkey, l_linenumber, {unsigned_zero('l_tax')} AS l_tax, {unsigned_zero('l_discount')} AS l_discount,
        CASE WHEN l_tax = 0 THEN 'l_tax_zero' ELSE 'l_discount_zero' END AS reason FROM lineitem
        WHERE (l_tax = 0 AND l_discount <> 0) OR (l_discount = 0 AND l_tax <> 0)""",
)
def _(t: Views) -> DataFrame:
    return rules.paired_zero(t.lineitem.select("l_orderkey", "l_linenumber", "l_tax", "l_discount"), "l_tax", "l_discount")


@query(
    "v04_paired_null",
    f"""WITH s AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (WHERE year(o_orderdate) = 1996) AS spend_1996,
            sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (WHERE year(o_orderdate) = 2000) AS spend_2000 FROM orders GROUP BY 1)
        SELECT o_custkey, {dbl('spend_1996')} AS spend_1996, {dbl('spend_2000')} AS spend_2000,
        CASE WHEN spend_1996 IS NULL THEN 'spend_1996_null' ELSE 'spend_2000_null' END AS reason
        FROM s WHERE (spend_1996 IS NULL) <> (spend_2000 IS NULL)""",
)
def _(t: Views) -> DataFrame:
    year, amount = F.year("o_orderdate"), money("o_totalprice")
    both = t.orders.groupBy("o_custkey").agg(
        F.sum(F.when(year == 1996, amount)).alias("spend_1996"), F.sum(F.when(year == 2000, amount)).alias("spend_2000")
    )
    return rules.paired_null(both, "spend_1996", "spend_2000")


@query(
    "v05_negative",
    f"""SELECT 'customer' AS table_name, c_custkey AS id, {dbl('c_acctbal')} AS balance, 'balance' AS reason FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT 'supplier', s_suppkey, {dbl('s_acctbal')}, 'balance' FROM supplier WHERE s_acctbal < 0""",
)
def _(t: Views) -> DataFrame:
    customers = t.customer.select(F.lit("customer").alias("table_name"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    suppliers = t.supplier.select(F.lit("supplier").alias("table_name"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return rules.negative(union_all([customers, suppliers]), ["balance"])


@query(
    "v05_negative_or_zero_text",
    """SELECT l_orderkey, l_linenumber, tax, margin, concat_ws(',', CASE WHEN CAST(margin AS DOUBLE) < 0 THEN 'margin' END,
        CASE WHEN CAST(tax AS DOUBLE) = 0 THEN 'tax' END) AS reason
       FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_tax * 100 AS INTEGER) AS VARCHAR) AS tax,
             CAST(CAST(l_quantity AS INTEGER) - 2 AS VARCHAR) AS margin FROM lineitem)
       WHERE CAST(margin AS DOUBLE) < 0 OR CAST(tax AS DOUBLE) = 0""",
)
def _(t: Views) -> DataFrame:
    texts = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_tax") * 100).cast("int").cast("string").alias("tax"),
        (F.col("l_quantity").cast("int") - 2).cast("string").alias("margin"),
    )
    return rules.negative(texts, ["margin"], zeros=["tax"])


@query(
    "v06_rate_zero_amount_nonzero",
    f"""SELECT * FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_discount * 20) AS BIGINT) AS rate,
            {dbl('CAST(l_extendedprice * l_discount AS DECIMAL(18,4))')} AS amount, 'rate_zero' AS reason FROM lineitem)
        WHERE rate = 0 AND amount <> 0""",
)
def _(t: Views) -> DataFrame:
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.floor(F.col("l_discount") * 20).alias("rate"),
        money(F.col("l_extendedprice") * F.col("l_discount")).alias("amount"),
    )
    return rules.rate_zero_amount_nonzero(lines, "rate", "amount")


ALLOCATION_SQL = f"""{with_views('planned')}, a AS (SELECT plan_line_id, CAST(budget_usd AS DOUBLE) AS total, plan_start,
        CASE WHEN budget_usd < 2000 THEN plan_start - 5 ELSE plan_end END AS finish,
        round(CAST(budget_usd AS DOUBLE) / 31, 2) + CASE priority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 1 ELSE 0 END AS rate
        FROM planned),
     b AS (SELECT *, round(total / CASE WHEN finish - plan_start + 1 > 0 THEN finish - plan_start + 1 END, 2) AS calculated_rate FROM a)
     SELECT plan_line_id, {dbl('total')} AS total, {dbl('rate')} AS rate, {dbl('calculated_rate')} AS calculated_rate,
     {dbl('round(rate / nullif(calculated_rate, 0), 2)')} AS rate_ratio
     FROM b WHERE round(rate / nullif(calculated_rate, 0), 2) <> 1.00"""


@query("v07_even_allocation", ALLOCATION_SQL)
def _(t: Views) -> DataFrame:
    # Urgent lines are booked 100 too high, high ones 1; lines below 2000 have a reversed span.
    extra = F.when(F.col("priority") == "1-URGENT", 100).when(F.col("priority") == "2-HIGH", 1).otherwise(0)
    total = F.col("budget_usd").cast("double")
    booked = t.planned.select(
        "plan_line_id", total.alias("total"), "plan_start",
        F.when(F.col("budget_usd") < 2000, F.date_sub("plan_start", 5)).otherwise(F.col("plan_end")).alias("finish"),
        (F.round(total / 31, 2) + extra).alias("rate"),
    )
    return rules.even_allocation(booked, "total", "rate", "plan_start", "finish").drop("plan_start", "finish")


@query(
    "v08_date_out_of_bounds",
    f"""{with_views('perf')} SELECT plan_line_id, creative_id, date, campaign_start_date FROM perf
        WHERE NOT (date BETWEEN campaign_start_date AND campaign_start_date + 365 + 1)""",
)
def _(t: Views) -> DataFrame:
    spans = t.perf.select("plan_line_id", "creative_id", "date", "campaign_start_date").withColumn("until", F.date_add("campaign_start_date", 365))
    return rules.date_out_of_bounds(spans, "date", "campaign_start_date", "until", slack=1).drop("until")


def _span_sql(op: str) -> str:
    return f"""{with_views('perf')}, d AS (SELECT DISTINCT campaign_id, campaign_start_date, campaign_start_date + 365 AS campaign_end_date FROM perf),
        o AS (SELECT campaign_id, min(date) AS first_date, max(date) AS last_date FROM perf GROUP BY 1)
        SELECT campaign_id, first_date, last_date, campaign_start_date, campaign_end_date FROM o JOIN d USING (campaign_id)
        WHERE campaign_start_date <> first_date {op} campaign_end_date <> last_date"""


def _spans(t: Views, mode: str) -> DataFrame:
    declared = t.perf.withColumn("campaign_end_date", F.date_add("campaign_start_date", 365))
    return rules.declared_vs_observed_span(declared, ["campaign_id"], "date", "campaign_start_date", "campaign_end_date", mode)


@query("v09_declared_vs_observed_any", _span_sql("OR"))
def _(t: Views) -> DataFrame:
    return _spans(t, "any")


@query("v09_declared_vs_observed_both", _span_sql("AND"))
def _(t: Views) -> DataFrame:
    return _spans(t, "both")


@query(
    "v10_status_vs_latest",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS end_date,
           CAST(max(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE) AS latest FROM orders)
       SELECT * FROM o WHERE (o_orderstatus = 'O' AND end_date <> latest) OR (o_orderstatus = 'F' AND end_date = latest)""",
)
def _(t: Views) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("end_date"))
    return rules.status_vs_latest(orders, "o_orderstatus", "end_date", "o_custkey", active="O", inactive="F")


@query(
    "v11_prefix_mismatch",
    """SELECT p_partkey, p_name, left(p_type, 2) AS code, upper(left(p_name, 2)) AS prefix FROM part
       WHERE upper(left(p_name, 2)) <> left(p_type, 2)""",
)
def _(t: Views) -> DataFrame:
    return rules.prefix_mismatch(t.part.select("p_partkey", "p_name", F.substring("p_type", 1, 2).alias("code")), "p_name", "code")


@query(
    "v12_one_name_many_keys",
    """WITH pairs AS (SELECT DISTINCT p_name, p_brand FROM part), n AS (SELECT p_name, count(*) AS n_keys FROM pairs GROUP BY 1)
       SELECT p_name, p_brand, n_keys FROM pairs JOIN n USING (p_name) WHERE n_keys > 1""",
)
def _(t: Views) -> DataFrame:
    return rules.one_name_many_keys(t.part, "p_name", "p_brand")


def _zero_sql(join: str) -> str:
    return f"""{with_views('delivery', 'products')} SELECT product_id, plan_line_id, creative_id, clicks, brand
        FROM delivery {join} JOIN (SELECT * FROM products WHERE product_type = 'PROMO') USING (product_id) WHERE fully_played = 0"""


def _zero_metric(t: Views, how: str) -> DataFrame:
    fact = t.delivery.select("product_id", "plan_line_id", "creative_id", "clicks", "fully_played")
    dim = t.products.select("product_id", "product_type", "brand")
    out = rules.zero_metric_for_type(fact, dim, "product_id", F.col("product_type") == "PROMO", "fully_played", how)
    return out.drop("fully_played", "product_type")


@query("v13_zero_metric_for_type", _zero_sql(""))
def _(t: Views) -> DataFrame:
    return _zero_metric(t, "inner")


@query("v13_zero_metric_for_type_left", _zero_sql("LEFT"))
def _(t: Views) -> DataFrame:
    return _zero_metric(t, "left")


@query(
    "v14_subset_by_attribute",
    f"""{with_views('planned', 'campaigns')} SELECT plan_line_id, campaign_id, segment FROM planned JOIN campaigns USING (campaign_id)
        WHERE lower(segment) IN ('furniture', 'machinery')""",
)
def _(t: Views) -> DataFrame:
    plan = t.planned.select("plan_line_id", "campaign_id")
    return rules.subset_by_attribute(plan, t.campaigns.select("campaign_id", "segment"), "campaign_id", "segment", ["Furniture", "MACHINERY", "machinery"])


@query(
    "v15_attribute_disagreement",
    f"""{with_views('perf', 'campaigns', 'channels')} SELECT DISTINCT campaign_id, channel_id, country_id, channel_country
        FROM perf LEFT JOIN campaigns USING (campaign_id) LEFT JOIN channels USING (channel_id) WHERE country_id <> channel_country""",
)
def _(t: Views) -> DataFrame:
    return rules.attribute_disagreement(
        t.perf,
        (t.campaigns.select("campaign_id", "country_id"), "campaign_id"),
        (t.channels.select("channel_id", "channel_country"), "channel_id"),
        [("country_id", "channel_country")],
    )


@query(
    "v16_equal_columns",
    f"""{with_views('delivery')} SELECT status, tier, count(*) AS n_rows, count(*) FILTER (WHERE spend_lc = spend_usd) AS n_equal,
        {dbl('sum(spend_lc)')} AS sum_spend_lc, {dbl('sum(spend_usd)')} AS sum_spend_usd FROM delivery GROUP BY 1, 2""",
)
def _(t: Views) -> DataFrame:
    return rules.equal_columns(t.delivery, "spend_lc", "spend_usd", ["status", "tier"])


@query(
    "v17_parity_for_keys",
    f"""{with_views('perf_country')}, s AS (SELECT country_id, {yr('date')} AS year,
            {raw_ratio('sum(spend_lc)', 'sum(spend_usd)')} AS spend_ratio FROM perf_country GROUP BY 1, 2)
        SELECT country_id, year, {dbl('spend_ratio')} AS spend_ratio FROM s
        WHERE country_id IN (1, 3, 5, 7, 11) AND year >= 1999 AND spend_ratio <> 1.0""",
)
def _(t: Views) -> DataFrame:
    return rules.parity_for_keys(t.spend_year, "country_id", [1, 3, 5, 7, 11], "year", 1999, {"spend_ratio": ("spend_lc", "spend_usd")})


@query(
    "v18_column_disagreement",
    f"{with_views('delivery')} SELECT plan_line_id, creative_id, {dbl('spend_usd')} AS spend_usd, {dbl('spend_lc')} AS spend_lc FROM delivery WHERE spend_usd <> spend_lc",
)
def _(t: Views) -> DataFrame:
    return rules.column_disagreement(t.delivery.select("plan_line_id", "creative_id", "spend_usd", "spend_lc"), "spend_usd", "spend_lc")


@query(
    "v18_column_disagreement_null_safe",
    f"{with_views('labelled')} SELECT doc_id, quality, toxic FROM labelled WHERE quality IS DISTINCT FROM toxic",
)
def _(t: Views) -> DataFrame:
    return rules.column_disagreement(t.labelled.select("doc_id", "quality", "toxic"), "quality", "toxic", null_safe=True)


@query(
    "v19_span_order",
    f"""{with_views('perf')}, s AS (SELECT plan_line_id, creative_id, campaign_start_date AS start_date,
            CASE WHEN tier = 'R' THEN campaign_start_date - 1 ELSE campaign_start_date + 700 END AS end_date, date FROM perf),
          r AS (SELECT *, CASE WHEN start_date > end_date THEN 'start_after_end' WHEN start_date > date THEN 'day_before_start'
            WHEN end_date < date THEN 'day_after_end' END AS reason FROM s)
        SELECT * FROM r WHERE reason IS NOT NULL""",
)
def _(t: Views) -> DataFrame:
    start = F.col("campaign_start_date")
    end = F.when(F.col("tier") == "R", F.date_sub(start, 1)).otherwise(F.date_add(start, 700))
    spans = t.perf.select("plan_line_id", "creative_id", start.alias("start_date"), end.alias("end_date"), "date")
    return rules.span_order(spans, "start_date", "end_date", "date")


VIDEO = ["fully_played", "video_25", "video_50", "video_75"]


@query(
    "v20_nonzero_in_channel",
    f"""{with_views('delivery', 'channels')}, s AS (SELECT channel_id, product_id, tier, """
    + ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in VIDEO)
    + """ FROM delivery JOIN channels USING (channel_id) WHERE channel_country IN (2, 4, 6, 8, 10) GROUP BY 1, 2, 3)
        SELECT * FROM s WHERE fully_played <> 0 AND video_25 <> 0 AND video_50 <> 0 AND video_75 <> 0""",
)
def _(t: Views) -> DataFrame:
    df = t.delivery.join(t.channels.select("channel_id", "channel_country"), "channel_id")
    return rules.nonzero_in_channel(df, F.col("channel_country").isin(2, 4, 6, 8, 10), ["channel_id", "product_id", "tier"], VIDEO)


