"""R: referential integrity and set comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import refs
from ..operators.scope import filter_years
from ..plans.bindings import Views, with_views
from ..sources.tables import union_all
from .registry import query, sums


@query(
    "r01_orphans",
    """SELECT DISTINCT 'documents' AS fact, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT DISTINCT 'orders', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
       UNION ALL SELECT DISTINCT 'events', user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""",
)
def _(t: Views) -> DataFrame:
    pairs = {
        "documents": (t.documents.select(F.col("doc_id").alias("id")), t.labels.select(F.col("doc_id").alias("id"))),
        "orders": (t.orders.select(F.col("o_orderkey").alias("id")), t.lineitem.select(F.col("l_orderkey").alias("id"))),
        "events": (t.events.select(F.col("user_id").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id"))),
    }
    return union_all(refs.orphans(a, b, ["id"]).select(F.lit(n).alias("fact"), "id") for n, (a, b) in pairs.items())


@query(
    "r02_orphan_rows",
    """SELECT event_id, user_id, event_type FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""",
)
def _(t: Views) -> DataFrame:
    suppliers = t.supplier.select(F.col("s_suppkey").alias("user_id"))
    return refs.orphan_rows(t.events, suppliers, ["user_id"], ["event_id", "event_type"])


@query(
    "r02_missing_key_counts",
    """SELECT 'supplier' AS dim_name, count(DISTINCT user_id) AS missing_keys, count(*) AS missing_rows FROM events
       WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
       UNION ALL SELECT 'nation', count(DISTINCT user_id), count(*) FROM events WHERE user_id NOT IN (SELECT n_nationkey FROM nation)
       UNION ALL SELECT 'customer', count(DISTINCT user_id), count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""",
)
def _(t: Views) -> DataFrame:
    dims = {
        "supplier": (t.supplier.select(F.col("s_suppkey").alias("user_id")), ["user_id"]),
        "nation": (t.nation.select(F.col("n_nationkey").cast("bigint").alias("user_id")), ["user_id"]),
        "customer": (t.customer.select(F.col("c_custkey").alias("user_id")), ["user_id"]),
    }
    return refs.missing_key_counts(t.events, dims)


@query("r03_key_difference", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def _(t: Views) -> DataFrame:
    return refs.key_difference(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query(
    "r04_code_overlap",
    """WITH a AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal < 2000),
            b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT')
       SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left_only' WHEN a.id IS NULL THEN 'right_only' ELSE 'both' END AS side
       FROM a FULL JOIN b ON a.id = b.id""",
)
def _(t: Views) -> DataFrame:
    a = t.customer.filter("c_acctbal < 2000").select(F.col("c_custkey").alias("id"))
    b = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return refs.code_overlap(a, b, "id")


@query(
    "r05_presence_matrix",
    """WITH k AS (SELECT c_nationkey * 2 AS nationkey, 'c' AS t FROM customer
                 UNION SELECT s_nationkey, 's' FROM supplier UNION SELECT n_nationkey, 'n' FROM nation)
       SELECT nationkey, bool_or(t = 'c') AS in_customer, bool_or(t = 's') AS in_supplier, bool_or(t = 'n') AS in_nation
       FROM k GROUP BY 1""",
)
def _(t: Views) -> DataFrame:
    frames = {
        # Codes of another system: some of them no nation has.
        "customer": t.customer.select((F.col("c_nationkey") * 2).alias("nationkey")),
        "supplier": t.supplier.select(F.col("s_nationkey").alias("nationkey")),
        "nation": t.nation.select(F.col("n_nationkey").alias("nationkey")),
    }
    return refs.presence_matrix(frames, "nationkey")


@query(
    "r06_full_outer_keys",
    """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996),
            b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 2000)
       SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'left_only' ELSE 'right_only' END AS side
       FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL""",
)
def _(t: Views) -> DataFrame:
    a, b = (filter_years(t.orders, "o_orderdate", [y]) for y in (1996, 2000))
    return refs.full_outer_keys(a, b, "o_custkey")


@query(
    "r07_unmatched_in_plan",
    f"""{with_views('planned', 'campaigns')} SELECT campaign_id, campaign_desc, segment FROM campaigns
        WHERE campaign_id NOT IN (SELECT campaign_id FROM planned WHERE year(plan_start) = 1999)""",
)
def _(t: Views) -> DataFrame:
    plan = filter_years(t.planned, "plan_start", [1999])
    return refs.unmatched_in_plan(t.campaigns.select("campaign_id", "campaign_desc", "segment"), plan, ["campaign_id"])


@query(
    "r08_enrich_unmatched",
    f"""{with_views('delivery', 'channels', 'products')}, lost AS (SELECT DISTINCT o_orderkey AS plan_line_id FROM orders
        WHERE o_custkey NOT IN (SELECT user_id FROM events))
        SELECT channel_country, brand, {sums('spend_usd', 'spend_lc')}
        FROM lost LEFT JOIN delivery USING (plan_line_id) LEFT JOIN channels USING (channel_id) LEFT JOIN products USING (product_id)
        GROUP BY 1, 2""",
)
def _(t: Views) -> DataFrame:
    plan = t.planned.select("plan_line_id", "campaign_id")
    lost = refs.unmatched_in_plan(plan, t.reach, ["campaign_id"])
    dims = [(t.channels.select("channel_id", "channel_country"), "channel_id"), (t.products.select("product_id", "brand"), "product_id")]
    fact = t.delivery.select("plan_line_id", "channel_id", "product_id", "spend_usd", "spend_lc")
    return refs.enrich_unmatched(lost, fact, ["plan_line_id"], dims, ["channel_country", "brand"], ["spend_usd", "spend_lc"])


@query(
    "r09_code_filter_join",
    "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)",
)
def _(t: Views) -> DataFrame:
    codes = t.lineitem.filter("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return refs.code_filter_join(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), codes, "s_suppkey")


@query(
    "r10_source_gap",
    """SELECT lang, n_chars FROM documents WHERE source = 'src1' EXCEPT SELECT lang, n_chars FROM documents WHERE source = 'src2'""",
)
def _(t: Views) -> DataFrame:
    return refs.source_gap(t.documents, "source", "src1", "src2", ["lang", "n_chars"])


