"""F: filters and projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scope
from ..plans.bindings import Views, with_views
from ..sources.tables import union_all
from .registry import dbl, query, yr

LINE = "l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS ship_date"


def _line(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("ship_date"))


@query(
    "f01_filter_keys",
    """SELECT 'customer' AS table_name, c_custkey AS id, c_nationkey AS nationkey FROM customer
       WHERE c_nationkey IN (1, 2, 3, 5, 8, 13, 21) AND c_nationkey NOT IN (8, 13)
       UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier
       WHERE s_nationkey IN (1, 2, 3, 5, 8, 13, 21) AND s_nationkey NOT IN (8, 13)""",
)
def _(t: Views) -> DataFrame:
    frames = {
        "customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nationkey")),
        "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nationkey")),
    }
    kept = scope.filter_keys(frames, "nationkey", include=[1, 2, 3, 5, 8, 13, 21], exclude=[8, 13])
    return union_all(df.select(F.lit(n).alias("table_name"), "id", "nationkey") for n, df in kept.items())


@query("f02_filter_vendor", "SELECT doc_id, source, lang, n_chars FROM documents WHERE source = 'src7'")
def _(t: Views) -> DataFrame:
    return scope.filter_vendor(t.documents, "source", "src7").select("doc_id", "source", "lang", "n_chars")


@query("f03_filter_years", f"SELECT {LINE} FROM lineitem WHERE year(l_shipdate) IN (1996, 1998)")
def _(t: Views) -> DataFrame:
    return _line(scope.filter_years(t.lineitem, "l_shipdate", [1996, 1998]))


@query("f04_as_of", f"SELECT {LINE} FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1995-06-30'")
def _(t: Views) -> DataFrame:
    return _line(scope.as_of(t.lineitem, "l_shipdate", dt.date(1995, 6, 30)))


@query("f04_between_dates", f"SELECT {LINE} FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-02-01' AND DATE '1997-02-28'")
def _(t: Views) -> DataFrame:
    return _line(scope.between_dates(t.lineitem, "l_shipdate", dt.date(1997, 2, 1), dt.date(1997, 2, 28)))


@query("f05_exclude_values", "SELECT event_id, user_id, event_type FROM events WHERE event_type NOT IN ('error', 'signup')")
def _(t: Views) -> DataFrame:
    return scope.exclude_values(t.events, "event_type", ["error", "signup"]).select("event_id", "user_id", "event_type")


@query(
    "f06_sql_filter",
    "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 5000 AND c_mktsegment LIKE 'M%'",
)
def _(t: Views) -> DataFrame:
    return scope.sql_filter(t.customer, "c_acctbal > 5000 AND c_mktsegment LIKE 'M%'").drop("c_name")


@query(
    "f07_default_region",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' OR c_acctbal < 0 THEN 'NORTH' ELSE c_mktsegment END AS region_code
       FROM customer""",
)
def _(t: Views) -> DataFrame:
    # Empty for one segment, missing for negative accounts.
    code = F.when(F.col("c_acctbal") < 0, None).when(F.col("c_mktsegment") == "FURNITURE", "").otherwise(F.col("c_mktsegment"))
    return scope.default_region(t.customer.select("c_custkey", code.alias("region_code")), "region_code", "NORTH")


@query(
    "f08_scope_dim",
    """SELECT DISTINCT c_custkey, c_name, c_mktsegment, o_orderpriority
        FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderdate >= DATE '2000-01-01'""",
)
def _(t: Views) -> DataFrame:
    used = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    out = scope.scope_dim(t.customer, used, "c_custkey", "o_orderdate", dt.date(2000, 1, 1), ["o_orderpriority"])
    return out.select("c_custkey", "c_name", "c_mktsegment", "o_orderpriority")


@query("f09_allow_values", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def _(t: Views) -> DataFrame:
    return scope.allow_values(t.events, "event_type", ["click", "view", "purchase"]).select("event_id", "event_type", "value")


@query(
    "f10_drill",
    f"""SELECT c_name, o_orderkey, {dbl('o_totalprice')} AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_name IN ('Customer#000000007', 'Customer#000000042')""",
)
def _(t: Views) -> DataFrame:
    chosen = scope.drill(t.customer, "c_name", ["Customer#000000007", "Customer#000000042"])
    return t.orders.join(chosen, F.col("o_custkey") == F.col("c_custkey")).select("c_name", "o_orderkey", "o_totalprice")


@query(
    "f11_match_text",
    """SELECT p_partkey, p_name FROM part
       WHERE contains(p_name, 'red') OR contains(p_name, 'ring') OR regexp_matches(p_name, '^(cold|hot) g')""",
)
def _(t: Views) -> DataFrame:
    return scope.match_text(t.part, "p_name", ["red", "ring"], r"^(cold|hot) g").select("p_partkey", "p_name")


@query(
    "f12_pick_dates",
    f"SELECT {LINE} FROM lineitem WHERE CAST(l_shipdate AS DATE) IN (DATE '1996-02-29', DATE '1997-12-31', DATE '1998-01-01')",
)
def _(t: Views) -> DataFrame:
    dates = [dt.date(1996, 2, 29), dt.date(1997, 12, 31), dt.date(1998, 1, 1)]
    return _line(scope.pick_dates(t.lineitem, "l_shipdate", dates))


@query("f13_distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t: Views) -> DataFrame:
    return scope.distinct_values(t.part, ["p_brand", "p_type"])


@query(
    "f14_project",
    "SELECT p_partkey AS product_id, p_name AS product_ref, p_brand AS brand_ref FROM part",
)
def _(t: Views) -> DataFrame:
    picked = scope.project(t.part, ["p_partkey", "p_name", "p_brand", "p_type"], drop=["p_type"])
    renamed = scope.rename_all(picked, ["product_id", "product", "brand"])
    return scope.suffix_columns(renamed, "_ref", keep=["product_id"])


@query(
    "f15_cast_columns",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, {dbl('CAST(o_totalprice AS DECIMAL(20,1))')} AS o_totalprice,
        TRY_CAST(left(o_orderpriority, 1) AS INTEGER) AS rank, TRY_CAST(o_orderstatus AS DOUBLE) AS status_number FROM orders""",
)
def _(t: Views) -> DataFrame:
    raw = t.orders.select(
        "o_orderkey", "o_totalprice", F.substring("o_orderpriority", 1, 1).alias("rank"), F.col("o_orderstatus").alias("status_number")
    )
    return scope.cast_columns(raw, {"o_orderkey": "string", "o_totalprice": "decimal(20,1)", "rank": "int", "status_number": "double"})


@query(
    "f16_fill_missing",
    f"{with_views('labelled')} SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM labelled",
)
def _(t: Views) -> DataFrame:
    return scope.fill_missing(t.labelled.select("doc_id", "quality", "toxic"), 0, ["quality", "toxic"])


@query("f17_order_desc", f"SELECT o_orderkey, {yr('o_orderdate')} AS year, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def _(t: Views) -> DataFrame:
    return scope.order_desc(t.orders, "o_orderdate", "o_orderkey").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), "o_orderstatus"
    )
