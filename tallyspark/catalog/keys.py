"""K: keys and uniqueness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keys
from ..plans.bindings import TABLES, Views
from .registry import query


@query(
    "k01_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_shipdate AS DATE) AS ship_date, key_count
       FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS key_count FROM lineitem) WHERE key_count > 1""",
)
def _(t: Views) -> DataFrame:
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("ship_date")
    )
    return keys.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


@query(
    "k02_duplicate_key_counts",
    "SELECT l_orderkey, l_linenumber, count(*) AS key_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(t: Views) -> DataFrame:
    return keys.duplicate_key_counts(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "k03_functional_dependency",
    "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1",
)
def _(t: Views) -> DataFrame:
    return keys.functional_dependency(t.orders, ["o_custkey"], ["o_orderpriority"])


@query(
    "k03_functional_dependency_nulls",
    """SELECT source, n_values FROM (SELECT source, count(*) AS n_values FROM
       (SELECT DISTINCT source, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY source) WHERE n_values > 1""",
)
def _(t: Views) -> DataFrame:
    return keys.functional_dependency(t.labelled, ["source"], ["quality"], count_nulls=True)


@query(
    "k04_fd_attributes",
    "SELECT p_brand, p_size, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) > 1",
)
def _(t: Views) -> DataFrame:
    return keys.functional_dependency(t.part, ["p_brand", "p_size"], ["p_type"], name="n_types")


GRAIN_SQL = "SELECT l_orderkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"


@query("k05_grain_duplicates", GRAIN_SQL)
def _(t: Views) -> DataFrame:
    return keys.grain_duplicates(t.lineitem, ["l_orderkey", "l_suppkey"])


@query("k06_grain_duplicates_sql", GRAIN_SQL)
def _(t: Views) -> DataFrame:
    t.lineitem.createOrReplaceTempView("grain_lineitem")
    return t.spark.sql(keys.grain_duplicates_sql("grain_lineitem", ["l_orderkey", "l_suppkey"]))


def _duplicates_sql(name: str, columns: str = "*") -> str:
    return f"""SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) AS n_rows,
        (SELECT count(*) FROM {name}) - (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {name})) AS n_duplicates"""


@query("k07_duplicate_row_count", " UNION ALL ".join(_duplicates_sql(n) for n in TABLES))
def _(t: Views) -> DataFrame:
    return keys.duplicate_row_count(t.all(), digest=["text", "html"])


@query("k07_duplicate_texts", _duplicates_sql("documents", "text"))
def _(t: Views) -> DataFrame:
    return keys.duplicate_row_count({"documents": t.documents.select("text")}, digest=["text"])


@query(
    "k08_key_recomposition",
    """WITH ids AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS code,
           c_mktsegment || '_' || c_nationkey || '_' || CASE WHEN c_acctbal > 9900 THEN 0 ELSE c_custkey END AS id FROM customer),
         e AS (SELECT *, code || '_' || c_nationkey || '_' || c_custkey AS expected FROM ids)
       SELECT c_custkey, id, expected FROM e WHERE id IS DISTINCT FROM expected""",
)
def _(t: Views) -> DataFrame:
    # Ids of very large accounts are wrong; accounts below zero have no segment code.
    number = F.when(F.col("c_acctbal") > 9900, 0).otherwise(F.col("c_custkey"))
    ids = t.customer.select(
        "c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("code"),
        keys.recomposed(["c_mktsegment", "c_nationkey", number]).alias("id"),
    )
    return keys.key_recomposition(ids, "id", ["code", "c_nationkey", "c_custkey"]).select("c_custkey", "id", "expected")


@query(
    "k08_customer_ids",
    """SELECT c_custkey, c_name, 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS expected FROM customer
       WHERE c_name IS DISTINCT FROM 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')""",
)
def _(t: Views) -> DataFrame:
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    return keys.key_recomposition(t.customer.select("c_custkey", "c_name"), "c_name", [F.lit("Customer"), number], sep="#")


@query(
    "k09_name_recomposition",
    """SELECT p_partkey, stored, split_part(p_name, ' ', 1) || '_' || split_part(p_name, ' ', 2) AS expected
       FROM (SELECT *, replace(p_name, ' ', CASE WHEN p_size = 1 THEN '-' ELSE '_' END) AS stored FROM part)
       WHERE stored <> split_part(p_name, ' ', 1) || '_' || split_part(p_name, ' ', 2)""",
)
def _(t: Views) -> DataFrame:
    tokens = F.split("p_name", " ")
    stored = F.when(F.col("p_size") == 1, F.translate("p_name", " ", "-")).otherwise(F.translate("p_name", " ", "_"))
    named = t.part.select("p_partkey", stored.alias("stored"), F.get(tokens, F.lit(0)).alias("a"), F.get(tokens, F.lit(1)).alias("b"))
    return keys.name_recomposition(named, "stored", ["a", "b"]).select("p_partkey", "stored", "expected")


@query(
    "k10_one_to_one",
    """SELECT p_brand || '_' || p_type || '_' || p_size AS built_name, count(DISTINCT p_name) AS n_stored FROM part
       GROUP BY 1 HAVING count(DISTINCT p_name) > 1""",
)
def _(t: Views) -> DataFrame:
    return keys.one_to_one(t.part, ["p_brand", "p_type", "p_size"], "p_name")


@query(
    "k11_keep_one_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS order_date
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def _(t: Views) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("order_date"))
    newest = -F.unix_date("order_date")
    return keys.keep_one_per_key(orders, ["o_custkey"], [newest, F.col("o_orderkey")])


@query(
    "k11_keep_one_located",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
       CAST(l_shipdate AS DATE) AS ship_date
       FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey, l_linenumber) AS rn FROM lineitem)
       WHERE rn = 1""",
)
def _(t: Views) -> DataFrame:
    newest = -F.unix_date(F.col("l_shipdate").cast("date"))
    last = keys.keep_one_located(t.lineitem, ["l_partkey"], [newest, F.col("l_orderkey"), F.col("l_linenumber")])
    columns = "l_partkey l_orderkey l_linenumber l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()
    return last.select(*columns, F.col("l_shipdate").cast("date").alias("ship_date"))


@query(
    "k12_keys_per_name",
    "SELECT c_mktsegment, c_nationkey, count(DISTINCT c_custkey) AS n_keys FROM customer GROUP BY 1, 2",
)
def _(t: Views) -> DataFrame:
    return keys.keys_per_name(t.customer, ["c_mktsegment", "c_nationkey"], "c_custkey")
