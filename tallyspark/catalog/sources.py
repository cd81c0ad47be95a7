"""S and Q: reading, writing, profiles, schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import base64_text
from ..plans.bindings import TABLES, Views
from ..sources import extracts, sinks, tables
from ..sources.scratch import scratch_path
from .registry import big, dbl, query, yr


@query(
    "s03_load_table",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS order_date FROM orders",
)
def _(t: Views) -> DataFrame:
    spec = tables.TableSpec("orders", path=f"{t.folder}/orders.parquet", keys=("o_orderkey",))
    return tables.load_table(t.spark, spec).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("order_date")
    )


@query("s04_load_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t: Views) -> DataFrame:
    path = scratch_path(t.spark, "customer-csv")
    sinks.write_result(t.customer, path)
    return tables.load_csv(t.spark, path, t.customer.schema)


@query("s05_load_metastore", "SELECT s_suppkey, upper(s_name) AS s_name, s_acctbal FROM supplier")
def _(t: Views) -> DataFrame:
    t.supplier.withColumnRenamed("s_acctbal", "s_acctbal\u00a0").createOrReplaceTempView("supplier_rates")
    return tables.load_metastore(t.spark, "supplier_rates", upper=["s_name"]).select("s_suppkey", "s_name", "s_acctbal")


def part_codes(t: Views) -> DataFrame:
    """The accepted brands and types of parts as a raw codebook: padded, with repeats and blanks."""
    pairs = F.array(
        F.struct(F.lit("p_brand").alias("attribute"), F.concat(F.lit(" "), F.col("p_brand")).alias("code")),
        F.struct(F.lit("p_type").alias("attribute"), F.col("p_type").alias("code")),
        F.struct(F.lit("p_type").alias("attribute"), F.lit(" ").alias("code")),
    )
    return t.part.select(F.inline(pairs)).distinct().select(F.lit("part").alias("entity"), "attribute", "code")


@query(
    "s06_load_codebook",
    """SELECT DISTINCT 'part' AS entity, 'p_brand' AS attribute, p_brand AS code FROM part
       UNION SELECT DISTINCT 'part', 'p_type', p_type FROM part""",
)
def _(t: Views) -> DataFrame:
    path = scratch_path(t.spark, "codebook")
    sinks.write_result(part_codes(t), path)
    return extracts.load_codebook(t.spark, path)


@query("s07_load_exceptions", "SELECT DISTINCT 'customer' AS entity, c_name AS name FROM customer WHERE c_acctbal < 0")
def _(t: Views) -> DataFrame:
    path = scratch_path(t.spark, "exceptions")
    names = t.customer.filter("c_acctbal < 0").select(F.lit("customer").alias("entity"), F.col("c_name").alias("name"))
    sinks.write_result(names, path)
    return extracts.load_exceptions(t.spark, path)


EXTRACT_HEADING = ["Account", "Segment", "Balance", "Market"]


def write_extracts(t: Views) -> str:
    """Customers as tab-separated extracts, some files per market segment: 4 preamble lines, a heading, the rows."""
    path = scratch_path(t.spark, "extracts")
    # Files grow with the rows (counted from the footers), and no segment is one file.
    parts = 2 + t.customer.count() // 1_000_000
    file = [F.col("c_mktsegment").alias("segment"), F.pmod(F.xxhash64("c_custkey"), F.lit(parts)).alias("part")]
    # Every other customer's segment is quoted.
    segment = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))).otherwise(F.col("c_mktsegment"))
    row = F.concat_ws("\t", "c_custkey", segment, F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string"))
    write_with_preamble(t.customer.select(*file, row.alias("value")), "customers", EXTRACT_HEADING, path)
    return path


def write_with_preamble(rows: DataFrame, title: str, heading: list[str], path: str) -> None:
    """Lines (segment, part, value) as one text file per segment and part, each with 4 preamble lines and a heading."""
    top = [f"Report\t{title}", "Created by the finance team", "Currency USD", "", "\t".join(heading)]
    preamble = rows.select("segment", "part").distinct().select(
        "segment", "part", F.posexplode(F.array(*[F.lit(x) for x in top])).alias("pos", "value")
    )
    body = rows.select("segment", "part", F.lit(len(top)).alias("pos"), "value")
    lines = body.unionByName(preamble).repartition("segment", "part").sortWithinPartitions("segment", "part", "pos")
    lines.select("segment", "part", "value").write.partitionBy("segment", "part").text(path)


@query(
    "s08_load_extracts",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS "Account", c_mktsegment AS "Segment", {dbl('c_acctbal')} AS balance,
        CAST(c_nationkey AS VARCHAR) AS "Market" FROM customer""",
)
def _(t: Views) -> DataFrame:
    df = extracts.load_extracts(t.spark, f"{write_extracts(t)}/*/*/*.txt", EXTRACT_HEADING)
    return df.select("Account", "Segment", F.col("Balance").cast("double").alias("balance"), "Market")


@query(
    "s09_conform_extract",
    f"""SELECT 'ALL' AS country, coalesce(c_mktsegment, 'NA') AS channel, CAST(c_custkey AS BIGINT) AS account,
        {dbl("coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 0)")} AS spend FROM customer""",
)
def _(t: Views) -> DataFrame:
    raw = t.customer.select(
        F.col("c_custkey").cast("string").alias("Account"),
        F.col("c_mktsegment").alias("Channel Name"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("Media Spend"),
    )
    mapping = {"channel": ("Channel Name", "string"), "account": ("Account", "bigint"), "spend": ("Media Spend", "double")}
    return extracts.conform_extract(raw, mapping, {"country": "ALL"})


@query(
    "s10_write_result",
    """WITH s AS (SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY c_nationkey)
       SELECT * FROM s UNION ALL SELECT * FROM s""",
)
def _(t: Views) -> DataFrame:
    path = scratch_path(t.spark, "result")
    result = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    sinks.write_result(result, path, "parquet")
    sinks.write_result(result, path, "parquet", mode="append")
    return t.spark.read.parquet(path)


@query(
    "s11_export_summary",
    f"SELECT source, lang, count(*) AS n_docs, {big('sum(n_chars)')} AS n_chars FROM documents GROUP BY source, lang",
)
def _(t: Views) -> DataFrame:
    path = scratch_path(t.spark, "summary")
    summary = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    sinks.export_summary(summary, path)
    return tables.load_csv(t.spark, path, summary.schema)


@query("s12_register_views", f"""SELECT o_orderpriority, count(*) AS n_orders, {dbl('sum(CAST(o_totalprice AS DECIMAL(18,2)))')} AS total
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY o_orderpriority""")
def _(t: Views) -> DataFrame:
    tables.StarSchema.from_folder(t.folder, ["orders", "customer"]).register_views(t.spark, "star_")
    return t.spark.sql(
        """SELECT o_orderpriority, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
           FROM star_orders JOIN star_customer ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY o_orderpriority"""
    )


@query(
    "s13_year_spine",
    f"""WITH spine AS (SELECT CAST(unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS INTEGER) AS year FROM orders)
        SELECT spine.year, count(o_orderkey) AS n_orders FROM spine
        LEFT JOIN orders ON {yr('o_orderdate')} = spine.year AND o_orderpriority = '1-URGENT' GROUP BY spine.year""",
)
def _(t: Views) -> DataFrame:
    per_year = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    return tables.year_spine(t.orders, "o_orderdate").join(per_year, "year", "left").fillna(0, ["n_orders"])


def _all_tables(select: str) -> str:
    return " UNION ALL ".join(select.format(t=n) for n in TABLES)


@query(
    "s14_table_profile",
    _all_tables(
        "SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, "
        "(SELECT count(*) FROM (DESCRIBE {t})) AS n_columns"
    ),
)
def _(t: Views) -> DataFrame:
    return tables.table_profile(t.all())


@query("s15_base64_content", "SELECT page_id, to_base64(encode(html)) AS content_base64 FROM pages")
def _(t: Views) -> DataFrame:
    return t.pages.select("page_id", base64_text(F.encode("html", "UTF-8")).alias("content_base64"))


@query("s15_files_to_base64", "SELECT page_id, html FROM pages")
def _(t: Views) -> DataFrame:
    """Pages written to files of 200 at most, read as base64 and taken apart again."""
    path = scratch_path(t.spark, "pages-html")
    lines = t.pages.select(F.concat_ws("\u0001", F.col("page_id").cast("string"), "html"))
    lines.write.option("maxRecordsPerFile", 200).text(path, lineSep="\u0000")
    content = F.decode(F.unbase64("content_base64"), "UTF-8")
    pages = extracts.files_to_base64(t.spark, path).select(F.explode(F.split(content, "\u0000")).alias("page")).filter("page != ''")
    parts = F.split("page", "\u0001", 2)
    return pages.select(F.get(parts, F.lit(0)).cast("bigint").alias("page_id"), F.get(parts, F.lit(1)).alias("html"))


@query(
    "s16_sample_view",
    "SELECT p_partkey, p_name, p_brand, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25",
)
def _(t: Views) -> DataFrame:
    parts = t.part.select("p_partkey", "p_name", "p_brand", "p_size")
    return tables.sample_view(parts, 25, [F.desc("p_size"), F.asc("p_partkey")])


# The approved schema of all tables; l_linenumber and label are approved with a wider type than the tables
# have, and l_comment is missing.
APPROVED = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz, l_comment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
COLUMNS = {n: [c.split(" ") for c in s.split(", ")] for n, s in APPROVED.items()}

_TYPE_SQL = """CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(column_type) END"""


def _schema_sql() -> str:
    want = ", ".join(f"('{n}', '{c}', '{kind}')" for n, s in COLUMNS.items() for c, kind in s)
    have = " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, column_name, {_TYPE_SQL} AS actual FROM (DESCRIBE {n})" for n in COLUMNS
    )
    return f"""WITH want(table_name, column_name, expected) AS (VALUES {want}), have AS ({have})
        SELECT table_name, column_name, expected, actual, coalesce(expected = actual, false) AS matches
        FROM want FULL JOIN have USING (table_name, column_name)"""


@query("q01_schema_check", _schema_sql())
def _(t: Views) -> DataFrame:
    return tables.schema_check(t.spark, t.all(), {n: T.StructType.fromDDL(s) for n, s in APPROVED.items()})


