"""T: identifiers and tokens in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import date_text
from ..operators import text
from ..plans.bindings import Views
from .registry import query, rat, yr

# An id in the url wins over one in the page body; 'page=' over '/en/'.
ID_SQL = """pages_id AS (SELECT page_id, url, coalesce(nullif(regexp_extract(url, '.*page=([0-9]+)', 1), ''),
    nullif(regexp_extract(html, '.*page=([0-9]+)', 1), ''), nullif(regexp_extract(url, '.*/en/([0-9]+)', 1), ''),
    nullif(regexp_extract(html, '.*/en/([0-9]+)', 1), '')) AS extracted_id,
    regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)"""


def pages_with_id(t: Views) -> DataFrame:
    found = text.extract_id(t.pages, ["url", "html"], ["page=", "/en/"])
    return found.select("page_id", "url", "extracted_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


COUNTS_SQL = """counts AS (SELECT host, count(*) AS n_rows, count(*) FILTER (WHERE extracted_id IS NULL) AS n_without_id
    FROM pages_id GROUP BY host)"""


@query("t01_extract_id", f"WITH {ID_SQL} SELECT page_id, extracted_id FROM pages_id")
def _(t: Views) -> DataFrame:
    return pages_with_id(t).select("page_id", "extracted_id")


@query(
    "t01_extract_id_ignore_case",
    "SELECT conv_id, turn, nullif(regexp_extract(text, '(?i).*the ([0-9]+)', 1), '') AS extracted_id FROM conversations",
)
def _(t: Views) -> DataFrame:
    return text.extract_id(t.conversations, ["text"], ["the "], ignore_case=True).select("conv_id", "turn", "extracted_id")


@query("t02_entities_without_id", f"WITH {ID_SQL}, {COUNTS_SQL} SELECT * FROM counts WHERE n_rows = n_without_id")
def _(t: Views) -> DataFrame:
    return text.entities_without_id(pages_with_id(t), ["host"], "extracted_id")


@query("t03_entities_with_id", f"WITH {ID_SQL}, {COUNTS_SQL} SELECT * FROM counts WHERE n_rows <> n_without_id")
def _(t: Views) -> DataFrame:
    return text.entities_with_id(pages_with_id(t), ["host"], "extracted_id")


@query(
    "t04_id_coverage",
    f"""WITH {ID_SQL}, {COUNTS_SQL} SELECT count(*) AS n_entities, count(*) FILTER (WHERE n_rows = n_without_id) AS n_without_id,
        {rat('count(*) FILTER (WHERE n_rows = n_without_id)', 'count(*)')} AS share_without_id FROM counts""",
)
def _(t: Views) -> DataFrame:
    return text.id_coverage(pages_with_id(t), ["host"], "extracted_id")


@query(
    "t04_without_id_details",
    f"WITH {ID_SQL}, {COUNTS_SQL} SELECT page_id, url, host FROM pages_id WHERE host IN (SELECT host FROM counts WHERE n_rows = n_without_id)",
)
def _(t: Views) -> DataFrame:
    return text.without_id_details(pages_with_id(t), ["host"], "extracted_id").select("page_id", "url", "host")


@query(
    "t05_split_token",
    "SELECT page_id, string_split_regex(url, '[/?]')[5] AS page_number, string_split_regex(url, '[/?]')[6] AS rest FROM pages",
)
def _(t: Views) -> DataFrame:
    first = text.split_token(t.pages, "url", "[/?]", 4, "page_number")
    return text.split_token(first, "url", "[/?]", 5, "rest").select("page_id", "page_number", "rest")


@query("t06_token_count", "SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_tokens FROM documents")
def _(t: Views) -> DataFrame:
    return text.token_count(t.documents, "text", " ").select("doc_id", "n_tokens")


@query(
    "t07_join_on_token",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer
       WHERE CAST(c_custkey AS VARCHAR) IN (SELECT regexp_extract(props, '.*": ([0-9]+)', 1) FROM events)""",
)
def _(t: Views) -> DataFrame:
    names = text.extract_id(t.events, ["props"], ['": '], out="token")
    return text.join_on_token(names, "token", t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")


@query("t08_year_of", f"SELECT o_orderkey, {yr('o_orderdate')} AS year, {yr('o_orderdate')} AS text_year FROM orders")
def _(t: Views) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyyMMdd").alias("o_datetext"))
    return text.year_of(text.year_of(orders, "o_orderdate"), "o_datetext", "text_year").drop("o_orderdate", "o_datetext")


@query(
    "t09_date_text",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date_text FROM orders""",
)
def _(t: Views) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return t.orders.select("o_orderkey", date_text(raw, "yyyyMMdd", "dd/MM/yyyy").alias("date_text"))


@query(
    "t10_value_alias",
    """SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'Brand#01' WHEN 'Brand#2' THEN 'Brand#02' ELSE p_brand END AS p_brand FROM part""",
)
def _(t: Views) -> DataFrame:
    return text.value_alias(t.part.select("p_partkey", "p_brand"), "p_brand", {"Brand#1": "Brand#01", "Brand#2": "Brand#02"})
