"""O: the check suite over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import last_number_after, money, ratio
from ..operators import complete, keys, kpi, naming, reconcile, refs, rules, text
from ..operators.scope import filter_years
from ..plans.bindings import Views
from ..plans.suite import BREAKING, DATA_ISSUE, FAILED, Check, Suite, Tables
from ..sources.scratch import scratch_path
from ..sources.tables import union_all
from .registry import dbl, query


def _orphans(fact: str, key: str, dim: str, dim_key: str):
    def frame(tables: Tables) -> DataFrame:
        return refs.orphans(tables[fact], tables[dim].withColumnRenamed(dim_key, key), [key])

    return frame


def _overspent(tables: Tables) -> DataFrame:
    spent = tables["lineitem"].select(F.col("l_orderkey").alias("line"), money("l_extendedprice").alias("spent"))
    planned = tables["orders"].select(F.col("o_orderkey").alias("line"), money("o_totalprice").alias("budget"))
    return reconcile.compare_sums(spent, planned, ["line"], {"share": ("spent", "budget")}).filter("spent > budget")


def _underspent(tables: Tables) -> DataFrame:
    """Campaigns whose lines cost less than half of the budgets of the plans that have lines."""
    spent = tables["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).alias("spent"))
    both = tables["orders"].select("o_orderkey", "o_custkey", money("o_totalprice").alias("budget")).join(spent, "o_orderkey")
    return kpi.sum_by(both, ["o_custkey"], ["spent", "budget"]).withColumn("share", ratio("spent", "budget")).filter("share < 0.5")


def _measured_lines(tables: Tables) -> DataFrame:
    return tables["lineitem"].selectExpr(
        "l_suppkey AS channel", "CAST(l_quantity * (1 + l_suppkey % 4) AS BIGINT) AS clicks", "CAST(l_quantity * 1000 AS BIGINT) AS impressions"
    )


def _yearly(tables: Tables, year: int) -> DataFrame:
    lines = filter_years(tables["lineitem"], "l_shipdate", [year])
    return lines.select(F.col("l_suppkey").alias("channel"), money("l_extendedprice").alias("spent"))


# id, domain, severity, table, condition (used as it is by Spark and DuckDB)
RULES = [
    ("discount_range", "performance", DATA_ISSUE, "lineitem", "NOT (l_discount BETWEEN 0 AND 0.08)"),
    ("tax_zero_discount_not", "performance", DATA_ISSUE, "lineitem", "l_tax = 0 AND l_discount <> 0"),
    ("quantity_negative", "performance", BREAKING, "lineitem", "l_quantity < 0"),
    ("ship_date_missing", "performance", BREAKING, "lineitem", "l_shipdate IS NULL"),
    ("priority_accepted", "plan", DATA_ISSUE, "orders", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')"),
    ("price_positive", "plan", BREAKING, "orders", "o_totalprice <= 0"),
    ("balance_negative", "campaign", DATA_ISSUE, "customer", "c_acctbal < 0"),
    ("name_missing", "campaign", BREAKING, "customer", "c_name IS NULL OR c_name = ''"),
    ("event_value_zero", "reach", DATA_ISSUE, "events", "value = 0"),
    ("line_price_missing", "performance", BREAKING, "lineitem", "l_extendedprice IS NULL OR l_extendedprice <= 0"),
    ("line_status_accepted", "performance", DATA_ISSUE, "lineitem", "l_linestatus IS NULL OR l_linestatus NOT IN ('F', 'O')"),
    ("ship_date_in_bounds", "performance", DATA_ISSUE, "lineitem", "l_shipdate < DATE '1992-01-01' OR l_shipdate >= DATE '2000-01-01'"),
    ("budget_missing", "investment", BREAKING, "orders", "o_totalprice IS NULL"),
    ("budget_too_high", "investment", DATA_ISSUE, "orders", "o_totalprice > 400000"),
    ("plan_status_accepted", "investment", DATA_ISSUE, "orders", "o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')"),
    ("plan_date_missing", "investment", BREAKING, "orders", "o_orderdate IS NULL"),
    ("plan_date_in_bounds", "investment", DATA_ISSUE, "orders", "o_orderdate < DATE '1992-06-01' OR o_orderdate >= DATE '1999-01-01'"),
    ("country_missing", "campaign", BREAKING, "customer", "c_nationkey IS NULL"),
    ("segment_accepted", "campaign", DATA_ISSUE, "customer", "c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY')"),
    ("event_time_missing", "reach", BREAKING, "events", "ts IS NULL"),
    ("event_type_accepted", "reach", DATA_ISSUE, "events", "event_type IS NULL OR event_type = 'error'"),
    ("event_value_range", "reach", DATA_ISSUE, "events", "NOT (value BETWEEN 0 AND 100)"),
    ("text_missing", "content", BREAKING, "documents", "text IS NULL OR text = ''"),
    ("language_accepted", "content", DATA_ISSUE, "documents", "lang IS NULL OR lang NOT IN ('en', 'fr', 'de')"),
    ("part_size_range", "naming", DATA_ISSUE, "part", "NOT (p_size BETWEEN 1 AND 45)"),
    ("brand_pattern", "naming", DATA_ISSUE, "part", "p_brand IS NULL OR p_brand NOT LIKE 'Brand#%'"),
    ("url_missing", "creative", BREAKING, "pages", "url IS NULL OR url = ''"),
    ("url_secure", "creative", DATA_ISSUE, "pages", "url NOT LIKE 'https://%'"),
    ("html_missing", "creative", BREAKING, "pages", "html IS NULL OR html = ''"),
]

# id, domain, severity, table, violations, SQL count of the violations
FRAMES = [
    (
        "line_key_unique", "performance", BREAKING, "lineitem",
        lambda t: keys.duplicate_key_counts(t["lineitem"], ["l_orderkey", "l_linenumber"]),
        "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    ),
    (
        "line_part_known", "performance", BREAKING, "lineitem", _orphans("lineitem", "l_partkey", "part", "p_partkey"),
        "SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)",
    ),
    (
        "order_has_lines", "plan", BREAKING, "orders", _orphans("orders", "o_orderkey", "lineitem", "l_orderkey"),
        "SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    ),
    (
        "order_key_unique", "plan", BREAKING, "orders", lambda t: keys.duplicate_key_counts(t["orders"], ["o_orderkey"]),
        "SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)",
    ),
    (
        "one_priority_per_campaign", "plan", DATA_ISSUE, "orders",
        lambda t: keys.functional_dependency(t["orders"], ["o_custkey"], ["o_orderpriority"]),
        "SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1)",
    ),
    (
        "enough_countries", "campaign", DATA_ISSUE, "customer", lambda t: complete.min_distinct(t["customer"], "c_nationkey", 30),
        "SELECT count(*) FROM (SELECT 1 FROM customer HAVING count(DISTINCT c_nationkey) < 30)",
    ),
    (
        "document_labelled", "content", DATA_ISSUE, "documents", _orphans("documents", "doc_id", "labels", "doc_id"),
        "SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    (
        "plan_line_overspent", "investment", DATA_ISSUE, "orders", _overspent,
        """SELECT count(*) FROM (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS s FROM lineitem GROUP BY 1)
           JOIN orders ON l_orderkey = o_orderkey WHERE s > CAST(o_totalprice AS DECIMAL(18,4))""",
    ),
    (
        "budget_per_campaign", "investment", BREAKING, "orders",
        lambda t: kpi.sum_by(t["orders"].withColumn("budget", money("o_totalprice")), ["o_custkey"], ["budget"]).filter("budget <= 0"),
        "SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING sum(CAST(o_totalprice AS DECIMAL(18,4))) <= 0)",
    ),
    (
        "part_name_tokens", "naming", DATA_ISSUE, "part",
        lambda t: naming.compliance_flag(t["part"], {"p_type": ["ECONOMY", "STANDARD"]}, "part", ["p_type"]).filter("calculated_flag = 1"),
        "SELECT count(*) FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD')",
    ),
    (
        "ctr_too_low", "performance", DATA_ISSUE, "lineitem",
        lambda t: kpi.kpi_rollup(_measured_lines(t), ["channel"], ["ctr"]).filter("ctr < 0.25"),
        """SELECT count(*) FROM (SELECT sum(CAST(l_quantity * (1 + l_suppkey % 4) AS BIGINT)) AS clicks, sum(CAST(l_quantity * 1000 AS BIGINT)) AS shown
           FROM lineitem GROUP BY l_suppkey) WHERE CAST(100 AS DOUBLE) * clicks / nullif(shown, 0) < 0.25""",
    ),
    (
        "spend_per_channel_year", "performance", DATA_ISSUE, "lineitem",
        lambda t: reconcile.compare_sums(_yearly(t, 1997), _yearly(t, 1998), ["channel"], {"change": ("spent", "spent")}, "full").filter("change IS NULL OR change > 1.2"),
        """SELECT count(*) FROM (SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS a FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1) x
           FULL JOIN (SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS b FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY 1) y USING (l_suppkey)
           WHERE a IS NULL OR b IS NULL OR b = 0 OR CAST(a AS DOUBLE) / CAST(b AS DOUBLE) > 1.2""",
    ),
    (
        "spend_without_plan", "investment", BREAKING, "lineitem", _orphans("lineitem", "l_orderkey", "orders", "o_orderkey"),
        "SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    ),
    (
        "campaign_underspent", "investment", DATA_ISSUE, "orders", _underspent,
        """SELECT count(*) FROM (SELECT o_custkey, sum(s) AS s, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS b FROM orders JOIN
           (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1)
           WHERE CAST(s AS DOUBLE) / CAST(b AS DOUBLE) < 0.5""",
    ),
    (
        "budget_without_country", "investment", BREAKING, "orders", _orphans("orders", "o_custkey", "customer", "c_custkey"),
        "SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    ),
    (
        "event_key_unique", "reach", BREAKING, "events", lambda t: keys.duplicate_key_counts(t["events"], ["event_id"]),
        "SELECT count(*) FROM (SELECT 1 FROM events GROUP BY event_id HAVING count(*) > 1)",
    ),
    (
        "document_key_unique", "content", BREAKING, "documents", lambda t: keys.duplicate_key_counts(t["documents"], ["doc_id"]),
        "SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY doc_id HAVING count(*) > 1)",
    ),
    (
        "part_brand_codes", "naming", DATA_ISSUE, "part",
        lambda t: naming.compliance_flag(t["part"], {"p_brand": ["brand1", "brand 2", "BRAND#3"]}, "part", ["p_brand"], "alnum_lower").filter("calculated_flag = 1"),
        "SELECT count(*) FROM part WHERE coalesce(lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), '') NOT IN ('brand1', 'brand2', 'brand3')",
    ),
    (
        "part_name_length", "naming", DATA_ISSUE, "part", lambda t: text.token_count(t["part"], "p_name", " ").filter("n_tokens <> 2"),
        "SELECT count(*) FROM part WHERE len(string_split(p_name, ' ')) <> 2",
    ),
    (
        "page_key_unique", "creative", BREAKING, "pages", lambda t: keys.duplicate_key_counts(t["pages"], ["page_id"]),
        "SELECT count(*) FROM (SELECT 1 FROM pages GROUP BY page_id HAVING count(*) > 1)",
    ),
    (
        "page_has_number", "creative", DATA_ISSUE, "pages",
        lambda t: t["pages"].filter(last_number_after("url", "/").isNull()),
        "SELECT count(*) FROM pages WHERE NOT regexp_matches(coalesce(url, ''), '/[0-9]')",
    ),
    (
        "label_quality_set", "content", BREAKING, "labels", lambda t: rules.not_in_set(t["labels"], "quality", [0, 1], nulls="fail"),
        "SELECT count(*) FROM labels WHERE quality IS NULL OR quality NOT IN (0, 1)",
    ),
]


def _rule(text: str):
    return lambda: F.expr(text)


CHECKS = [Check(i, d, s, t, rule=_rule(c)) for i, d, s, t, c in RULES] + [
    Check(i, d, s, t, frame=f) for i, d, s, t, f, _ in FRAMES
]


def _suite_sql() -> str:
    counted = [(i, d, s, t, f"SELECT count(*) FROM {t} WHERE {c}") for i, d, s, t, c in RULES] + [
        (i, d, s, t, sql) for i, d, s, t, _, sql in FRAMES
    ]
    rows = " UNION ALL ".join(
        f"""SELECT CAST({n} AS INTEGER) AS number, '{i}' AS check_id, '{d}' AS domain, '{s}' AS severity, '{t}' AS table_name, ({sql}) AS violations,
            (SELECT count(*) FROM {t}) AS base_rows"""
        for n, (i, d, s, t, sql) in enumerate(counted, 1)
    )
    return f"""suite AS (SELECT *, {dbl('CAST(violations AS DOUBLE) / nullif(base_rows, 0)')} AS share, violations = 0 AS passed FROM ({rows}))"""


@query("o01_suite_run", f"WITH {_suite_sql()} SELECT * FROM suite")
def _(t: Views) -> DataFrame:
    return Suite(CHECKS).run(t.all())


@query("o01_suite_written", f"WITH {_suite_sql()} SELECT *, violations AS written FROM suite")
def _(t: Views) -> DataFrame:
    """The summary, next to the violations that were written for each check."""
    path = scratch_path(t.spark, "violations")
    suite = Suite(CHECKS)
    summary = suite.write(t.all(), path)
    rows = [t.spark.read.parquet(f"{path}/rows/{table}").select(F.explode(FAILED).alias("check_id")) for table in dict.fromkeys(c.table for c in CHECKS if c.rule)]
    rows += [t.spark.read.parquet(f"{path}/checks/{c.check_id}").select(F.lit(c.check_id).alias("check_id")) for c in CHECKS if c.frame]
    written = union_all(rows).groupBy("check_id").agg(F.count(F.lit(1)).alias("written"))
    return summary.join(written, "check_id", "left").fillna(0, subset=["written"])


def _domain(domain: str) -> None:
    columns = "check_id, domain, severity, table_name, violations, base_rows, share, passed"
    number = "CAST(row_number() OVER (ORDER BY number) AS INTEGER) AS number"

    @query(f"o01_suite_{domain}", f"WITH {_suite_sql()} SELECT {number}, {columns} FROM suite WHERE domain = '{domain}'")
    def _(t: Views) -> DataFrame:
        return Suite(CHECKS).of(domain).run(t.all())


for _name in dict.fromkeys(c.domain for c in CHECKS):
    _domain(_name)


@query(
    "o03_severity",
    f"""WITH {_suite_sql()} SELECT severity, domain, count(*) AS n_checks, count(*) FILTER (WHERE NOT passed) AS n_failed,
        CAST(sum(violations) AS BIGINT) AS violations FROM suite GROUP BY 1, 2""",
)
def _(t: Views) -> DataFrame:
    return (
        Suite(CHECKS).run(t.all())
        .groupBy("severity", "domain")
        .agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"), F.sum("violations").alias("violations"))
    )
