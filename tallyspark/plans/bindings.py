"""Campaign views over the given tables, as DataFrames and as the same SQL.

``delivery`` needs order lines only; ``perf`` adds the campaign through the order; ``perf_country`` also the
country. Queries take the narrowest view, so that no join is run for columns nobody reads. Joins carry no
broadcast hint: small dims are broadcast by their measured file size, large ones are shuffled.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import MONEY
from ..operators.kpi import sum_by
from ..operators.reconcile import fiscal_calendar

# The given tables.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

MEASURES = ("spend_usd", "spend_lc", "impressions", "clicks", "views", "fully_played")
QUARTILES = ("video_25", "video_50", "video_75")


class Views:
    """The tables of one folder and the views built on them, read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._tables = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def all(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLES}

    @cached_property
    def delivery(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "l_orderkey AS plan_line_id",
            "l_partkey AS product_id",
            "l_suppkey AS channel_id",
            "l_linenumber AS creative_id",
            "CAST(l_shipdate AS DATE) AS date",
            f"CAST(l_extendedprice AS {MONEY}) AS spend_usd",
            f"CAST(l_extendedprice * (1 + l_tax) AS {MONEY}) AS spend_lc",
            "CAST(l_quantity * 1000 AS BIGINT) AS impressions",
            "CAST(l_quantity * (1 + l_suppkey % 4) AS BIGINT) AS clicks",
            "CAST(l_quantity * (60 + l_partkey % 50) AS BIGINT) AS views",
            "CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity * 10 END AS BIGINT) AS fully_played",
            "CAST(l_quantity * (40 + l_partkey % 20) AS BIGINT) AS video_25",
            "CAST(l_quantity * (25 + l_suppkey % 15) AS BIGINT) AS video_50",
            "CAST(l_quantity * (10 + l_linenumber % 15) AS BIGINT) AS video_75",
            "l_discount AS score",
            "l_linestatus AS status",
            "l_returnflag AS tier",
        )

    @cached_property
    def perf(self) -> DataFrame:
        campaign = self.orders.selectExpr(
            "o_orderkey AS plan_line_id", "o_custkey AS campaign_id", "CAST(o_orderdate AS DATE) AS campaign_start_date"
        )
        return self.delivery.join(campaign, "plan_line_id")

    @cached_property
    def campaigns(self) -> DataFrame:
        return self.customer.selectExpr(
            "c_custkey AS campaign_id", "c_name AS campaign_desc", "c_nationkey AS country_id", "c_mktsegment AS segment"
        )

    @cached_property
    def countries(self) -> DataFrame:
        named = self.nation.join(self.region, F.expr("n_regionkey = r_regionkey"))
        return named.selectExpr("n_nationkey AS country_id", "n_name AS country_desc", "r_name AS region_desc")

    @cached_property
    def products(self) -> DataFrame:
        return self.part.selectExpr("p_partkey AS product_id", "p_brand AS brand", "p_type AS product_type", "p_name AS product")

    @cached_property
    def channels(self) -> DataFrame:
        return self.supplier.selectExpr("s_suppkey AS channel_id", "s_name AS channel_desc", "s_nationkey AS channel_country")

    @cached_property
    def country_dim(self) -> DataFrame:
        """campaign_id -> country_id."""
        return self.customer.selectExpr("c_custkey AS campaign_id", "c_nationkey AS country_id")

    @cached_property
    def brand_dim(self) -> DataFrame:
        """product_id -> brand."""
        return self.part.selectExpr("p_partkey AS product_id", "p_brand AS brand")

    @cached_property
    def spend_year(self) -> DataFrame:
        """Spend per country, campaign and year."""
        yearly = self.perf.selectExpr("campaign_id", "year(date) AS year", "spend_usd", "spend_lc")
        return sum_by(yearly, ["campaign_id", "year"], ["spend_usd", "spend_lc"]).join(self.country_dim, "campaign_id")

    @cached_property
    def perf_country(self) -> DataFrame:
        return self.perf.join(self.country_dim, "campaign_id")

    @cached_property
    def planned(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_orderkey AS plan_line_id",
            "o_custkey AS campaign_id",
            f"CAST(o_totalprice AS {MONEY}) AS budget_usd",
            f"CAST(o_totalprice * 1.1D AS {MONEY}) AS budget_lc",
            "CAST(o_orderdate AS DATE) AS plan_start",
            "date_add(CAST(o_orderdate AS DATE), 30) AS plan_end",
            "o_orderpriority AS priority",
        )

    @cached_property
    def planned_country(self) -> DataFrame:
        return self.planned.join(self.country_dim, "campaign_id")

    @cached_property
    def reach(self) -> DataFrame:
        return self.events.selectExpr(
            "user_id AS campaign_id", "event_type AS platform", "CAST(ts AS DATE) AS date", f"CAST(value AS {MONEY}) AS value", "event_id"
        )

    @cached_property
    def calendar(self) -> DataFrame:
        """Days from the first to the last date that a delivery or a plan line has."""
        dates = self.lineitem.selectExpr("CAST(l_shipdate AS DATE) AS date").union(self.orders.selectExpr("CAST(o_orderdate AS DATE)"))
        return fiscal_calendar(dates, "date")

    @cached_property
    def labelled(self) -> DataFrame:
        """Documents with their label, null where there is none."""
        return self.documents.join(self.labels, "doc_id", "left")


# The same views as SQL, to be put behind WITH.
SQL: dict[str, str] = {
    "delivery": """delivery AS (SELECT l_orderkey AS plan_line_id, l_partkey AS product_id, l_suppkey AS channel_id,
        l_linenumber AS creative_id, CAST(l_shipdate AS DATE) AS date, CAST(l_extendedprice AS DECIMAL(18,4)) AS spend_usd,
        CAST(l_extendedprice * (1 + l_tax) AS DECIMAL(18,4)) AS spend_lc, CAST(l_quantity * 1000 AS BIGINT) AS impressions,
        CAST(l_quantity * (1 + l_suppkey % 4) AS BIGINT) AS clicks, CAST(l_quantity * (60 + l_partkey % 50) AS BIGINT) AS views,
        CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity * 10 END AS BIGINT) AS fully_played,
        CAST(l_quantity * (40 + l_partkey % 20) AS BIGINT) AS video_25, CAST(l_quantity * (25 + l_suppkey % 15) AS BIGINT) AS video_50,
        CAST(l_quantity * (10 + l_linenumber % 15) AS BIGINT) AS video_75, l_discount AS score, l_linestatus AS status, l_returnflag AS tier
        FROM lineitem)""",
    "perf": """perf AS (SELECT d.*, o_custkey AS campaign_id, CAST(o_orderdate AS DATE) AS campaign_start_date
        FROM delivery d JOIN orders ON plan_line_id = o_orderkey)""",
    "campaigns": """campaigns AS (SELECT c_custkey AS campaign_id, c_name AS campaign_desc, c_nationkey AS country_id,
        c_mktsegment AS segment FROM customer)""",
    "countries": """countries AS (SELECT n_nationkey AS country_id, n_name AS country_desc, r_name AS region_desc
        FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "products": """products AS (SELECT p_partkey AS product_id, p_brand AS brand, p_type AS product_type, p_name AS product
        FROM part)""",
    "channels": """channels AS (SELECT s_suppkey AS channel_id, s_name AS channel_desc, s_nationkey AS channel_country
        FROM supplier)""",
    "perf_country": """perf_country AS (SELECT p.*, c_nationkey AS country_id FROM perf p JOIN customer ON campaign_id = c_custkey)""",
    "planned": """planned AS (SELECT o_orderkey AS plan_line_id, o_custkey AS campaign_id,
        CAST(o_totalprice AS DECIMAL(18,4)) AS budget_usd, CAST(o_totalprice * 1.1 AS DECIMAL(18,4)) AS budget_lc,
        CAST(o_orderdate AS DATE) AS plan_start, CAST(o_orderdate AS DATE) + 30 AS plan_end, o_orderpriority AS priority
        FROM orders)""",
    "planned_country": """planned_country AS (SELECT p.*, c_nationkey AS country_id FROM planned p
        JOIN customer ON campaign_id = c_custkey)""",
    "reach": """reach AS (SELECT user_id AS campaign_id, event_type AS platform, CAST(ts AS DATE) AS date,
        CAST(value AS DECIMAL(18,4)) AS value, event_id FROM events)""",
    "days": """days AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS calendar_date
        FROM (SELECT date_trunc('day', l_shipdate) AS d FROM lineitem UNION ALL SELECT date_trunc('day', o_orderdate) FROM orders))""",
    "calendar": """calendar AS (SELECT calendar_date, CAST(year(calendar_date) AS INTEGER) AS cal_year,
        CAST(weekofyear(calendar_date) AS INTEGER) AS cal_week_of_year,
        'P' || lpad(CAST(least(13, CAST(floor((dayofyear(calendar_date) - 1) / 28) AS INTEGER) + 1) AS VARCHAR), 2, '0')
        AS fiscal_period FROM days)""",
    "labelled": "labelled AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
}

_NEEDS = {
    "perf": ["delivery"], "perf_country": ["perf"], "planned_country": ["planned"], "calendar": ["days"],
}


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views and those they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n"
