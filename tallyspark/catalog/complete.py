"""C: completeness and freshness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import complete
from ..operators.scope import in_years
from ..plans.bindings import TABLES, Views, with_views
from ..sources.tables import union_all
from .registry import big, day, query, rat, yr
from .sources import COLUMNS

LABELLED = with_views("labelled")


@query(
    "c01_row_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, count(*) = 0 AS is_empty FROM {n}" for n in TABLES),
)
def _(t: Views) -> DataFrame:
    return complete.row_counts(t.all())


NULL_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


@query(
    "c02_null_counts",
    LABELLED + "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in NULL_COLUMNS) + " FROM labelled",
)
def _(t: Views) -> DataFrame:
    return complete.null_counts(t.labelled, NULL_COLUMNS)


# Every column that the tables have; l_comment is approved but missing.
PRESENT = {"labelled": NULL_COLUMNS, **{n: [c for c, _ in s if c != "l_comment"] for n, s in COLUMNS.items()}}


@query(
    "c02_null_counts_all_tables",
    LABELLED
    + " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_nulls FROM {n}"
        for n, cs in PRESENT.items()
        for c in cs
    ),
)
def _(t: Views) -> DataFrame:
    frames = {"labelled": t.labelled, **t.all()}
    return union_all(complete.null_counts_long(df, n) for n, df in frames.items())


@query(
    "c03_null_counts_cast",
    LABELLED + "SELECT " + ", ".join(f"{big(f'sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)')} AS {c}" for c in NULL_COLUMNS) + " FROM labelled",
)
def _(t: Views) -> DataFrame:
    return complete.null_counts_cast(t.labelled, NULL_COLUMNS)


@query(
    "c04_sentinel_counts",
    """SELECT count(*) FILTER (WHERE o_orderstatus = '4-NOT SPECIFIED') AS o_orderstatus,
       count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS o_orderpriority FROM orders""",
)
def _(t: Views) -> DataFrame:
    return complete.sentinel_counts(t.orders, "4-NOT SPECIFIED")


@query(
    "c05_nullish_counts",
    """SELECT count(*) FILTER (WHERE page IS NULL OR page = '' OR contains(page, 'NULL')) AS page,
       count(*) FILTER (WHERE score IS NULL OR isnan(score)) AS score,
       count(*) FILTER (WHERE page_id IS NULL) AS page_id, count(*) FILTER (WHERE note IS NULL OR note = '' OR contains(note, 'NULL')) AS note
       FROM (SELECT page_id, regexp_extract(url, 'page=([0-9]+)', 1) AS page,
             CASE WHEN contains(url, '.html') THEN CAST('NaN' AS DOUBLE) ELSE page_id / 2 END AS score,
             CASE WHEN contains(url, 'http://') THEN 'is NULL' WHEN contains(url, '/en/') THEN url END AS note FROM pages)""",
)
def _(t: Views) -> DataFrame:
    url = F.col("url")
    pages = t.pages.select(
        "page_id",
        F.regexp_extract(url, "page=([0-9]+)", 1).alias("page"),
        F.when(url.contains(".html"), F.lit(float("nan"))).otherwise(F.col("page_id") / 2).alias("score"),
        F.when(url.contains("http://"), "is NULL").when(url.contains("/en/"), url).alias("note"),
    )
    return complete.nullish_counts(pages)


@query("c06_null_attribute", LABELLED + "SELECT DISTINCT source, lang FROM labelled WHERE quality IS NULL")
def _(t: Views) -> DataFrame:
    return complete.null_attribute(t.labelled, "quality", ["source", "lang"])


@query(
    "c07_min_distinct",
    """SELECT 'c_nationkey' AS column_name, count(DISTINCT c_nationkey) AS n_distinct, CAST(30 AS BIGINT) AS threshold
       FROM customer HAVING count(DISTINCT c_nationkey) < 30
       UNION ALL SELECT 'c_custkey', count(DISTINCT c_custkey), 30 FROM customer HAVING count(DISTINCT c_custkey) < 30""",
)
def _(t: Views) -> DataFrame:
    return union_all(complete.min_distinct(t.customer, c, 30) for c in ("c_nationkey", "c_custkey"))


@query(
    "c08_coverage_matrix",
    f"""WITH spine AS (SELECT o_custkey, CAST(year AS INTEGER) AS year FROM (SELECT DISTINCT o_custkey FROM orders),
            (SELECT unnest(range(1994, 2003)) AS year)),
         n AS (SELECT o_custkey, {yr('o_orderdate')} AS year, count(o_orderdate) AS n_rows FROM orders GROUP BY 1, 2)
       SELECT o_custkey, year, n_rows FROM spine LEFT JOIN n USING (o_custkey, year)""",
)
def _(t: Views) -> DataFrame:
    return complete.coverage_matrix(t.orders, "o_custkey", "o_orderdate", range(1994, 2003))


@query(
    "c09_calendar_gaps",
    """WITH days AS (SELECT CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS missing_day)
       SELECT user_id, missing_day FROM (SELECT DISTINCT user_id FROM events), days
       EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events""",
)
def _(t: Views) -> DataFrame:
    return complete.calendar_gaps(t.events, ["user_id"], "ts", dt.date(2023, 12, 30), dt.date(2024, 2, 2))


# Gaps of a campaign's order days over several years: days in a row that are missing fall together.
SPAN = dt.date(1994, 11, 5), dt.date(1998, 3, 17)


@query(
    "c09_calendar_gap_spans",
    f"""WITH days AS (SELECT CAST(unnest(generate_series(DATE '{SPAN[0]}', DATE '{SPAN[1]}', INTERVAL 1 DAY)) AS DATE) AS d),
            gaps AS (SELECT o_custkey, d FROM (SELECT DISTINCT o_custkey FROM orders), days EXCEPT SELECT o_custkey, CAST(o_orderdate AS DATE) FROM orders),
            runs AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY d) AS INTEGER) AS run FROM gaps)
       SELECT o_custkey, min(d) AS gap_start, max(d) AS gap_end, count(*) AS n_days FROM runs GROUP BY o_custkey, run""",
)
def _(t: Views) -> DataFrame:
    return complete.calendar_gap_spans(t.orders, ["o_custkey"], "o_orderdate", *SPAN)


@query(
    "c10_freshness",
    f"""SELECT 'lineitem' AS table_name, l_returnflag || l_linestatus AS key, min({day('l_shipdate')}) AS first_date,
            max({day('l_shipdate')}) AS last_date, count(*) AS n_rows FROM lineitem GROUP BY ALL
        UNION ALL SELECT 'orders', o_orderpriority, min({day('o_orderdate')}), max({day('o_orderdate')}), count(*) FROM orders GROUP BY ALL
        UNION ALL SELECT 'events', event_type, min({day('ts')}), max({day('ts')}), count(*) FROM events GROUP BY ALL""",
)
def _(t: Views) -> DataFrame:
    facts = {
        "lineitem": t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("key"), F.col("l_shipdate").alias("d")),
        "orders": t.orders.select(F.col("o_orderpriority").alias("key"), F.col("o_orderdate").alias("d")),
        "events": t.events.select(F.col("event_type").alias("key"), F.col("ts").alias("d")),
    }
    return union_all(complete.freshness(df, ["key"], "d").withColumn("table_name", F.lit(n)) for n, df in facts.items())


@query(
    "c11_year_bounds",
    f"SELECT o_custkey, {yr('min(o_orderdate)')} AS first_year, {yr('max(o_orderdate)')} AS last_year FROM orders GROUP BY 1",
)
def _(t: Views) -> DataFrame:
    return complete.year_bounds(t.orders, ["o_custkey"], "o_orderdate")


@query(
    "c12_missing_in_period",
    "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE year(o_orderdate) = 1997) = 0",
)
def _(t: Views) -> DataFrame:
    return complete.missing_in_period(t.orders, ["o_custkey"], in_years("o_orderdate", [1997]))


@query(
    "c13_rows_per_period",
    f"""SELECT 'orders' AS table_name, o_orderpriority AS key, {yr('o_orderdate')} AS year, count(*) AS n_rows FROM orders GROUP BY ALL
        UNION ALL SELECT 'lineitem', l_returnflag, {yr('l_shipdate')}, count(*) FROM lineitem GROUP BY ALL""",
)
def _(t: Views) -> DataFrame:
    orders = complete.rows_per_period(t.orders, ["o_orderpriority"], "o_orderdate").withColumnRenamed("o_orderpriority", "key")
    lines = complete.rows_per_period(t.lineitem, ["l_returnflag"], "l_shipdate").withColumnRenamed("l_returnflag", "key")
    return union_all([orders.withColumn("table_name", F.lit("orders")), lines.withColumn("table_name", F.lit("lineitem"))])


@query("c14_distinct_per_period", f"SELECT {day('ts')} AS day, count(DISTINCT user_id) AS n_distinct FROM events GROUP BY 1")
def _(t: Views) -> DataFrame:
    return complete.distinct_per_period(t.events, "ts", "user_id")


@query(
    "c15_unparseable",
    """SELECT page_id, last FROM (SELECT page_id, regexp_extract(url, '([^/]*)/?$', 1) AS last FROM pages)
       WHERE TRY_CAST(last AS INTEGER) IS NULL""",
)
def _(t: Views) -> DataFrame:
    pages = t.pages.select("page_id", F.regexp_extract("url", "([^/]*)/?$", 1).alias("last"))
    return complete.unparseable(pages, "last", "int", ["page_id"])


@query(
    "c16_presence_share",
    LABELLED
    + f"""SELECT source, lang, count(*) AS n_rows, count(*) FILTER (WHERE quality IS NULL) AS n_missing,
          {rat('count(*) FILTER (WHERE quality IS NULL)', 'count(*)')} AS missing_share FROM labelled GROUP BY 1, 2""",
)
def _(t: Views) -> DataFrame:
    return complete.presence_share(t.labelled, ["source", "lang"], "quality")
