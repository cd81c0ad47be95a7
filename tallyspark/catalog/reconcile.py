"""X: reconciliation, ratios, spreading, windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money
from ..operators import reconcile as rec
from ..operators.kpi import sum_by, sum_through
from ..operators.scope import filter_years
from ..plans.bindings import Views, with_views
from ..sources import extracts
from ..sources.scratch import scratch_path, tasks_for
from .registry import big, counts, day, dbl, query, rat, raw_ratio, rounded, sums, yr
from .sources import write_with_preamble


def with_year(df: DataFrame, date: str) -> DataFrame:
    return df.withColumn("year", F.year(date))


def _plan_actual(grain: str, plan_year: str = "plan_start") -> str:
    """CTEs p (distinct plan lines summed) and a (actual sums) at a grain that may contain ``year``."""
    return f"""{with_views('perf_country', 'planned_country')},
        p AS (SELECT {grain}, sum(budget_usd) AS budget_usd, sum(budget_lc) AS budget_lc FROM
              (SELECT DISTINCT {grain}, plan_line_id, budget_usd, budget_lc FROM
               (SELECT *, {yr(plan_year)} AS year FROM planned_country)) GROUP BY ALL),
        a AS (SELECT {grain}, sum(spend_usd) AS spend_usd, sum(spend_lc) AS spend_lc FROM
              (SELECT *, {yr('date')} AS year FROM perf_country) GROUP BY ALL)"""


AMOUNTS = ", ".join(f"{dbl(c)} AS {c}" for c in ("spend_usd", "spend_lc", "budget_usd", "budget_lc"))
FX = f"""{AMOUNTS}, {rat('spend_lc', 'spend_usd')} AS actual_ratio, {rat('budget_lc', 'budget_usd')} AS planned_ratio,
    {dbl(f"({raw_ratio('budget_lc', 'budget_usd')}) / nullif({raw_ratio('spend_lc', 'spend_usd')}, 0)")} AS ratio"""


def fx_ratios(t: Views, grain: list[str]) -> DataFrame:
    return rec.fx_ratio_consistency(with_year(t.planned_country, "plan_start"), t.spend_year, grain)


@query("x01_fx_ratio_country", f"{_plan_actual('country_id')} SELECT country_id, {FX} FROM a JOIN p USING (country_id)")
def _(t: Views) -> DataFrame:
    return fx_ratios(t, ["country_id"])


@query("x01_fx_ratio_country_year", f"{_plan_actual('country_id, year')} SELECT country_id, year, {FX} FROM a JOIN p USING (country_id, year)")
def _(t: Views) -> DataFrame:
    return fx_ratios(t, ["country_id", "year"])


@query(
    "x02_fx_vs_reference",
    f"""{_plan_actual('country_id')}, fx AS (SELECT n_nationkey AS country_id, 1 + CAST(n_nationkey AS DOUBLE) / 100 AS latest_value
        FROM nation WHERE n_regionkey <> 3)
        SELECT country_id, {FX}, {dbl('latest_value')} AS latest_value,
        {dbl(f"({raw_ratio('spend_lc', 'spend_usd')}) / nullif(latest_value, 0)")} AS vs_reference
        FROM a JOIN p USING (country_id) LEFT JOIN fx USING (country_id)""",
)
def _(t: Views) -> DataFrame:
    rates = t.nation.filter("n_regionkey <> 3").select(
        F.col("n_nationkey").alias("country_id"), (1 + F.col("n_nationkey").cast("double") / 100).alias("latest_value")
    )
    return rec.fx_vs_reference(fx_ratios(t, ["country_id"]), rates, "country_id")


CAMPAIGN_YEAR = "country_id, year, campaign_id"
VARIANCE = f"{rat('spend_usd', 'budget_usd', 100)} AS variance_usd, {rat('spend_lc', 'budget_lc', 100)} AS variance_lc"
OUTLIER = f"({raw_ratio('spend_lc', 'budget_lc', 100)} > 110 OR {raw_ratio('spend_lc', 'budget_lc', 100)} < 30)"


def variance_inputs(t: Views) -> tuple[DataFrame, DataFrame, list[str]]:
    return with_year(t.planned_country, "plan_start"), t.spend_year, CAMPAIGN_YEAR.split(", ")


@query(
    "x03_plan_vs_actual_outliers",
    f"{_plan_actual(CAMPAIGN_YEAR)} SELECT {CAMPAIGN_YEAR}, {AMOUNTS}, {VARIANCE} FROM a JOIN p USING ({CAMPAIGN_YEAR}) WHERE {OUTLIER}",
)
def _(t: Views) -> DataFrame:
    return rec.plan_vs_actual_outliers(*variance_inputs(t))


CHANNEL = "country_id, year, channel_id, campaign_id"


@query(
    "x03_plan_vs_actual_channel",
    f"""{with_views('perf_country', 'planned_country')}, lines AS (SELECT DISTINCT plan_line_id, channel_id FROM delivery),
        p AS (SELECT {CHANNEL}, sum(budget_usd) AS budget_usd, sum(budget_lc) AS budget_lc FROM
              (SELECT *, {yr('plan_start')} AS year FROM planned_country JOIN lines USING (plan_line_id)) GROUP BY ALL),
        a AS (SELECT {CHANNEL}, sum(spend_usd) AS spend_usd, sum(spend_lc) AS spend_lc FROM
              (SELECT *, {yr('date')} AS year FROM perf_country) GROUP BY ALL)
        SELECT {CHANNEL}, {AMOUNTS}, {VARIANCE} FROM a JOIN p USING ({CHANNEL})""",
)
def _(t: Views) -> DataFrame:
    # A plan line counts once for each channel that its lines have. Groups are nearly as many as the lines.
    tasks = tasks_for(t.lineitem)
    lines = with_year(t.delivery, "date").select("plan_line_id", "channel_id", "year", *rec.SPENDS).repartition(tasks, "plan_line_id")
    channels = lines.select("plan_line_id", "channel_id").distinct()
    plan = with_year(t.planned_country, "plan_start").join(channels, "plan_line_id")
    spent = lines.join(t.planned.select("plan_line_id", "campaign_id"), "plan_line_id").repartition(tasks, "campaign_id")
    actual = sum_by(spent, ["campaign_id", "year", "channel_id"], rec.SPENDS).join(t.country_dim, "campaign_id")
    return rec.plan_vs_actual(plan, actual, CHANNEL.split(", "), tasks)


@query(
    "o02_violation_share",
    f"""{_plan_actual(CAMPAIGN_YEAR)} SELECT count(*) FILTER (WHERE {OUTLIER}) AS violations, count(*) AS base_rows,
        {rat(f'count(*) FILTER (WHERE {OUTLIER})', 'count(*)')} AS share FROM a JOIN p USING ({CAMPAIGN_YEAR})""",
)
def _(t: Views) -> DataFrame:
    return rec.violation_share(rec.plan_vs_actual(*variance_inputs(t)), rec.is_outlier())


@query(
    "x04_relative_variance",
    f"""{with_views('delivery')}, s AS (SELECT {yr('date')} AS year, status, sum(spend_lc) AS spend_lc, sum(spend_usd) AS spend_usd FROM delivery GROUP BY ALL)
        SELECT year, status, {dbl('spend_lc')} AS spend_lc, {dbl('spend_usd')} AS spend_usd,
        {rat('spend_lc - spend_usd', 'spend_usd', 100)} AS variance_pct FROM s""",
)
def _(t: Views) -> DataFrame:
    per_year = sum_by(with_year(t.delivery, "date"), ["year", "status"], ["spend_lc", "spend_usd"])
    return rec.relative_variance(per_year, "spend_lc", "spend_usd")


def _sides(grain: str) -> str:
    return f"""{with_views('perf_country', 'planned_country')},
        p AS (SELECT {grain}, sum(budget_usd) AS budget_usd, sum(budget_lc) AS budget_lc FROM
              (SELECT *, {yr('plan_start')} AS year FROM planned_country) GROUP BY ALL),
        a AS (SELECT {grain}, sum(spend_usd) AS spend_usd, sum(spend_lc) AS spend_lc FROM
              (SELECT *, {yr('date')} AS year FROM perf_country) GROUP BY ALL)"""


@query("x05_yearly_sides", f"{_sides('country_id, year')} SELECT country_id, year, {AMOUNTS} FROM a LEFT JOIN p USING (country_id, year)")
def _(t: Views) -> DataFrame:
    return rec.yearly_sides(with_year(t.planned_country, "plan_start"), t.spend_year, ["country_id", "year"])


@query(
    "x05_zero_by_year",
    f"""{_sides('campaign_id, year')} SELECT campaign_id, year, {AMOUNTS} FROM a LEFT JOIN p USING (campaign_id, year)
        WHERE coalesce(spend_usd, 0) = 0 OR coalesce(spend_lc, 0) = 0 OR coalesce(budget_usd, 0) = 0 OR coalesce(budget_lc, 0) = 0""",
)
def _(t: Views) -> DataFrame:
    return rec.yearly_sides(with_year(t.planned, "plan_start"), t.spend_year, ["campaign_id", "year"], only_zero=True)


@query(
    "x06_recompute_ratio",
    f"""{with_views('perf', 'reach')}, b AS (SELECT r.campaign_id, platform, impressions, reach,
            round({raw_ratio('impressions', 'reach')}, 1) AS frequency,
            round({raw_ratio('impressions', 'reach')}, 2) AS recomputed
          FROM (SELECT campaign_id, platform, sum(value) AS reach FROM reach GROUP BY ALL) r
          JOIN (SELECT campaign_id, sum(impressions) AS impressions FROM perf GROUP BY ALL) USING (campaign_id))
        SELECT campaign_id, platform, {big('impressions')} AS impressions, {dbl('reach')} AS reach, {dbl('frequency')} AS frequency,
          {dbl('recomputed')} AS recomputed, {dbl('round(recomputed - round(frequency, 2), 2)')} AS difference
        FROM b WHERE round(recomputed - round(frequency, 2), 2) <> 0""",
)
def _(t: Views) -> DataFrame:
    reach = t.reach.groupBy("campaign_id", "platform").agg(F.sum("value").alias("reach"))
    both = reach.join(sum_by(t.perf, ["campaign_id"], ["impressions"]), "campaign_id")
    stored = both.withColumn("frequency", F.round(F.try_divide(F.col("impressions").cast("double"), F.col("reach").cast("double")), 1))
    return rec.recompute_ratio(stored, "impressions", "reach", "frequency")


CURRENCIES = {"usd_ratio": ("spend_usd", "budget_usd"), "lc_ratio": ("spend_lc", "budget_lc")}
CURRENCY_SQL = ", ".join(f"{rat(a, b)} AS {n}" for n, (a, b) in CURRENCIES.items())


@query("x07_actual_vs_ingoing", f"{_sides('country_id, year')} SELECT country_id, year, {AMOUNTS}, {CURRENCY_SQL} FROM a LEFT JOIN p USING (country_id, year)")
def _(t: Views) -> DataFrame:
    return rec.compare_sums(t.spend_year, with_year(t.planned_country, "plan_start"), ["country_id", "year"], CURRENCIES, "left")


@query("x08_table_vs_table_sums", f"{_sides('plan_line_id')} SELECT plan_line_id, {AMOUNTS}, {CURRENCY_SQL} FROM a JOIN p USING (plan_line_id)")
def _(t: Views) -> DataFrame:
    return rec.compare_sums(t.delivery, t.planned, ["plan_line_id"], CURRENCIES)


@query(
    "x09_ratio_of_ratios",
    f"""{with_views('delivery')}, s AS (SELECT {yr('l_shipdate')} AS year, l_returnflag,
            sum(CAST(l_extendedprice * (1 + l_tax) AS DECIMAL(18,4))) AS total_lc, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS total_usd,
            sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS rate_lc FROM lineitem GROUP BY ALL)
        SELECT year, l_returnflag, {rat('total_lc', 'total_usd')} AS total_ratio, {rat('rate_lc', 'total_usd')} AS rate_ratio,
        {dbl(f"({raw_ratio('total_lc', 'total_usd')}) / nullif({raw_ratio('rate_lc', 'total_usd')}, 0)")} AS ratio FROM s""",
)
def _(t: Views) -> DataFrame:
    price = F.col("l_extendedprice")
    df = t.lineitem.select(
        F.year("l_shipdate").alias("year"), "l_returnflag", money(price * (1 + F.col("l_tax"))).alias("total_lc"), money(price).alias("total_usd"),
        money(price * (1 - F.col("l_discount"))).alias("rate_lc"), money(price).alias("rate_usd"),
    )
    return rec.ratio_of_ratios(df, ["year", "l_returnflag"], ("total_lc", "total_usd"), ("rate_lc", "rate_usd"))


@query(
    "x10_sums_by_grain",
    f"""SELECT o_custkey, {dbl('sum(CAST(o_totalprice AS DECIMAL(18,4)))')} AS sum_total, CAST(min(o_orderdate) AS DATE) AS first_date,
        CAST(max(o_orderdate) AS DATE) AS last_date, count(*) AS n_rows FROM orders GROUP BY 1""",
)
def _(t: Views) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderdate", money("o_totalprice").alias("total"))
    return rec.sums_by_grain(orders, ["o_custkey"], ["total"], "o_orderdate")


@query(
    "x11_cross_domain_compare",
    f"""{with_views('perf', 'planned', 'campaigns', 'calendar')},
        a AS (SELECT segment, cal_year, fiscal_period, sum(spend_usd) AS spend_usd FROM perf JOIN campaigns USING (campaign_id)
              JOIN calendar ON date = calendar_date GROUP BY ALL),
        b AS (SELECT segment, cal_year, fiscal_period, sum(budget_usd) AS budget_usd FROM planned JOIN campaigns USING (campaign_id)
              JOIN calendar ON plan_start = calendar_date GROUP BY ALL)
        SELECT segment, cal_year, fiscal_period, {dbl('spend_usd')} AS spend_usd, {dbl('budget_usd')} AS budget_usd, {rat('spend_usd', 'budget_usd')} AS usd_ratio
        FROM a FULL JOIN b USING (segment, cal_year, fiscal_period)""",
)
def _(t: Views) -> DataFrame:
    segment = t.campaigns.select("campaign_id", "segment")
    days = t.calendar.select("calendar_date", "cal_year", "fiscal_period")
    spent = sum_by(t.perf, ["campaign_id", "date"], ["spend_usd"]).join(segment, "campaign_id")
    a = spent.join(days, F.col("date") == F.col("calendar_date"))
    b = t.planned.join(segment, "campaign_id").join(days, F.col("plan_start") == F.col("calendar_date"))
    return rec.compare_sums(a, b, ["segment", "cal_year", "fiscal_period"], {"usd_ratio": ("spend_usd", "budget_usd")}, "full")


@query(
    "x11_cross_domain_brand",
    f"""{with_views('perf', 'products', 'planned', 'calendar')},
        firsts AS (SELECT l_orderkey AS plan_line_id, min({{'n': l_linenumber, 'p': l_partkey}}).p AS product_id FROM lineitem GROUP BY 1),
        a AS (SELECT brand, cal_year, fiscal_period, sum(spend_usd) AS spend_usd FROM perf JOIN products USING (product_id)
              JOIN calendar ON date = calendar_date GROUP BY ALL),
        b AS (SELECT brand, cal_year, fiscal_period, sum(budget_usd) AS budget_usd FROM planned JOIN firsts USING (plan_line_id)
              JOIN products USING (product_id) JOIN calendar ON plan_start = calendar_date GROUP BY ALL)
        SELECT brand, cal_year, fiscal_period, {dbl('spend_usd')} AS spend_usd, {dbl('budget_usd')} AS budget_usd, {rat('spend_usd', 'budget_usd')} AS usd_ratio
        FROM a FULL JOIN b USING (brand, cal_year, fiscal_period)""",
)
def _(t: Views) -> DataFrame:
    """Spend by the brand of the product, budgets by the brand of the plan line's first product."""
    days = t.calendar.select("calendar_date", "cal_year", "fiscal_period")
    leading = t.delivery.groupBy("plan_line_id").agg(F.min(F.struct("creative_id", "product_id")).alias("first"))
    planned = t.planned.join(leading.select("plan_line_id", "first.product_id"), "plan_line_id")
    # Both sides are added up by product and day before they meet the dims.
    spent = sum_by(t.perf, ["product_id", "date"], ["spend_usd"]).join(t.brand_dim, "product_id")
    budget = sum_by(planned, ["product_id", "plan_start"], ["budget_usd"]).join(t.brand_dim, "product_id")
    a = spent.join(days, F.col("date") == F.col("calendar_date"))
    b = budget.join(days, F.col("plan_start") == F.col("calendar_date"))
    return rec.compare_sums(a, b, ["brand", "cal_year", "fiscal_period"], {"usd_ratio": ("spend_usd", "budget_usd")}, "full")


VERSION_SQL = "year(o_orderdate) || 'H' || CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END"


def versions(t: Views) -> DataFrame:
    half = F.when(F.month("o_orderdate") <= 6, "H1").otherwise("H2")
    return t.orders.select(
        "o_custkey", "o_orderpriority", F.concat(F.year("o_orderdate").cast("string"), half).alias("version"), money("o_totalprice").alias("total")
    )


@query(
    "x12_version_compare",
    f"""SELECT {VERSION_SQL} AS version, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys,
        {dbl('sum(CAST(o_totalprice AS DECIMAL(18,4)))')} AS sum_total FROM orders GROUP BY 1""",
)
def _(t: Views) -> DataFrame:
    return rec.version_compare(versions(t), "version", "o_custkey", ["total"])


@query(
    "x12_only_in_latest",
    f"""WITH v AS (SELECT o_custkey, o_orderpriority, {VERSION_SQL} AS version FROM orders)
        SELECT o_custkey, o_orderpriority, min(version) AS version FROM v GROUP BY 1, 2 HAVING min(version) = (SELECT max(version) FROM v)""",
)
def _(t: Views) -> DataFrame:
    return rec.only_in_latest(versions(t), "version", ["o_custkey", "o_orderpriority"])


@query(
    "x13_environment_compare",
    f"""WITH a AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n_rows_a, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS total_a FROM orders GROUP BY 1, 2),
             b AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n_rows_b, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS total_b FROM orders
                   WHERE o_totalprice > 100000 AND o_orderpriority <> '3-MEDIUM' GROUP BY 1, 2)
        SELECT o_orderpriority, o_orderstatus, n_rows_a, n_rows_b, {dbl('total_a')} AS total_a, {dbl('total_b')} AS total_b,
        coalesce(n_rows_a, 0) - coalesce(n_rows_b, 0) AS n_rows_delta, {dbl('coalesce(total_a, 0) - coalesce(total_b, 0)')} AS total_delta
        FROM a FULL JOIN b USING (o_orderpriority, o_orderstatus)""",
)
def _(t: Views) -> DataFrame:
    orders = t.orders.select("o_orderpriority", "o_orderstatus", money("o_totalprice").alias("total"))
    other = orders.filter("total > 100000 AND o_orderpriority <> '3-MEDIUM'")
    return rec.environment_compare(orders, other, ["o_orderpriority", "o_orderstatus"], ["total"])


@query(
    "x14_composed_key_reconcile",
    f"""{with_views('perf_country', 'planned_country')},
        a AS (SELECT year(date) || '_' || country_id AS plan_name, sum(spend_usd) AS spend_usd FROM perf_country GROUP BY 1),
        b AS (SELECT year(plan_start) || '_' || country_id AS plan_name, sum(budget_usd) AS budget_usd FROM planned_country GROUP BY 1)
        SELECT plan_name, {dbl('spend_usd')} AS spend_usd, {dbl('budget_usd')} AS budget_usd, {rat('spend_usd', 'budget_usd')} AS ratio
        FROM a FULL JOIN b USING (plan_name)""",
)
def _(t: Views) -> DataFrame:
    return rec.composed_key_reconcile(
        t.spend_year, with_year(t.planned_country, "plan_start"), ["year", "country_id"], ("spend_usd", "budget_usd")
    )


@query(
    "x15_taxonomy_match",
    """WITH m AS (SELECT DISTINCT lower(p_type) AS code, 'Brand#' || length(p_type) AS mapped FROM part WHERE p_type <> 'PROMO')
       SELECT p_partkey, p_type, p_brand, mapped, CASE WHEN mapped IS NULL THEN 'unmapped' WHEN mapped = p_brand THEN 'match' ELSE 'mismatch' END AS outcome
       FROM part LEFT JOIN m ON lower(p_type) = code""",
)
def _(t: Views) -> DataFrame:
    mapping = t.part.filter("p_type <> 'PROMO'").select(
        F.initcap("p_type").alias("code"), F.concat(F.lit("Brand#"), F.length("p_type").cast("string")).alias("mapped")
    )
    return rec.taxonomy_match(t.part.select("p_partkey", "p_type", "p_brand"), mapping, "p_type", "p_brand")


@query(
    "x16_wide_export",
    f"""{with_views('perf', 'campaigns', 'products')} SELECT DISTINCT {yr('date')} AS year, country_id, segment, brand, tier
        FROM perf LEFT JOIN campaigns USING (campaign_id) LEFT JOIN products USING (product_id)""",
)
def _(t: Views) -> DataFrame:
    dims = [
        (t.campaigns.select("campaign_id", "country_id", "segment"), "campaign_id", "left"),
        (t.products.select("product_id", "brand"), "product_id", "left"),
    ]
    return rec.wide_export(with_year(t.perf, "date"), dims, ["year", "country_id", "segment", "brand", "tier"])


@query(
    "x17_reload_snapshot",
    f"""{with_views('perf_country', 'products')} SELECT country_id, {yr('date')} AS year, channel_id, brand, {sums('spend_usd', 'spend_lc')}, {counts('clicks', 'impressions')}
        FROM perf_country LEFT JOIN products USING (product_id) WHERE year(date) IN (1997, 1998) GROUP BY ALL""",
)
def _(t: Views) -> DataFrame:
    return _snapshot(t, t.perf)


SNAPSHOT = ["country_id", "year"], ["channel_id", "brand"], ["spend_usd", "spend_lc", "clicks", "impressions"]


def _snapshot(t: Views, perf: DataFrame) -> DataFrame:
    """Sums per country, year, channel and brand; lines are added up before they meet the dims."""
    upper, keys, measures = SNAPSHOT
    df = with_year(filter_years(perf, "date", [1997, 1998]), "date")
    return sum_through(df, [(t.brand_dim, "product_id", "left"), (t.country_dim, "campaign_id", "inner")], [*upper, *keys], measures)


def _reload_sql() -> str:
    (upper, keys, measures), changed = SNAPSHOT, "spend_usd + CASE WHEN campaign_id = 7 AND year(date) = 1997 THEN 1 ELSE 0 END"
    source = f"""SELECT country_id, {yr('date')} AS year, channel_id, brand, campaign_id, date, spend_usd, spend_lc, clicks, impressions
        FROM perf_country LEFT JOIN products USING (product_id) WHERE year(date) IN (1997, 1998)"""
    by = ", ".join([*upper, *keys])

    def side(tag: str, where: str, spend: str) -> str:
        sums = ", ".join(f"sum({spend if m == 'spend_usd' else m}) AS {tag}_{m}" for m in measures)
        return f"{tag} AS (SELECT {by}, {sums} FROM s WHERE {where} GROUP BY {by})"

    differs = " OR ".join(f"old_{m} IS DISTINCT FROM new_{m}" for m in measures)
    same = " AND ".join(f"old.{c} IS NOT DISTINCT FROM new.{c}" for c in (*upper, *keys))
    picked = ", ".join(f"coalesce(old.{c}, new.{c}) AS {c}" for c in (*upper, *keys))
    values = ", ".join(f"{(dbl if m.startswith('spend') else big)(f'{tag}_{m}')} AS {tag}_{m}" for tag in ("old", "new") for m in measures)
    return f"""{with_views('perf_country', 'products')}, s AS ({source}), {side('old', 'TRUE', 'spend_usd')},
        {side('new', "NOT (campaign_id = 11 AND year(date) = 1998)", changed)} SELECT {picked}, {values} FROM old FULL JOIN new ON {same} WHERE {differs}"""


@query("x17_reload_compare", _reload_sql())
def _(t: Views) -> DataFrame:
    """A reload in which a campaign's spend of 1997 has grown by 1 a line, and another's lines of 1998 are gone."""
    upper, keys, measures = SNAPSHOT
    grown = F.when((F.col("campaign_id") == 7) & (F.year("date") == 1997), 1).otherwise(0)
    reloaded = t.perf.filter("NOT (campaign_id = 11 AND year(date) = 1998)")
    reloaded = reloaded.withColumn("spend_usd", (F.col("spend_usd") + grown).cast("decimal(18,4)"))
    paths = [scratch_path(t.spark, "snapshot") for _ in range(2)]
    for perf, path in zip((t.perf, reloaded), paths):
        rec.store_snapshot(_snapshot(t, perf), path, upper)
    return rec.compare_snapshots(t.spark, *paths, upper, keys, measures)


@query(
    "x18_plan_actual_join",
    f"""{with_views('perf', 'planned', 'products')},
        a AS (SELECT campaign_id, brand, sum(spend_usd) AS spend_usd, sum(spend_lc) AS spend_lc FROM perf JOIN products USING (product_id) GROUP BY ALL),
        p AS (SELECT campaign_id, sum(budget_usd) AS budget_usd, sum(budget_lc) AS budget_lc FROM planned GROUP BY ALL)
        SELECT campaign_id, brand, """
    + ", ".join(f"{dbl(f'round({c}, 2)')} AS {c}" for c in ("spend_usd", "spend_lc", "budget_usd", "budget_lc"))
    + " FROM a LEFT JOIN p USING (campaign_id)",
)
def _(t: Views) -> DataFrame:
    actual = t.perf.join(t.products.select("product_id", "brand"), "product_id")
    return rec.plan_actual_join(actual, t.planned, ["campaign_id", "brand"], ["campaign_id"])


SPREAD_SQL = f"""{with_views('planned')}, d AS (SELECT priority, CAST(unnest(generate_series(plan_start, plan_end, INTERVAL 1 DAY)) AS DATE) AS day,
    CAST(budget_usd AS DOUBLE) / 31 AS daily FROM planned)"""


@query("x19_spread_daily", f"{SPREAD_SQL} SELECT day, round(sum(daily), 2) AS daily_amount FROM d GROUP BY 1")
def _(t: Views) -> DataFrame:
    days = rec.daily_totals(t.planned, "plan_start", "plan_end", "budget_usd")
    return days.select("day", F.round("daily_amount", 2).alias("daily_amount"))


@query(
    "x19_daily_by_grain",
    f"""{SPREAD_SQL.replace('SELECT priority', 'SELECT campaign_id, priority')} SELECT campaign_id, priority, day, round(sum(daily), 2) AS daily_amount FROM d GROUP BY ALL""",
)
def _(t: Views) -> DataFrame:
    days = rec.daily_totals(t.planned, "plan_start", "plan_end", "budget_usd", ["campaign_id", "priority"])
    return days.withColumn("daily_amount", F.round("daily_amount", 2))


@query(
    "x19_spread_monthly",
    f"{SPREAD_SQL} SELECT priority, last_day(day) AS month_end, round(sum(daily), 2) AS monthly_amount FROM d GROUP BY 1, 2",
)
def _(t: Views) -> DataFrame:
    months = rec.spread_monthly(t.planned, "plan_start", "plan_end", "budget_usd", ["priority"])
    return months.withColumn("monthly_amount", F.round("monthly_amount", 2))


@query(
    "x19_reversed_spans",
    f"""{with_views('perf')} SELECT plan_line_id, creative_id, campaign_start_date, date FROM perf WHERE date < campaign_start_date""",
)
def _(t: Views) -> DataFrame:
    spans = t.perf.select("plan_line_id", "creative_id", "campaign_start_date", "date")
    return rec.reversed_spans(spans, "campaign_start_date", "date")


@query(
    "x20_monthly_actual",
    f"""{with_views('delivery', 'products')} SELECT brand, last_day(date) AS month_end, {sums('spend_usd')}, {counts('impressions')}
        FROM delivery JOIN products USING (product_id) GROUP BY 1, 2""",
)
def _(t: Views) -> DataFrame:
    monthly = rec.monthly_actual(t.delivery, "date", ["product_id"], ["spend_usd", "impressions"])
    return sum_by(monthly.join(t.brand_dim, "product_id"), ["brand", "month_end"], ["spend_usd", "impressions"])


@query(
    "x21_fiscal_rollup",
    f"""{with_views('delivery', 'calendar')} SELECT cal_year, fiscal_period, status, {sums('spend_usd')}, {counts('clicks')}
        FROM delivery JOIN calendar ON date = calendar_date GROUP BY ALL""",
)
def _(t: Views) -> DataFrame:
    return rec.fiscal_rollup(t.delivery, t.calendar, "date", ["cal_year", "fiscal_period", "status"], ["spend_usd", "clicks"])


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_constant"]


def _correlation_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i:]]
    rows = " UNION ALL ".join(
        f"""SELECT l_returnflag, '{a}' AS column_a, '{b}' AS column_b,
            {rounded(f'covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)')} AS correlation FROM l GROUP BY 1"""
        for a, b in pairs
    )
    return f"WITH l AS (SELECT *, CAST(7 AS DOUBLE) AS l_constant FROM lineitem) {rows}"


@query("x22_correlation_matrix", _correlation_sql())
def _(t: Views) -> DataFrame:
    matrix = rec.correlation_matrix(t.lineitem.withColumn("l_constant", F.lit(7.0)), CORRELATED, ["l_returnflag"])
    return matrix.withColumn("correlation", F.round("correlation", 6))


@query(
    "x23_expected_rows_vs_days",
    f"""{with_views('reach')}, g AS (SELECT campaign_id, platform, count(date) AS n_rows, CAST(max(date) - min(date) + 1 AS BIGINT) AS expected_rows
        FROM reach GROUP BY ALL) SELECT * FROM g WHERE n_rows <> expected_rows""",
)
def _(t: Views) -> DataFrame:
    return rec.expected_rows_vs_days(t.reach, ["campaign_id", "platform"], "date", F.min("date"), F.max("date"))


@query(
    "x23_two_offsets",
    f"""{with_views('perf')}, s AS (SELECT campaign_id, campaign_start_date, date, CASE WHEN date < DATE '1999-01-01' THEN 1 ELSE 2 END AS side FROM perf),
        g AS (SELECT campaign_id, side, count(date) AS n_rows, max(date) - min(campaign_start_date) + 1 AS days FROM s GROUP BY campaign_id, side)
        SELECT campaign_id, side, n_rows, CAST(days + side - 1 AS BIGINT) AS expected_rows FROM g WHERE n_rows <> days + side - 1""",
)
def _(t: Views) -> DataFrame:
    # The declared start, not the first day with data; one more row is due from 1999 on.
    side = F.when(F.col("date") < F.lit(dt.date(1999, 1, 1)), 1).otherwise(2)
    df = t.perf.select("campaign_id", "campaign_start_date", "date", side.alias("side"))
    offset = F.when(F.col("side") == 1, 0).otherwise(1)
    return rec.expected_rows_vs_days(df, ["campaign_id", "side"], "date", F.min("campaign_start_date"), F.max("date"), offset)


@query(
    "x24_non_monotonic",
    f"""{with_views('reach')}, w AS (SELECT *, lag(value) OVER (PARTITION BY campaign_id, platform ORDER BY date, event_id) AS previous_value FROM reach)
        SELECT campaign_id, platform, date, event_id, {dbl('value')} AS value, {dbl('previous_value')} AS previous_value FROM w WHERE value < previous_value""",
)
def _(t: Views) -> DataFrame:
    return rec.non_monotonic(t.reach, ["campaign_id", "platform"], "date", ["event_id"], "value")


@query(
    "x25_running_total",
    f"""SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS order_date, {dbl('o_totalprice')} AS total,
        {dbl('sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')}
        AS running_total FROM orders""",
)
def _(t: Views) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"), money("o_totalprice").alias("total"))
    return rec.running_total(orders, ["o_custkey"], "order_date", "total")


PLAN_LEVELS = {
    "line": ["country", "budget_year", "brand", "plan_name", "media", "media_type", "start_date", "end_date"],
    "country_year": ["country", "budget_year"],
}
PLAN_HEADING = ["Country", "Budget Year", "Brand", "Plan Name", "Media", "Media type", "Start Date", "End Date", "Cost to Client", "Cost to Client USD"]


def _levels_sql() -> str:
    """One GROUP BY per level and side."""
    kinds = {"country": "INTEGER", "budget_year": "INTEGER", "start_date": "DATE", "end_date": "DATE"}
    columns = PLAN_LEVELS["line"]
    ctes, rows = [], []
    for level, grain in PLAN_LEVELS.items():
        for tag, where in (("a", "TRUE"), ("b", "o_orderstatus <> 'P'")):
            ctes.append(
                f"""{level}_{tag} AS (SELECT {', '.join(grain)}, count(*) AS n_rows_{tag}, sum(cost) AS cost_{tag}, sum(cost_usd) AS cost_usd_{tag}
                    FROM plan WHERE {where} GROUP BY {', '.join(grain)})"""
            )
        picked = ", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" if c in grain else f"CAST(NULL AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c in columns)
        sums = ", ".join(
            f"{dbl(f'{m}_a')} AS {m}_a, {dbl(f'{m}_b')} AS {m}_b, {dbl(f'coalesce({m}_a, 0) - coalesce({m}_b, 0)')} AS {m}_delta" for m in ("cost", "cost_usd")
        )
        n_rows = f"{big('n_rows_a')} AS n_rows_a, {big('n_rows_b')} AS n_rows_b, {big('coalesce(n_rows_a, 0) - coalesce(n_rows_b, 0)')} AS n_rows_delta"
        same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in grain)
        rows.append(f"SELECT '{level}' AS level, {picked}, {n_rows}, {sums} FROM {level}_a a FULL JOIN {level}_b b ON {same}")
    plan = f"""plan AS (SELECT o_orderstatus, c_nationkey AS country, {yr('o_orderdate')} AS budget_year, c_mktsegment AS brand, 'Plan "' || c_name || '"' AS plan_name,
        o_orderpriority AS media, o_orderstatus || chr(9) || o_orderpriority AS media_type, {day('o_orderdate')} AS start_date, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS end_date,
        CAST(o_totalprice * CAST(1.1 AS DOUBLE) AS DECIMAL(18,4)) AS cost, CAST(o_totalprice AS DECIMAL(18,4)) AS cost_usd FROM orders JOIN customer ON o_custkey = c_custkey)"""
    return f"WITH {plan}, {', '.join(ctes)} {' UNION ALL '.join(rows)}"


@query("x26_extract_vs_table", _levels_sql())
def _(t: Views) -> DataFrame:
    lines = t.orders.join(t.customer, F.expr("o_custkey = c_custkey")).select(
        "o_orderkey", "o_orderstatus", F.col("c_nationkey").cast("int").alias("country"), F.year("o_orderdate").alias("budget_year"),
        F.col("c_mktsegment").alias("brand"), F.concat(F.lit('Plan "'), "c_name", F.lit('"')).alias("plan_name"), F.col("o_orderpriority").alias("media"),
        F.concat_ws("\t", "o_orderstatus", "o_orderpriority").alias("media_type"), F.col("o_orderdate").cast("date").alias("start_date"),
        F.date_add(F.col("o_orderdate").cast("date"), 30).alias("end_date"), F.expr("CAST(o_totalprice * 1.1D AS DECIMAL(18,4))").alias("cost"), money("o_totalprice").alias("cost_usd"),
    )
    # The extract: names with quotes and types with a tab, quoted as a spreadsheet writes them.
    quoted = {c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in ("plan_name", "media_type")}
    value = F.concat_ws("\t", *[quoted.get(c, F.col(c).cast("string")) for c in (*PLAN_LEVELS["line"], "cost", "cost_usd")])
    path = scratch_path(t.spark, "plans")
    file = [F.col("brand").alias("segment"), F.pmod(F.xxhash64("o_orderkey"), F.lit(2 + t.orders.count() // 1_000_000)).alias("part")]
    write_with_preamble(lines.select(*file, value.alias("value")), "plans", PLAN_HEADING, path)
    kinds = {"country": "int", "budget_year": "int", "start_date": "date", "end_date": "date", "cost": "decimal(18,4)", "cost_usd": "decimal(18,4)"}
    mapping = {n: (h, kinds.get(n, "string")) for n, h in zip((*PLAN_LEVELS["line"], "cost", "cost_usd"), PLAN_HEADING)}
    extract = extracts.conform_extract(extracts.load_extracts(t.spark, f"{path}/*/*/*.txt", PLAN_HEADING), mapping)
    return rec.compare_by_levels(extract, lines.filter("o_orderstatus <> 'P'"), PLAN_LEVELS, ["cost", "cost_usd"])


def _fanout_sql() -> str:
    """Each fact row weighs the product of the matches of its keys; an unmatched left join counts 1, an inner one 0."""
    rights = [
        ("products", "product_id", "products", 1), ("reach", "campaign_id", "reach", 1), ("planned", "campaign_id", "planned", 1),
        ("channels", "channel_id", "channels WHERE channel_country < 12", 0),
    ]
    per_key = ", ".join(f"k{i} AS (SELECT {key}, count(*) AS n{i} FROM {table} GROUP BY {key})" for i, (_, key, table, _) in enumerate(rights, 1))
    joins = " ".join(f"LEFT JOIN k{i} USING ({key})" for i, (_, key, _, _) in enumerate(rights, 1))
    weights = ["1"] + [f"coalesce(n{i}, {missing})" for i, (_, _, _, missing) in enumerate(rights, 1)]
    totals = ", ".join(f"{dbl(f'sum({chr(42).join(weights[: i + 1])})')} AS t{i}" for i in range(5))
    rows = " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS step, '{name}' AS step_name, t{i - 1} AS rows_before, t{i} AS rows_after,
            (SELECT max(n{i}) <= 1 FROM k{i}) AS key_is_unique FROM totals"""
        for i, (name, _, _, _) in enumerate(rights, 1)
    )
    return f"{with_views('perf', 'products', 'reach', 'planned', 'channels')}, {per_key}, totals AS (SELECT {totals} FROM perf {joins}) {rows}"


@query("x27_join_fanout", _fanout_sql())
def _(t: Views) -> DataFrame:
    steps = [
        ("products", t.products, "product_id", "left"),
        ("reach", t.reach, "campaign_id", "left"),
        ("planned", t.planned, "campaign_id", "left"),
        ("channels", t.channels.filter("channel_country < 12"), "channel_id", "inner"),
    ]
    return rec.join_fanout(t.perf, steps)


@query(
    "x28_profile_extract",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_nulls, count(DISTINCT {c}) AS n_distinct FROM l"
        for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
    ).replace("SELECT", f"{with_views('labelled')}, l AS (FROM labelled) SELECT", 1),
)
def _(t: Views) -> DataFrame:
    return rec.profile_extract(t.labelled)


@query(
    "x28_extract_shape",
    f"""{with_views('labelled')}, p AS (SELECT * FROM labelled UNION ALL SELECT * FROM labelled WHERE quality = 0)
        SELECT (SELECT count(*) FROM p) AS n_rows, CAST(7 AS BIGINT) AS n_columns,
        (SELECT count(*) FROM p) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS n_duplicates""",
)
def _(t: Views) -> DataFrame:
    # Whole rows; those of low quality are delivered twice.
    return rec.extract_shape(t.labelled.union(t.labelled.filter("quality = 0")))
