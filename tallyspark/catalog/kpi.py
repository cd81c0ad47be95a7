"""M: KPI rollups and dashboard tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money
from ..functions.kpis import measures_for
from ..operators import kpi
from ..operators.scope import drill
from ..plans.bindings import MEASURES, QUARTILES, Views, with_views
from ..sources import extracts
from ..sources.scratch import scratch_path
from ..sources.sinks import split_hot, write_bucketed
from .registry import big, counts, dbl, query, rat, raw_ratio, sums, unsigned_zero, yr
from .sources import EXTRACT_HEADING, write_extracts

MONEY = {"spend_usd", "spend_lc", "budget_usd", "budget_lc"}


def total(measure: str, expr: str | None = None) -> str:
    expr = expr or f"sum({measure})"
    return f"{dbl(expr) if measure in MONEY else big(expr)} AS {measure}"


# The KPI formulas in SQL, stated apart from the registry that they check.
FORMULAS = {
    "ctr": rat("clicks", "impressions", 100),
    "ctr_fraction": rat("clicks", "impressions"),
    "cpm_usd": rat("spend_usd", "impressions", 1000),
    "cpm_lc": rat("spend_lc", "impressions", 1000),
    "cpcv_usd": rat("spend_usd", "fully_played"),
    "cpcv_lc": rat("spend_lc", "fully_played"),
    "vtr_views": rat("views", "impressions"),
    "vtr_views_pct": rat("views", "impressions", 100),
    "vtr_completions": rat("fully_played", "impressions"),
    "vtr_completions_pct": rat("fully_played", "impressions", 100),
    "vcr_views": rat("fully_played", "views"),
    "vcr_views_pct": rat("fully_played", "views", 100),
    "vcr_impressions": rat("fully_played", "impressions"),
    "vcr_impressions_pct": rat("fully_played", "impressions", 100),
    "vcr25": rat("video_25", "views"),
    "vcr50": rat("video_50", "views"),
    "vcr75": rat("video_75", "views"),
    "spend_pacing": rat("spend_usd", "budget_usd", 100),
}


def formulas(kpis: list[str]) -> str:
    return "".join(f", {FORMULAS[k]} AS {k}" for k in kpis)


def kpi_sql(grain: str, kpis: list[str], source: str, measures: list[str] | None = None) -> str:
    measures = measures or measures_for(kpis)
    sums_ = ", ".join(f"sum({m}) AS {m}" for m in measures)
    return f"SELECT {grain}, {', '.join(total(m, m) for m in measures)}{formulas(kpis)} FROM (SELECT {grain}, {sums_} FROM {source} GROUP BY ALL)"


SUMMARY = ["vtr_completions", "ctr", "cpm_usd", "cpm_lc", "cpcv_usd", "cpcv_lc", "vcr_views"]
DASHBOARD = ["ctr", "cpm_usd", "cpm_lc", "vcr_impressions_pct", "cpcv_usd", "cpcv_lc"]


@query("m01_kpi_country", with_views("perf_country") + kpi_sql("country_id", SUMMARY, "perf_country"))
def _(t: Views) -> DataFrame:
    return kpi.kpi_rollup(t.perf, ["country_id"], SUMMARY, dims=[(t.country_dim, "campaign_id", "inner")])


@query("m01_kpi_brand", with_views("delivery", "products") + kpi_sql("brand", SUMMARY, "delivery LEFT JOIN products USING (product_id)"))
def _(t: Views) -> DataFrame:
    return kpi.kpi_rollup(t.delivery, ["brand"], SUMMARY, dims=[(t.brand_dim, "product_id", "left")])


@query("m01_kpi_platform_channel", with_views("delivery") + kpi_sql("tier, channel_id", SUMMARY, "delivery"))
def _(t: Views) -> DataFrame:
    return kpi.kpi_rollup(t.delivery, ["tier", "channel_id"], SUMMARY)


QUARTILE_KPIS = ["vcr25", "vcr50", "vcr75", "vcr_views_pct", "vtr_views", "vtr_views_pct", "vtr_completions_pct", "ctr_fraction", "vcr_impressions"]


@query("m01_kpi_campaign", with_views("perf") + kpi_sql("campaign_id", QUARTILE_KPIS, "perf"))
def _(t: Views) -> DataFrame:
    return kpi.kpi_rollup(t.perf, ["campaign_id"], QUARTILE_KPIS)


#: Rows that agree in these columns beside the grain and the measures are counted once.
DEDUP = ["campaign_id", "date", "views", "video_25"]


def dedup_sql(grain: str, source: str) -> str:
    rows = f"(SELECT DISTINCT {grain}, {', '.join(measures_for(DASHBOARD))}, {', '.join(DEDUP)} FROM {source})"
    return kpi_sql(grain, DASHBOARD, rows)


@query(
    "m02_kpi_dedup_country_year",
    with_views("perf_country") + dedup_sql("country_id, year", f"(SELECT *, {yr('date')} AS year FROM perf_country)"),
)
def _(t: Views) -> DataFrame:
    df = t.perf.withColumn("year", F.year("date"))
    return kpi.kpi_rollup(df, ["country_id", "year"], DASHBOARD, dedup=DEDUP, dims=[(t.country_dim, "campaign_id", "inner")])


@query(
    "m03_kpi_dedup_brand",
    with_views("perf_country", "products")
    + dedup_sql("country_id, year, brand", f"(SELECT *, {yr('date')} AS year FROM perf_country LEFT JOIN products USING (product_id))"),
)
def _(t: Views) -> DataFrame:
    df = t.perf.withColumn("year", F.year("date")).join(t.brand_dim, "product_id", "left")
    return kpi.kpi_rollup(df, ["country_id", "year", "brand"], DASHBOARD, dedup=DEDUP, dims=[(t.country_dim, "campaign_id", "inner")])


@query(
    "m03_kpi_channel_platform",
    with_views("perf_country", "channels")
    + dedup_sql("country_id, year, channel_desc, tier", f"(SELECT *, {yr('date')} AS year FROM perf_country LEFT JOIN channels USING (channel_id))"),
)
def _(t: Views) -> DataFrame:
    named = t.channels.select("channel_id", "channel_desc")
    df = t.perf.withColumn("year", F.year("date")).join(named, "channel_id", "left")
    return kpi.kpi_rollup(df, ["country_id", "year", "channel_desc", "tier"], DASHBOARD, dedup=DEDUP, dims=[(t.country_dim, "campaign_id", "inner")])


PACING = ["ctr", "cpm_usd", "vcr_views_pct", "spend_pacing"]


def pacing_sql(where: str, extra: str = "") -> str:
    actual = [m for m in measures_for(PACING) if m != "budget_usd"]
    return f"""a AS (SELECT campaign_id, {', '.join(f'sum({m}) AS {m}' for m in actual)} FROM perf {where} GROUP BY ALL),
        b AS (SELECT campaign_id, sum(budget_usd) AS budget_usd FROM (SELECT DISTINCT campaign_id, plan_line_id, budget_usd FROM planned {where}) GROUP BY ALL)
        SELECT campaign_id, {', '.join(total(m, m) for m in (*actual, 'budget_usd'))}
        {formulas(PACING)}{extra}
        FROM a LEFT JOIN b USING (campaign_id)"""


@query(
    "m04_campaign_detail",
    f"""{with_views('perf', 'planned', 'reach')}, r AS (SELECT campaign_id, sum(value) AS sum_reach, count(*) AS reach_rows,
        {raw_ratio('sum(value)', 'count(value)')} AS avg_reach FROM reach GROUP BY 1), """
    + pacing_sql("WHERE campaign_id = 42", f", {dbl('avg_reach')} AS avg_reach, {dbl('sum_reach')} AS sum_reach, reach_rows")
    + " LEFT JOIN r USING (campaign_id)",
)
def _(t: Views) -> DataFrame:
    chosen = [drill(df, "campaign_id", [42]) for df in (t.perf, t.planned, t.reach)]
    detail = kpi.campaign_pacing(chosen[0], chosen[1], ["campaign_id"], PACING)
    return detail.join(kpi.reach_per_campaign(chosen[2]), "campaign_id", "left")


COMPARED = {"usd": ["ctr", "vcr_views", "vcr25", "vcr50", "vcr75", "cpm_usd", "cpcv_usd"], "lc": ["ctr", "vcr_views", "cpm_lc", "cpcv_lc"]}


def _comparison(name: str, kpis: list[str]) -> None:
    @query(name, with_views("perf", "campaigns") + kpi_sql("campaign_desc", kpis, "perf JOIN campaigns USING (campaign_id) WHERE campaign_desc IN ('Customer#000000007', 'Customer#000000042')"))
    def _(t: Views) -> DataFrame:
        names = drill(t.campaigns.select("campaign_id", "campaign_desc"), "campaign_desc", ["Customer#000000007", "Customer#000000042"])
        return kpi.kpi_rollup(t.perf.join(names, "campaign_id"), ["campaign_desc"], kpis)


for _currency, _kpis in COMPARED.items():
    _comparison(f"m05_campaign_comparison_{_currency}", _kpis)


REGION = "segment, region_desc, country_desc, product_type, brand"


@query(
    "m06_multi_region",
    with_views("perf", "campaigns", "countries", "products")
    + kpi_sql(REGION, ["ctr", "cpm_usd", "cpcv_usd"], "perf JOIN campaigns USING (campaign_id) JOIN countries USING (country_id) JOIN products USING (product_id)"),
)
def _(t: Views) -> DataFrame:
    dims = [
        (t.campaigns.select("campaign_id", "country_id", "segment"), "campaign_id", "inner"),
        (t.countries, "country_id", "inner"),
        (t.products.select("product_id", "brand", "product_type"), "product_id", "inner"),
    ]
    return kpi.kpi_rollup(kpi.join_dims(t.perf, dims), REGION.split(", "), ["ctr", "cpm_usd", "cpcv_usd"])


PERFORMANCE = ["ctr", "cpm_usd", "vcr_views_pct", "vtr_views_pct", "cpcv_usd"]


@query(
    "m07_performance_summary",
    with_views("perf", "campaigns", "channels")
    + kpi_sql("campaign_desc, channel_country, tier, status", PERFORMANCE, "perf JOIN campaigns USING (campaign_id) JOIN channels USING (channel_id)"),
)
def _(t: Views) -> DataFrame:
    dims = [
        (t.campaigns.select("campaign_id", "campaign_desc"), "campaign_id", "inner"),
        (t.channels.select("channel_id", "channel_country"), "channel_id", "inner"),
    ]
    return kpi.kpi_rollup(kpi.join_dims(t.perf, dims), ["campaign_desc", "channel_country", "tier", "status"], PERFORMANCE)


@query(
    "m08_campaign_reach",
    f"""{with_views('perf', 'reach')}, k AS ({kpi_sql('campaign_id, tier, status', PERFORMANCE, 'perf')}),
        r AS (SELECT campaign_id, {rat('sum(value)', 'count(value)')} AS avg_reach FROM reach GROUP BY 1)
        SELECT k.*, avg_reach FROM k JOIN r USING (campaign_id)""",
)
def _(t: Views) -> DataFrame:
    return kpi.campaign_reach(t.perf, t.reach, ["campaign_id", "tier", "status"], PERFORMANCE)


def _spend(name: str, grain: str, sql_source: str, views: tuple[str, ...], source) -> None:
    @query(name, f"{with_views(*views)} SELECT {grain}, {sums('spend_usd', 'spend_lc')} FROM {sql_source} GROUP BY ALL")
    def _(t: Views) -> DataFrame:
        return kpi.sum_by(source(t), grain.split(", "), ["spend_usd", "spend_lc"])


_YEAR = f"(SELECT *, {yr('date')} AS year FROM %s)"
_spend("m09_spend_country_year", "country_id, year", _YEAR % "perf_country", ("perf_country",), lambda t: t.spend_year)
_spend("m09_spend_channel_year", "channel_id, year", _YEAR % "delivery", ("delivery",), lambda t: t.delivery.withColumn("year", F.year("date")))
_spend("m09_spend_platform_year", "tier, year", _YEAR % "delivery", ("delivery",), lambda t: t.delivery.withColumn("year", F.year("date")))
_spend(
    "m09_spend_brand_year", "brand, year", f"{_YEAR % 'delivery'} JOIN products USING (product_id)", ("delivery", "products"),
    lambda t: kpi.sum_by(t.delivery.withColumn("year", F.year("date")), ["product_id", "year"], ["spend_usd", "spend_lc"]).join(t.brand_dim, "product_id"),
)


@query(
    "m10_planned_country",
    f"""{with_views('planned_country')} SELECT country_id, {sums('budget_usd', 'budget_lc')} FROM
        (SELECT DISTINCT country_id, plan_line_id, budget_usd, budget_lc FROM planned_country) GROUP BY 1""",
)
def _(t: Views) -> DataFrame:
    return kpi.planned_summary(t.planned_country, ["country_id"], ["budget_usd", "budget_lc"])


@query(
    "m10_planned_brand",
    f"""{with_views('planned', 'delivery', 'products')} SELECT brand, {sums('budget_usd', 'budget_lc')} FROM
        (SELECT DISTINCT brand, plan_line_id, budget_usd, budget_lc FROM planned JOIN delivery USING (plan_line_id) JOIN products USING (product_id)) GROUP BY 1""",
)
def _(t: Views) -> DataFrame:
    # A plan line counts once for each brand that its lines have.
    products = t.delivery.select("plan_line_id", "product_id").distinct().join(t.brand_dim, "product_id")
    brands = products.select("plan_line_id", "brand").distinct()
    return kpi.planned_summary(t.planned.join(brands, "plan_line_id"), ["brand"], ["budget_usd", "budget_lc"])


@query(
    "m10_planned_priority",
    f"""{with_views('planned')} SELECT priority, {sums('budget_usd')} FROM (SELECT DISTINCT priority, plan_line_id, budget_usd FROM planned) GROUP BY 1""",
)
def _(t: Views) -> DataFrame:
    return kpi.planned_summary(t.planned, ["priority"], ["budget_usd"])


ALL_MEASURES = [*MEASURES, *QUARTILES]


@query(
    "m11_kpi_by_country",
    f"{with_views('perf_country')} SELECT country_id, max(date) AS last_date, count(*) AS n_rows, {', '.join(total(m) for m in ALL_MEASURES)} FROM perf_country GROUP BY 1",
)
def _(t: Views) -> DataFrame:
    return kpi.measures_by(t.perf, ["country_id"], "date", ALL_MEASURES, (t.country_dim, "campaign_id", "inner"))


@query(
    "m12_grand_total",
    f"{with_views('delivery')} SELECT {dbl('sum(spend_usd)')} AS total_spend_usd, {dbl('sum(spend_lc)')} AS total_spend_lc, "
    + ", ".join(f"{big(f'sum({m})')} AS total_{m}" for m in ("impressions", "clicks", "views", "fully_played"))
    + " FROM delivery",
)
def _(t: Views) -> DataFrame:
    measures = ["spend_usd", "spend_lc", "impressions", "clicks", "views", "fully_played"]
    return kpi.grand_total(kpi.sum_by(t.delivery, ["channel_id", "tier"], measures), measures)


CONTENT = ["vtr_completions_pct", "vcr_views_pct", "vcr25", "vcr50", "vcr75"]


@query(
    "m13_content_summary",
    with_views("perf_country") + kpi_sql("campaign_id, country_id, tier, creative_id", CONTENT, "perf_country"),
)
def _(t: Views) -> DataFrame:
    grain = ["campaign_id", "country_id", "tier", "creative_id"]
    return kpi.kpi_rollup(t.perf, grain, CONTENT, dims=[(t.country_dim, "campaign_id", "inner")])


WINDOW = "campaign_id = 42 AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"


@query("m14_campaign_window_totals", f"{with_views('perf')} SELECT {', '.join(total(m) for m in MEASURES)} FROM perf WHERE {WINDOW}")
def _(t: Views) -> DataFrame:
    inside = (F.col("campaign_id") == 42) & F.col("date").between(F.lit(dt.date(1996, 1, 1)), F.lit(dt.date(1999, 12, 31)))
    return kpi.window_totals(t.perf, inside, MEASURES)


@query(
    "m15_distinct_creatives",
    f"{with_views('perf_country')} SELECT country_id, tier, count(DISTINCT product_id) AS n_creatives FROM perf_country GROUP BY 1, 2",
)
def _(t: Views) -> DataFrame:
    pairs = t.perf.select("campaign_id", "tier", "product_id").distinct().join(t.country_dim, "campaign_id")
    return kpi.distinct_with_count(pairs, ["country_id", "tier"], "product_id", "n_creatives")


def creative_base(t: Views) -> DataFrame:
    """Creative test rows with campaign segment, channel country and brand."""
    dims = [
        (t.campaigns.select("campaign_id", "segment"), "campaign_id", "left"),
        (t.channels.select("channel_id", "channel_country"), "channel_id", "left"),
        (t.products.select("product_id", "brand"), "product_id", "left"),
    ]
    return kpi.join_dims(t.perf, dims)


BASE_SQL = f"""{with_views('perf', 'campaigns', 'channels', 'products')}, base AS (SELECT * FROM perf LEFT JOIN campaigns USING (campaign_id)
    LEFT JOIN channels USING (channel_id) LEFT JOIN products USING (product_id)) """


@query(
    "m16_creative_base",
    BASE_SQL + f"SELECT plan_line_id, creative_id, product_id, status, tier, {unsigned_zero('score')} AS score, segment, channel_country, brand FROM base",
)
def _(t: Views) -> DataFrame:
    return creative_base(t).select("plan_line_id", "creative_id", "product_id", "status", "tier", "score", "segment", "channel_country", "brand")


# A guideline is the line number; a row passes with a score of 0.05.
def _passes(name: str, grain: str, views: tuple[str, ...], sql_source: str, source) -> None:
    @query(name, f"{with_views(*views)} SELECT status, {grain}, count(*) AS n_pass FROM {sql_source} WHERE score = 0.05 GROUP BY ALL")
    def _(t: Views) -> DataFrame:
        return kpi.pass_counts(source(t), "status", "score", grain.split(", "), 0.05)


_BRANDED = "delivery LEFT JOIN products USING (product_id)"


def branded(t: Views) -> DataFrame:
    return t.delivery.join(t.products.select("product_id", "brand"), "product_id", "left")


_passes("m17_pass_guideline", "creative_id", ("delivery",), "delivery", lambda t: t.delivery)
_passes("m17_pass_channel_guideline", "channel_id, creative_id", ("delivery",), "delivery", lambda t: t.delivery)
_passes("m17_pass_campaign_guideline", "campaign_id, creative_id", ("perf",), "perf", lambda t: t.perf)
_passes("m17_pass_channel_brand_guideline", "channel_id, brand, creative_id", ("delivery", "products"), _BRANDED, branded)
_passes("m17_pass_tier_guideline", "tier, creative_id", ("delivery",), "delivery", lambda t: t.delivery)
_passes("m18_pass_brand", "brand", ("delivery", "products"), _BRANDED, branded)
_passes("m18_pass_channel_brand", "channel_id, brand", ("delivery", "products"), _BRANDED, branded)
_passes("m18_pass_tier_brand", "tier, brand", ("delivery", "products"), _BRANDED, branded)


def _scores(name: str, grain: str, view: str) -> None:
    @query(name, f"{with_views(view)} SELECT {grain}, {rat('sum(CAST(score AS DECIMAL(28,10)))', 'count(score)')} AS avg_score FROM {view} GROUP BY ALL")
    def _(t: Views) -> DataFrame:
        return kpi.avg_score(getattr(t, view), "score", grain.split(", "))


_scores("m19_score_status", "status", "delivery")
_scores("m19_score_channel", "status, channel_id", "delivery")
_scores("m19_score_campaign", "status, campaign_id", "perf")
_scores("m19_score_tier", "status, tier", "delivery")


def _tiers(suffix: str, grain: str, view: str) -> None:
    columns = grain.split(", ")

    @query(
        f"m20_tier_counts_{suffix}",
        f"{with_views(view)} SELECT {grain}, count(*) AS n_creatives FROM (SELECT DISTINCT {grain}, product_id FROM {view}) GROUP BY ALL",
    )
    def _(t: Views) -> DataFrame:
        return kpi.tier_counts(getattr(t, view), "product_id", columns)

    @query(
        f"m21_tier_spend_{suffix}",
        f"{with_views(view)} SELECT {grain}, {sums('spend_usd')} FROM (SELECT DISTINCT {grain}, product_id, spend_usd FROM {view}) GROUP BY ALL",
    )
    def _(t: Views) -> DataFrame:
        return kpi.tier_spend(getattr(t, view), "product_id", "spend_usd", columns)


_tiers("status", "status, tier", "delivery")
_tiers("channel", "status, channel_id, tier", "delivery")
_tiers("campaign", "status, campaign_id, tier", "perf")


@query(
    "m22_creative_counts",
    f"{with_views('delivery')} SELECT status, channel_id, count(DISTINCT product_id) AS n_creatives FROM delivery GROUP BY 1, 2",
)
def _(t: Views) -> DataFrame:
    return kpi.distinct_with_count(t.delivery, ["status", "channel_id"], "product_id", "n_creatives")


@query(
    "m22_creative_names",
    f"""{with_views('delivery', 'products')} SELECT product, count(DISTINCT tier) AS n_tiers FROM delivery JOIN products USING (product_id) GROUP BY 1""",
)
def _(t: Views) -> DataFrame:
    df = t.delivery.select("product_id", "tier").distinct().join(t.products.select("product_id", "product"), "product_id")
    return kpi.distinct_with_count(df, ["product"], "tier", "n_tiers")


@query(
    "m23_creative_detail",
    f"""{with_views('delivery', 'planned')} SELECT plan_line_id, campaign_id, priority, creative_id, status, {dbl('spend_usd')} AS spend_usd
        FROM delivery RIGHT JOIN planned USING (plan_line_id)""",
)
def _(t: Views) -> DataFrame:
    tested = t.delivery.select("plan_line_id", "creative_id", "status", "spend_usd")
    return kpi.join_dims(tested, [(t.planned.select("plan_line_id", "campaign_id", "priority"), "plan_line_id", "right")])


@query(
    "m24_guideline_sums",
    f"""{with_views('delivery')} SELECT tier, creative_id, {dbl('sum(score)')} AS score FROM
        (SELECT tier, creative_id, CAST(score AS DECIMAL(18,4)) AS score FROM delivery) GROUP BY 1, 2""",
)
def _(t: Views) -> DataFrame:
    return kpi.sum_by(t.delivery.withColumn("score", money("score")), ["tier", "creative_id"], ["score"])


@query(
    "m25_status_intersection",
    f"""{with_views('delivery')} SELECT channel_id, product_id FROM delivery WHERE status = 'F'
        INTERSECT SELECT channel_id, product_id FROM delivery WHERE status = 'O'""",
)
def _(t: Views) -> DataFrame:
    return kpi.status_intersection(t.delivery, "status", "F", "O", ["channel_id", "product_id"])


@query("m26_campaign_pacing", with_views("perf", "planned") + ", " + pacing_sql(""))
def _(t: Views) -> DataFrame:
    return kpi.campaign_pacing(t.perf, t.planned, ["campaign_id"], PACING)


CASE_TWO = ["cpm_usd", "ctr", "vtr_completions_pct"]


@query(
    "m26_channel_reach",
    f"""{with_views('perf', 'reach')}, k AS ({kpi_sql('campaign_id, campaign_start_date, channel_id, tier', CASE_TWO, 'perf')}),
        r AS (SELECT campaign_id, {dbl('sum(value)')} AS sum_reach, count(*) AS reach_rows FROM reach GROUP BY 1)
        SELECT k.*, sum_reach, reach_rows FROM k LEFT JOIN r USING (campaign_id)""",
)
def _(t: Views) -> DataFrame:
    rolled = kpi.kpi_rollup(t.perf, ["campaign_id", "campaign_start_date", "channel_id", "tier"], CASE_TWO)
    return rolled.join(kpi.reach_per_campaign(t.reach).drop("avg_reach"), "campaign_id", "left")


WIDE_SQL = f"""{with_views('perf', 'campaigns', 'products', 'reach', 'planned', 'calendar')},
    r AS (SELECT campaign_id, {rat('sum(value)', 'count(value)')} AS avg_reach FROM reach GROUP BY 1),
    b AS (SELECT campaign_id, {sums('budget_usd')} FROM planned GROUP BY 1)
    SELECT campaign_id, product_id, date, clicks, {dbl('spend_usd')} AS spend_usd, brand, country_id, avg_reach, budget_usd, cal_week_of_year
    FROM perf LEFT JOIN products USING (product_id) LEFT JOIN campaigns USING (campaign_id)
    LEFT JOIN r USING (campaign_id) LEFT JOIN b USING (campaign_id) JOIN calendar ON date = calendar_date"""


@query(
    "m27_wide_join",
    WIDE_SQL,
)
def _(t: Views) -> DataFrame:
    dims = [
        (t.products.select("product_id", "brand"), "product_id", "left"),
        (t.campaigns.select("campaign_id", "country_id"), "campaign_id", "left"),
    ]
    fact = t.perf.select("campaign_id", "product_id", "date", "clicks", "spend_usd")
    return kpi.wide_join(fact, dims, t.reach, t.planned, t.calendar.select("calendar_date", "cal_week_of_year"), "date")


@query("m27_wide_join_bucketed", WIDE_SQL)
def _(t: Views) -> DataFrame:
    """The same rows from tables stored in buckets of the campaign: only the joins by product and day shuffle."""
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    fact = t.perf.select("campaign_id", "product_id", "date", "clicks", "spend_usd")
    rest, hot = split_hot(fact, "campaign_id", buckets)
    frames = {"fact": rest, "campaigns": t.campaigns.select("campaign_id", "country_id"), "reach": t.reach, "planned": t.planned}

    def stored(label: str) -> DataFrame:
        path = scratch_path(t.spark, f"wide_{label}")
        return write_bucketed(frames[label], path.rsplit("/", 1)[1].replace("-", "_"), path, "campaign_id", buckets)

    rest, campaigns, reach, planned = [stored(label) for label in frames]
    days = t.calendar.select("calendar_date", "cal_week_of_year")
    dims = [(campaigns, "campaign_id", "left")]
    # Hot campaigns are few: what belongs to them is looked up by a join that adaptive execution can split.
    keys = F.broadcast(hot.select("campaign_id").distinct())
    few = [df.join(keys, "campaign_id", "left_semi") for df in (campaigns, reach, planned)]
    wide = kpi.wide_join(rest, dims, reach, planned, days, "date").unionByName(
        kpi.wide_join(hot, [(few[0], "campaign_id", "left")], few[1], few[2], days, "date")
    )
    return wide.join(t.brand_dim, "product_id", "left")


@query(
    "m28_audience_impressions",
    f"{with_views('perf', 'campaigns')} SELECT campaign_desc, segment, {counts('impressions')} FROM perf JOIN campaigns USING (campaign_id) GROUP BY 1, 2",
)
def _(t: Views) -> DataFrame:
    dims = [(t.campaigns.select("campaign_id", "campaign_desc", "segment"), "campaign_id", "inner")]
    return kpi.sum_through(t.perf, dims, ["campaign_desc", "segment"], ["impressions"])


@query(
    "m29_campaigns_per_platform",
    f"{with_views('planned')} SELECT priority, count(DISTINCT campaign_id) AS n_campaigns FROM planned GROUP BY 1",
)
def _(t: Views) -> DataFrame:
    return kpi.distinct_with_count(t.planned, ["priority"], "campaign_id", "n_campaigns")


@query(
    "m30_extract_rollup",
    f"""SELECT c_mktsegment AS channel, c_nationkey AS market, 'ALL' AS country, {dbl('sum(CAST(c_acctbal AS DECIMAL(18,4)))')} AS spend
        FROM customer GROUP BY 1, 2""",
)
def _(t: Views) -> DataFrame:
    raw = extracts.load_extracts(t.spark, f"{write_extracts(t)}/*/*/*.txt", EXTRACT_HEADING)
    mapping = {"channel": ("Segment", "string"), "market": ("Market", "int"), "spend": ("Balance", "decimal(18,4)")}
    return kpi.sum_by(extracts.conform_extract(raw, mapping, {"country": "ALL"}), ["country", "channel", "market"], ["spend"])


@query(
    "m31_reach_export",
    f"""{with_views('reach', 'campaigns', 'countries')} SELECT region_desc, country_desc, segment, platform, campaign_id, date, {dbl('sum(value)')} AS value
        FROM reach JOIN campaigns USING (campaign_id) JOIN countries USING (country_id) GROUP BY ALL""",
)
def _(t: Views) -> DataFrame:
    per_day = kpi.sum_by(t.reach, ["campaign_id", "platform", "date"], ["value"])
    wide = per_day.join(t.campaigns.select("campaign_id", "country_id", "segment"), "campaign_id").join(t.countries, "country_id")
    return wide.select("region_desc", "country_desc", "segment", "platform", "campaign_id", "date", "value")
