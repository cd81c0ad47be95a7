"""N: naming compliance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalise_token
from ..operators import naming
from ..operators.scope import match_text
from ..plans.bindings import Views, with_views
from ..sources.extracts import clean_codebook
from ..sources.scratch import measured, tasks_for
from ..sources.tables import union_all
from .registry import query, yr

ATTRIBUTES = ["brand", "type", "size"]

CODEBOOK_SQL = """codebook AS (SELECT DISTINCT 'part' AS entity, 'brand' AS attribute, p_brand AS code FROM part
        WHERE p_brand NOT IN ('Brand#3', 'Brand#13')
    UNION SELECT 'part', 'type', p_type FROM part WHERE p_type <> 'PROMO'
    UNION SELECT 'part', 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_size <= 45)"""

NAMED_SQL = """named AS (SELECT p_partkey AS part_id, p_name || '-' || p_partkey AS name, p_brand AS brand,
    CASE WHEN p_size <> 50 THEN p_type END AS type, CAST(p_size AS VARCHAR) AS size,
    CASE WHEN p_size > 40 OR p_type = 'PROMO' THEN 1 ELSE 0 END AS stored_flag FROM part)"""


def _accepted(attribute: str) -> str:
    return f"coalesce({attribute} IN (SELECT code FROM codebook WHERE attribute = '{attribute}'), false)"


FLAGGED_SQL = (
    f"{CODEBOOK_SQL}, {NAMED_SQL}, flagged AS (SELECT *, CASE WHEN "
    + " AND ".join(_accepted(a) for a in ATTRIBUTES)
    + " THEN 0 ELSE 1 END AS calculated_flag FROM named)"
)
EXCEPTIONS_SQL = "exceptions AS (SELECT 'part' AS entity, p_name || '-' || p_partkey AS name FROM part WHERE p_size = 47)"
USED_SQL = f"""used AS (SELECT DISTINCT product_id, region_desc, country_desc, tier AS platform, {yr('date')} AS year
    FROM delivery JOIN channels USING (channel_id) JOIN countries ON channel_country = country_id)"""
BASE = f"WITH {FLAGGED_SQL}, {EXCEPTIONS_SQL} "
SCOPED = f"""{with_views('delivery', 'channels', 'countries')}, {FLAGGED_SQL}, {EXCEPTIONS_SQL}, {USED_SQL},
    scoped AS (SELECT f.*, region_desc, country_desc, platform, year FROM flagged f JOIN used ON part_id = product_id) """


def codebook(t: Views) -> DataFrame:
    """Accepted codes of parts. Derived from a table, so it is measured before it is joined."""
    size = F.col("p_size").cast("string")
    cells = [
        ("brand", F.when(~F.col("p_brand").isin("Brand#3", "Brand#13"), F.col("p_brand"))),
        ("type", F.when(F.col("p_type") != "PROMO", F.col("p_type"))),
        ("size", F.when(F.col("p_size") <= 45, size)),
    ]
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), c.alias("code")) for a, c in cells])
    long = t.part.select(F.inline(pairs)).distinct().withColumn("entity", F.lit("part"))
    return measured(clean_codebook(long))


def named(t: Views) -> DataFrame:
    stored = F.when((F.col("p_size") > 40) | (F.col("p_type") == "PROMO"), 1).otherwise(0)
    return t.part.select(
        F.col("p_partkey").alias("part_id"),
        F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_size") != 50, F.col("p_type")).alias("type"),
        F.col("p_size").cast("string").alias("size"),
        stored.alias("stored_flag"),
    )


def exceptions(t: Views) -> DataFrame:
    parts = t.part.filter("p_size = 47")
    return parts.select(F.lit("part").alias("entity"), F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("name"))


def flagged(t: Views) -> DataFrame:
    return naming.compliance_flag(named(t), codebook(t), "part", ATTRIBUTES)


def used(t: Views) -> DataFrame:
    """Fact rows with the market, platform and year in which a part was used."""
    df = t.delivery.join(t.channels, "channel_id").join(t.countries, F.col("channel_country") == F.col("country_id"))
    return df.select(
        F.col("product_id").alias("part_id"), "region_desc", "country_desc", F.col("tier").alias("platform"), F.year("date").alias("year")
    )


MARKET = ["region_desc", "country_desc", "platform", "year"]


def markets(t: Views, rows: DataFrame, attributes: list[str]) -> DataFrame:
    """Distinct markets of each part. They may be nearly as many as the rows, which are dealt by the key of later joins."""
    return rows.select("part_id", *attributes).repartition(tasks_for(t.lineitem), "part_id").distinct()


def scoped(t: Views, attributes: list[str] = MARKET) -> DataFrame:
    return flagged(t).join(markets(t, used(t), attributes), "part_id")


def rollup(t: Views, df: DataFrame, grain: list[str], pct: bool = False) -> DataFrame:
    return naming.compliance_rollup(df, grain, "name", pct=pct, tasks=tasks_for(t.lineitem))


def rollup_sql(grain: str, source: str, flag: str = "calculated_flag", pct: bool = False, extra: str = "") -> str:
    out = f"""SELECT {grain}, count(name) AS total_count, count(*) FILTER (WHERE {flag} = 0) AS following,
        count(*) FILTER (WHERE {flag} = 1) AS not_following"""
    if pct:
        out += "".join(
            f", round(100 * CAST(count(*) FILTER (WHERE {flag} = {v}) AS DOUBLE) / count(name), 0) AS {n}_pct"
            for v, n in ((0, "following"), (1, "not_following"))
        )
    return f"{out}{extra} FROM (SELECT DISTINCT {grain}, name, {flag} FROM {source}) GROUP BY {grain}"


@query(
    "n01_normalise_token",
    r"""SELECT doc_id, md5(lower(text)) AS lower_digest, md5(lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS alnum_digest FROM documents""",
)
def _(t: Views) -> DataFrame:
    return t.documents.select(
        "doc_id", F.md5(normalise_token("text", "lower")).alias("lower_digest"), F.md5(normalise_token("text", "alnum_lower")).alias("alnum_digest")
    )


@query("n02_compliance_flag", BASE + "SELECT part_id, name, stored_flag, calculated_flag FROM flagged")
def _(t: Views) -> DataFrame:
    return flagged(t).select("part_id", "name", "stored_flag", "calculated_flag")


@query(
    "n03_compliance_flag_normalised",
    """WITH c AS (SELECT c_custkey, c_name, lower(regexp_replace(c_mktsegment, '[^a-zA-Z0-9]', '', 'g')) AS segment,
            lower(regexp_replace(n_name, '[^a-zA-Z0-9]', '', 'g')) AS market FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT c_custkey, c_name, CASE WHEN segment IN (SELECT lower(c_mktsegment) FROM customer WHERE c_mktsegment <> 'FURNITURE')
       AND market IN (SELECT lower(replace(n_name, '_', '')) FROM nation WHERE n_regionkey <> 3) THEN 0 ELSE 1 END AS calculated_flag FROM c""",
)
def _(t: Views) -> DataFrame:
    codes = [
        t.customer.filter("c_mktsegment <> 'FURNITURE'").select(F.lit("segment").alias("attribute"), F.col("c_mktsegment").alias("code")),
        t.nation.filter("n_regionkey <> 3").select(F.lit("market").alias("attribute"), F.col("n_name").alias("code")),
    ]
    book = measured(clean_codebook(union_all(codes).distinct().withColumn("entity", F.lit("customer"))))
    # Names are written in another case and with other marks than the codebook.
    tokens = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", F.concat(F.initcap("c_mktsegment"), F.lit(".")).alias("segment"), F.translate(F.lower("n_name"), "_", "-").alias("market")
    )
    return naming.compliance_flag(tokens, book, "customer", ["segment", "market"], "alnum_lower").drop("segment", "market")


ORDER_CODES = {
    "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"],
    "status": ["F", "O"],
    "year": ["1996", "1997", "1998", "1999", "2000"],
}


@query(
    "n04_compliance_flag_lists",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') AND o_orderstatus IN ('F', 'O')
       AND year(o_orderdate) BETWEEN 1996 AND 2000 THEN 0 ELSE 1 END AS calculated_flag FROM orders""",
)
def _(t: Views) -> DataFrame:
    tokens = t.orders.select(
        "o_orderkey", F.lower("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year")
    )
    return naming.compliance_flag(tokens, ORDER_CODES, "order", list(ORDER_CODES), "lower").drop(*ORDER_CODES)


@query("n05_flag_mismatch", BASE + "SELECT part_id, name, stored_flag, calculated_flag FROM flagged WHERE stored_flag <> calculated_flag")
def _(t: Views) -> DataFrame:
    return naming.flag_mismatch(flagged(t), "stored_flag").select("part_id", "name", "stored_flag", "calculated_flag")


NOT_EXCEPTION = "name NOT IN (SELECT name FROM exceptions)"


@query(
    "n06_exclude_exceptions",
    BASE + f"""SELECT part_id, name, calculated_flag, platform FROM flagged
        LEFT JOIN (SELECT DISTINCT l_partkey, l_returnflag AS platform FROM lineitem) ON l_partkey = part_id WHERE {NOT_EXCEPTION}""",
)
def _(t: Views) -> DataFrame:
    kept = naming.exclude_exceptions(flagged(t), exceptions(t), "part", "name")
    fact = t.lineitem.select(F.col("l_partkey").alias("part_id"), F.col("l_returnflag").alias("platform"))
    return naming.attach_platform(kept, fact, "part_id", ["platform"]).select("part_id", "name", "calculated_flag", "platform")


@query(
    "n07_unknown_codes",
    BASE + "SELECT DISTINCT attribute, value FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, {a} AS value FROM flagged WHERE stored_flag <> calculated_flag AND NOT {_accepted(a)}" for a in ATTRIBUTES
    )
    + ")",
)
def _(t: Views) -> DataFrame:
    book = codebook(t)
    mismatching = naming.flag_mismatch(naming.compliance_flag(named(t), book, "part", ATTRIBUTES), "stored_flag")
    return naming.unknown_codes(mismatching, book, "part", ATTRIBUTES)


@query(
    "n08_mask_accepted",
    BASE + "SELECT part_id, " + ", ".join(f"CASE WHEN NOT {_accepted(a)} THEN {a} END AS {a}" for a in ATTRIBUTES) + " FROM flagged",
)
def _(t: Views) -> DataFrame:
    return naming.mask_accepted(named(t), codebook(t), "part", ATTRIBUTES).select("part_id", *ATTRIBUTES)


@query("n09_compliance_rollup", SCOPED + rollup_sql("region_desc", f"(SELECT * FROM scoped WHERE {NOT_EXCEPTION})", pct=True))
def _(t: Views) -> DataFrame:
    kept = naming.exclude_exceptions(scoped(t, ["region_desc"]), exceptions(t), "part", "name")
    return rollup(t, kept, ["region_desc"], pct=True)


@query("n10_rollup_market_platform", SCOPED + rollup_sql("region_desc, country_desc, platform", "scoped"))
def _(t: Views) -> DataFrame:
    grain = ["region_desc", "country_desc", "platform"]
    return rollup(t, scoped(t, grain), grain)


@query("n11_rollup_country", SCOPED + rollup_sql("country_desc", "scoped"))
def _(t: Views) -> DataFrame:
    return rollup(t, scoped(t, ["country_desc"]), ["country_desc"])


@query("n12_rollup_year_brand", SCOPED + rollup_sql("region_desc, country_desc, year, brand, platform", "scoped"))
def _(t: Views) -> DataFrame:
    return rollup(t, scoped(t), ["region_desc", "country_desc", "year", "brand", "platform"])


@query(
    "n13_staged_compliance",
    SCOPED
    + " UNION ALL ".join(
        rollup_sql("region_desc", source, flag, True, f", CAST({i} AS INTEGER) AS stage")
        for i, (source, flag) in enumerate(
            [("scoped", "stored_flag"), ("scoped", "calculated_flag"), (f"(SELECT * FROM scoped WHERE {NOT_EXCEPTION})", "calculated_flag")], 1
        )
    ),
)
def _(t: Views) -> DataFrame:
    return naming.staged_compliance(scoped(t, ["region_desc"]), exceptions(t), "part", "name", "stored_flag", ["region_desc"], tasks=tasks_for(t.lineitem))


@query(
    "n14_subset_compliance",
    SCOPED + rollup_sql("country_desc", "(SELECT * FROM scoped WHERE contains(name, 'red') OR contains(name, 'bolt'))", pct=True),
)
def _(t: Views) -> DataFrame:
    return rollup(t, match_text(scoped(t, ["country_desc"]), "name", ["red", "bolt"]), ["country_desc"], pct=True)


@query(
    "n15_exception_summary",
    SCOPED + f"""SELECT region_desc, country_desc, platform, count(name) AS n_names FROM
        (SELECT DISTINCT region_desc, country_desc, platform, name FROM scoped WHERE NOT ({NOT_EXCEPTION})) GROUP BY 1, 2, 3""",
)
def _(t: Views) -> DataFrame:
    grain = ["region_desc", "country_desc", "platform"]
    dim = named(t).join(markets(t, used(t), grain), "part_id")
    return naming.exception_summary(dim, exceptions(t), "part", "name", grain)


@query("n15_exception_compliance", SCOPED + rollup_sql("region_desc", f"(SELECT * FROM scoped WHERE NOT ({NOT_EXCEPTION}))", pct=True))
def _(t: Views) -> DataFrame:
    found = naming.only_exceptions(scoped(t, ["region_desc"]), exceptions(t), "part", "name")
    return rollup(t, found, ["region_desc"], pct=True)


@query(
    "n16_flat_export",
    f"""{with_views('delivery', 'products', 'channels')} SELECT DISTINCT product_id, brand, product, product_type, channel_country, tier, status
        FROM delivery JOIN products USING (product_id) LEFT JOIN channels USING (channel_id) WHERE date >= DATE '2000-01-01'""",
)
def _(t: Views) -> DataFrame:
    fact = t.delivery.filter("date >= date '2000-01-01'")
    return naming.flat_export(
        fact, t.products, "product_id", [(t.channels.select("channel_id", "channel_country"), "channel_id", "left")],
        ["product_id", "brand", "product", "product_type", "channel_country", "tier", "status"],
    )


@query("n17_flagged_rows", BASE + "SELECT part_id, name, brand, type, size FROM flagged WHERE calculated_flag = 1")
def _(t: Views) -> DataFrame:
    return naming.flagged_rows(flagged(t), "calculated_flag", ["part_id", "name", *ATTRIBUTES])


@query(
    "n17_flagged_null_counts",
    BASE + "SELECT " + ", ".join(f"count(*) FILTER (WHERE {a} IS NULL) AS {a}" for a in ATTRIBUTES) + " FROM flagged WHERE calculated_flag = 1",
)
def _(t: Views) -> DataFrame:
    return naming.flagged_null_counts(flagged(t), "calculated_flag", ATTRIBUTES)


@query(
    "n18_scoped_compliance",
    SCOPED + rollup_sql("country_desc", "(SELECT * FROM scoped WHERE region_desc = 'ASIA' AND platform = 'R')", pct=True),
)
def _(t: Views) -> DataFrame:
    found = markets(t, used(t).filter("region_desc = 'ASIA' AND platform = 'R'"), ["country_desc"])
    return rollup(t, flagged(t).join(found, "part_id"), ["country_desc"], pct=True)


def _wide(name: str, entity: str, n: int, mode: str) -> None:
    """The flag over ``n`` tokens of a part's name. Codes of numbers divisible by the token's modulus are not accepted."""
    moduli = {f"token{i}": 40 + i for i in range(n)}
    flag = " AND ".join(f"p_partkey % {m} <> 0" for m in moduli.values())

    @query(name, f"SELECT p_partkey, CASE WHEN {flag} THEN 0 ELSE 1 END AS calculated_flag FROM part")
    def _(t: Views) -> DataFrame:
        code = {k: F.concat(F.col("p_brand"), F.lit("-"), F.lpad((F.col("p_partkey") % m).cast("string"), 3, "0")) for k, m in moduli.items()}
        cells = [F.struct(F.lit(k).alias("attribute"), F.when(F.col("p_partkey") % m != 0, code[k]).alias("code")) for k, m in moduli.items()]
        long = t.part.select(F.inline(F.array(*cells))).distinct().withColumn("entity", F.lit(entity))
        written = F.lower if mode == "alnum_lower" else (lambda c: c)
        tokens = t.part.select("p_partkey", *[written(c).alias(k) for k, c in code.items()])
        return naming.compliance_flag(tokens, measured(clean_codebook(long)), entity, list(moduli), mode).select("p_partkey", "calculated_flag")


_wide("n02_compliance_flag_10_tokens", "campaign", 10, "strict")
_wide("n03_compliance_flag_19_tokens", "media_buy", 19, "alnum_lower")
_wide("n04_compliance_flag_14_tokens", "creative", 14, "strict")


@query(
    "n16_flat_export_campaign",
    f"""{with_views('perf', 'campaigns', 'countries')} SELECT DISTINCT campaign_id, campaign_desc, segment, country_desc, region_desc, status
        FROM perf JOIN campaigns USING (campaign_id) LEFT JOIN countries USING (country_id) WHERE date >= DATE '2000-01-01'""",
)
def _(t: Views) -> DataFrame:
    fact = t.perf.filter("date >= date '2000-01-01'").select("campaign_id", "status").distinct()
    named = t.campaigns.join(t.countries, "country_id", "left").drop("country_id")
    return naming.flat_export(fact, named, "campaign_id", [], ["campaign_id", "campaign_desc", "segment", "country_desc", "region_desc", "status"])


@query(
    "n16_flat_export_creative",
    f"""{with_views('delivery', 'products', 'channels')} SELECT DISTINCT creative_id, channel_id, channel_desc, product_id, product, tier
        FROM delivery JOIN products USING (product_id) LEFT JOIN channels USING (channel_id) WHERE date >= DATE '2000-01-01'""",
)
def _(t: Views) -> DataFrame:
    fact = t.delivery.filter("date >= date '2000-01-01'").select("creative_id", "channel_id", "product_id", "tier").distinct()
    named = (t.channels.select("channel_id", "channel_desc"), "channel_id", "left")
    columns = ["creative_id", "channel_id", "channel_desc", "product_id", "product", "tier"]
    return naming.flat_export(fact, t.products.select("product_id", "product"), "product_id", [named], columns)
