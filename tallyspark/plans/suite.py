"""Check suites: an ordered list of numbered checks, run to one summary row each.

Row checks (a condition on one table) of the same table share a single scan and aggregate. Frame checks (joins,
groupings) count their violations in a plan of their own. Nothing is collected; ``run`` returns a DataFrame.
``write`` also keeps the violating rows: they are counted while they are written, so each table is still read once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.tables import union_all

BREAKING = "dashboard_breaking"
DATA_ISSUE = "data_issue"
SEVERITIES = (BREAKING, DATA_ISSUE)

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Check:
    """A check of one table: either ``rule`` (violating rows of it) or ``frame`` (violations as a DataFrame)."""

    check_id: str
    domain: str
    severity: str
    table: str
    rule: Callable[[], Column] | None = None
    frame: Callable[[Tables], DataFrame] | None = None

    def __post_init__(self):
        if (self.rule is None) == (self.frame is None):
            raise ValueError(f"{self.check_id}: give either a rule or a frame")
        if self.severity not in SEVERITIES:
            raise ValueError(f"{self.check_id}: unknown severity {self.severity!r}")

    def violations(self, tables: Tables) -> DataFrame:
        return tables[self.table].filter(self.rule()) if self.rule else self.frame(tables)


@dataclass(frozen=True)
class Suite:
    checks: Sequence[Check]

    def of(self, domain: str) -> Suite:
        """The checks of one domain, numbered anew."""
        return Suite([c for c in self.checks if c.domain == domain])

    def run(self, tables: Tables) -> DataFrame:
        """number (place in the suite, from 1), check_id, domain, severity, table_name, violations, base_rows, share, passed."""
        numbers = {c.check_id: i for i, c in enumerate(self.checks, 1)}
        if len(numbers) < len(self.checks):
            raise ValueError("check ids must differ")
        by_table: dict[str, list[Check]] = defaultdict(list)
        for c in self.checks:
            by_table[c.table].append(c)
        parts = []
        for table, checks in by_table.items():
            rules = [c for c in checks if c.rule]
            scan = tables[table].agg(
                F.count(F.lit(1)).alias("base_rows"), *[F.count_if(c.rule()).alias(f"v{i}") for i, c in enumerate(rules)]
            )
            empty = F.array().cast(ROWS)
            counted = F.array(*[_row(c, F.col(f"v{i}")) for i, c in enumerate(rules)]).cast(ROWS) if rules else empty
            parts.append(scan.select(F.lit(table).alias("table_name"), "base_rows", counted.alias("rows")))
            for c in checks:
                if c.frame:
                    own = c.frame(tables).agg(F.count(F.lit(1)).alias("n"))
                    row = F.array(_row(c, F.col("n"))).cast(ROWS).alias("rows")
                    parts.append(own.select(F.lit(table).alias("table_name"), F.lit(None).cast("bigint").alias("base_rows"), row))
        # One row per part; a handful of rows meet here.
        per_table = union_all(parts).groupBy("table_name").agg(
            F.max("base_rows").alias("base_rows"), F.flatten(F.collect_list("rows")).alias("rows")
        )
        number = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
        return per_table.select("table_name", "base_rows", F.inline("rows")).select(
            F.element_at(number, F.col("check_id")).alias("number"), "check_id", "domain", "severity", "table_name", "violations", "base_rows",
            ratio("violations", "base_rows").alias("share"), (F.col("violations") == 0).alias("passed"),
        )

    def write(self, tables: Tables, path: str) -> DataFrame:
        """The summary of ``run``, and the violations as Parquet files under ``path``.

        All rules of a table share one scan: ``path/rows/<table>`` has the rows that break a rule, with the rules in
        ``failed_checks``. ``path/checks/<check_id>`` has the violations of a frame check. The counts are observed as the
        rows pass by; the driver gets one number for each check.
        """
        counts: dict[str, int] = {}
        base: dict[str, int] = {}
        for table in dict.fromkeys(c.table for c in self.checks):
            rules, df = [c for c in self.checks if c.table == table and c.rule], tables[table]
            if not rules:
                base[table] = df.count()  # from the footers
                continue
            if FAILED in df.columns:
                raise ValueError(f"{table} has a column {FAILED}")
            seen = Observation()
            failed = F.filter(F.array(*[F.when(c.rule(), c.check_id) for c in rules]), lambda x: x.isNotNull())
            marked = df.withColumn(FAILED, failed)
            numbers = [F.count_if(F.array_contains(FAILED, c.check_id)).alias(f"v{i}") for i, c in enumerate(rules)]
            marked = marked.observe(seen, F.count(F.lit(1)).alias("base"), *numbers)
            marked.filter(F.size(FAILED) > 0).write.parquet(f"{path}/rows/{table}")
            base[table] = seen.get["base"]
            counts |= {c.check_id: seen.get[f"v{i}"] for i, c in enumerate(rules)}
        for c in self.checks:
            if c.frame:
                seen = Observation()
                c.frame(tables).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/checks/{c.check_id}")
                counts[c.check_id] = seen.get["n"]
        rows = [(i, c.check_id, c.domain, c.severity, c.table, counts[c.check_id], base[c.table]) for i, c in enumerate(self.checks, 1)]
        spark = next(iter(tables.values())).sparkSession
        summary = spark.createDataFrame(rows, "number int, check_id string, domain string, severity string, table_name string, violations long, base_rows long")
        return summary.withColumns({"share": ratio("violations", "base_rows"), "passed": F.col("violations") == 0})


#: Column of written rows that names the rules they break.
FAILED = "failed_checks"
ROWS = "array<struct<check_id: string, domain: string, severity: string, violations: bigint>>"


def _row(check: Check, violations: Column) -> Column:
    return F.struct(
        F.lit(check.check_id).alias("check_id"), F.lit(check.domain).alias("domain"),
        F.lit(check.severity).alias("severity"), violations.alias("violations"),
    )
