"""KPI registry. Dashboards define VTR and VCR in several ways, so every definition has its own id."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kpi:
    name: str
    numerator: str
    denominator: str
    scale: float = 1.0

    def column(self) -> Column:
        """Null when the denominator is zero."""
        scaled = "" if self.scale == 1.0 else f"{self.scale}D * "
        return F.expr(f"try_divide({scaled}CAST({self.numerator} AS DOUBLE), CAST({self.denominator} AS DOUBLE)) AS {self.name}")


# KPI definitions (id, numerator, denominator, scale).
_DEFINITIONS = (
    ("ctr", "clicks", "impressions", 100.0),
    ("ctr_fraction", "clicks", "impressions", 1.0),
    ("cpm_usd", "spend_usd", "impressions", 1000.0),
    ("cpm_lc", "spend_lc", "impressions", 1000.0),
    ("cpcv_usd", "spend_usd", "fully_played", 1.0),
    ("cpcv_lc", "spend_lc", "fully_played", 1.0),
    ("vtr_views", "views", "impressions", 1.0),
    ("vtr_views_pct", "views", "impressions", 100.0),
    ("vtr_completions", "fully_played", "impressions", 1.0),
    ("vtr_completions_pct", "fully_played", "impressions", 100.0),
    ("vcr_views", "fully_played", "views", 1.0),
    ("vcr_views_pct", "fully_played", "views", 100.0),
    ("vcr_impressions", "fully_played", "impressions", 1.0),
    ("vcr_impressions_pct", "fully_played", "impressions", 100.0),
    ("vcr25", "video_25", "views", 1.0),
    ("vcr50", "video_50", "views", 1.0),
    ("vcr75", "video_75", "views", 1.0),
    ("spend_pacing", "spend_usd", "budget_usd", 100.0),
)

REGISTRY: dict[str, Kpi] = {d[0]: Kpi(*d) for d in _DEFINITIONS}


def kpi_columns(names: Iterable[str]) -> list[Column]:
    return [REGISTRY[n].column() for n in names]


def measures_for(names: Iterable[str]) -> list[str]:
    """Measure columns the KPIs read, each once, in order of first use."""
    used: dict[str, None] = {}
    for n in names:
        used.setdefault(REGISTRY[n].numerator)
        used.setdefault(REGISTRY[n].denominator)
    return list(used)
