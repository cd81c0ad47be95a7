"""Query catalog: one entry per operator, bound to the given tables."""

from . import complete, keys, kpi, naming, reconcile, refs, rules, scope, sources, suite, text  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
