"""All registered queries."""

from tablewarden.plans import queries_checks, queries_issues, queries_repair, queries_sources  # noqa: F401 - fill the registry
from tablewarden.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
