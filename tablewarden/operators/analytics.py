"""Figures over ranked issue tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden import config

_SHOWN = 50


def issue_kpis(issues: DataFrame) -> DataFrame:
    """Totals by severity, average score and confidence, issues waiting for review."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return issues.agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity") == "high").alias("high_issues"),
        F.count_if(F.col("severity") == "medium").alias("medium_issues"),
        zero(F.round(F.avg("impact_score"), 4)).alias("avg_impact"),
        zero(F.round(F.avg(F.coalesce("confidence", F.lit(1.0))), 2)).alias("avg_confidence"))


def needs_review_count(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.coalesce("confidence", F.lit(1.0)) < config.REVIEW_BELOW).alias("needs_review"))


def filter_issues(issues: DataFrame, severities: Iterable[str] = ("high", "medium"),
                  types: Iterable[str] = ()) -> DataFrame:
    """Issues of the given severities and, where any are named, types."""
    out = issues.where(F.col("severity").isin(*severities))
    types = list(types)
    return out.where(F.col("issue_type").isin(*types)) if types else out


def issue_listing(issues: DataFrame, top: int = _SHOWN) -> DataFrame:
    """The ranked list as shown to an analyst."""
    columns = F.coalesce(F.nullif(F.array_join("columns", ", "), F.lit("")), F.lit("n/a"))
    return (issues.orderBy("rank").limit(top).select(
        "rank", "issue_id", "issue_type", "table", columns.alias("columns"),
        F.upper("severity").alias("severity"), F.round("impact_score", 6).alias("bis"),
        F.round("confidence", 2).alias("confidence"), "evidence_rows", "description"))


def issues_by_type(issues: DataFrame) -> DataFrame:
    return (issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n_issues"))
            .orderBy(F.desc("n_issues"), "issue_type"))


def impact_by_table(issues: DataFrame) -> DataFrame:
    return (issues.groupBy("table").agg(F.round(F.sum("impact_score"), 6).alias("total_bis"))
            .orderBy(F.desc("total_bis"), "table"))
