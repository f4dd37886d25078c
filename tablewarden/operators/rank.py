"""Business Impact Score and ranking of issue rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden import config
from tablewarden.functions.scoring import lookup
from tablewarden.runtime import local_frame


def evidence_density(evidence: Column, rows: Column) -> Column:
    return (F.when((rows <= 0) | (evidence <= 0), 0.0)
            .otherwise(F.log1p(evidence) / F.log1p(F.greatest(rows, evidence))))


def affected_reports(issue_type: Column) -> Column:
    return F.coalesce(lookup(issue_type, config.REPORTS_BY_TYPE), F.array().cast("array<string>"))


def report_criticality(reports: Column) -> Column:
    """Share of the highest possible report score, capped at 1."""
    score = lambda r: lookup(r, config.REPORT_SCORES, config.REPORT_SCORE_UNKNOWN)
    total = F.aggregate(reports, F.lit(0.0), lambda acc, r: acc + score(r))
    return (F.when(F.size(reports) == 0, config.REPORT_SCORE_NO_MAPPING)
            .otherwise(F.least(total / config.REPORT_SCORE_TOTAL, F.lit(1.0))))


def score_issues(issues: DataFrame, sizes: Mapping[str, int] | None = None) -> DataFrame:
    """Adds reports, the four factors, ``impact_score`` and its text breakdown."""
    if "affected_reports" not in issues.columns:
        issues = issues.withColumn("affected_reports", affected_reports(F.col("issue_type")))
    if "confidence" not in issues.columns:
        issues = issues.withColumn("confidence", F.lit(1.0))
    known = local_frame(issues.sparkSession, list((sizes or {}).items()), "table string, table_rows long")
    e = F.col("evidence_rows")
    rows = F.coalesce("table_rows", F.greatest(e * 10, F.lit(1)))
    scored = (issues.join(F.broadcast(known), "table", "left")      # a row per table
              .withColumn("base_weight", lookup(F.col("issue_type"), config.TYPE_WEIGHTS, config.TYPE_WEIGHT_UNKNOWN))
              .withColumn("severity_weight", lookup(F.col("severity"), config.SEVERITY_WEIGHTS, config.SEVERITY_WEIGHT_UNKNOWN))
              .withColumn("evidence_density",
                          F.when(e == 0, F.least(F.col("metric"), F.lit(1.0))).otherwise(evidence_density(e, rows)))
              .withColumn("report_criticality", report_criticality(F.col("affected_reports"))))
    raw = (F.col("base_weight") * F.col("severity_weight")
           * F.col("evidence_density") * F.col("report_criticality"))
    return (scored.withColumn("score_breakdown", F.format_string(
                "BIS = %.2f(base) × %.2f(sev) × %.4f(density) × %.4f(criticality) = %.4f",
                "base_weight", "severity_weight", "evidence_density", "report_criticality", raw))
            .withColumn("impact_score", F.round(raw, 6)).drop("table_rows"))


def rank_order() -> list[Column]:
    """Total order of issues; ties on the score are broken by place and id."""
    return [F.desc("impact_score"), F.asc("table"), F.asc("issue_type"), F.asc("issue_id")]


def rank_issues(issues: DataFrame, sizes: Mapping[str, int] | None = None,
                noise_floor: float | None = config.NOISE_FLOOR) -> DataFrame:
    """Issues by falling score with ``rank``; those under the noise floor are dropped."""
    scored = score_issues(issues, sizes)
    if noise_floor is not None:
        scored = scored.where(F.col("impact_score") >= noise_floor)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))


def linear_score(issues: DataFrame) -> DataFrame:
    """The earlier score: severity x type x metric."""
    return issues.withColumn(
        "v1_score",
        lookup(F.col("severity"), config.SEVERITY_WEIGHTS, config.SEVERITY_WEIGHT_UNKNOWN)
        * lookup(F.col("issue_type"), config.V1_TYPE_WEIGHTS, config.V1_TYPE_WEIGHT_UNKNOWN)
        * F.greatest(F.col("metric"), F.lit(config.V1_METRIC_FLOOR)))


def compare_scores(issues: DataFrame, sizes: Mapping[str, int] | None = None) -> DataFrame:
    """Both scores, both ranks, and how far each issue moved up or down."""
    both = linear_score(rank_issues(issues, sizes, noise_floor=None)).withColumnRenamed("rank", "v2_rank")
    v1 = F.row_number().over(Window.orderBy(F.desc("v1_score"), "table", "issue_type", "issue_id"))
    delta = F.col("v1_rank") - F.col("v2_rank")
    arrow = F.when(delta > 0, "↑").when(delta < 0, "↓").otherwise("=")
    return both.withColumn("v1_rank", v1).select(
        "issue_id", F.substring("issue_type", 1, 20).alias("issue_type"),
        F.round("v1_score", 4).alias("v1_score"), F.round("impact_score", 4).alias("v2_score"),
        "v1_rank", "v2_rank", F.concat(arrow, F.abs(delta).cast("string")).alias("rank_change"))


def dedupe_issues(issues: DataFrame, order: Column | None = None) -> DataFrame:
    """One issue per (type, table, columns): the first in ``order`` (issue id by default)."""
    place = Window.partitionBy("issue_type", "table", "columns").orderBy(
        order if order is not None else F.asc("issue_id"))
    return issues.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
