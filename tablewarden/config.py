"""Thresholds, weights and lookup tables of the triage rules."""

from __future__ import annotations

# Null fraction at or above which a column is reported.
NULL_LIMIT_KEY = 0.01
NULL_LIMIT_OTHER = 0.05
NULL_LIMIT_HIGH_SENSITIVITY = 0.01

# Smallest reported share of excess copies.
DUPLICATE_MIN_SHARE = {"normal": 0.01, "high": 0.005}

# Outlier fences and smallest reported share.
IQR_MULTIPLIER = {"normal": 3.0, "high": 1.5}
OUTLIER_MIN_SHARE = {"normal": 0.01, "high": 0.005}
MIN_ROWS_FOR_STATS = 20
MIN_REFERENCE_POINTS = 10

# Dates after this are sentinels, whatever the sensitivity.
FUTURE_CUTOFF_INT = 20500101
FUTURE_CUTOFF_DATE = "2050-01-01"

# Severity bands over the affected share of rows.
SEVERITY_HIGH_FROM = 0.05
SEVERITY_MEDIUM_FROM = 0.01

# Drift.
PSI_AMBER = 0.10
PSI_RED = 0.25
KS_ALPHA = 0.05
KS_HIGH_BELOW = 0.01
SNAPSHOT_PROBS = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
SNAPSHOT_TOP_VALUES = 50
SNAPSHOT_BINS = 20
REFERENCE_POINTS = 1000
PSI_BINS = 10
PSI_EMPTY_SHARE = 1e-4

# Verification.
REVIEW_BELOW = 0.70
DRIFT_CONFIDENCE = 0.80
FALLBACK_CONFIDENCE = 0.50

# Business Impact Score.
TYPE_WEIGHTS = {
    "referential_integrity_break": 4.0,
    "duplicate_rows": 3.5,
    "empty_table": 3.0,
    "numeric_outliers": 2.8,
    "statistical_drift": 2.5,
    "missing_values": 2.3,
    "invalid_future_dates": 2.1,
}
TYPE_WEIGHT_UNKNOWN = 1.5
SEVERITY_WEIGHTS = {"high": 3.0, "medium": 2.0, "low": 1.0}
SEVERITY_WEIGHT_UNKNOWN = 1.0
REPORT_SCORES = {
    "daily sales summary": 1.00,
    "daily_sales_summary": 1.00,
    "promotion performance": 0.90,
    "sales by store": 0.85,
    "sales by product category": 0.85,
    "inventory replenishment": 0.80,
    "top products": 0.70,
    "customer segmentation": 0.65,
}
REPORT_SCORE_TOTAL = 6.75
REPORT_SCORE_UNKNOWN = 0.3
REPORT_SCORE_NO_MAPPING = 0.5
NOISE_FLOOR = 0.05
REPORTS_BY_TYPE = {
    "missing_values": ["sales by store", "sales by product category"],
    "duplicate_rows": ["daily sales summary", "top products"],
    "numeric_outliers": ["daily sales summary", "promotion performance"],
    "invalid_future_dates": ["daily sales summary"],
    "referential_integrity_break": ["sales by store", "sales by product category"],
    "statistical_drift": ["daily sales summary", "promotion performance"],
    "empty_table": ["daily sales summary"],
}

# The earlier linear score, kept for side-by-side comparison.
V1_TYPE_WEIGHTS = {
    "referential_integrity_break": 3.0,
    "duplicate_rows": 2.8,
    "numeric_outliers": 2.6,
    "missing_values": 2.3,
    "invalid_future_dates": 2.1,
}
V1_TYPE_WEIGHT_UNKNOWN = 1.0
V1_METRIC_FLOOR = 0.001

# Column meaning from names.
KEY_SUFFIXES = ("_id", "_sk", "_key")
NAME_NOISE = ("normalized", "denormalized", "injected")
PROMO_WORDS = ("promo", "campaign", "discount")

# Which ground-truth types a predicted type may stand for.
TRUTH_TYPES = {
    "missing_values": ["missing_key_values", "dimension_missing_values"],
    "duplicate_rows": ["duplicate_transactions"],
    "numeric_outliers": ["numeric_outliers"],
    "invalid_future_dates": ["invalid_future_dates"],
    "referential_integrity_break": ["referential_integrity_break"],
    "statistical_drift": ["promotion_drift"],
}

# Issue-id prefixes.
ID_PREFIX = {
    "missing_values": "DNULL_",
    "duplicate_rows": "DDUP_",
    "numeric_outliers": "DOUT_",
    "invalid_future_dates": "DDATE_",
    "referential_integrity_break": "DFK_",
    "statistical_drift": "DRIFT_",
}

ISSUE_TYPES = tuple(TYPE_WEIGHTS)

# Text QA.
RESPONSE_MIN_SCORE = 0.70
RESPONSE_TOP_ISSUES = 5
DIGEST_ISSUES = 10
DIGEST_DESCRIPTION_CHARS = 200
CHAT_BUDGET_CHARS = 24_000
CODE_BUILTINS = (
    "rowid", "null", "true", "false", "current_date", "current_timestamp",
    "avg", "sum", "count", "min", "max", "stddev_pop", "stddev",
    "information_schema", "tables",
)

# Cell texts a CSV reader takes as missing.
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Scale limits of this library (not rules of the triage).
#: Values inside one quantile bracket that a single window task may order.
BRACKET_ROWS = 200_000
#: Rows up to which a counted relation may be broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

# Fixed values of the text checks: patterns of names in prose, SQL and code, and the texts of a failed response.
QUOTED_NAME = r"[`\"']([a-zA-Z_][a-zA-Z0-9_]*)[`\"'](?!\s*:)"
QUOTED_SQL_NAME = r"[\"`]([a-zA-Z_][a-zA-Z0-9_]*)[\"`]"
SQL_TARGET = r"(?i)\b(?:FROM|JOIN|UPDATE|TABLE|INTO)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
FRAME_COLUMN = r"df\[['\"]([a-zA-Z_][a-zA-Z0-9_]*)['\"]\]"
RESPONSE_FAILED = "Overall score %.2f is below threshold %.2f. [factual=%.2f schema=%.2f complete=%.2f conf=%.2f]"
RESPONSE_EMPTY = "LLM returned an empty response."
