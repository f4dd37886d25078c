"""Text over issue tables: explanations, priorities, fixes, summaries, reports.

Everything is a column expression or a join with a small template table.  The issues are those of one run, a row per
column at most; only ``executive_summary`` takes several runs, by ``run_id``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden import config
from tablewarden.functions.scoring import lookup
from tablewarden.operators.rank import rank_order
from tablewarden.runtime import local_frame

SEVERITY_LABELS = {"high": "Critical", "medium": "Moderate", "low": "Minor"}
URGENCY = {"high": "critical", "medium": "high"}

EXPLANATIONS = {
    "missing_values": "The share of rows without a value is at or above the limit for this kind of column; keys and dates have the lower limit. "
                      "Evidence counts the rows without a value.",
    "duplicate_rows": "Groups of rows are equal in the key columns, or in all columns where no key is known. Evidence counts the rows beyond the "
                      "first of each group.",
    "numeric_outliers": "Values lie outside the quartile fences at the multiplier of the chosen sensitivity. Evidence counts these values; rows "
                        "without a value are never among them.",
    "invalid_future_dates": f"Values are later than the cutoff {config.FUTURE_CUTOFF_DATE}, which no real event reaches. Evidence counts them.",
    "referential_integrity_break": "Key values of this column have no row in the dimension that it refers to. Evidence counts the rows that hold such "
                                   "a key; rows without a key are not among them.",
    "empty_table": "The table can be read and holds zero rows, so no other check could run on it.",
    "statistical_drift": "Against the snapshot, the column passes a limit on population stability, or its distribution differs more than chance "
                         "allows (PSI and the KS test). Missing values and rare categories are not part of this test.",
}
EXPLANATION_UNKNOWN = "No rule of this library has this type."
ACTIONS = {
    "missing_values": "Run null_rate, then one of fill_mean, fill_sentinel, drop_missing and flag_missing.",
    "duplicate_rows": "Run duplicate_rows to see the groups, then dedupe_on_key or dedupe_rows.",
    "numeric_outliers": "Run outlier_bounds and extreme_values, then one of winsorise, drop_outliers and keep_inside.",
    "invalid_future_dates": "Run future_values, then one of null_future, open_end_future and drop_future.",
    "referential_integrity_break": "Run orphan_values, then one of drop_orphans, add_placeholder_dimension and null_orphans.",
    "empty_table": "Put require_rows behind the job that loads the table, and load it again.",
    "statistical_drift": "Run drift_stats against the baseline; build a new snapshot if the change is meant.",
}
ACTION_UNKNOWN = "Run sample_rows on the table."


def _label() -> Column:
    return lookup(F.col("severity"), SEVERITY_LABELS, "Unknown")


def explain(issues: DataFrame) -> DataFrame:
    """Business explanation, risk sentence and action for every issue."""
    return issues.select(
        "issue_id", "issue_type", "table", "columns", "severity",
        lookup(F.col("issue_type"), EXPLANATIONS, EXPLANATION_UNKNOWN).alias("business_explanation"),
        F.format_string("%s risk — %,d affected records (%.1f%% of table).",
                        _label(), F.col("evidence_rows"), F.col("metric") * 100).alias("risk_summary"),
        lookup(F.col("issue_type"), ACTIONS, ACTION_UNKNOWN).alias("recommended_action"))


def prioritise(issues: DataFrame) -> DataFrame:
    """Priority by falling impact score, with urgency and a one-line reason."""
    place = F.row_number().over(Window.orderBy(*rank_order()))
    return (issues.withColumn("priority_rank", place)
            .withColumn("urgency", lookup(F.col("severity"), URGENCY, "medium"))
            .withColumn("priority_justification", F.format_string(
                "Ranked %d by Business Impact Score (%.2f). Severity: %s. Affects %,d records.",
                F.col("priority_rank"), F.col("impact_score"), _label(), F.col("evidence_rows"))))


def merge_priorities(issues: DataFrame, priorities: DataFrame) -> DataFrame:
    """Priorities given from outside, by issue id; issues without one go last."""
    given = priorities.select("issue_id", "priority_rank", "urgency", "priority_justification")
    return (issues.drop("priority_rank", "urgency", "priority_justification")
            .join(given, "issue_id", "left")
            .withColumn("priority_rank", F.coalesce("priority_rank", F.lit(999)))
            .withColumn("urgency", F.coalesce("urgency", F.lit("medium")))
            .withColumn("priority_justification", F.coalesce("priority_justification", F.lit("")))
            .orderBy("priority_rank", "issue_id"))


# --------------------------------------------------------------------------------------
# Fix text.  {t} table, {v} view of the fixed table, {c} first column, {k} all columns as a list, {q} all columns in SQL,
# {d} dimension, {p} its key.  SQL names are quoted where they have to be.
# --------------------------------------------------------------------------------------

_LATE = ("coalesce(coalesce(try_cast(cast({c} AS string) AS date), try_to_date(cast({c} AS string), 'yyyyMMdd')) > "
         f"DATE '{config.FUTURE_CUTOFF_DATE}', false)")
BY_KEY = "duplicate_rows_by_key"
SQL_FIX = {
    "missing_values": "CREATE OR REPLACE TEMP VIEW {v} AS SELECT * FROM {t} WHERE {c} IS NOT NULL;",
    "duplicate_rows": "CREATE OR REPLACE TEMP VIEW {v} AS SELECT DISTINCT * FROM {t};",
    BY_KEY: "CREATE OR REPLACE TEMP VIEW {v} AS SELECT * EXCEPT (copy_no) FROM "
            "(SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY {q}) AS copy_no FROM {t}) WHERE copy_no = 1;",
    "numeric_outliers": "SELECT t.* FROM {t} t CROSS JOIN (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {t}) b "
                        "WHERE t.{c} NOT BETWEEN b.m - 3 * b.s AND b.m + 3 * b.s;",
    "invalid_future_dates": "CREATE OR REPLACE TEMP VIEW {v} AS SELECT * EXCEPT ({c}), CASE WHEN NOT " + _LATE + " THEN {c} END AS {c} FROM {t};",
    "referential_integrity_break": "SELECT f.* FROM {t} f LEFT ANTI JOIN {d} d ON f.{c} = d.{p} WHERE f.{c} IS NOT NULL;",
    "empty_table": "SELECT count(*) AS row_count FROM {t};",
    "statistical_drift": "SELECT avg({c}) AS current_avg, stddev_pop({c}) AS current_std, "
                         "min({c}) AS current_min, max({c}) AS current_max FROM {t};",
}
SQL_FIX_UNKNOWN = "-- no standard fix for this issue type"
PYTHON_FIX = {
    "missing_values": "df = df.dropna(subset=['{c}'])",
    "duplicate_rows": "df = dedupe_rows(df)",
    BY_KEY: "df = df.dropDuplicates({k})",
    "numeric_outliers": "df = keep_inside(df, '{c}')",
    "invalid_future_dates": "df = null_future(df, '{c}')",
    "referential_integrity_break": "df = drop_orphans(df, '{c}', dim_df, '{p}')",
    "empty_table": "df = require_rows(df, '{t}')",
    "statistical_drift": "ks = two_sample_ks(baseline_df, df, ['{c}'], baseline_df.count() + df.count())",
}
PYTHON_FIX_UNKNOWN = "# no standard fix for this issue type"


def _dimension() -> tuple[Column, Column]:
    """Dimension table and key; read from the description where the issue does not carry them."""
    d, p = F.col("dim_table"), F.col("dim_pk")
    pattern = r"not found in (\w+)\.(\w+)"
    complete = (F.coalesce(d, F.lit("")) != "") & (F.coalesce(p, F.lit("")) != "")
    broken = F.col("issue_type") == "referential_integrity_break"
    read = lambda own, i, default: F.coalesce(
        F.nullif(F.when(complete | ~broken, own).otherwise(
            F.coalesce(F.nullif(F.regexp_extract("description", pattern, i), F.lit("")), own)), F.lit("")),
        F.lit(default))
    return read(d, 1, "dimension_table"), read(p, 2, "pk_column")


def _sql_name(name: Column) -> Column:
    """The name as SQL takes it: quoted unless it is a plain identifier."""
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), name).otherwise(
        F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


def _filled(text: Column, sql: Column | bool = False) -> Column:
    """The marks of a template filled in; in SQL names are quoted where they have to be."""
    d, p = _dimension()
    c = F.coalesce(F.get("columns", F.lit(0)), F.lit("your_column"))
    sql = F.lit(sql) if isinstance(sql, bool) else sql
    as_text = lambda x: F.when(sql, _sql_name(x)).otherwise(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")))
    listed = F.array_join(F.transform("columns", lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))), ", ")
    k = F.when(F.size("columns") > 0, F.concat(F.lit("["), listed, F.lit("]"))).otherwise("")
    q = F.array_join(F.transform("columns", _sql_name), ", ")
    marks = (("{v}", _sql_name(F.concat("table", F.lit("_fixed")))), ("{t}", as_text(F.col("table"))), ("{c}", as_text(c)), ("{k}", k), ("{q}", q),
             ("{d}", as_text(d)), ("{p}", as_text(p)))
    for mark, value in marks:
        text = F.replace(text, F.lit(mark), value)
    return text


def _kind() -> Column:
    """The issue type, with duplicates of a known key apart."""
    return F.when((F.col("issue_type") == "duplicate_rows") & (F.size("columns") > 0), BY_KEY).otherwise(F.col("issue_type"))


def fix_text(issues: DataFrame) -> DataFrame:
    """A Spark SQL statement and a PySpark line for every issue."""
    return issues.select(
        "issue_id", "issue_type",
        _filled(lookup(_kind(), SQL_FIX, SQL_FIX_UNKNOWN), sql=True).alias("sql_fix"),
        _filled(lookup(_kind(), PYTHON_FIX, PYTHON_FIX_UNKNOWN)).alias("python_fix"))


# --------------------------------------------------------------------------------------
# Executive summary
# --------------------------------------------------------------------------------------

SUMMARY_TEXT = {
    "excellent": "No data quality issues were found; the load is ready for reporting.",
    "poor": "%d issue(s) found, %d of them critical. Act before this data reaches a report.",
    "fair": "%d issue(s) found, %d of them critical. Review reports before they go out.",
    "good": "%d minor issue(s) found and none critical. Repairs can follow the normal schedule.",
}
SUMMARY_ACTIONS = {
    "excellent": ["Keep monitoring with the next load."],
    "poor": ["Hold back reports until the critical issues are solved.", "Tell the data engineers now.",
             "Review the jobs that load the affected tables."],
    "fair": ["Solve the critical issues before the next reporting cycle.", "Mark affected reports as under review."],
    "good": ["Plan repairs for the next sprint.", "Watch whether the issues return."],
}


def executive_summary(issues: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row per run: health, text, top three risks, actions.

    ``issues`` has ``run_id`` and ``rank``; ``runs`` adds the runs without any issue.
    """
    kind = F.initcap(F.replace("issue_type", F.lit("_"), F.lit(" ")))
    risk = F.struct("rank", F.format_string("%s in %s affecting %,d records.", kind, F.col("table"),
                                            F.col("evidence_rows")).alias("text"))
    high = F.col("severity") == "high"
    per_run = issues.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_issues"), F.count_if(high).alias("critical_issues"),
        F.slice(F.sort_array(F.collect_list(F.when(high, risk))), 1, 3).alias("risks"))
    if runs is not None:
        per_run = runs.select("run_id").distinct().join(per_run, "run_id", "left")
    n, c = F.coalesce("total_issues", F.lit(0)), F.coalesce("critical_issues", F.lit(0))
    health = F.when(n == 0, "excellent").when(c >= 3, "poor").when(c >= 1, "fair").otherwise("good")
    text = (F.when(n == 0, SUMMARY_TEXT["excellent"])
            .when(c >= 3, F.format_string(SUMMARY_TEXT["poor"], n, c))
            .when(c >= 1, F.format_string(SUMMARY_TEXT["fair"], n, c))
            .otherwise(F.format_string(SUMMARY_TEXT["good"], n)))
    return per_run.select(
        "run_id", health.alias("overall_data_health"), text.alias("executive_summary"),
        F.coalesce(F.transform("risks", lambda r: r["text"]), F.array().cast("array<string>")).alias("top_risks"),
        lookup(health, SUMMARY_ACTIONS).alias("recommended_actions"),
        n.alias("total_issues"), c.alias("critical_issues"))


# --------------------------------------------------------------------------------------
# Resolution guide and report, as ordered line tables
# --------------------------------------------------------------------------------------

_FENCE = "```"


def _block(title: str, *statements: str) -> list[str]:
    return [title, _FENCE + "sql", *statements, _FENCE, ""]


GUIDE: dict[str, list[str]] = {
    "referential_integrity_break": [
        "**Why it matters**: joins drop rows whose key has no match, and totals shrink without an error.", "",
        *_block("**Step 1: which keys are unknown**",
                "SELECT f.{c} AS invalid_fk_value, count(*) AS affected_rows FROM {t} f "
                "LEFT ANTI JOIN {d} d ON f.{c} = d.{p} WHERE f.{c} IS NOT NULL GROUP BY f.{c} "
                "ORDER BY affected_rows DESC LIMIT 20;"),
        *_block("**Option A: leave these rows out**",
                "SELECT * FROM {t} f WHERE f.{c} IS NULL OR EXISTS (SELECT 1 FROM {d} d WHERE d.{p} = f.{c});"),
        *_block("**Option B: add placeholder dimension rows**",
                "INSERT INTO {d} ({p}) SELECT DISTINCT f.{c} FROM {t} f LEFT ANTI JOIN {d} d ON f.{c} = d.{p} WHERE f.{c} IS NOT NULL;"),
        *_block("**Option C: clear the unknown keys**",
                "SELECT f.* EXCEPT ({c}), d.k AS {c} FROM {t} f LEFT JOIN (SELECT DISTINCT {p} AS k FROM {d}) d ON f.{c} = d.k;"),
    ],
    "duplicate_rows": [
        "**Why it matters**: every copy is counted again in revenue, transactions and activity.", "",
        *_block("**Step 1: how many copies**",
                "SELECT sum(n) AS total_rows, sum(n - 1) AS duplicate_rows FROM (SELECT count(*) AS n FROM {t} GROUP BY ALL);"),
        *_block("**Option A: keep one row per group**", "SELECT DISTINCT * FROM {t};"),
        "Prevention: make the load step idempotent on the business key.", "",
    ],
    BY_KEY: [
        "**Why it matters**: every copy is counted again in revenue, transactions and activity.", "",
        *_block("**Step 1: how many copies**",
                "SELECT sum(n) AS total_rows, sum(n - 1) AS duplicate_rows FROM (SELECT count(*) AS n FROM {t} GROUP BY {q});"),
        *_block("**Option A: keep one row per key**",
                "SELECT * EXCEPT (copy_no) FROM (SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY {q}) AS copy_no FROM {t}) WHERE copy_no = 1;"),
        "Prevention: make the load step idempotent on the business key.", "",
    ],
    "numeric_outliers": [
        "**Why it matters**: a few extreme values of `{c}` move averages, totals and alerts.", "",
        *_block("**Step 1: bounds**",
                "SELECT percentile(cast({c} AS double), array(0.25, 0.75)) AS quartiles, min({c}) AS min_val, "
                "max({c}) AS max_val, avg({c}) AS mean_val FROM {t};"),
        "**Option A**: cap at the fences with `winsorise(df, '{c}')`.",
        "**Option B**: remove the rows with `drop_outliers(df, '{c}')`.", "",
    ],
    "missing_values": [
        "**Why it matters**: missing `{c}` never joins and is left out of sums and averages.", "",
        *_block("**Step 1: how many**",
                "SELECT count(*) AS total_rows, count_if({c} IS NULL) AS null_count, "
                "round(100 * count_if({c} IS NULL) / count(*), 2) AS null_pct FROM {t};"),
        "**Option A**: fill with the mean, `fill_mean(df, '{c}')`.",
        "**Option B**: fill with a marker, `fill_sentinel(df, '{c}')`.",
        "**Option C**: drop the rows, `drop_missing(df, '{c}')`.",
        "**Option D**: keep the rows and mark them, `flag_missing(df, '{c}')`.", "",
    ],
    "invalid_future_dates": [
        "**Why it matters**: placeholder dates in `{c}` keep closed records open in every date filter.", "",
        *_block("**Step 1: which dates**",
                "SELECT {c}, count(*) AS row_count FROM {t} WHERE coalesce(try_cast(cast({c} AS string) AS date), "
                "try_to_date(cast({c} AS string), 'yyyyMMdd')) > DATE '2050-01-01' GROUP BY {c} ORDER BY {c};"),
        "**Option A**: clear them, `null_future(df, '{c}')`.",
        "**Option B**: use the open-end date, `open_end_future(df, '{c}')`.",
        "**Option C**: drop the rows, `drop_future(df, '{c}')`.", "",
    ],
    "statistical_drift": [
        "**Why it matters**: each value of `{c}` may be valid while the population has changed.", "",
        *_block("**Step 1: current distribution**",
                "SELECT count(*) AS row_count, min({c}) AS min_val, max({c}) AS max_val, avg({c}) AS mean_val, "
                "stddev({c}) AS std_val, median({c}) AS median_val FROM {t};"),
        "- Load error: repair the job, load again, run triage again.",
        "- Real change in the business: save a new snapshot.",
        "- Changed schema: update the metadata and save a new snapshot.", "",
    ],
    "empty_table": [
        "**Why it matters**: every report that joins `{t}` returns nothing.", "",
        *_block("**Step 1: confirm**", "SELECT count(*) AS row_count FROM {t};"),
        "- Is the source file or response empty?", "- Does the load log show filtered or failed records?",
        "- Are path and permissions right?", "- Run the load for this table again.", "",
    ],
}
GUIDE_UNKNOWN = [
    "**Why it matters**: this issue type has no standard guide.", "",
    *_block("**Look at the rows**", "SELECT * FROM {t} LIMIT 20;"),
]


def _guide_lines(spark) -> DataFrame:
    rows = [(kind, i, line) for kind, lines in {**GUIDE, "": GUIDE_UNKNOWN}.items()
            for i, line in enumerate(lines)]
    return local_frame(spark, rows, "guide string, line_no int, template string")


def resolution_lines(ranked: DataFrame) -> DataFrame:
    """Rows ``(rank, line_no, text)``: a field table and the steps for each issue."""
    guide = F.when(_kind().isin(*GUIDE), _kind()).otherwise("")
    listed = lambda c, none: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(none))
    head = F.array(
        F.format_string("### Issue #%d: `%s` in `%s`", F.col("rank"), F.col("issue_type"), F.col("table")),
        F.lit(""), F.lit("| Field | Value |"), F.lit("|---|---|"),
        F.format_string("| Priority | #%d |", F.col("rank")),
        F.format_string("| Severity | %s |", F.col("severity")),
        F.format_string("| Business Impact Score | %.4f |", F.col("impact_score")),
        F.format_string("| Confidence | %.2f |", F.col("confidence")),
        F.format_string("| Evidence rows | %,d |", F.col("evidence_rows")),
        F.format_string("| Affected reports | %s |", listed("affected_reports", "none")),
        F.format_string("| Columns | %s |", listed("columns", "n/a")),
        F.lit(""), F.format_string("**What is wrong**: %s", F.col("description")), F.lit(""))
    n_head = 14
    heads = ranked.select("rank", F.posexplode(head).alias("line_no", "text"))
    bodies = (ranked.withColumn("guide", guide)
              .join(F.broadcast(_guide_lines(ranked.sparkSession)), "guide")     # fixed templates
              .select("rank", (F.col("line_no") + n_head).alias("line_no"), _filled(F.col("template"), F.col("template").rlike("^(SELECT|INSERT|CREATE) ")).alias("text")))
    return heads.unionByName(bodies)


def report_lines(ranked: DataFrame, source: str, sensitivity: str, trace: Iterable[str] = (),
                 timing: Mapping[str, float] | None = None, title: str = "Data quality triage report",
                 n_issues: int | None = None, failures: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """The whole report as rows ``(section, rank, line_no, text)``; sort by the first three.

    ``failures`` are checks that did not come to an end, with their errors.
    """
    failures = list(failures)
    spark = ranked.sparkSession
    n = ranked.count() if n_issues is None else n_issues
    head = [f"# {title}", "", f"**Source**: `{source}` | **Sensitivity**: `{sensitivity}`",
            f"**Total issues detected**: {n}", ""]
    head += (["## Issues and resolution guide", "", f"> {n} issue(s), ranked by Business Impact Score.", ""]
             if n else ["No issues detected; all checks passed.", ""] if not failures else
             ["No issues detected by the checks that came to an end.", ""])
    if failures:
        head += ["## Failed checks", "", "> These checks did not come to an end; what they look for is not in this report.", "",
                 *(f"- `{check}`: {' '.join(error.split())[:300]}" for check, error in failures), ""]
    tail = ["## Steps", "", " → ".join(trace), "", "## Timing", ""]
    tail += [f"- `{step}`: {seconds:.3f}s" for step, seconds in (timing or {}).items()]
    fixed = [(0, 0, i, line) for i, line in enumerate(head)] + [(2, 0, i, line) for i, line in enumerate(tail)]
    return (local_frame(spark, fixed, "section int, rank int, line_no int, text string")
            .unionByName(resolution_lines(ranked).select(F.lit(1).alias("section"), "rank", "line_no", "text")))


def adhoc_report_lines(ranked: DataFrame, n_issues: int | None = None) -> DataFrame:
    return report_lines(ranked, "upload", "high", title="Upload data quality report", n_issues=n_issues)


# --------------------------------------------------------------------------------------
# Digests
# --------------------------------------------------------------------------------------

def issue_digest(issues: DataFrame, top: int = config.DIGEST_ISSUES) -> DataFrame:
    """The first issues with rounded numbers and a shortened description."""
    # rint works on the binary value; round would lift 0.10175 (stored just below) to 0.1018
    four = lambda c: (F.rint(F.col(c) * 10_000) / 10_000).alias(c)
    return (issues.orderBy("rank").limit(top).select(
        "issue_id", "issue_type", "table", "columns", "severity", four("metric"), "evidence_rows",
        four("impact_score"), four("confidence"),
        F.substring("description", 1, config.DIGEST_DESCRIPTION_CHARS).alias("description")))


def schema_digest(issues: DataFrame, sizes: Mapping[str, int] | None = None) -> DataFrame:
    """Tables named by issues, their sorted distinct columns and row counts."""
    known = local_frame(issues.sparkSession, list((sizes or {}).items()), "table string, row_count long")
    return (issues.where("table <> ''").select("table", F.explode_outer("columns").alias("column"))
            .groupBy("table").agg(F.sort_array(F.collect_set("column")).alias("columns"))
            .join(F.broadcast(known), "table", "left"))                      # a row per table
