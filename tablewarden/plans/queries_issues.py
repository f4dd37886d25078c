"""Queries on ranking, narration, analytics, text checks and pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden import config
from tablewarden.operators import analytics, checks, narrate, rank, textqa
from tablewarden.operators.profile import profile_tables, table_sizes
from tablewarden.operators.snapshot import build_snapshot
from tablewarden.plans import datasets, oracle_views as o
from tablewarden.plans.queries_checks import DRIFT_RANKED, flat_issues, scratch
from tablewarden.plans.registry import DIRTY_META, dirty_issues, dirty_ranked, query, subset
from tablewarden.plans.triage import adhoc_triage, analyze, run_triage
from tablewarden.runtime import local_frame
from tablewarden.sources import stores

_LABEL = "CASE severity WHEN 'high' THEN 'Critical' WHEN 'medium' THEN 'Moderate' WHEN 'low' THEN 'Minor' ELSE 'Unknown' END"


def _case(key: str, table: dict[str, str], other: str) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items()) + f" ELSE {text(other)} END"


# ---- ranking ---------------------------------------------------------------------------

@query("missing_value_impact", f"{o.scored()} SELECT {o.COMMON}, bis AS impact_score FROM scored WHERE issue_type = 'missing_values' AND bis >= 0.05")
def missing_value_impact(spark, sf):
    """Which columns miss values, and how much does each matter?"""
    profile = profile_tables(datasets.dirty(spark, sf), DIRTY_META)
    ranked = rank.rank_issues(checks.null_issues(profile, DIRTY_META, "high"), table_sizes(profile))
    return flat_issues(ranked, "impact_score")


@query("bis_scores", f"""{o.scored()} SELECT issue_id, base_weight, severity_weight, round(density, 6) AS evidence_density,
round(criticality, 6) AS report_criticality, reports AS affected_reports, bis AS impact_score FROM scored""")
def bis_scores(spark, sf):
    _, profile, issues = dirty_issues(spark, sf)
    return rank.score_issues(issues, table_sizes(profile)).select(
        "issue_id", "base_weight", "severity_weight", F.round("evidence_density", 6).alias("evidence_density"),
        F.round("report_criticality", 6).alias("report_criticality"),
        F.array_join("affected_reports", ", ").alias("affected_reports"), "impact_score")


@query("bis_rank", f"{o.scored()} SELECT {o.COMMON}, bis AS impact_score, rnk AS rank FROM ranked")
def bis_rank(spark, sf):
    ranked = dirty_ranked(spark, sf)
    return flat_issues(ranked, "impact_score", F.col("rank").cast("long").alias("rank"))


@query("v1_v2_compare", f"""{o.scored()}, v AS (SELECT *, severity_weight * v1_weight * greatest(metric, 0.001) AS v1 FROM scored),
r AS (SELECT *, row_number() OVER (ORDER BY v1 DESC, tbl, issue_type, issue_id) AS r1, row_number() OVER (ORDER BY bis DESC, tbl, issue_type, issue_id) AS r2 FROM v)
SELECT issue_id, left(issue_type, 20) AS issue_type, round(v1, 4) AS v1_score, round(bis, 4) AS v2_score, r1 AS v1_rank, r2 AS v2_rank,
CASE WHEN r1 > r2 THEN '↑' WHEN r1 < r2 THEN '↓' ELSE '=' END || abs(r1 - r2) AS rank_change FROM r""")
def v1_v2_compare(spark, sf):
    _, profile, issues = dirty_issues(spark, sf)
    return rank.compare_scores(issues, table_sizes(profile))


@query("dedupe_issues", f"{o.issues('high')} SELECT {o.COMMON} FROM issues")
def dedupe_issues(spark, sf):
    """The same run listed twice collapses to one issue per type, table and columns."""
    _, _, issues = dirty_issues(spark, sf)
    again = issues.withColumn("issue_id", F.concat(F.col("issue_id"), F.lit("_again")))
    return flat_issues(rank.dedupe_issues(issues.unionByName(again)))


# ---- narration -------------------------------------------------------------------------

@query("explain", f"""{o.scored()} SELECT issue_id, issue_type, tbl AS "table", array_to_string(cols, ',') AS columns, severity,
{_case('issue_type', narrate.EXPLANATIONS, narrate.EXPLANATION_UNKNOWN)} AS business_explanation,
format('{{}} risk — {{:,}} affected records ({{:.1f}}% of table).', {_LABEL}, evidence_rows, metric * 100) AS risk_summary,
{_case('issue_type', narrate.ACTIONS, narrate.ACTION_UNKNOWN)} AS recommended_action FROM ranked""")
def explain(spark, sf):
    return narrate.explain(dirty_ranked(spark, sf)).withColumn("columns", F.array_join("columns", ","))


@query("prioritise", f"""{o.scored()} SELECT issue_id, rnk AS priority_rank, CASE severity WHEN 'high' THEN 'critical' WHEN 'medium' THEN 'high' ELSE 'medium' END AS urgency,
format('Ranked {{}} by Business Impact Score ({{:.2f}}). Severity: {{}}. Affects {{:,}} records.', rnk, bis, {_LABEL}, evidence_rows) AS priority_justification FROM ranked""")
def prioritise(spark, sf):
    return narrate.prioritise(dirty_ranked(spark, sf)).select(
        "issue_id", F.col("priority_rank").cast("long").alias("priority_rank"), "urgency", "priority_justification")


@query("merge_priorities", f"""{o.scored()} SELECT issue_id, CASE WHEN issue_type = 'missing_values' THEN 1 ELSE 999 END AS priority_rank,
CASE WHEN issue_type = 'missing_values' THEN 'critical' ELSE 'medium' END AS urgency FROM ranked""")
def merge_priorities(spark, sf):
    ranked = dirty_ranked(spark, sf)
    given = ranked.where("issue_type = 'missing_values'").select(
        "issue_id", F.lit(1).alias("priority_rank"), F.lit("critical").alias("urgency"), F.lit("asked for").alias("priority_justification"))
    return narrate.merge_priorities(ranked, given).select("issue_id", "priority_rank", "urgency")


def _fix_case(table: dict[str, str], other: str) -> str:
    text = _case("CASE WHEN issue_type = 'duplicate_rows' AND len(cols) > 0 THEN 'duplicate_rows_by_key' ELSE issue_type END", table, other)
    col = "coalesce(cols[1], 'your_column')"
    keys = "CASE WHEN len(cols) > 0 THEN '[''' || array_to_string(cols, ''', ''') || ''']' ELSE '' END"
    for mark, value in (("{v}", "tbl || '_fixed'"), ("{q}", "array_to_string(cols, ', ')"), ("{t}", "tbl"), ("{c}", col), ("{k}", keys),
                        ("{d}", "coalesce(nullif(dim_table, ''), 'dimension_table')"), ("{p}", "coalesce(nullif(dim_pk, ''), 'pk_column')")):
        text = f"replace({text}, '{mark}', {value})"
    return text


@query("fix_text", f"{o.scored()} SELECT issue_id, issue_type, {_fix_case(narrate.SQL_FIX, narrate.SQL_FIX_UNKNOWN)} AS sql_fix, "
       f"{_fix_case(narrate.PYTHON_FIX, narrate.PYTHON_FIX_UNKNOWN)} AS python_fix FROM ranked")
def fix_text(spark, sf):
    return narrate.fix_text(dirty_ranked(spark, sf))


@query("exec_summary", f"""{o.scored()}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE severity = 'high') AS c FROM ranked),
top AS (SELECT string_agg(array_to_string(list_transform(string_split(issue_type, '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')
  || ' in ' || tbl || ' affecting ' || format('{{:,}}', evidence_rows) || ' records.', '|' ORDER BY rnk) AS risks
  FROM (SELECT * FROM ranked WHERE severity = 'high' ORDER BY rnk LIMIT 3))
SELECT 'dirty' AS run_id, CASE WHEN n = 0 THEN 'excellent' WHEN c >= 3 THEN 'poor' WHEN c >= 1 THEN 'fair' ELSE 'good' END AS overall_data_health,
  coalesce(risks, '') AS top_risks, n AS total_issues, c AS critical_issues FROM s, top""")
def exec_summary(spark, sf):
    ranked = dirty_ranked(spark, sf).withColumn("run_id", F.lit("dirty"))
    runs = local_frame(spark, [("dirty",)], "run_id string")
    return narrate.executive_summary(ranked, runs).select(
        "run_id", "overall_data_health", F.array_join("top_risks", "|").alias("top_risks"), "total_issues", "critical_issues")


_GUIDE_COUNTS = {k: len(v) for k, v in narrate.GUIDE.items()}


@query("resolution_guide", f"""{o.scored()}, b(issue_type, body) AS (VALUES {", ".join(f"('{k}', {n})" for k, n in _GUIDE_COUNTS.items())})
SELECT rnk AS rank, issue_id, 14 + body AS n_lines, format('### Issue #{{}}: `{{}}` in `{{}}`', rnk, issue_type, tbl) AS title,
'**What is wrong**: ' || description AS wrong FROM ranked JOIN b USING (issue_type)""")
def resolution_guide(spark, sf):
    """Guide sections, folded to one row per issue: lines, title and what is wrong."""
    ranked = dirty_ranked(spark, sf)
    lines = narrate.resolution_lines(ranked)
    at = lambda n: F.max(F.when(F.col("line_no") == n, F.col("text")))
    return (lines.groupBy("rank").agg(F.count(F.lit(1)).alias("n_lines"), at(0).alias("title"), at(12).alias("wrong"))
            .join(ranked.select("rank", "issue_id"), "rank").withColumn("rank", F.col("rank").cast("long")))


@query("triage_report", f"""{o.scored()}, b(issue_type, body) AS (VALUES {", ".join(f"('{k}', {n})" for k, n in _GUIDE_COUNTS.items())})
SELECT 0 AS section, CAST(9 AS BIGINT) AS n_lines UNION ALL SELECT 1, CAST(sum(14 + body) AS BIGINT) FROM ranked JOIN b USING (issue_type) UNION ALL SELECT 2, 7""")
def triage_report(spark, sf):
    """The report written as Markdown, read back and folded to lines per section."""
    ranked = dirty_ranked(spark, sf)
    lines = narrate.report_lines(ranked, "injected", "high", ["profiler", "detector", "ranker"], {"profiler": 0.5})
    path = scratch(spark)
    stores.write_report(lines, path, "injected")
    stored = spark.read.option("wholetext", False).text(f"{path}/triage_report_injected")
    if stored.count() != lines.count():
        raise RuntimeError("the stored report differs from its lines")
    return lines.groupBy("section").agg(F.count(F.lit(1)).alias("n_lines"))


@query("adhoc_report", f"""{o.scored()}, b(issue_type, body) AS (VALUES {", ".join(f"('{k}', {n})" for k, n in _GUIDE_COUNTS.items())})
SELECT CAST(15 + sum(14 + body) AS BIGINT) AS n_lines FROM ranked JOIN b USING (issue_type)""")
def adhoc_report(spark, sf):
    return narrate.adhoc_report_lines(dirty_ranked(spark, sf)).agg(F.count(F.lit(1)).alias("n_lines"))


@query("issue_digest", f"""{o.scored()} SELECT issue_id, issue_type, tbl AS "table", array_to_string(cols, ',') AS columns, severity, round(metric, 4) AS metric,
evidence_rows, round(bis, 4) AS impact_score, 1.0 AS confidence, left(description, 200) AS description FROM ranked WHERE rnk <= 10""")
def issue_digest(spark, sf):
    return narrate.issue_digest(dirty_ranked(spark, sf)).withColumn("columns", F.array_join("columns", ","))


@query("schema_digest", f"""{o.scored()} SELECT tbl AS "table", coalesce(string_agg(DISTINCT c, ',' ORDER BY c), '') AS columns, any_value(table_rows) AS row_count
FROM (SELECT tbl, unnest(CASE WHEN len(cols) = 0 THEN [NULL] ELSE cols END) AS c FROM ranked) JOIN sizes USING (tbl) GROUP BY tbl""")
def schema_digest(spark, sf):
    _, profile, issues = dirty_issues(spark, sf)
    ranked = rank.rank_issues(issues, table_sizes(profile))
    return narrate.schema_digest(ranked, table_sizes(profile)).withColumn("columns", F.array_join("columns", ","))


# ---- analytics -------------------------------------------------------------------------

@query("issue_kpis", f"""{o.scored()} SELECT count(*) AS total_issues, count(*) FILTER (WHERE severity = 'high') AS high_issues,
count(*) FILTER (WHERE severity = 'medium') AS medium_issues, round(avg(bis), 4) AS avg_impact, 1.0 AS avg_confidence FROM ranked""")
def issue_kpis(spark, sf):
    return analytics.issue_kpis(dirty_ranked(spark, sf))


@query("filter_issues", f"{o.scored()} SELECT {o.COMMON} FROM ranked WHERE severity IN ('high', 'medium') AND issue_type IN ('numeric_outliers', 'missing_values')")
def filter_issues(spark, sf):
    return flat_issues(analytics.filter_issues(dirty_ranked(spark, sf), ("high", "medium"), ("numeric_outliers", "missing_values")))


@query("issue_listing", f"""{o.scored()} SELECT rnk AS rank, issue_id, issue_type, tbl AS "table", coalesce(nullif(array_to_string(cols, ', '), ''), 'n/a') AS columns,
upper(severity) AS severity, bis, 1.0 AS confidence, evidence_rows, description FROM ranked WHERE rnk <= 50""")
def issue_listing(spark, sf):
    return analytics.issue_listing(dirty_ranked(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query("issues_by_type", f"{o.scored()} SELECT issue_type, count(*) AS n_issues FROM ranked GROUP BY 1")
def issues_by_type(spark, sf):
    return analytics.issues_by_type(dirty_ranked(spark, sf))


@query("bis_by_table", f"""{o.scored()} SELECT tbl AS "table", round(sum(bis), 6) AS total_bis FROM ranked GROUP BY 1""")
def bis_by_table(spark, sf):
    return analytics.impact_by_table(dirty_ranked(spark, sf))


@query("needs_review_count", f"{o.scored()} SELECT count(*) FILTER (WHERE issue_type = 'duplicate_rows' AND len(cols) = 0) AS needs_review FROM ranked")
def needs_review_count(spark, sf):
    tables = datasets.dirty(spark, sf)
    return analytics.needs_review_count(run_triage(tables, DIRTY_META, with_drift=False).ranked)


# ---- text checks -----------------------------------------------------------------------

def _trim_sql(source: str, budget: int = config.CHAT_BUDGET_CHARS) -> str:
    return f"""SELECT conv_id, turn, role, text FROM (SELECT *, sum(length(text)) OVER w AS used, row_number() OVER w AS n FROM ({source})
WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, md5(text) DESC ROWS UNBOUNDED PRECEDING)) WHERE used <= {budget} OR n = 1"""


@query("chat_trim", _trim_sql("SELECT * FROM conversations"))
def chat_trim(spark, sf):
    return textqa.trim_conversations(datasets.read(spark, sf, "conversations")).select("conv_id", "turn", "role", "text")


@query("chat_trim_ties", _trim_sql("""SELECT conv_id % 3 AS conv_id, CASE WHEN turn % 5 <> 0 THEN turn // 3 END AS turn, role,
  text || ' ' || conv_id || '/' || turn AS text FROM conversations""", 9000))
def chat_trim_ties(spark, sf):
    """A few long conversations whose turns repeat or are missing: newest by the hash of their texts, in blocks of 16."""
    talks = datasets.read(spark, sf, "conversations").selectExpr(
        "conv_id % 3 AS conv_id", "CASE WHEN turn % 5 <> 0 THEN turn DIV 3 END AS turn", "role",
        "text || ' ' || conv_id || '/' || turn AS text")
    return textqa.trim_conversations(talks, 9000, turns_per_block=16).select("conv_id", "turn", "role", "text")


def replies(spark, sf):
    """Assistant turns as responses that talk about issues, some of them wrongly."""
    k = F.col("turn") % 4
    said = (F.when(k == 1, "Fix `customer_id` in fact_orders: missing_values and duplicate_rows.")
            .when(k == 3, "Column `invented_col` shows numeric_outliers; see 'total_price': and `status`.")
            .otherwise("The load looks fine."))
    fence = F.when(F.col("conv_id") % 2 == 0, F.lit("\n```SQL\nSELECT 1;\n```\ntext\n```sql\n\n```")).otherwise(
        F.lit("\n```sql\nSELECT count(*)\nFROM fact_orders\n```"))
    return (datasets.read(spark, sf, "conversations").where("role = 'assistant'")
            .select("conv_id", "turn", F.concat(F.col("text"), F.lit("\n"), said, fence).alias("text")))


@query("sql_blocks", """SELECT conv_id, turn, 0 AS block_no, CASE WHEN conv_id % 2 = 0 THEN 'SELECT 1;' ELSE 'SELECT count(*)' || chr(10) || 'FROM fact_orders' END AS sql
FROM conversations WHERE role = 'assistant'""")
def sql_blocks(spark, sf):
    return textqa.sql_blocks(replies(spark, sf), "conv_id", "turn")


_REPLY_SQL = """r AS (SELECT conv_id || '-' || turn AS response_id, turn % 4 AS k, text || chr(10) || CASE turn % 4
  WHEN 1 THEN 'Fix `customer_id` in fact_orders: missing_values and duplicate_rows.'
  WHEN 3 THEN 'Column `invented_col` shows numeric_outliers; see ''total_price'': and `status`.' ELSE 'The load looks fine.' END
  || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '```SQL' || chr(10) || 'SELECT 1;' || chr(10) || '```' || chr(10) || 'text' || chr(10) || '```sql' || chr(10) || chr(10) || '```'
     ELSE chr(10) || '```sql' || chr(10) || 'SELECT count(*)' || chr(10) || 'FROM fact_orders' || chr(10) || '```' END AS text
  FROM conversations WHERE role = 'assistant')"""


@query("response_score", f"""{o.scored()}, {_REPLY_SQL},
ctx AS (SELECT list(DISTINCT issue_type) AS types, (SELECT list(DISTINCT x) FROM (SELECT lower(tbl) AS x FROM ranked UNION ALL SELECT lower(unnest(cols)) FROM ranked)) AS names FROM ranked),
top AS (SELECT lower(tbl) AS tbl, list_transform(cols, lambda c: lower(c)) AS cols FROM ranked WHERE rnk <= 5),
m AS (SELECT response_id, text, list_filter({list(config.ISSUE_TYPES)}, lambda t: contains(lower(text), t)) AS said,
  list_distinct(list_transform(list_filter(regexp_extract_all(text, '[`"''][a-zA-Z_][a-zA-Z0-9_]*[`"''](\\s*:)?'), lambda x: NOT regexp_matches(x, ':$')), lambda x: lower(x[2:-2]))) AS idents,
  (SELECT count(*) FROM top WHERE contains(lower(r.text), tbl) OR len(list_filter(cols, lambda c: contains(lower(r.text), c))) > 0) AS hit, (SELECT count(*) FROM top) AS n_top FROM r),
s AS (SELECT response_id, CASE WHEN len(said) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(said, types)) / len(said) END AS f,
  CASE WHEN len(idents) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(idents, names)) / len(idents) END AS sc, hit / n_top AS c FROM m, ctx),
t AS (SELECT *, round(f * 0.3::DOUBLE + sc * 0.4::DOUBLE + c * 0.2::DOUBLE + 0.1::DOUBLE, 4) AS total FROM s)
SELECT response_id, round(f, 4) AS factual_consistency_score, round(sc, 4) AS schema_compliance_score, round(c, 4) AS completeness_score, 1.0 AS confidence_score,
  total AS overall_score, total >= 0.7 AS passed, CASE WHEN total >= 0.7 THEN '' ELSE printf('Overall score %.2f is below threshold 0.70. [factual=%.2f schema=%.2f complete=%.2f conf=1.00]', total, f, sc, c) END AS failure_reason FROM t""")
def response_score(spark, sf):
    ranked = dirty_ranked(spark, sf)
    responses = replies(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), "text")
    return textqa.score_responses(responses, ranked, narrate.schema_digest(ranked))


@query("input_violations", "SELECT CAST(event_id AS VARCHAR) AS issue_id, format('unknown issue_type ''{}''', event_type) AS violation FROM events WHERE event_type <> 'error'")
def input_violations(spark, sf):
    """Events read as issues: only 'error' is renamed to a known type."""
    events = datasets.read(spark, sf, "events")
    issues = events.select(F.col("event_id").cast("string").alias("issue_id"),
                           F.when(F.col("event_type") == "error", "missing_values").otherwise(F.col("event_type")).alias("issue_type"))
    return textqa.input_violations(issues)


@query("allowed_names", f"{o.scored()} SELECT DISTINCT lower(x) AS name FROM (SELECT tbl AS x FROM ranked UNION ALL SELECT unnest(cols) FROM ranked)")
def allowed_names(spark, sf):
    return textqa.allowed_names(narrate.schema_digest(dirty_ranked(spark, sf)))


@query("code_idents", """WITH c AS (SELECT event_id, 'SELECT * FROM ' || event_type || ' JOIN fact_orders ON "Order_ID" = count(*)' AS sql_fix,
'df[''value''] = df["' || event_type || '_x"]' AS python_fix, event_type FROM events)
SELECT event_id, array_to_string(list_sort(CASE WHEN event_type = 'click' THEN ['click_x'] ELSE [event_type, event_type || '_x'] END), ',') AS unknown_names, false AS valid FROM c""")
def code_idents(spark, sf):
    """Code written from events, checked against known names."""
    events = datasets.read(spark, sf, "events")
    code = events.select(
        "event_id", F.format_string("SELECT * FROM %s JOIN fact_orders ON \"Order_ID\" = count(*)", F.col("event_type")).alias("sql_fix"),
        F.format_string("df['value'] = df[\"%s_x\"]", F.col("event_type")).alias("python_fix"))
    schema = local_frame(spark, [("fact_orders", ["order_id", "value"]), ("click", [])], "table string, columns array<string>")
    return (textqa.check_code(code, textqa.allowed_names(schema))
            .select("event_id", F.array_join("unknown_names", ",").alias("unknown_names"), "valid"))


# ---- pipelines -------------------------------------------------------------------------

_CONF = "CASE WHEN issue_type = 'duplicate_rows' AND len(cols) = 0 THEN 0.5 ELSE 1.0 END AS confidence"


@query("triage_dirty", f"{o.scored()} SELECT {o.COMMON}, bis AS impact_score, rnk AS rank, {_CONF} FROM ranked")
def triage_dirty(spark, sf):
    """Whole pipeline with inferred metadata, without a baseline."""
    ranked = run_triage(datasets.dirty(spark, sf), sensitivity="high").ranked
    return flat_issues(ranked, "impact_score", F.col("rank").cast("long").alias("rank"), "confidence")


@query("triage_drift", f"{o.scored()}, {DRIFT_RANKED} SELECT {o.COMMON}, bis AS impact_score, confidence FROM all_ranked WHERE issue_type <> 'empty_table'")
def triage_drift(spark, sf):
    """Pipeline on dirty tables against the snapshot of the clean ones."""
    names = ("fact_orders", "fact_lineitems", "fact_events", "dim_customers", "dim_parts", "dim_suppliers", "dim_users")
    snapshot = build_snapshot(subset(datasets.star(spark, sf), *names[:3]))
    ranked = run_triage(subset(datasets.dirty(spark, sf), *names), DIRTY_META, snapshot=snapshot).ranked
    return flat_issues(ranked, "impact_score", "confidence")


@query("triage_adhoc", f"{o.scored()} SELECT {o.COMMON}, bis AS impact_score, {_CONF} FROM ranked WHERE tbl IN ('fact_orders', 'dim_customers')")
def triage_adhoc(spark, sf):
    ranked = adhoc_triage(subset(datasets.dirty(spark, sf), "fact_orders", "dim_customers"))
    # issue ids count within a run; outlier ids agree because orders come first
    return flat_issues(ranked, "impact_score", "confidence")


@query("analyze", f"""{o.scored()} SELECT issue_id, {_case('issue_type', narrate.ACTIONS, narrate.ACTION_UNKNOWN)} AS recommended_action,
(SELECT CASE WHEN count(*) FILTER (WHERE severity = 'high') >= 3 THEN 'poor' WHEN count(*) FILTER (WHERE severity = 'high') >= 1 THEN 'fair' ELSE 'good' END FROM ranked) AS overall_data_health FROM ranked""")
def analyze_dirty(spark, sf):
    _, explained, summary = analyze(datasets.dirty(spark, sf), meta=DIRTY_META)
    health = summary.first()["overall_data_health"]
    return explained.select("issue_id", "recommended_action", F.lit(health).alias("overall_data_health"))
