import datetime

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import investigate, narrate, repair, textqa
from tablewarden.runtime import local_frame
from tablewarden.schemas import ISSUE


@pytest.fixture
def sales(make):
    return (make("id long, fk long, x double, d string", [
                (1, 1, 1.0, "2024-01-01"), (2, 2, 2.0, "2099-01-01"), (3, 9, 3.0, "99999-bad"), (4, None, None, None),
                (5, 9, 4.0, "9999-06-01"), (6, 1, 100.0, "2024-02-01"), (6, 1, 100.0, "2024-02-01")]),
            make("pk long, name string", [(1, "a"), (2, "b"), (None, "c")]))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_reference_repairs(sales):
    fact, dim = sales
    assert ids(repair.drop_orphans(fact, "fk", dim, "pk")) == [1, 2, 4, 6, 6]
    assert repair.drop_orphans(fact, "fk", dim, "pk").columns == fact.columns
    nulled = repair.null_orphans(fact, "fk", dim, "pk")
    assert nulled.count() == 7 and nulled.where("fk IS NULL").count() == 3
    assert sorted(str(r["pk"]) for r in repair.add_placeholder_dimension(fact, "fk", dim, "pk").collect()) == ["1", "2", "9", "None"]
    assert ids(investigate.orphan_rows(fact, "fk", dim, "pk")) == [3, 5]
    assert [tuple(r) for r in investigate.orphan_values(fact, "fk", dim, "pk").collect()] == [(9, 2)]


def test_duplicates(sales, make):
    fact, _ = sales
    assert ids(repair.dedupe_rows(fact)) == [1, 2, 3, 4, 5, 6]
    df = make("k long, o long, v string", [(1, 2, "b"), (1, 1, "z"), (1, 1, "a"), (None, 5, "n"), (None, 4, "m")])
    assert sorted(map(tuple, repair.dedupe_on_key(df, ["k"], "o").collect()), key=str) == [(1, 1, "a"), (None, 4, "m")]
    rate = investigate.duplication_rate(fact).first()
    assert (rate["total_rows"], rate["duplicate_rows"], rate["dup_pct"]) == (7, 1, 14.29)
    shown = investigate.duplicate_rows(fact).collect()
    assert [(r["id"], r["occurrences"]) for r in shown] == [(6, 2), (6, 2)]
    assert investigate.duplicate_rows(make("a long", [(1,)] * 500)).count() == 20


def test_outlier_repairs(make):
    df = make("x double", [(float(v),) for v in [*range(1, 21), 500]] + [(None,)])
    low, high = 6.0 - 15.0, 16.0 + 15.0
    capped = [r["x"] for r in repair.winsorise(df, "x").collect()]
    assert max(v for v in capped if v is not None) == high and None in capped and len(capped) == 22
    assert repair.drop_outliers(df, "x").count() == 21 and repair.keep_inside(df, "x").count() == 20
    bounds = investigate.outlier_bounds(df, "x").first()
    assert (bounds["q1"], bounds["q3"], bounds["iqr"], bounds["max_val"]) == (6.0, 16.0, 10.0, 500.0)
    assert [r["x"] for r in investigate.extreme_values(df, "x").collect()] == [500.0]
    assert investigate.sigma_rows(df, "x").count() == 1
    empty = make("x double", [(None,)])
    assert investigate.outlier_bounds(empty, "x").first()["q1"] is None and repair.winsorise(empty, "x").count() == 1


def test_missing_value_repairs(sales):
    fact, _ = sales
    assert repair.fill_mean(fact, "x").where("id = 4").first()["x"] == pytest.approx(210 / 6)
    assert repair.fill_sentinel(fact, "d").where("id = 4").first()["d"] == "UNKNOWN"
    assert repair.drop_missing(fact, "x").count() == 6
    assert repair.flag_missing(fact, "x").where("x_is_null").count() == 1
    rate = investigate.null_rate(fact, "x").first()
    assert (rate["total_rows"], rate["null_count"], rate["null_pct"]) == (7, 1, 14.29)


def test_future_repairs(sales, make):
    fact, _ = sales
    texts = lambda df: {r["id"]: r["d"] for r in df.collect()}
    assert texts(repair.null_future(fact, "d"))[2] is None and texts(repair.null_future(fact, "d"))[3] == "99999-bad"
    opened = texts(repair.open_end_future(fact, "d"))
    assert opened[2] == "9999-12-31" and opened[5] == "9999-06-01" and opened[1] == "2024-01-01"
    assert ids(repair.drop_future(fact, "d")) == [1, 3, 4, 6, 6]
    assert [tuple(r) for r in investigate.future_values(fact, "d").collect()] == [("2099-01-01", 1), ("9999-06-01", 1)]
    typed = make("id int, day date, k int", [(1, datetime.date(2099, 1, 1), 20990101), (2, datetime.date(2020, 1, 1), 20200101)])
    assert {r["day"] for r in repair.open_end_future(typed, "day").collect()} == {datetime.date(9999, 12, 31), datetime.date(2020, 1, 1)}
    assert {r["k"] for r in repair.open_end_future(typed, "k").collect()} == {99991231, 20200101}


def test_require_rows(make):
    df = make("a long", [(1,)])
    assert repair.require_rows(df, "t") is df
    with pytest.raises(ValueError, match="table t is empty"):
        repair.require_rows(df.where("false"), "t")


def test_other_investigations(make):
    df = make("t long, x double", [(i, float(i)) for i in range(30)])
    d = investigate.distribution(df, "x").first()
    assert (d["row_count"], d["median_val"], d["std_val"]) == (30, 14.5, 8.8034)
    assert [r["t"] for r in investigate.recent_rows(df, "t", 2).collect()] == [29, 28]
    assert investigate.row_count(df).first()[0] == 30 and investigate.sample_rows(df).count() == 20
    assert investigate.drift_stats(df, "x").first()["current_max"] == 29.0


# ---- narration -------------------------------------------------------------------------

KINDS = ["missing_values", "duplicate_rows", "numeric_outliers", "invalid_future_dates",
         "referential_integrity_break", "empty_table", "statistical_drift", "odd_type"]


def ranked(spark, kinds=KINDS, severity="high"):
    rows = [(f"I{n}", k, "fact_sales", [] if k == "empty_table" else ["customer_sk"], severity, 0.125, 1234,
             "Column 'customer_sk' has 3 values not found in dim_customers.customer_sk." if k.startswith("ref") else f"about {k}", "", "")
            for n, k in enumerate(kinds, 1)]
    df = local_frame(spark, rows, ISSUE)
    return (df.withColumn("rank", F.substring("issue_id", 2, 3).cast("int"))
            .withColumn("impact_score", 2.0 - F.col("rank") / 10).withColumn("confidence", F.lit(1.0))
            .withColumn("affected_reports", F.array(F.lit("daily sales summary"))).withColumn("run_id", F.lit("r1")))


def test_explain_and_prioritise(spark):
    rows = {r["issue_type"]: r for r in narrate.explain(ranked(spark)).collect()}
    assert rows["missing_values"]["risk_summary"] == "Critical risk — 1,234 affected records (12.5% of table)."
    assert all(r["business_explanation"] and r["recommended_action"] for r in rows.values())
    assert rows["odd_type"]["recommended_action"] == narrate.ACTION_UNKNOWN
    first = narrate.prioritise(ranked(spark)).orderBy("priority_rank").first()
    assert first["issue_id"] == "I1" and first["urgency"] == "critical"
    assert first["priority_justification"] == "Ranked 1 by Business Impact Score (1.90). Severity: Critical. Affects 1,234 records."
    given = local_frame(spark, [("I3", 1, "high", "now")], "issue_id string, priority_rank int, urgency string, priority_justification string")
    merged = narrate.merge_priorities(ranked(spark), given).collect()
    assert merged[0]["issue_id"] == "I3" and merged[1]["priority_rank"] == 999 and merged[1]["urgency"] == "medium"


def test_fix_text_uses_the_dimension(spark):
    fixes = {r["issue_type"]: r for r in narrate.fix_text(ranked(spark)).collect()}
    assert "dim_customers d ON f.customer_sk = d.customer_sk" in fixes["referential_integrity_break"]["sql_fix"]
    assert fixes["missing_values"]["python_fix"] == "df = df.dropna(subset=['customer_sk'])"
    assert fixes["duplicate_rows"]["python_fix"] == "df = df.dropDuplicates(['customer_sk'])"
    assert fixes["odd_type"]["sql_fix"] == narrate.SQL_FIX_UNKNOWN
    bare = ranked(spark, ["referential_integrity_break"]).withColumn("description", F.lit("no hint"))
    assert "dimension_table d ON f.customer_sk = d.pk_column" in narrate.fix_text(bare).first()["sql_fix"]


def test_executive_summary(spark):
    summary = lambda df: narrate.executive_summary(df, local_frame(spark, [("r1",)], "run_id string")).first()
    poor = summary(ranked(spark))
    assert poor["overall_data_health"] == "poor" and len(poor["top_risks"]) == 3 and poor["critical_issues"] == 8
    assert poor["top_risks"][0] == "Missing Values in fact_sales affecting 1,234 records."
    assert summary(ranked(spark).where("false"))["overall_data_health"] == "excellent"
    assert summary(ranked(spark, KINDS[:1]))["overall_data_health"] == "fair"
    assert summary(ranked(spark, severity="low"))["overall_data_health"] == "good"


def test_report_and_digests(spark):
    lines = narrate.report_lines(ranked(spark), "injected", "normal", ["detector", "ranker"], {"detector": 1.5})
    text = [r["text"] for r in lines.orderBy("section", "rank", "line_no").collect()]
    assert "**Source**: `injected` | **Sensitivity**: `normal`" in text and "- `detector`: 1.500s" in text
    assert "### Issue #5: `referential_integrity_break` in `fact_sales`" in text
    assert any("LEFT ANTI JOIN dim_customers d" in t for t in text) and not any("{t}" in t for t in text)
    none = [r["text"] for r in narrate.report_lines(ranked(spark).where("false"), "clean", "high").collect()]
    assert "No issues detected; all checks passed." in none
    assert "# Upload data quality report" in [r["text"] for r in narrate.adhoc_report_lines(ranked(spark)).collect()]
    long = ranked(spark).withColumn("description", F.repeat(F.lit("x"), 300))
    assert {len(r["description"]) for r in narrate.issue_digest(long).collect()} == {200}
    digest = narrate.schema_digest(ranked(spark), {"fact_sales": 9}).first()
    assert (digest["table"], digest["columns"], digest["row_count"]) == ("fact_sales", ["customer_sk"], 9)


def test_generated_sql_parses_in_spark(spark, make):
    make("customer_sk long, x double", [(1, 1.0)]).createOrReplaceTempView("fact_sales")
    make("customer_sk long", [(1,)]).createOrReplaceTempView("dim_customers")
    texts = narrate.report_lines(ranked(spark), "a", "high").groupBy("rank").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    blocks = textqa.sql_blocks(texts, "rank").collect()
    assert len(blocks) >= 10
    for row in blocks:
        if not row["sql"].startswith("INSERT"):
            spark.sql(row["sql"].rstrip(";"))
    for row in narrate.fix_text(ranked(spark)).collect():
        if not row["sql_fix"].startswith(("--", "CREATE")):
            spark.sql(row["sql_fix"].rstrip(";"))


def test_fix_texts_do_what_repairs_do(spark, make):
    rows = [(1, 10, "20240101"), (1, 11, "20990101"), (2, None, None), (3, 99, "2051-02-03"), (None, 10, "soon")]
    df, dim = make("`a b` int, `f-k` int, day string", rows), make("pk int, x int", [(10, 1), (10, 2), (11, 1)])
    df.createOrReplaceTempView("`my table`")
    dim.createOrReplaceTempView("dim_x")

    def issue(kind, column):
        row = (f"I_{kind}", kind, "my table", [column], "high", 0.1, 3, "", "dim_x", "pk")
        return local_frame(spark, [row], ISSUE)

    def fixed(kind, column):
        text = narrate.fix_text(issue(kind, column)).first()
        spark.sql(text["sql_fix"].rstrip(";"))
        namespace = {"df": df, "dim_df": dim, **{n: getattr(repair, n) for n in ("null_future", "drop_orphans", "dedupe_rows", "keep_inside")}}
        exec(text["python_fix"], namespace)
        return sorted(map(str, spark.table("`my table_fixed`").select(df.columns).collect())), sorted(map(str, namespace["df"].collect()))

    for kind, column in (("invalid_future_dates", "day"), ("missing_values", "f-k")):
        by_sql, by_spark = fixed(kind, column)
        assert by_sql == by_spark
    by_sql, by_spark = fixed("duplicate_rows", "a b")
    assert len(by_sql) == len(by_spark) == 4
    text = narrate.fix_text(issue("referential_integrity_break", "f-k")).first()
    assert [r["f-k"] for r in spark.sql(text["sql_fix"].rstrip(";")).collect()] == [99]
    namespace = {"df": df, "dim_df": dim, "drop_orphans": repair.drop_orphans}
    exec(text["python_fix"], namespace)
    assert namespace["df"].count() == 4
    lines = [r["text"] for r in narrate.resolution_lines(issue("referential_integrity_break", "f-k").selectExpr(
        "*", "1 AS rank", "0.5D AS impact_score", "1.0D AS confidence", "array('r') AS affected_reports")).orderBy("line_no").collect()]
    options = [x.rstrip(";") for x in lines if x.startswith("SELECT")]
    assert spark.sql(options[1]).count() == 4 and spark.sql(options[2]).count() == 5      # kept rows; nothing is multiplied


# ---- text checks -----------------------------------------------------------------------

def test_response_scores(spark):
    issues = ranked(spark, ["missing_values"])
    schema = narrate.schema_digest(issues)
    texts = {"empty": "", "blank": " \n ", "good": "missing_values in `fact_sales`, column `customer_sk`.",
             "column": "missing_values in fact_sales, `invented_one` and `invented_two`", "type": "duplicate_rows in fact_sales `customer_sk`",
             "json": '{"table": "fact_sales", "column_name" : "customer_sk"}'}
    responses = local_frame(spark, list(texts.items()), "response_id string, text string")
    rows = {r["response_id"]: r for r in textqa.score_responses(responses, issues, schema).collect()}
    assert rows["good"]["overall_score"] == 1.0 and rows["good"]["passed"]
    assert not rows["empty"]["passed"] and rows["empty"]["overall_score"] == 0 == rows["blank"]["overall_score"]
    assert rows["column"]["schema_compliance_score"] == 0.0 and not rows["column"]["passed"]
    assert rows["type"]["factual_consistency_score"] == 0.0
    assert rows["json"]["schema_compliance_score"] == 1.0            # object keys are not claims
    assert rows["good"]["failure_reason"] == "" and rows["empty"]["failure_reason"] == rows["blank"]["failure_reason"] != ""
    assert rows["column"]["failure_reason"].startswith("Overall score 0.") and "schema=0.00" in rows["column"]["failure_reason"]


def test_code_and_input_checks(spark):
    schema = local_frame(spark, [("Fact_Sales", ["Amount"]), ("dim_x", None)], "table string, columns array<string>")
    names = textqa.allowed_names(schema)
    assert sorted(r[0] for r in names.collect()) == ["amount", "dim_x", "fact_sales"]
    code = local_frame(spark, [(1, "SELECT count(*) FROM fact_sales JOIN nowhere", "df['amount']"), (2, 'SELECT "amount", rowid FROM fact_sales', ""), (3, None, "df['ghost']")],
                       "id int, sql_fix string, python_fix string")
    rows = {r["id"]: r for r in textqa.check_code(code, names).collect()}
    assert rows[1]["unknown_names"] == ["nowhere"] and rows[2]["valid"] and rows[3]["unknown_names"] == ["ghost"]
    assert textqa.check_code(code, names.where("false")).where("NOT valid").isEmpty()
    issues = local_frame(spark, [("A", "missing_values"), ("B", "odd"), ("C", None)], "issue_id string, issue_type string")
    assert {r["issue_id"]: r["violation"] for r in textqa.input_violations(issues, schema).collect()} == {"B": "unknown issue_type 'odd'", "C": "missing issue_type"}
    assert textqa.input_violations(issues.where("false"), schema.where("false")).count() == 2


def test_sql_blocks(spark):
    f = "```"
    texts = {"none": "no code", "one": f"a\n{f}sql\nSELECT 1\n{f}", "two": f"{f}SQL\nSELECT 1;\n{f} x {f}sql\n SELECT\n2 \n{f}", "empty": f"{f}sql\n\n{f}", "other": f"{f}python\nx\n{f}"}
    rows = textqa.sql_blocks(local_frame(spark, list(texts.items()), "id string, text string"), "id").orderBy("id", "block_no").collect()
    assert [(r["id"], r["sql"]) for r in rows] == [("one", "SELECT 1"), ("two", "SELECT 1;"), ("two", "SELECT\n2")]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_trim_matches_a_walk_over_messages(spark, make, block):
    import random
    rng = random.Random(block)
    rows = [(c, t, "x" * rng.choice([0, 5, 40, 200])) for c in range(6) for t in range(rng.choice([1, 7, 300 if c == 0 else 20]))]
    rows.append((99, 0, "y" * 5000))
    budget, expected = 400, set()
    for conv in {r[0] for r in rows}:
        used, newest = 0, sorted((r for r in rows if r[0] == conv), key=lambda r: -r[1])
        kept = []
        for r in newest:
            if used + len(r[2]) > budget:
                break
            used += len(r[2])
            kept.append(r)
        expected |= {(r[0], r[1]) for r in kept or newest[:1]}
    got = textqa.trim_conversations(make("conv_id long, turn long, text string", rows), budget, block)
    assert {(r["conv_id"], r["turn"]) for r in got.collect()} == expected and got.columns == ["conv_id", "turn", "text"]


def test_trim_with_equal_and_missing_turns(make):
    """No block above its bound, and one defined answer."""
    import hashlib
    import random
    rng = random.Random(4)
    rows = [(c, None if c == 1 or rng.random() < 0.2 else rng.randint(0, 3), f"{i} " + "x" * rng.choice([0, 3, 30])) for i in range(900) for c in (rng.choice([0, 1, None]),)]
    expected = []
    for conv in (0, 1, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(r[2].encode()).hexdigest()), reverse=True)
        used = 0
        for k, r in enumerate(own):
            used += len(r[2])
            if used > 700 and k:
                break
            expected.append(r)
    messages = make("conv_id long, turn long, text string", rows)
    for block in (4, 32, 4096):
        got = textqa.trim_conversations(messages.withColumn("chars", F.lit("mine")), 700, block)
        assert got.columns == ["conv_id", "turn", "text", "chars"]
        assert sorted(map(str, ((r["conv_id"], r["turn"], r["text"]) for r in got.collect()))) == sorted(map(str, expected))
