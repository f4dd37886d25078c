import datetime

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import checks
from tablewarden.operators.metadata import infer_metadata
from tablewarden.operators.profile import profile_tables, table_sizes
from tablewarden.operators.verify import apply_decision, low_confidence, needs_review, verify_issues
from tablewarden.runtime import local_frame
from tablewarden.schemas import ISSUE, TableMeta


def prepared(tables):
    profile = profile_tables(tables)
    return profile, infer_metadata(tables, profile)


def by_column(issues):
    return {tuple(r["columns"]): r for r in issues.collect()}


def test_null_key_is_still_reported(make):
    keys = list(range(1, 951)) + list(range(1, 31)) + [None] * 20
    profile, meta = prepared({"fact_sales": make("sales_sk long, amount double", [(k, 1.0) for k in keys])})
    assert meta["fact_sales"].primary_keys == ()
    found = by_column(checks.null_issues(profile, meta, "normal"))
    assert found[("sales_sk",)]["evidence_rows"] == 20 and found[("sales_sk",)]["severity"] == "medium"
    assert found[("sales_sk",)]["description"] == "Column 'sales_sk' has 2.00% missing values."


def test_few_null_keys_pass(make):
    rows = [(None if i < 5 else i, 1.0) for i in range(1000)]
    profile, meta = prepared({"fact_sales": make("sales_sk long, amount double", rows)})
    assert by_column(checks.null_issues(profile, meta, "normal")) == {}


@pytest.mark.parametrize("nulls, sensitivity, fires", [(15, "normal", True), (9, "normal", False), (11, "high", True)])
def test_null_foreign_key_limits(make, nulls, sensitivity, fires):
    tables = {"dim_customers": make("customer_sk long", [(i,) for i in range(100)]),
              "fact_sales": make("sales_sk long, customer_sk long, amount double",
                                 [(i, None if i < nulls else i % 100, 1.0) for i in range(1000)])}
    profile, meta = prepared(tables)
    assert meta["fact_sales"].foreign_keys == {"customer_sk": ("dim_customers", "customer_sk")}
    assert (("customer_sk",) in by_column(checks.null_issues(profile, meta, sensitivity))) == fires


def test_full_row_duplicates_and_key_confidence(make):
    tables = {"fact_sales": make("sales_sk long, amount double", [(i, float(i)) for i in range(1, 6)] * 2)}
    profile, meta = prepared(tables)
    issue = checks.duplicate_issues(tables, profile, meta, "normal").first()
    assert issue["evidence_rows"] == 5 and issue["columns"] == [] and "no primary key" in issue["description"]
    on_key = {"fact_sales": TableMeta("fact", primary_keys=("sales_sk",))}
    keyed = checks.duplicate_issues(tables, profile, on_key, "normal")
    verified = verify_issues(tables, keyed, "normal").first()
    assert verified["sql_count"] == 5 and verified["confidence"] >= 0.95
    assert verify_issues(tables, local_frame(keyed.sparkSession, [issue], ISSUE), "normal").first()["confidence"] == 0.5


def test_missing_keys_count_as_copies_of_each_other(make):
    df = make("k long", [(None,)] * 4 + [(1,), (1,), (2,)])
    assert checks.excess_copies(df, ["k"]).first()["excess"] == 4     # 3 of the missing, 1 of key 1
    meta = {"t": TableMeta("fact", primary_keys=("k",))}
    issue = checks.duplicate_issues({"t": df}, profile_tables({"t": df}), meta, "high")
    assert verify_issues({"t": df}, issue).first()["sql_count"] == 5  # SQL leaves missing keys out


def test_hash_first_duplicates_agree(make, monkeypatch):
    df = make("a long, b string", [(1, "x")] * 400 + [(i, "y") for i in range(300)] + [(None, "z"), (None, "z")])
    plain = sorted(map(tuple, checks.repeated_groups(df, ["a", "b"]).collect()), key=str)
    monkeypatch.setattr(checks, "HASH_FIRST_ROWS", 10)
    hashed = sorted(map(tuple, checks.repeated_groups(df, ["a", "b"], 702).collect()), key=str)
    monkeypatch.setattr(checks.config, "BROADCAST_ROWS", 0)
    shuffled = sorted(map(tuple, checks.repeated_groups(df, ["a", "b"], 702).collect()), key=str)
    assert plain == hashed == shuffled and len(plain) == 2


def outlier_tables(make):
    values = [0] * 25 + [10] * 25 + [30] * 10 + [100] * 5
    return {"fact_sales": make("fact_sales string, amount int", [("r", v) for v in values])}


@pytest.mark.parametrize("sensitivity, hits", [("high", 15), ("normal", 5)])
def test_outliers_by_sensitivity(make, sensitivity, hits):
    tables = outlier_tables(make)
    profile, meta = prepared(tables)
    issues = checks.outlier_issues(tables, profile, meta, sensitivity)
    assert by_column(issues)[("amount",)]["evidence_rows"] == hits
    assert verify_issues(tables, issues, sensitivity).first()["confidence"] == 1.0
    other = "normal" if sensitivity == "high" else "high"
    assert verify_issues(tables, issues, other).first()["confidence"] < 1.0


def test_outlier_recount_with_certified_quartiles(make, monkeypatch):
    tables = outlier_tables(make)
    profile, meta = prepared(tables)
    issues = checks.outlier_issues(tables, profile, meta, "high")
    from tablewarden.operators import verify
    assert verify_issues(tables, issues, "high").first()["sql_count"] == 15
    wrong = {"amount": {0.25: 50.0, 0.75: 60.0}}
    monkeypatch.setattr(verify, "exact_quantiles", lambda *a, **k: wrong)
    row = verify_issues(tables, issues, "high").first()
    assert row["confidence"] == 0.5 and row["sql_count"] == 15       # certificate fails, fallback


def test_broken_reference_without_dimension_falls_back(make):
    tables = outlier_tables(make)
    row = ("DFK_0001", "referential_integrity_break", "fact_sales", ["amount"], "high", 0.1, 3, "", "", "")
    issue = local_frame(tables["fact_sales"].sparkSession, [row], ISSUE)
    assert verify_issues(tables, issue).first()["confidence"] == 0.5


def test_future_dates_in_text(make):
    rows = [(i, "2099-01-01" if i < 10 else "2024-02-19T15:28:02", 1.0) for i in range(200)]
    tables = {"fact_sales": make("sales_sk long, sales_date string, amount double", rows)}
    profile, meta = prepared(tables)
    assert meta["fact_sales"].date_cols == ("sales_date",)
    issues = checks.future_date_issues(profile, meta)
    assert issues.first()["evidence_rows"] == 10
    assert verify_issues(tables, issues).first()["confidence"] == 1.0


def test_future_date_layouts(make):
    text = ["20990101", "2099-01-01T10:00:00+02:00", "2049-12-31", "2050-01-01", "2050-01-02", "soon", None]
    df = make("day_text string, date_key int, at date", [
        (t, k, d) for t, k, d in zip(text, [20990101, 20500101, 20500102, None, 1, 2, 3],
                                     [datetime.date(2099, 1, 1), datetime.date(2050, 1, 1)] + [None] * 5)])
    rows = {r["column"]: r["n_future"] for r in profile_tables({"t": df}).collect()}
    assert rows["day_text"] == 3 and rows["date_key"] == 2
    dated = df.withColumnRenamed("at", "at_date")
    assert {r["column"]: r["n_future"] for r in profile_tables({"t": dated}).collect()}["at_date"] == 1


def test_broken_references_with_a_hot_key(make):
    rows = [(999,)] * 400 + [(i % 7,) for i in range(600)] + [(None,)] * 50
    tables = {"fact_sales": make("store_sk long", rows), "dim_stores": make("store_sk long", [(i,) for i in range(6)])}
    profile, meta = prepared(tables)
    issues = checks.reference_issues(tables, profile, meta)
    row = issues.first()
    assert row["evidence_rows"] == 400 + 85 and (row["dim_table"], row["dim_pk"]) == ("dim_stores", "store_sk")
    assert verify_issues(tables, issues).first()["confidence"] == 1.0


def test_references_compare_as_text_when_types_differ(make):
    tables = {"fact_sales": make("store_id string", [("1",), ("2",), ("9",)]), "dim_stores": make("store_sk long", [(1,), (2,)])}
    meta = {"fact_sales": TableMeta("fact", foreign_keys={"store_id": ("dim_stores", "store_sk")}),
            "dim_stores": TableMeta("dimension", primary_keys=("store_sk",))}
    issues = checks.reference_issues(tables, profile_tables(tables), meta)
    assert issues.first()["evidence_rows"] == 1
    assert verify_issues(tables, issues).first()["sql_count"] == 1


def test_empty_table_and_failing_check(make, monkeypatch):
    tables = {"empty_tbl": make("col_a long", []), "orders": make("id long, amount double", [(i, 1.0) for i in range(20)] + [(i, 1.0) for i in range(10)])}
    profile, meta = prepared(tables)

    def broken(*_):
        raise RuntimeError("broken check")
    monkeypatch.setitem(checks.CHECKS, "numeric_outliers", broken)
    issues, failures = checks.run_checks(tables, meta, "high", profile)
    types = {r["issue_type"]: r for r in issues.collect()}
    assert set(types) == {"empty_table", "duplicate_rows"} and failures == [("numeric_outliers", "broken check")]
    assert types["empty_table"]["issue_id"] == "EMPTY_EMPTY_TBL" and types["duplicate_rows"]["evidence_rows"] == 10


def test_review_gate(make):
    spark = make("x int", [(1,)]).sparkSession
    rows = [(i, "missing_values", "t", [], "low", 0.1, 1, "", "", "") for i in ("DNULL_0001", "DNULL_0002")]
    verified = local_frame(spark, rows, ISSUE).withColumn("confidence", F.when(F.col("issue_id") == "DNULL_0001", 0.5).otherwise(1.0))
    assert verified.agg(needs_review(verified)).first()[0] is True
    assert low_confidence(verified).first()["prompt"] == "[DNULL_0001] missing_values in t - confidence=0.50, evidence_rows=1"
    assert apply_decision(verified, "approve all").count() == 2
    assert [r["issue_id"] for r in apply_decision(verified, "reject dnull_0001").collect()] == ["DNULL_0002"]
    assert apply_decision(verified, "reject DNULL_0001, DNULL_0002").count() == 0
