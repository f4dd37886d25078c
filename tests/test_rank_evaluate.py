import collections
import math

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import analytics, evaluate, inject
from tablewarden.operators.metadata import infer_metadata
from tablewarden.operators.rank import (compare_scores, dedupe_issues, evidence_density, linear_score, rank_issues,
                                        report_criticality, score_issues)
from tablewarden.plans import triage
from tablewarden.plans.triage import evaluate_tables
from tablewarden.operators.snapshot import build_snapshot
from tablewarden.runtime import local_frame
from tablewarden.schemas import ISSUE, TRUTH


def issue(issue_id, kind="missing_values", table="fact_sales", columns=("customer_sk",), severity="high", metric=0.2, rows=20):
    return (issue_id, kind, table, list(columns), severity, metric, rows, "", "", "")


def frame(spark, *rows):
    return local_frame(spark, rows, ISSUE)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_density_and_criticality(spark):
    density = lambda e, n: one(spark, evidence_density(F.lit(e), F.lit(n)))
    assert density(10, 0) == 0 and density(0, 100) == 0 and 0 < density(50, 1000) < 1
    assert density(50, 1000) == pytest.approx(math.log1p(50) / math.log1p(1000))
    reports = lambda *r: one(spark, report_criticality(F.array(*map(F.lit, r)).cast("array<string>")))
    assert reports() == 0.5 and reports("unheard of") == pytest.approx(0.3 / 6.75)
    assert reports("sales by store", "sales by product category") == pytest.approx(1.7 / 6.75)


def test_scores(spark):
    drift = score_issues(frame(spark, issue("D", "statistical_drift", metric=0.4, rows=0)), {"fact_sales": 1000}).first()
    assert drift["evidence_density"] == 0.4 and drift["impact_score"] > 0
    empty = score_issues(frame(spark, issue("E", "empty_table", "empty_tbl", (), "high", 1.0, 0)), {"empty_tbl": 0}).first()
    assert empty["impact_score"] == pytest.approx(1.333333)
    unknown = score_issues(frame(spark, issue("U", "odd_type", severity="odd"))).first()
    assert (unknown["base_weight"], unknown["severity_weight"], unknown["report_criticality"]) == (1.5, 1.0, 0.5)
    assert unknown["evidence_density"] == pytest.approx(math.log1p(20) / math.log1p(200))
    assert "BIS = 1.50(base) × 1.00(sev)" in unknown["score_breakdown"]


def test_order_noise_and_comparison(spark):
    small = issue("A", severity="low", metric=0.0001, rows=1)
    large = issue("B", "duplicate_rows", severity="high", metric=0.1, rows=1000)
    ranked = rank_issues(frame(spark, small, large), {"fact_sales": 10_000}).collect()
    assert ranked[0]["issue_id"] == "B" and all(r["impact_score"] >= 0.05 for r in ranked)
    by_size = rank_issues(frame(spark, issue("S", "duplicate_rows", metric=0.01, rows=10), issue("L", "duplicate_rows", metric=0.1, rows=100)), {"fact_sales": 1000})
    assert [r["issue_id"] for r in by_size.orderBy("rank").collect()] == ["L", "S"]
    assert linear_score(frame(spark, large)).first()["v1_score"] == pytest.approx(3 * 2.8 * 0.1)
    moved = {r["issue_id"]: r["rank_change"] for r in compare_scores(frame(spark, small, large), {"fact_sales": 10_000}).collect()}
    assert moved == {"A": "=0", "B": "=0"}


def test_structural_dedupe_keeps_first(spark):
    assert [r["issue_id"] for r in dedupe_issues(frame(spark, issue("B"), issue("A"), issue("C", columns=("x",)))).orderBy("issue_id").collect()] == ["A", "C"]


def truth_rows(spark, *rows):
    full = [(i, k, t, list(c), 10, "high", "", "", {}) for i, k, t, c in rows]
    return evaluate.truth_positions(local_frame(spark, full, TRUTH))


def predictions(spark, *rows):
    full = [issue(f"P{n}", k, t, c) for n, (k, t, c) in enumerate(rows, 1)]
    df = frame(spark, *full).withColumn("rank", F.substring("issue_id", 2, 9).cast("int"))
    return evaluate.positions(df, "run")


@pytest.mark.parametrize("pred, truth, hit", [
    (("missing_values", "f", ("a",)), ("missing_key_values", "f", ("a",)), True),
    (("missing_values", "f", ("a",)), ("missing_key_values", "g", ("a",)), False),
    (("numeric_outliers", "f", ("a",)), ("promotion_drift", "f", ("a",)), False),
    (("numeric_outliers", "f", ("a",)), ("numeric_outliers", "f", ("b",)), False),
    (("numeric_outliers", "f", ("a", "b")), ("numeric_outliers", "f", ("b",)), True),
    (("duplicate_rows", "f", ()), ("duplicate_transactions", "f", ()), True),
    (("empty_table", "f", ()), ("empty_table", "f", ("a",)), True),
])
def test_match_rule(spark, pred, truth, hit):
    pairs = evaluate.match_pairs(predictions(spark, pred), truth_rows(spark, ("I1", *truth)))
    assert (pairs.count() == 1) == hit


def test_greedy_counts_each_truth_once(spark):
    preds = predictions(spark, *[("duplicate_rows", "f", ())] * 5)
    truth = truth_rows(spark, ("I1", "missing_key_values", "f", ("a",)), ("I2", "duplicate_transactions", "f", ()), ("I3", "promotion_drift", "f", ("p",)))
    row = evaluate.evaluation_metrics(preds, truth).first()
    assert row["summary_accuracy"] == 0.2 and row["top_5_recall"] == 0.3333
    assert (row["true_positives"], row["false_positives"], row["false_negatives"]) == (1, 4, 2)


def test_metrics_and_empty_run(spark):
    preds = predictions(spark, ("missing_values", "f", ("a",)), ("duplicate_rows", "f", ()), ("numeric_outliers", "f", ("a",)))
    truth = truth_rows(spark, ("I1", "missing_key_values", "f", ("a",)), ("I2", "duplicate_transactions", "f", ()))
    runs = local_frame(spark, [("run",), ("none",)], "run_id string")
    rows = {r["strategy"]: r for r in evaluate.evaluation_metrics(preds, truth, runs).collect()}
    run, none = rows["run"], rows["none"]
    assert (run["true_positives"], run["false_positives"], run["false_negatives"], run["precision"], run["recall"]) == (2, 1, 0, 0.6667, 1.0)
    assert (none["predicted_issues"], none["precision"], none["f1"], none["summary_accuracy"]) == (0, 0.0, 0.0, 0.0)


def retail(make, n=200):
    return {
        "dim_customers": make("customer_sk long, customer_name string", [(i, f"c{i}") for i in range(50)]),
        "dim_products": make("product_sk long, product_name string", [(i, f"p{i}") for i in range(30)]),
        "fact_sales": make("sales_sk long, sales_id string, customer_sk long, product_sk long, sales_date string, total_amount double",
                           [(i, f"s{i}", i % 50, i % 30, "2024-05-01", 100.0 + i % 17) for i in range(n)]),
    }


def test_injector_is_schema_aware_and_exact(make):
    clean = retail(make)
    injected, truth = inject.inject_issues(clean, seed=42)
    rows = {r["issue_type"]: r for r in truth.collect()}
    assert rows["missing_key_values"]["columns"] == ["sales_sk"]
    assert rows["referential_integrity_break"]["columns"] == ["customer_sk"]
    assert list(rows) == ["missing_key_values", "duplicate_transactions", "invalid_future_dates",
                          "referential_integrity_break", "numeric_outliers", "dimension_missing_values"]
    fact = injected["fact_sales"]
    assert fact.columns == clean["fact_sales"].columns and fact.count() == 204
    assert rows["duplicate_transactions"]["row_count"] == 4
    assert fact.where("customer_sk = 49 + 999").count() == rows["referential_integrity_break"]["row_count"] == 4
    assert fact.where("sales_date = '2099-01-01'").count() == 4 and fact.where("total_amount > 500").count() == 4
    assert injected["dim_customers"].where("customer_name IS NULL").count() == 1 == rows["dimension_missing_values"]["row_count"]
    again, _ = inject.inject_issues(clean, seed=42, keys={"fact_sales": "sales_id", "dim_customers": "customer_sk"})
    twice, _ = inject.inject_issues(clean, seed=42, keys={"fact_sales": "sales_id", "dim_customers": "customer_sk"})
    assert again["fact_sales"].exceptAll(twice["fact_sales"]).isEmpty()


def test_pick_is_exact_with_equal_hashes(make, monkeypatch):
    df = inject.with_row_id(make("k long", [(i,) for i in range(500)]), "k")
    monkeypatch.setattr(inject, "_BITS", 7)          # nearly all hashes collide
    for share, k in ((0.02, 10), (0.5, 250), (0.0001, 1)):
        hit, n = inject.pick_rows(df, share, 1)
        assert n == k
    monkeypatch.undo()
    hit, n = inject.pick_rows(df, 0.1, 3)
    assert df.where(hit).count() == n == 50
    assert inject.pick_rows(df.where("k < 0"), 0.1, 3)[1] == 0


def test_inject_triage_evaluate(make):
    clean = retail(make, 600)
    injected, truth = inject.inject_issues(clean, seed=7)
    result = {r["strategy"]: r for r in evaluate_tables(injected, truth, build_snapshot(clean)).collect()}
    assert set(result) == {"A_baseline", "B_supervisor", "C_full"}
    for row in result.values():
        assert row["error"] is None and row["precision"] == 1.0 and row["recall"] >= 0.75
    wide = evaluate.strategy_pivot(local_frame(truth.sparkSession, [("A", 1.0, 0.75)], "strategy string, precision double, recall double"), ["A", "B"])
    assert {r["metric"]: (r["A"], r["B"]) for r in wide.collect()} == {"precision": ("1.0000", "n/a"), "recall": ("0.7500", "n/a")}


def test_analytics(spark):
    rows = frame(spark, issue("A"), issue("B", "duplicate_rows", "t", (), "medium", 0.02, 5), issue("C", severity="low", metric=0.001, rows=9))
    ranked = rank_issues(rows, {"fact_sales": 100, "t": 50}, noise_floor=None).withColumn(
        "confidence", F.when(F.col("issue_id") == "B", 0.5).otherwise(1.0))
    kpis = analytics.issue_kpis(ranked).first()
    assert (kpis["total_issues"], kpis["high_issues"], kpis["medium_issues"], kpis["avg_confidence"]) == (3, 1, 1, 0.83)
    assert analytics.needs_review_count(ranked).first()[0] == 1
    assert analytics.filter_issues(ranked).count() == 2
    assert analytics.filter_issues(ranked, ["low"], ["missing_values"]).count() == 1
    listing = analytics.issue_listing(ranked).collect()
    assert [r["rank"] for r in listing] == [1, 2, 3] and {r["columns"] for r in listing} == {"customer_sk", "n/a"}
    assert analytics.issues_by_type(ranked).first()["issue_type"] == "missing_values"
    assert analytics.impact_by_table(ranked).count() == 2
    assert analytics.issue_kpis(ranked.where("false")).first()["avg_impact"] == 0.0


def test_strategies_share_their_stages(make, monkeypatch):
    clean = {"fact_sale": make("sale_key long, amount double", [(i, float(i % 50)) for i in range(400)])}
    dirty = {"fact_sale": make("sale_key long, amount double", [(i % 300, None if i % 3 else 500.0) for i in range(400)])}
    runs = collections.Counter()

    def counting(module, name):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: runs.update([name]) or real(*a, **k))

    counting(triage.checks, "run_checks"), counting(triage.drift, "detect_drift"), counting(triage, "profile_tables"), counting(triage, "infer_metadata")
    truth = local_frame(next(iter(clean.values())).sparkSession, [], TRUTH)
    rows = evaluate_tables(dirty, truth, build_snapshot(clean), "high").collect()
    assert [r["strategy"] for r in rows] == sorted(triage.STRATEGIES) and all(r["error"] is None and r["wall_seconds"] > 0 for r in rows)
    assert runs == {"run_checks": 1, "detect_drift": 1, "profile_tables": 1, "infer_metadata": 1}
    alone = {n: triage.run_triage(dirty, None, "high", build_snapshot(clean), with_verification=v, with_drift=d).ranked for n, (v, d) in triage.STRATEGIES.items()}
    stages = triage.Stages(dirty, None, "high", build_snapshot(clean))
    for n, (v, d) in triage.STRATEGIES.items():
        shared = triage.run_triage(dirty, with_verification=v, with_drift=d, stages=stages)
        assert sorted(map(str, shared.ranked.collect())) == sorted(map(str, alone[n].collect()))
        assert set(shared.timing) == set(shared.trace) and ("drift_detector" in shared.trace) == d


def test_a_failing_stage_fails_only_who_needs_it(make, monkeypatch):
    tables = {"fact_sale": make("sale_key long, amount double", [(i, float(i)) for i in range(50)])}
    monkeypatch.setattr(triage.drift, "detect_drift", lambda *a: 1 / 0)
    truth = local_frame(next(iter(tables.values())).sparkSession, [], TRUTH)
    rows = {r["strategy"]: r["error"] for r in evaluate_tables(tables, truth, build_snapshot(tables)).collect()}
    assert rows["A_baseline"] is None and rows["B_supervisor"] is None and "division" in rows["C_full"]
