import logging

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import narrate
from tablewarden.operators.inject import inject_issues
from tablewarden.operators.snapshot import build_snapshot
from tablewarden.plans import triage as pipelines
from tablewarden.sources import stores, tables as files
from test_rank_evaluate import retail


def test_folder_of_csv_files(spark, tmp_path):
    (tmp_path / "fact_sales_injected.csv").write_text('sale_id,amount,note,flag,none,when\n1,2.5,"a, b",True,,2024-01-01\n2,NA,N/A,False,,20240101\n')
    (tmp_path / "dim_products.csv").write_text("product_id,name\n7,x\n")
    (tmp_path / "zero.csv").write_text("")
    (tmp_path / "sales_denormalized.csv").write_text("a\n1\n")
    (tmp_path / "notes.txt").write_text("no table")
    found = files.load_folder(spark, str(tmp_path))
    assert list(found) == ["dim_products", "fact_sales"]
    assert dict(found["fact_sales"].dtypes) == {"sale_id": "bigint", "amount": "double", "note": "string", "flag": "boolean", "none": "double", "when": "string"}
    assert [tuple(r) for r in found["fact_sales"].orderBy("sale_id").collect()] == [(1, 2.5, "a, b", True, None, "2024-01-01"), (2, None, None, False, None, "20240101")]
    given = files.load_folder(spark, str(tmp_path), {"dim_products": "product_id int, name string"})
    assert given["dim_products"].dtypes[0][1] == "int"


def test_named_sources_and_replaced_folders(spark, make, tmp_path):
    folders = {"clean": str(tmp_path / "clean"), "injected": str(tmp_path / "injected")}
    with pytest.raises(ValueError, match="'clean' or 'injected'"):
        files.load_source(spark, "other", folders)
    with pytest.raises(FileNotFoundError):
        files.load_source(spark, "injected", folders)
    df = make("a long, b string", [(1, 'say "hi", ok'), (2, None)])
    files.write_tables({"old": df, "fact_a": df}, folders["clean"])
    files.write_tables({"fact_a": df}, folders["clean"])
    loaded = files.load_source(spark, "clean", folders)
    assert list(loaded) == ["fact_a"]
    assert sorted(map(tuple, loaded["fact_a"].collect())) == [(1, 'say "hi", ok'), (2, None)]
    files.write_tables({"fact_a": df}, folders["injected"], fmt="parquet")
    assert files.load_source(spark, "injected", folders)["fact_a"].count() == 2


def test_adhoc_files(spark, tmp_path):
    (tmp_path / "My Sales-2024.csv").write_text("id,name\n1,a\n")
    (tmp_path / "latin.csv").write_bytes("id,name\n1,caf\xe9\n".encode("latin-1"))
    (tmp_path / "header.csv").write_text("id,name\n")
    (tmp_path / "nothing.csv").write_text("")
    loaded, warnings = files.load_adhoc(spark, [str(tmp_path / n) for n in ("My Sales-2024.csv", "latin.csv", "header.csv", "nothing.csv", "absent.csv")])
    assert set(loaded) == {"my_sales_2024", "latin"} and loaded["latin"].first()["name"] == "café"
    assert len(warnings) == 3 and warnings[0] == "`header.csv` is empty — skipped." and warnings[1] == "`nothing.csv` has no columns — skipped."


def test_catalog(spark, make):
    df = make("a long, b string", [(i, "x") for i in range(30)])
    assert files.register({"tw_cat": df}) == ["tw_cat"] and files.register({"tw_cat": df.where("false")}, overwrite=False) == []
    assert spark.table("tw_cat").count() == 30
    assert [tuple(r) for r in files.describe({"t": df}).collect()] == [("t", 0, "a", "bigint"), ("t", 1, "b", "string")]
    assert files.preview(df).count() == 10


def test_snapshot_store_by_tag(spark, make, tmp_path):
    path = str(tmp_path / "snap")
    assert stores.load_snapshot(spark, path) is None
    for tag, value in (("baseline", 1.0), ("other", 2.0), ("baseline", 3.0)):
        stores.save_snapshot(build_snapshot({"t": make("x double", [(value,)])}, tag), path)
    assert stores.load_snapshot(spark, path, "baseline").first()["mean"] == 3.0
    assert stores.load_snapshot(spark, path, "other").first()["mean"] == 2.0
    assert stores.load_snapshot(spark, path, "absent") is None


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert stores.run_history(spark, path).count() == 0
    for n in (1, 2):
        stores.append_run(stores.run_entry(spark, "clean", "high", n, ["a", "b"], f"run{n}"), path)
    (tmp_path / "log" / "part-broken.json").write_text('\n{"run_id": \nnonsense\n')
    assert [r["run_id"] for r in stores.run_history(spark, path).collect()] == ["run2", "run1"]
    assert stores.get_run(spark, path, "run1").first()["issue_count"] == 1 and stores.get_run(spark, path, "x").isEmpty()
    assert stores.run_history(spark, path).first()["agent_trace"] == "a -> b"


def test_pipelines_with_files(spark, make, tmp_path, caplog):
    folders = {"clean": str(tmp_path / "clean"), "injected": str(tmp_path / "injected")}
    out, truth_path, snap = (str(tmp_path / n) for n in ("out", "truth", "snap"))
    with pytest.raises(FileNotFoundError):
        stores.load_truth(spark, truth_path)
    files.write_tables(retail(make, 400), folders["clean"])
    pipelines.snapshot_source(spark, folders, snap)
    truth = pipelines.inject_source(spark, folders, truth_path)
    assert stores.load_truth(spark, truth_path).count() == truth.count() == 6
    for source in ("clean", "injected"):
        result = pipelines.triage_source(spark, source, folders, out, snapshot_path=snap)
        assert result.failures == [] and result.trace[-1] == "ranker"
    found = {r["issue_type"] for r in stores.load_ranked(spark, f"{out}/ranked_issues", "injected").collect()}
    assert {"missing_values", "duplicate_rows", "invalid_future_dates", "referential_integrity_break", "numeric_outliers"} <= found
    assert stores.load_ranked(spark, f"{out}/ranked_issues", "clean").count() == 0
    assert stores.run_history(spark, f"{out}/run_log").count() == 2
    text = [r[0] for r in spark.read.text(f"{out}/triage_report_injected").collect()]
    assert text[0] == "# Data quality triage report"
    scored = pipelines.evaluate_source(spark, folders, truth_path, f"{out}/evaluation", snap)
    assert stores.load_evaluation(spark, f"{out}/evaluation").count() == 3
    assert min(r["f1"] for r in scored.collect()) > 0.8
    with caplog.at_level(logging.WARNING):
        pipelines.triage_source(spark, "clean", folders, out)
    assert "drift is skipped" in caplog.text


def messy(make, rows=200):
    """Index lists instead of a random generator: 40 null revenues, 20 null customers, 5 huge, 8 far dates, 15 copies."""
    def row(i):
        return (i, None if i % 10 == 3 else i % 40,
                None if i % 5 == 1 else 999999.99 if i in (20, 40, 60, 80, 100) else 50.0 + i % 90,
                "2099-12-31T00:00:00" if i in (7, 17, 27, 37, 47, 57, 67, 77) else f"2024-0{1 + i % 9}-1{i % 10}T10:00:00", "cat")
    data = [row(i) for i in range(rows)]
    return {"fact_orders": make("order_id long, customer_id long, revenue double, order_date string, category string", data + data[:15]),
            "dim_customers": make("customer_id long, name string, region string", [(i, f"n{i}", "north") for i in range(40)])}


def test_messy_shop(spark, make):
    ranked, explained, summary = pipelines.analyze(messy(make), sensitivity="high")
    rows = ranked.orderBy("rank").collect()
    assert {"missing_values", "duplicate_rows", "invalid_future_dates", "numeric_outliers"} <= {r["issue_type"] for r in rows}
    scores = [r["impact_score"] for r in rows]
    assert scores == sorted(scores, reverse=True) and min(scores) >= 0 and rows[0]["severity"] in ("high", "medium")
    assert explained.count() == len(rows) and summary.first()["total_issues"] == len(rows)


@pytest.mark.parametrize("case", ["none", "one", "all_null"])
def test_edge_tables(make, case):
    rows = {"none": [], "one": [(1, 5.0, "2024-01-01")], "all_null": [(i, None, None) for i in range(30)]}[case]
    result = pipelines.run_triage({"fact_x": make("x_id long, amount double, day string", rows)})
    types = {r["issue_type"] for r in result.ranked.collect()}
    assert result.failures == [] and types == {"none": {"empty_table"}, "one": set(), "all_null": {"missing_values"}}[case]


def test_adhoc_with_and_without_baseline(spark, make):
    now = {"fact_sales": make("sales_sk long, amount double", [(i, 100.0) for i in range(100)])}
    base = {"fact_sales": make("sales_sk long, amount double", [(i, 10.0) for i in range(100)])}
    assert pipelines.adhoc_triage(now).count() == 0
    assert [r["issue_type"] for r in pipelines.adhoc_triage(now, base).collect()] == ["statistical_drift"]
    two = {"table_a": make("x long", [(i,) for i in range(50)]), "table_b": make("y long", [(None if i < 30 else i,) for i in range(100)])}
    assert "table_b" in {r["table"] for r in pipelines.adhoc_triage(two).collect()}


def test_review_decision_drops_issues(make):
    tables = {"fact_sales": make("sales_sk long, amount double", [(i, float(i)) for i in range(30)] * 2)}
    kept = pipelines.run_triage(tables, decision="approve all").ranked
    gone = pipelines.run_triage(tables, decision="reject DDUP_0001").ranked
    assert kept.where("issue_type = 'duplicate_rows'").count() == 1 and gone.where("issue_type = 'duplicate_rows'").count() == 0


def test_injected_dates_keep_their_type(make):
    tables = {"fact_a": make("a_id long, date_key long, v double", [(i, 20240101, 1.0) for i in range(100)])}
    out, truth = inject_issues(tables, seed=123)
    assert out["fact_a"].where("date_key = 20990101").count() == 2 and truth.count() >= 4
    assert narrate.explain(pipelines.run_triage(out).ranked).count() >= 1


def test_csv_line_breaks_and_schema(spark, make, tmp_path):
    rows = [(1, "two\nlines", "2024-01-01"), (2, 'a "quote", and\r\nmore', "NA"), (3, "café", "x")]
    folder = str(tmp_path / "breaks")
    files.write_tables({"t": make("id int, note string, day string", rows)}, folder)
    plain = files.load_folder(spark, folder)["t"]
    assert {r["id"]: r["note"].replace("\r\n", "\n") for r in plain.collect()} == {i: n.replace("\r\n", "\n") for i, n, _ in rows}
    assert dict(plain.dtypes)["id"] == "bigint"
    typed = files.load_folder(spark, folder, {"t": "id int, note string, day string, gone double"})["t"]
    assert {(r["id"], r["day"], r["gone"]) for r in typed.collect()} == {(1, "2024-01-01", None), (2, None, None), (3, "x", None)}
    dated = files.load_folder(spark, folder, {"t": "id int, day date"})["t"]
    assert sorted((r["id"], str(r["day"])) for r in dated.collect()) == [(1, "2024-01-01"), (2, "None"), (3, "None")]


def test_latin_1_with_and_without_schema(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("id,name\n1,caf\xe9\n".encode("latin-1"))
    path = str(tmp_path / "l.csv")
    assert files.read_csv(spark, path).first()["name"] == files.read_csv(spark, path, "id int, name string").first()["name"] == "café"


def test_folder_is_replaced_as_a_whole(spark, make, tmp_path):
    folder = str(tmp_path / "both")
    files.write_tables({"a": make("x int", [(1,)]), "b": make("x int", [(2,)])}, folder, "parquet")
    with pytest.raises(ValueError, match="read from"):
        files.write_tables(files.load_folder(spark, folder), folder)
    assert len(files.load_folder(spark, folder)) == 2
    files.write_tables({"c": make("x int", [(3,)])}, folder)
    assert set(files.load_folder(spark, folder)) == {"c"}


def test_only_files_with_broken_lines_are_read_whole(spark, tmp_path):
    folder = tmp_path / "some data" / "sales.csv"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("id,note\n" + "".join(f'{i},"said ""yes"", {i}"\n' for i in range(4000)))
    (folder / "b.csv").write_text('id,note\n9001,"two\nlines"\n9002,plain\n9003,"three\n\nlines, ""quoted\n"""\n')
    whole, split = files.broken_files(spark, str(folder))
    assert [f.rsplit("/", 1)[1] for f in whole] == ["b.csv"] and [f.rsplit("/", 1)[1] for f in split] == ["a.csv"]
    limit = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "16k")
        found, old = files.read_csv(spark, str(folder)), files.read_csv(spark, str(folder), multiline=True)
        assert found.rdd.getNumPartitions() > 4 and old.rdd.getNumPartitions() <= 2
        assert found.dtypes == old.dtypes == [("id", "bigint"), ("note", "string")]
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, old.collect())) and found.count() == 4003
        given = files.read_csv(spark, str(folder), "id int, note string")
        assert sorted(map(tuple, given.collect())) == sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set(limit, before)


def test_no_moment_without_the_old_or_the_new_tables(spark, make, tmp_path):
    root = tmp_path / "out"
    files.write_tables({"t": make("a long", [(1,)])}, str(root))
    files.write_tables({"t": make("a long", [(2,), (3,)])}, str(root))
    assert sorted(r["a"] for r in files.load_folder(spark, str(root))["t"].collect()) == [2, 3]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
