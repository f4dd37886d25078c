"""Rows that differ only in nested columns, ids that would collide, stores, failures and shared folders."""

import pytest

from tablewarden import runtime
from tablewarden.operators import checks, investigate, repair, verify
from tablewarden.operators.profile import profile_tables
from tablewarden.operators.rank import rank_issues
from tablewarden.plans import triage as pipelines
from tablewarden.schemas import TableMeta
from tablewarden.sources import stores

NESTED = "id int, m map<string,int>, a array<map<string,int>>, s struct<x:int, m:map<int,string>>"


@pytest.fixture
def nested(make):
    rows = [(1, {"a": 1, "b": 2}, [{"k": 1}], (1, {1: "p"})), (1, {"b": 2, "a": 1}, [{"k": 1}], (1, {1: "p"})),
            (1, {"a": 1, "b": 3}, [{"k": 1}], (1, {1: "p"})), (1, {"a": 1, "b": 2}, [{"k": 2}], (1, {1: "p"})),
            (1, {"a": 1, "b": 2}, [{"k": 1}], (1, {1: "q"})), (2, None, None, None), (2, None, None, None)]
    return make(NESTED, rows)


def test_nested_columns_tell_rows_apart(nested):
    assert repair.dedupe_rows(nested).count() == 5 and repair.dedupe_rows(nested).columns == nested.columns
    assert checks.excess_copies(nested, nested.columns).first()["excess"] == 2
    assert checks.excess_copies(nested, nested.columns, 10, hash_first=1).first()["excess"] == 2
    rate = investigate.duplication_rate(nested).first()
    assert (rate["total_rows"], rate["duplicate_rows"]) == (7, 2)
    shown = investigate.duplicate_rows(nested).collect()
    assert len(shown) == 4 and {r["occurrences"] for r in shown} == {2} and {"a": 1, "b": 2} in [r["m"] for r in shown]


def test_variants_tell_rows_apart(spark):
    rows = spark.sql("""SELECT id, parse_json(j) AS v FROM VALUES (1, '{"a":1,"b":[1,2]}'), (1, '{"b":[1,2],"a":1}'), (1, '{"a":1,"b":[2,1]}'),
                        (1, '"1"'), (1, '1') AS t(id, j)""")
    assert repair.dedupe_rows(rows).count() == 4
    assert checks.excess_copies(rows, rows.columns).first()["excess"] == 1


def test_first_row_of_a_key_with_maps(make):
    df = make("k int, t int, m map<string,int>", [(1, 2, {"a": 1}), (1, 1, {"b": 2}), (1, 1, {"a": 9}), (2, 5, None), (None, 1, {"z": 1})])
    got = {r["k"]: (r["t"], r["m"]) for r in repair.dedupe_on_key(df, ["k"], "t").collect()}
    assert got == {1: (1, {"a": 9}), 2: (5, None), None: (1, {"z": 1})}


def test_empty_tables_with_like_names_stay_two(make):
    names = ["a_very_long_table_name_one", "a_very_long_table_name_two", "case", "CASE"]
    tables = {n: make("x int", []) for n in names}
    meta = {n: TableMeta("dimension") for n in names}
    issues, failures = checks.run_checks(tables, meta, "high", profile_tables(tables, meta))
    assert not failures and issues.select("issue_id").distinct().count() == 4
    verified = verify.verify_issues(tables, issues)
    assert verified.count() == 4 and rank_issues(verified, dict.fromkeys(names, 0), None).count() == 4
    again = verify.verify_issues(tables, issues.unionByName(issues))          # the same ids twice: nothing is multiplied
    assert again.count() == 8


def test_clean_run_empties_its_source(spark, make, tmp_path):
    path = str(tmp_path / "ranked")
    tables = {"t one": make("x int", [])}
    ranked = pipelines.triage(tables)
    for source in ("a/b c", "other"):
        stores.write_ranked(ranked, path, source)
    assert [stores.load_ranked(spark, path, s).count() for s in ("a/b c", "other", "never")] == [1, 1, 0]
    assert stores.load_ranked(spark, path, "other").first()["issue_id"] == "EMPTY_T ONE"
    stores.write_ranked(ranked.limit(0), path, "a/b c")
    assert [stores.load_ranked(spark, path, s).count() for s in ("a/b c", "other")] == [0, 1]


def test_failed_checks_are_seen(spark, make, tmp_path, monkeypatch):
    def broken(*_):
        raise ValueError("no luck")
    monkeypatch.setitem(checks.CHECKS, "duplicate_rows", broken)
    tables = {"t": make("x_id int, v double", [(i, float(i)) for i in range(40)])}
    result = pipelines.run_triage(tables)
    assert result.failures == [("duplicate_rows", "no luck")]
    lines = [r["text"] for r in result.report("up", "high").collect()]
    assert "- `duplicate_rows`: no luck" in lines and not any("all checks passed" in line for line in lines)
    with pytest.raises(RuntimeError, match="no luck"):
        pipelines.triage(tables)
    stores.append_run(stores.run_entry(spark, "up", "high", 0, ["x"], failures=result.failures), str(tmp_path / "log"))
    assert stores.run_log(spark, str(tmp_path / "log")).first()["failures"] == ["duplicate_rows: no luck"]


def test_cluster_without_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.checkpoint_dir(Session())
    assert runtime.is_local("local[8]") and not runtime.is_local("local-cluster[2,1,1024]") and not runtime.is_local("yarn")
