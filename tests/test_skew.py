"""Hot keys, equal results on every path, and plans that must not gather or cross."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import checks, investigate, references, repair, snapshot, textqa, verify
from tablewarden.operators.profile import profile_plan


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture
def hot(make):
    """A third of the fact rows share key 7, another share has an unknown key 99."""
    rows = [(7,)] * 500 + [(99,)] * 300 + [(i % 50,) for i in range(700)] + [(None,)] * 20
    random.Random(1).shuffle(rows)
    return make("fk long", rows), make("pk long, name string", [(i, "n") for i in range(45)] + [(None, "x")])


def test_orphans_of_a_hot_key(hot):
    fact, dim = hot
    found = dict(map(tuple, references.orphan_counts(fact, "fk", dim, "pk").collect()))
    assert found[99] == 300 and found[45] == 14 and set(found) == {45, 46, 47, 48, 49, 99}
    text = plan(references.orphan_counts(fact, "fk", dim, "pk"))
    assert "Join" not in text and "partial_sum" in text


@pytest.mark.parametrize("hot_rows", [10, 200, 10**9])
def test_repairs_agree_when_orphans_are_many(hot, hot_rows):
    fact, dim = hot
    fact = fact.withColumns({c: F.lit(c) for c in ("key_n", "KEY_S", "orphan", "_key", "rows", "n", "sure")})
    for f in (repair.drop_orphans, repair.null_orphans, investigate.orphan_rows):
        few, many = f(fact, "fk", dim, "pk"), f(fact, "fk", dim, "pk", broadcast_rows=0, hot_rows=hot_rows)
        assert few.columns == many.columns == fact.columns
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert repair.drop_orphans(fact, "fk", dim, "pk", 0, hot_rows).groupBy("fk").count().where("fk = 7 or fk is null").count() == 2
    assert repair.null_orphans(fact, "fk", dim, "pk", 0, hot_rows).where("fk is null").count() == 20 + 300 + 14 * 5


def test_hot_and_missing_keys_are_not_shuffled(hot):
    fact, dim = hot
    rows, _ = references.marked(fact, "fk", dim, "pk", broadcast_rows=0, hot_rows=200)
    seen = rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert seen.count("BroadcastExchange") >= 1 and "SortMergeJoin" in seen
    shuffled = seen.split("SortMergeJoin", 1)[1]
    assert "isnull(sure" in shuffled and ("isnotnull(fk" in shuffled or "isnotnull(key_n" in shuffled)


def test_one_scan_a_table_for_all_keys(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    tables = {"f": lines, "p": spark.read.parquet("/root/testdata/sf0.001/part.parquet"), "s": spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")}
    links = [references.Link("f", "l_partkey", "p", "p_partkey"), references.Link("f", "l_suppkey", "s", "s_suppkey"), references.Link("f", "l_orderkey", "p", "p_partkey")]
    uses = references.key_uses(tables, links)
    text = plan(uses).split("== Physical Plan ==")[1]
    assert text.count("FileScan") == 3 and "Join" not in text and "partial_sum" in text and "l_extendedprice" not in text
    total = {r["link"]: (r["rows"], r["n"]) for r in uses.groupBy("link").agg(F.sum("rows").alias("rows"), F.count_if(F.col("rows") > 0).alias("n")).collect()}
    assert {k: v[0] for k, v in total.items()} == {0: lines.count(), 1: lines.count(), 2: lines.count()}


@pytest.mark.parametrize("left,right,pairs", [
    ("bigint", "double", [(9007199254740993, 9007199254740992.0, False), (9007199254740992, 9007199254740992.0, True), (-5, -5.0, True),
                          (0, -0.0, True), (4611686018427387904, 4.611686018427387904e18, True), (9223372036854775807, 9.223372036854775808e18, False),
                          (2, 2.5, False), (3, float("inf"), False)]),
    ("decimal(20,2)", "double", [("0.10", 0.1, True), ("0.10", 0.1000000001, False), ("5.00", 5.0, True), ("90071992547409.93", 90071992547409.92, False)]),
    ("decimal(38,0)", "double", [("100000000000000000000", 1e20, True), ("100000000000000000001", 1e20, False)]),
    ("decimal(20,2)", "bigint", [("7.00", 7, True), ("7.01", 7, False), ("9007199254740993.00", 9007199254740993, True)]),
    ("decimal(38,0)", "int", [("12", 12, True), ("99999999999999999999999999999999999999", 12, False)]),
    ("float", "double", [(0.5, 0.5, True), (0.1, 0.1, False), (-0.0, 0.0, True)]),
    ("string", "bigint", [("12", 12, True), ("12.0", 12, False)]),
    ("timestamp", "timestamp", [("2020-01-01 00:00:00", "2020-01-01 00:00:00", True)]),
    ("binary", "binary", [("ab", "ab", True), ("ab", "ba", False)]), ("date", "date", [("2020-02-01", "2020-02-01", True)]),
])
def test_keys_of_two_types_are_compared_exactly(spark, left, right, pairs):
    """The check and the re-count, in both directions."""
    for a, b, same in pairs:
        def literal(v, kind):
            return F.lit(v if not isinstance(v, float) else float(v)).cast(kind) if not isinstance(v, int) else F.lit(str(v)).cast(kind)
        sides = spark.range(1).select(literal(a, left).alias("a"), literal(b, right).alias("b"))
        for one, two in (("a", "b"), ("b", "a")):
            fact, dim = sides.select(F.col(one).alias("k")).union(sides.select(F.lit(None).cast(left if one == "a" else right))), sides.select(F.col(two).alias("k"))
            missing = references.orphan_counts(fact, "k", dim, "k").collect()
            assert (missing == []) == same, (left, right, a, b, one)
            fact.createOrReplaceTempView("key_fact"), dim.createOrReplaceTempView("key_dim")
            issue = {"issue_id": "x", "issue_type": "referential_integrity_break", "columns": ["k"], "dim_table": "d", "dim_pk": "k"}
            text = verify.keys_sql("key_fact", fact, [issue], {"f": fact, "d": dim}, {"f": "key_fact", "d": "key_dim"})
            assert spark.sql(text).first()["sql_count"] == (0 if same else 1), (left, right, a, b, one)


def keyed_issue(i, kind, columns, dim="", pk=""):
    return {"issue_id": f"i{i}", "issue_type": kind, "columns": columns, "dim_table": dim, "dim_pk": pk}


def test_recount_of_keys_is_summed_where_rows_lie(hot, spark):
    """No shuffle by the place of an issue alone, which would bring all keys of a table together, and no text for whole numbers."""
    fact, dim = hot
    fact = fact.withColumn("part", F.lit(1))
    tables, views = {"f": fact, "d": dim}, {"f": "key_fact", "d": "key_dim"}
    fact.createOrReplaceTempView("key_fact"), dim.createOrReplaceTempView("key_dim")
    issues = [keyed_issue(0, "duplicate_rows", ["fk", "part"]), keyed_issue(1, "referential_integrity_break", ["fk"], "d", "pk"),
              keyed_issue(2, "duplicate_rows", ["part"])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spark.sql(verify.keys_sql("key_fact", fact, issues, tables, views))
        text = plan(found).split("== Physical Plan ==")[1]
        assert "hashpartitioning(" in text and "json" not in text
        assert not re.search(r"hashpartitioning\(place#\d+, \d+\)", text) and "partial_sum" in text
        assert dict(map(tuple, found.collect())) == {"i0": 1520 - 51, "i1": 300 + 14 * 5, "i2": 1519}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_narrow_keys_are_not_hashed_first(make, monkeypatch):
    """Two whole numbers are grouped as they are in a table of any size; no pass over their hashes is written."""
    df = make("a long, b int, c string", [(1, 1, "x")] * 3 + [(1, 2, "x"), (None, 1, "x"), (None, 1, "x")])
    hashed = checks.repeated_groups(df, ["a", "c"], 6, hash_first=1)
    assert sorted(map(tuple, hashed.collect()), key=str) == [(1, "x", 4), (None, "x", 2)]

    def never(df):
        raise AssertionError("written")

    monkeypatch.setattr(checks, "settled", never)
    found = checks.repeated_groups(df, ["a", "b"], 6, hash_first=1)
    assert "xxhash64" not in plan(found) and sorted(map(tuple, found.collect()), key=str) == [(1, 1, 3), (None, 1, 2)]
    with pytest.raises(AssertionError):
        checks.repeated_groups(df, ["a", "c"], 6, hash_first=1)


def test_whole_keys_of_all_references_are_grouped_without_text(hot, make):
    fact, dim = hot
    names = make("name string", [("n",), ("z",)])
    whole = references.key_uses({"f": fact, "d": dim}, [references.Link("f", "fk", "d", "pk")])
    mixed = references.key_uses({"f": fact, "d": dim, "m": names}, [references.Link("f", "fk", "d", "pk"), references.Link("m", "name", "d", "name")])
    assert whole.columns == mixed.columns and whole.dtypes == mixed.dtypes
    grouped = plan(whole).split("== Physical Plan ==")[1].split("hashpartitioning(")[1].split(")")[0]
    assert "n#" in grouped and "s#" not in grouped
    assert sorted(whole.collect()) == sorted(mixed.where("link = 0").collect())
    assert {(r["s"], r["rows"], r["known"]) for r in mixed.where("link = 1").collect()} == {(":n", 1, True), (":z", 1, False), (":x", 0, True)}


def test_recount_of_copies_by_kind_of_key(make, spark):
    """Whole numbers and text as they are, other parts by their JSON text; a row with a missing part has no key."""
    rows = [(1, "a", 0.5, {"x": 1}), (1, "a", 0.5, {"x": 1}), (1, None, 0.5, {"x": 2}), (1, None, 0.5, None), (None, "a", float("nan"), {"x": 1}),
            (2, "a", float("nan"), {}), (2, "b", None, {}), (2, '"b', 1.5, {"x": 1}), (2, '"b', 1.5, {"x": 1})]
    df = make("a int, b string, c double, m map<string,int>", rows)
    df = df.withColumn("d", F.col("a").cast("decimal(9,2)"))
    df.createOrReplaceTempView("key_fact")
    keys = [["a"], ["b"], ["a", "b"], ["c"], ["b", "c"], ["m"], ["d", "b"], ["a"]]
    issues = [keyed_issue(i, "duplicate_rows", k) for i, k in enumerate(keys)]
    place = {c: i for i, c in enumerate(["a", "b", "c", "m"])} | {"d": 0}

    def excess(columns):
        return len(rows) - len({str(v) for r in rows if None not in (v := tuple(r[place[c]] for c in columns))})

    want = {f"i{i}": excess(k) for i, k in enumerate(keys)}
    for some in (issues, *([i] for i in issues)):
        got = spark.sql(verify.keys_sql("key_fact", df, some, {"f": df}, {"f": "key_fact"})).collect()
        assert dict(map(tuple, got)) == {i["issue_id"]: want[i["issue_id"]] for i in some}
    empty = df.limit(0)
    empty.createOrReplaceTempView("key_fact")
    assert spark.sql(verify.keys_sql("key_fact", empty, issues[:1], {"f": empty}, {"f": "key_fact"})).first()["sql_count"] == 0


def test_no_cross_join_and_partial_aggregates(hot, make):
    fact, _ = hot
    assert "partial_count" in plan(checks.excess_copies(fact, ["fk"]))
    assert "partial_min" in plan(repair.dedupe_on_key(make("k long, o long", [(1, 1)]), ["k"], "o"))
    assert "Cartesian" not in plan(profile_plan({"t": fact}))
    top = plan(snapshot.top_values(make("a string, b string", [("x", "y")]), ["a", "b"]))
    assert "WindowGroupLimit" in top


def test_top_values_with_a_hot_value(make):
    df = make("a string", [("hot",)] * 400 + [(f"v{i:03d}",) for i in range(200)])
    rows = snapshot.top_values(df, ["a"]).orderBy("place").collect()
    assert len(rows) == 50 and (rows[0]["value"], rows[0]["n"]) == ("hot", 400) and rows[1]["value"] == "v000"


def test_top_values_of_a_flat_column(make, monkeypatch):
    """More values than the sketch keeps, most of them once: settled by hash, and no text but candidates is shuffled."""
    monkeypatch.setattr(snapshot, "TRACKED", 16)
    rows = [(f"{'same start ' if i % 2 else ''}{i:05d}" + "x" * 500, f"k{i % 700}", None if i % 3 else "") for i in range(5000)] + [("twice", "often", "a")] * 2 + [("b", "often", "b")] * 900
    df = make("a string, b string, c string", rows)
    got = {(r["column"], r["value"]): (r["n"], r["place"]) for r in snapshot.top_values(df, ["a", "b", "c"]).collect()}
    want = {}
    for k, c in enumerate("abc"):
        counts = collections.Counter(r[k] for r in rows if r[k] is not None)
        for place, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:50]):
            want[c, v] = n, place + 1
    assert got == want
    text = plan(snapshot._by_hash(df, ["a"], 50))
    assert "partial_count" in text and "WindowGroupLimit" in text
    exchanged = [line for line in text.split("== Physical Plan ==")[1].split("\n") if "partial_count" in line]
    assert exchanged and all("value" not in line.split("output=")[-1] for line in exchanged)


def test_trim_keeps_missing_ids_and_turns(make):
    rows = [(None, 1, "aaaa"), (None, 2, "bb"), (1, None, "cc"), (1, 5, "dd"), (1, 4, "x" * 50)]
    got = textqa.trim_conversations(make("conv_id long, turn long, text string", rows), 10)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 1, "aaaa"), (None, 2, "bb"), (1, 5, "dd")], key=str)


def test_one_endless_conversation_is_spread(make):
    rows = [(1, t, "y" if t % 3 else "") for t in range(3000)]
    messages = make("conv_id long, turn long, text string", rows)
    kept = textqa.trim_conversations(messages, 100, turns_per_block=64)
    assert kept.agg(F.sum(F.length("text")), F.count("*")).first()[:] == (100, 150)


def test_scan_reads_only_needed_columns(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    text = plan(checks.excess_copies(lines, ["l_orderkey", "l_linenumber"]))
    assert "l_extendedprice" not in text.split("== Physical Plan ==")[1]
