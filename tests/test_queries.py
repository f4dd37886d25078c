"""Registered queries against their SQL.  TABLEWARDEN_ALL_QUERIES=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from oracle import differences, duck

SF = "/root/testdata/sf0.001"
QUICK = ("null_issues", "dup_key", "dup_fullrow", "iqr_outliers", "future_text", "fk_orphans", "name_rules", "snapshot_topk",
         "inject_fk", "orphan_rows", "dup_groups", "fix_null_fk", "fix_placeholder_dim", "fix_dedupe_key", "fix_winsorise",
         "chat_trim", "sql_blocks", "code_idents", "baseline_ks")
NAMES = tuple(entry.oracle_sql()) if os.environ.get("TABLEWARDEN_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() == 2 and "impact_score" in df.columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
