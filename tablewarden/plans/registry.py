"""Registry of named queries, each with an equivalent ANSI SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewarden.operators import checks
from tablewarden.operators.profile import profile_tables, table_sizes
from tablewarden.operators.rank import rank_issues
from tablewarden.plans import datasets
from tablewarden.runtime import local_copy
from tablewarden.schemas import TableMeta

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


#: Metadata of the dirty views, given explicitly so that queries on issues need no inference.
DIRTY_META = {
    "fact_orders": TableMeta("fact", "order", (), {"customer_id": ("dim_customers", "customer_id")},
                             ("order_date",), ("total_price", "discount_pct"), ("discount_pct",)),
    "fact_lineitems": TableMeta("fact", "lineitem", (),
                                {"part_id": ("dim_parts", "part_id"), "supplier_id": ("dim_suppliers", "supplier_id")},
                                ("ship_date",), ("line_number", "quantity", "price", "discount", "tax"), ("discount",)),
    "fact_events": TableMeta("fact", "event", ("event_id",), {"user_id": ("dim_users", "user_id")},
                             ("event_date",), ("value",), ()),
    "fact_returns": TableMeta("fact", "return", ("order_id",), {}, (), ("quantity",), ()),
    "dim_customers": TableMeta("dimension", "customer", ("customer_id",), {}, (), ("balance",), ()),
    "dim_parts": TableMeta("dimension", "part", ("part_id",), {}, (), ("retail_price",), ()),
    "dim_suppliers": TableMeta("dimension", "supplier", ("supplier_id",), {}, (), ("balance",), ()),
    "dim_users": TableMeta("dimension", "user", ("user_id",), {}, (), ("nation_code",), ()),
}


def subset(tables: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
    return {n: tables[n] for n in names}


def dirty_issues(spark: SparkSession, sf_dir: str, sensitivity: str = "high"):
    """Tables, profile and rule issues of the dirty views."""
    tables = datasets.dirty(spark, sf_dir)
    profile = profile_tables(tables, DIRTY_META, checks.NEEDS)
    issues, failures = checks.run_checks(tables, DIRTY_META, sensitivity, profile)
    if failures:
        raise RuntimeError(f"checks failed: {failures}")
    return tables, profile, issues


def dirty_ranked(spark: SparkSession, sf_dir: str, sensitivity: str = "high") -> DataFrame:
    _, profile, issues = dirty_issues(spark, sf_dir, sensitivity)
    return local_copy(rank_issues(issues, table_sizes(profile)))
