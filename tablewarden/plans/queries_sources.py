"""Queries on sources, catalogues, older snapshots, the choice of a reference, and injection with files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import drift
from tablewarden.operators.profile import profile_tables
from tablewarden.operators.snapshot import build_snapshot
from tablewarden.plans import datasets, oracle_views as o, queries_checks as c
from tablewarden.plans.registry import DIRTY_META, query, subset
from tablewarden.plans.triage import inject_source
from tablewarden.runtime import local_frame, union_all
from tablewarden.sources import stores, tables as files


def _counts(tables, *more):
    """A row of counts for each table, beside given columns."""
    return union_all(df.agg(F.count(F.lit(1)).alias("n_rows")).select(*more, F.lit(t).alias("table"), "n_rows") for t, df in tables.items())


@query("named_sources", f"{o.VIEWS} " + " UNION ALL ".join(
    f"""SELECT '{source}' AS source, '{t}' AS "table", count(*) AS n_rows FROM {prefix}{t}"""
    for source, prefix in (("clean", ""), ("injected", "d_")) for t in o.TABLES))
def named_sources(spark, sf):
    """Clean and injected tables, each written to its folder and loaded by its name."""
    folders = {name: c.scratch(spark) for name in ("clean", "injected")}
    for name, tables in (("clean", datasets.star(spark, sf)), ("injected", datasets.dirty(spark, sf))):
        files.write_tables(tables, folders[name], "parquet")
    return union_all(_counts(files.load_source(spark, name, folders), F.lit(name).alias("source")) for name in folders)


@query("registered_views", """SELECT 'first' AS step, 'made tw_orders' AS made, count(*) AS n_orders FROM orders
UNION ALL SELECT 'kept', 'made tw_customers', count(*) FROM orders
UNION ALL SELECT 'replaced', 'made tw_orders', count(*) FROM orders WHERE o_orderkey % 3 = 0""")
def registered_views(spark, sf):
    """Tables as views for SQL: an existing view stays, or is replaced."""
    orders, customers = datasets.read(spark, sf, "orders"), datasets.read(spark, sf, "customer")
    some = orders.where("o_orderkey % 3 = 0")
    out = []
    try:
        for step, tables, overwrite in (("first", {"tw_orders": orders}, True), ("kept", {"tw_orders": some, "tw_customers": customers}, False),
                                        ("replaced", {"tw_orders": some}, True)):
            made = files.register(tables, overwrite)
            out.append(spark.sql("SELECT count(1) AS n_orders FROM tw_orders")
                       .select(F.lit(step).alias("step"), F.lit("made " + ", ".join(made)).alias("made"), "n_orders"))
    finally:
        for view in ("tw_orders", "tw_customers"):
            spark.catalog.dropTempView(view)
    return union_all(out)


@query("adhoc_files", """SELECT 'my_talks_2024' AS "table", count(*) AS n_rows, sum(length(text)) AS n_chars, 1 AS n_warnings FROM conversations
UNION ALL SELECT 'suppliers', count(*), sum(length(s_name)), 1 FROM supplier
UNION ALL SELECT 'stra_e', count(*), sum(length('é ' || c_name || ' ü')), 1 FROM customer WHERE c_custkey % 2 = 0""")
def adhoc_files(spark, sf):
    """Named files of two formats, with odd names, Latin-1 text and an empty table, which is left out with a warning."""
    root = c.scratch(spark)
    talks, suppliers = datasets.read(spark, sf, "conversations"), datasets.read(spark, sf, "supplier")
    names = datasets.read(spark, sf, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("é "), "c_name", F.lit(" ü")).alias("name"))
    csv = {"header": True, "quote": '"', "escape": '"'}
    talks.write.options(**csv).csv(f"{root}/My Talks-2024.csv")
    suppliers.write.parquet(f"{root}/Suppliers.parquet")
    names.write.options(**csv, encoding="ISO-8859-1").csv(f"{root}/Stra_e.csv")
    suppliers.where("false").write.parquet(f"{root}/nothing.parquet")
    loaded, warnings = files.load_adhoc(spark, [f"{root}/{p}" for p in ("My Talks-2024.csv", "Suppliers.parquet", "Stra_e.csv", "nothing.parquet")])
    text = {"my_talks_2024": "text", "suppliers": "s_name", "stra_e": "name"}
    return union_all(df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(text[t])).alias("n_chars")).select(
        F.lit(t).alias("table"), "n_rows", "n_chars", F.lit(len(warnings)).alias("n_warnings")) for t, df in loaded.items())


_COLUMNS = {
    "fact_orders": "order_id customer_id order_date total_price discount_pct status priority",
    "fact_lineitems": "order_id part_id supplier_id line_number quantity price discount tax ship_date",
    "fact_events": "event_id user_id event_date value event_type", "fact_returns": "order_id quantity",
    "dim_customers": "customer_id customer_name balance segment", "dim_parts": "part_id part_name brand retail_price",
    "dim_suppliers": "supplier_id supplier_name balance", "dim_users": "user_id user_name nation_code",
}
_SPARK_TYPE = ("CASE kind WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' "
               "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' ELSE kind END")


@query("schema_listing", f"""{o.VIEWS} SELECT "table", position, "column", {_SPARK_TYPE} AS type FROM (""" + " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", {i} AS position, '{name}' AS "column", (SELECT typeof({name}) FROM (SELECT 1) LEFT JOIN {t} ON true LIMIT 1) AS kind"""
    for t, cs in _COLUMNS.items() for i, name in enumerate(cs.split())) + ")")
def schema_listing(spark, sf):
    return files.describe(datasets.star(spark, sf))


def _midpoints_sql(t: str, m: str) -> str:
    return f"""SELECT "table", "column", round(lo + (bin + 0.5) * ((hi - lo) / 20), 6) AS value,
    CAST(n * greatest(1, floor(1000 / sum(n) OVER ())) AS BIGINT) AS weight
    FROM ({c._hist_sql(t, m)}), (SELECT min({m}) AS lo, max({m}) AS hi FROM {t})"""


@query("legacy_points", f"{o.VIEWS} SELECT * FROM (" + " UNION ALL ".join(
    f"({_midpoints_sql(t, m)})" for t, m in (("fact_orders", "total_price"), ("fact_events", "value"), ("dim_customers", "balance"))) + ") WHERE weight > 0")
def legacy_points(spark, sf):
    """A snapshot without quantiles is read as the midpoints of its histograms."""
    star = datasets.star(spark, sf)
    snap = build_snapshot({t: star[t].select(m) for t, m in (("fact_orders", "total_price"), ("fact_events", "value"), ("dim_customers", "balance"))})
    old = snap.withColumn("q_values", F.lit(None).cast("array<double>"))
    return drift.reference_points(old).select("table", "column", F.round("value", 6).alias("value"), "weight")


_CHOICES = {"snapshot before tables and tag": 1, "tables before tag": 0, "saved tag": 1, "unknown tag": 0, "nothing": 0}


@query("reference_choice", f"{c._DRIFT_HEAD}, {c._PSI_SQL}, {c._KS_SQL}, {c._TESTS_SQL}, n AS (SELECT count(*) AS n FROM drifted) " + " UNION ALL ".join(
    f"SELECT '{name}' AS choice, n * {used} AS n_issues FROM n" for name, used in _CHOICES.items()))
def reference_choice(spark, sf):
    """Dirty facts against the clean snapshot wherever that is chosen; the other references are the dirty facts themselves."""
    clean = subset(datasets.star(spark, sf), "fact_orders", "fact_lineitems", "fact_events")
    tables = subset(datasets.dirty(spark, sf), *clean)
    snap = build_snapshot({t: clean[t].select(*DIRTY_META[t].numeric_cols) for t in clean}, "clean", profile_tables(clean))
    path = c.scratch(spark)
    stores.save_snapshot(snap, path)
    profile = profile_tables(tables, DIRTY_META)
    asked = dict(zip(_CHOICES, (
        {"snapshot": snap, "baseline": tables, "snapshot_path": path, "tag": "clean"}, {"baseline": tables, "snapshot_path": path, "tag": "clean"},
        {"snapshot_path": path, "tag": "clean"}, {"snapshot_path": path, "tag": "april"}, {})))
    rows = [(name, drift.detect_drift(tables, DIRTY_META, profile, **how).count()) for name, how in asked.items()]
    return local_frame(spark, rows, "choice string, n_issues long")


@query("injected_files", """WITH n AS (SELECT (SELECT count(*) FROM orders) AS n, (SELECT count(*) FROM customer) AS d),
k AS (SELECT n, d, greatest(1, CAST(floor(n * 0.02) AS BIGINT)) AS a, greatest(1, CAST(floor((n + greatest(1, floor(n * 0.02))) * 0.02) AS BIGINT)) AS b,
  greatest(1, CAST(floor(d * 0.03) AS BIGINT)) AS e FROM n)
SELECT 'missing_key_values' AS issue_type, 'fact_orders' AS "table", a AS row_count, n + a AS n_written FROM k
UNION ALL SELECT 'duplicate_transactions', 'fact_orders', a, n + a FROM k
UNION ALL SELECT unnest(['invalid_future_dates', 'referential_integrity_break', 'numeric_outliers', 'promotion_drift']), 'fact_orders', b, n + a FROM k
UNION ALL SELECT 'dimension_missing_values', 'dim_customers', e, d FROM k""")
def injected_files(spark, sf):
    """Clean tables read from CSV, defects written to the injected folder with their truth, and both read back."""
    folders = {name: c.scratch(spark) for name in ("clean", "injected")}
    truth_path = c.scratch(spark)
    files.write_tables(subset(datasets.star(spark, sf), "fact_orders", "dim_customers"), folders["clean"])
    inject_source(spark, folders, truth_path)
    written = _counts(files.load_source(spark, "injected", folders)).withColumnRenamed("n_rows", "n_written")
    return stores.load_truth(spark, truth_path).join(written, "table").select("issue_type", "table", "row_count", "n_written")
