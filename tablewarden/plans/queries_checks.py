"""Queries on sources, metadata, rule checks, snapshots, drift and verification."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewarden import config
from tablewarden.functions import names
from tablewarden.functions.dates import after_cutoff
from tablewarden.functions.scoring import direction, kolmogorov_p, psi_severity
from tablewarden.operators import checks, drift, investigate, metadata, references, snapshot, verify
from tablewarden.operators.profile import distinct_counts, profile_plan, profile_tables, table_sizes
from tablewarden.plans import datasets, oracle_views as o
from tablewarden.plans.registry import DIRTY_META, dirty_issues, dirty_ranked, query, subset
from tablewarden.runtime import checkpoint_dir, local_copy, union_all
from tablewarden.schemas import TableMeta
from tablewarden.sources import stores, tables as files


def scratch(spark) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def six(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


def flat_issues(df, *more):
    """Issue columns with the column list as text, and any further columns."""
    return df.select("issue_id", "issue_type", "table", F.array_join("columns", ",").alias("columns"),
                     "severity", "metric", "evidence_rows", *more)


# ---- sources and catalog ---------------------------------------------------------------

#: Columns, columns of numbers, and a column to count, of each table read back from CSV.
_SCANNED = {"fact_orders": (7, 4, "customer_id"), "fact_lineitems": (9, 8, "tax"), "fact_events": (5, 3, "event_type"),
            "fact_returns": (2, 2, "quantity"), "dim_customers": (4, 2, "customer_name"), "dim_parts": (4, 2, "part_name"),
            "dim_suppliers": (3, 2, "supplier_name"), "dim_users": (3, 2, "user_name")}


@query("folder_scan", f"{o.VIEWS} " + " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", count(*) AS n_rows, {n} AS n_columns, {numbers} AS n_numeric, count({c}) AS n_names FROM d_{t}"""
    for t, (n, numbers, c) in _SCANNED.items()))
def folder_scan(spark, sf):
    """Dirty tables written as CSV folders and read back with inferred types."""
    tables, folder = datasets.dirty(spark, sf), scratch(spark)
    files.write_tables(tables, folder)
    loaded = files.load_folder(spark, folder)
    return union_all(
        df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(_SCANNED[t][2]).alias("n_names")).select(
            F.lit(t).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
            F.lit(sum(d in ("bigint", "double") for _, d in df.dtypes)).alias("n_numeric"), "n_names")
        for t, df in loaded.items())


@query("csv_conversations", " UNION ALL ".join(
    f"SELECT '{way}' AS way, count(*) AS n_rows, sum(turn) AS turns, sum(length(text)) AS n_chars FROM conversations" for way in ("found types", "given types")))
def csv_conversations(spark, sf):
    """Texts with line breaks written as CSV and read back, with types found and with types given."""
    talks, folder = datasets.read(spark, sf, "conversations"), scratch(spark)
    files.write_tables({"talks": talks}, folder)
    ways = {"found types": None, "given types": {"talks": "conv_id long, turn long, role string, text string"}}
    return union_all(files.load_folder(spark, folder, schemas)["talks"].agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("turn").alias("turns"), F.sum(F.length("text")).alias("n_chars")).select(
        F.lit(way).alias("way"), "n_rows", "turns", "n_chars") for way, schemas in ways.items())


@query("run_lookup", f"""{o.issues('high')} SELECT 'injected' AS source, 'high' AS sensitivity, CAST(count(*) AS INTEGER) AS issue_count,
  (SELECT string_agg('on ' || tbl || ': ' || n || ' rows', ',' ORDER BY tbl) FROM (
     SELECT tbl, max(evidence_rows) AS n FROM issues WHERE issue_type = 'duplicate_rows' GROUP BY tbl)) AS failures FROM issues""")
def run_lookup(spark, sf):
    """One run out of a log of several, with its number of issues and what was logged as failed in it."""
    path = scratch(spark)
    _, _, issues = dirty_issues(spark, sf)
    found = issues.collect()                                                     # a row per issue
    copies = {r["table"]: r["evidence_rows"] for r in found if r["issue_type"] == "duplicate_rows"}
    failed = [(f"on {t}", f"{n} rows") for t, n in sorted(copies.items())]
    for k, (source, n, lines) in enumerate((("clean", 0, []), ("injected", len(found), failed), ("clean", 1, []))):
        stores.append_run(stores.run_entry(spark, source, "high", n, ["profiler"], f"run{k}", lines), path)
    run = stores.get_run(spark, path, "run1")
    return run.select("source", "sensitivity", F.col("issue_count").cast("int").alias("issue_count"), F.array_join("failures", ",").alias("failures"))


@query("table_sizes", f"""{o.VIEWS} {" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM d_{t}" for t in o.TABLES)}""")
def sizes(spark, sf):
    return profile_plan(datasets.dirty(spark, sf), measures=()).select("table", "n_rows").distinct()


@query("preview_orders", f"""{o.VIEWS} SELECT order_id, customer_id, total_price, status FROM d_fact_orders
ORDER BY order_id, customer_id, total_price, status LIMIT 10""")
def preview_orders(spark, sf):
    orders = datasets.dirty(spark, sf)["fact_orders"].select("order_id", "customer_id", "total_price", "status")
    return files.preview(orders.orderBy(*orders.columns), 10)


_NUMERIC_STATS = [("fact_orders", "total_price"), ("fact_orders", "discount_pct"), ("fact_events", "value")]
_SNAP_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null, round(avg({c}), 4) AS mean,
    round(stddev_pop({c}), 4) AS std, min({c}) AS min, max({c}) AS max,
    {", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{int(p * 100):02d}" for p in (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99))}
    FROM {t}""" for t, c in _NUMERIC_STATS)


def snapshot_rows(snap):
    return (snap.where("(table = 'fact_orders' AND column IN ('total_price', 'discount_pct')) OR (table = 'fact_events' AND column = 'value')")
            .select("table", "column", "n_rows", "n_null", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
                    "min", "max", *[F.round(F.get("q_values", F.lit(i)), 6).alias(f"p{int(p * 100):02d}")
                                    for i, p in enumerate(config.SNAPSHOT_PROBS)]))


@query("snapshot_numeric", f"{o.VIEWS} {_SNAP_SQL}")
def snapshot_numeric(spark, sf):
    return snapshot_rows(snapshot.build_snapshot(subset(datasets.star(spark, sf), "fact_orders", "fact_events")))


@query("snapshot_store", f"{o.VIEWS} {_SNAP_SQL}")
def snapshot_store(spark, sf):
    """A snapshot written by tag and read back."""
    path = scratch(spark)
    stores.save_snapshot(snapshot.build_snapshot(subset(datasets.star(spark, sf), "fact_orders", "fact_events"), "base"), path)
    return snapshot_rows(stores.load_snapshot(spark, path, "base"))


def _hist_sql(t: str, c: str) -> str:
    edge = lambda b: f"(lo + {b} * ((hi - lo) / 20))"
    return f"""SELECT '{t}' AS "table", '{c}' AS "column", b AS bin, round(any_value({edge('b')}), 6) AS low_edge,
    count(x) AS n FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}) s
    CROSS JOIN (SELECT unnest(range(20)) AS b) g
    LEFT JOIN (SELECT {c} AS x FROM {t}) v ON x >= {edge('b')} AND (x < {edge('(b + 1)')} OR (b = 19 AND x <= hi)) GROUP BY b"""


@query("snapshot_hist", f"{o.VIEWS} {_hist_sql('fact_orders', 'total_price')} UNION ALL {_hist_sql('fact_events', 'value')}")
def snapshot_hist(spark, sf):
    tables = datasets.star(spark, sf)
    out = []
    for t, c in (("fact_orders", "total_price"), ("fact_events", "value")):
        snap = snapshot.build_snapshot({t: tables[t].select(c)})
        out.append(snap.select("table", "column", "hist_edges", F.posexplode("hist_counts").alias("bin", "n"))
                   .select("table", "column", F.col("bin").cast("long").alias("bin"),
                           F.round(F.get("hist_edges", F.col("bin")), 6).alias("low_edge"), "n"))
    return union_all(out)


#: All text columns, and one of dates.
_TEXTS = {"fact_orders": ("status", "priority", "order_date"), "fact_events": ("event_type",), "dim_customers": ("customer_name", "segment"),
          "dim_parts": ("part_name", "brand"), "dim_suppliers": ("supplier_name",), "dim_users": ("user_name",),
          "documents": ("text", "lang", "source"), "conversations": ("role", "text"), "pages": ("url", "html"), "benchmark": ("text",)}
_TEXT_CELLS = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", {"strftime(order_date, '%Y-%m-%d %H:%M:%S')" if c == "order_date" else c} AS value FROM {t}"""
    for t, cs in _TEXTS.items() for c in cs)


@query("snapshot_topk", f"""{o.VIEWS}, cells AS ({_TEXT_CELLS})
SELECT "table", "column", value, n, round(n / total, 6) AS share FROM (
  SELECT "table", "column", value, count(*) AS n, sum(count(*)) OVER (PARTITION BY "table", "column") AS total,
         row_number() OVER (PARTITION BY "table", "column" ORDER BY count(*) DESC, value) AS place FROM cells WHERE value IS NOT NULL GROUP BY 1, 2, 3)
WHERE place <= 50""")
def snapshot_topk(spark, sf):
    star = datasets.star(spark, sf)
    tables = {t: (star[t] if t in star else datasets.read(spark, sf, t)).select(*cs) for t, cs in _TEXTS.items()}
    n = F.col("n_rows") - F.col("n_null")
    return (snapshot.build_snapshot(tables).select("table", "column", n.alias("total"), F.explode("top_value_fracs").alias("value", "share"))
            .select("table", "column", "value", F.round(F.col("share") * F.col("total")).cast("long").alias("n"),
                    F.round("share", 6).alias("share")))


@query("run_history", f"""{o.issues('high')} SELECT 'injected' AS source, 'high' AS sensitivity, count(*) AS issue_count,
'profiler -> detector' AS agent_trace FROM issues UNION ALL SELECT 'clean', 'high', 0, 'profiler -> detector'""")
def run_history(spark, sf):
    """Two runs logged, one malformed line ignored, read back newest first."""
    path = scratch(spark)
    clean = profile_tables(subset(datasets.star(spark, sf), "fact_orders", "dim_customers"))
    n_clean = checks.null_issues(clean, DIRTY_META, "high").count()
    _, _, issues = dirty_issues(spark, sf)
    for source, n in (("clean", n_clean), ("injected", issues.count())):
        stores.append_run(stores.run_entry(spark, source, "high", n, ["profiler", "detector"]), path)
    spark.createDataFrame([("{not json",), ("",)], "value string").write.mode("append").text(path)
    found = stores.run_history(spark, path)
    return found.select("source", "sensitivity", F.col("issue_count").cast("long").alias("issue_count"), "agent_trace")


@query("ranked_store", f"{o.scored()} SELECT {o.COMMON}, bis AS impact_score, 'injected' AS source FROM ranked")
def ranked_store(spark, sf):
    path = scratch(spark)
    stores.write_ranked(dirty_ranked(spark, sf), path, "injected")
    return (stores.load_ranked(spark, path, "injected")
            .select("issue_id", "issue_type", "table", F.array_join("columns", ",").alias("columns"), "severity",
                    "metric", "evidence_rows", "impact_score", "source"))


# ---- names, roles and keys -------------------------------------------------------------

@query("name_rules", r"""WITH w AS (SELECT replace(p_name, ' ', '_') || '_id' AS k, 'dim_' || replace(p_name, ' ', '_') || 's' AS t FROM part),
e AS (SELECT k, t, regexp_replace(k, '_id$', '') AS stem, regexp_replace(regexp_replace(lower(t), '^dim_', ''), '_.*$', '') AS first FROM w)
SELECT k AS key_name, stem AS key_stem, regexp_replace(lower(stem), '[^a-z0-9]', '', 'g') AS normal_stem,
  CASE WHEN first LIKE '%ies' THEN left(first, length(first) - 3) || 'y' WHEN first LIKE '%sses' THEN left(first, length(first) - 2)
       WHEN first LIKE '%ses' THEN left(first, length(first) - 1) WHEN first LIKE '%s' AND first NOT LIKE '%ss' THEN left(first, length(first) - 1)
       ELSE first END AS table_entity, 'dimension' AS role, count(*) AS n FROM e GROUP BY ALL""")
def name_rules(spark, sf):
    """Name rules over key and table names made from part names."""
    part = datasets.read(spark, sf, "part")
    joined = F.replace("p_name", F.lit(" "), F.lit("_"))
    named = part.select(F.concat(joined, F.lit("_id")).alias("k"),
                        F.concat(F.lit("dim_"), joined, F.lit("s")).alias("t"))
    return (named.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("k").alias("key_name"), names.key_stem(F.col("k")).alias("key_stem"),
                    names.norm(names.key_stem(F.col("k"))).alias("normal_stem"),
                    names.table_entity(F.col("t")).alias("table_entity"),
                    names.table_role(F.col("t")).alias("role"), "n")
            .groupBy("key_name", "key_stem", "normal_stem", "table_entity", "role").agg(F.sum("n").alias("n")))


_ROLE_SQL = f"""{o.VIEWS}, column_counts AS ({o.column_counts()})
SELECT tbl AS "table", col AS "column", CASE WHEN tbl LIKE '%fact%' THEN 'fact' ELSE 'dimension' END AS role,
  regexp_matches(col, '(_id|_sk|_key)$') AS is_key, coalesce(CASE WHEN col LIKE '%_id' THEN left(col, length(col) - 3) END, '') AS entity,
  regexp_matches(col, 'date|day') AS is_date,
  col IN ('total_price', 'discount_pct', 'line_number', 'quantity', 'price', 'discount', 'tax', 'value', 'balance', 'retail_price', 'nation_code') AS is_numeric,
  regexp_matches(col, 'promo|campaign|discount') AS is_promo, n AS n_rows, nulls AS n_null FROM column_counts"""


@query("column_roles", _ROLE_SQL)
def column_roles(spark, sf):
    tables = datasets.dirty(spark, sf)
    counts = profile_plan(tables).select("table", "column", "n_rows", "n_null")
    return (metadata.column_meta(tables).join(counts, ["table", "column"])
            .select("table", "column", "role", "is_key", F.coalesce("entity", F.lit("")).alias("entity"),
                    "is_date", "is_numeric", "is_promo", "n_rows", "n_null"))


_CANDIDATES = [("fact_orders", "order_id"), ("fact_lineitems", "order_id"), ("fact_lineitems", "part_id"),
               ("fact_lineitems", "supplier_id"), ("fact_events", "event_id"), ("fact_returns", "order_id"),
               ("dim_customers", "customer_id"), ("dim_parts", "part_id"), ("dim_suppliers", "supplier_id"), ("dim_users", "user_id")]


@query("pk_candidates", o.VIEWS + " " + " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows, "
    f"count(DISTINCT {c}) = count(*) AS is_unique FROM d_{t}" for t, c in _CANDIDATES))
def pk_candidates(spark, sf):
    tables = datasets.dirty(spark, sf)
    asked: dict[str, list[str]] = {}
    for r in metadata.key_candidates(metadata.column_meta(tables)).collect():
        asked.setdefault(r["table"], []).append(r["column"])
    n_rows = profile_plan(tables, measures=()).select("table", "column", "n_rows")
    return (distinct_counts(tables, asked).join(n_rows, ["table", "column"])
            .withColumn("is_unique", F.col("n_distinct") == F.col("n_rows")))


@query("primary_keys", o.VIEWS + " " + " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS pk, count(*) AS n_rows FROM d_{t}"
    for t, c in [("fact_events", "event_id"), ("fact_returns", "order_id"), ("dim_customers", "customer_id"),
                 ("dim_parts", "part_id"), ("dim_suppliers", "supplier_id"), ("dim_users", "user_id")]))
def primary_keys(spark, sf):
    tables = datasets.dirty(spark, sf)
    profile = profile_tables(tables)
    keys = metadata.primary_keys(tables, profile, local_copy(metadata.column_meta(tables)))
    return (profile.select("table", "n_rows").distinct()
            .join(spark.createDataFrame(list(keys.items()), "table string, pk string"), "table")
            .select("table", "pk", "n_rows"))


@query("fk_map", o.VIEWS + " " + " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{fk}' AS fk, '{dim}' AS dim_table, '{pk}' AS dim_pk, count({fk}) AS n_keys FROM d_{t}"
    for t, fk, dim, pk in o.FOREIGN))
def fk_map(spark, sf):
    tables = datasets.dirty(spark, sf)
    profile = profile_tables(tables)
    catalog = local_copy(metadata.column_meta(tables))
    links = metadata.foreign_keys(tables, profile, catalog, metadata.primary_keys(tables, profile, catalog))
    used = profile.select("table", F.col("column").alias("fk"), (F.col("n_rows") - F.col("n_null")).alias("n_keys"))
    return links.join(used, ["table", "fk"]).select("table", "fk", "dim_table", "dim_pk", "n_keys")


# ---- rule checks -----------------------------------------------------------------------

@query("column_profile", f"""{o.VIEWS}, column_counts AS ({o.column_counts()})
SELECT tbl AS "table", col AS "column", n AS n_rows, nulls AS n_null, round(coalesce(nulls / nullif(n, 0), 0), 6) AS null_share FROM column_counts""")
def column_profile(spark, sf):
    share = F.round(F.coalesce(F.try_divide("n_null", "n_rows"), F.lit(0.0)), 6).alias("null_share")
    return profile_plan(datasets.dirty(spark, sf), measures=("missing",)).select("table", "column", "n_rows", "n_null", share)


@query("null_issues", f"{o.issues('high')} SELECT {o.COMMON}, description FROM issues WHERE issue_type = 'missing_values'")
def null_issues(spark, sf):
    found = checks.null_issues(profile_tables(datasets.dirty(spark, sf), DIRTY_META, ("missing",)), DIRTY_META, "high")
    return flat_issues(found, "description")


@query("null_issues_normal", f"{o.issues('normal')} SELECT {o.COMMON} FROM issues WHERE issue_type = 'missing_values'")
def null_issues_normal(spark, sf):
    return flat_issues(checks.null_issues(profile_tables(datasets.dirty(spark, sf), DIRTY_META, ("missing",)), DIRTY_META, "normal"))


@query("dup_key", """SELECT count(*) AS n_rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS excess FROM lineitem""")
def dup_key(spark, sf):
    lineitem = datasets.read(spark, sf, "lineitem")
    return (checks.excess_copies(lineitem, ["l_orderkey", "l_linenumber"])
            .withColumn("n_rows", F.lit(lineitem.count()).cast("long")))


_DUP_SQL = f"""{o.VIEWS} SELECT 'fact_orders' AS "table", count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d_fact_orders)) AS excess FROM d_fact_orders
UNION ALL SELECT 'lineitem', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) FROM lineitem"""


@query("dup_fullrow", _DUP_SQL)
def dup_fullrow(spark, sf):
    orders, lineitem = datasets.dirty(spark, sf)["fact_orders"], datasets.read(spark, sf, "lineitem")
    return union_all(checks.excess_copies(df, df.columns).select(F.lit(t).alias("table"), "excess")
                     for t, df in (("fact_orders", orders), ("lineitem", lineitem)))


@query("dup_fullrow_hashed", _DUP_SQL)
def dup_fullrow_hashed(spark, sf):
    """The way large tables go: row hashes first."""
    tables = {"fact_orders": datasets.dirty(spark, sf)["fact_orders"], "lineitem": datasets.read(spark, sf, "lineitem")}
    return union_all(checks.excess_copies(df, df.columns, 2, hash_first=1).select(F.lit(t).alias("table"), "excess")
                     for t, df in tables.items())


_NESTED_SQL = """SELECT count(*) AS total_rows, count(*) - count(DISTINCT (user_id, event_type, value)) AS duplicate_rows FROM events"""


@query("dup_nested", _NESTED_SQL)
def dup_nested(spark, sf):
    """Events as maps: copies are told apart by what is in the map."""
    events = datasets.read(spark, sf, "events")
    nested = events.select(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"),
                                        F.lit("value"), F.col("value").cast("string")).alias("what"))
    return investigate.duplication_rate(nested).select("total_rows", "duplicate_rows")


def _outlier_sql(table: str, column: str, mult: float) -> str:
    return f"""SELECT '{table}.{column}' AS measure, {mult} AS multiplier, round(q1, 6) AS q1, round(q3, 6) AS q3,
    (SELECT count(*) FROM {table} WHERE {column} < q1 - {mult} * (q3 - q1) OR {column} > q3 + {mult} * (q3 - q1)) AS n_outliers
    FROM (SELECT quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3 FROM {table})"""


_IQR_MEASURES = (("events", "value"), ("documents", "n_chars"), ("orders", "o_totalprice"), ("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"))
_IQR_SQL = " UNION ALL ".join(_outlier_sql(t, c, m) for t, c in _IQR_MEASURES for m in (1.5, 3.0))


def _iqr(spark, sf, bracket_rows):
    out = []
    for t, c in _IQR_MEASURES:
        df = datasets.read(spark, sf, t).select(c)
        fence = checks.quartile_fences(df, [c], bracket_rows=bracket_rows)[c]
        counts = df.agg(*[F.count_if(checks.beyond(df, fence, m)).alias(f"m{i}") for i, m in enumerate((1.5, 3.0))])
        out.append(counts.select(F.inline(F.array(*[
            F.struct(F.lit(f"{t}.{c}").alias("measure"), F.lit(m).alias("multiplier"), F.round(F.lit(fence.q1), 6).alias("q1"),
                     F.round(F.lit(fence.q3), 6).alias("q3"), F.col(f"m{i}").alias("n_outliers"))
            for i, m in enumerate((1.5, 3.0))]))))
    return union_all(out)


@query("iqr_outliers", _IQR_SQL)
def iqr_outliers(spark, sf):
    return _iqr(spark, sf, config.BRACKET_ROWS)


@query("iqr_outliers_bracketed", _IQR_SQL)
def iqr_outliers_bracketed(spark, sf):
    """The way large tables go: brackets from a sketch, counted exactly."""
    return _iqr(spark, sf, 20)


_DATE_INT = "CAST(year(order_date) * 10000 + month(order_date) * 100 + day(order_date) AS BIGINT)"


@query("future_int", f"{o.VIEWS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_DATE_INT} > 20500101) AS n_future FROM d_fact_orders")
def future_int(spark, sf):
    orders = datasets.dirty(spark, sf)["fact_orders"].selectExpr(f"{_DATE_INT} AS date_key")
    return profile_plan({"fact_orders": orders}, measures=("future",)).select("n_rows", "n_future")


@query("future_text", f"{o.VIEWS} SELECT status, count(*) AS n_rows, count(*) FILTER (WHERE order_date > TIMESTAMP '2050-01-01') AS n_future FROM d_fact_orders GROUP BY status")
def future_text(spark, sf):
    """ISO dates, ISO datetimes with a zone, and compact dates in one text column."""
    orders = datasets.dirty(spark, sf)["fact_orders"]
    text = (F.when(F.col("order_id") % 3 == 0, F.date_format("order_date", "yyyy-MM-dd"))
            .when(F.col("order_id") % 3 == 1, F.date_format("order_date", "yyyy-MM-dd'T'12:00:00+00:00"))
            .otherwise(F.date_format("order_date", "yyyyMMdd")))
    dated = orders.select("status", text.alias("order_day"))
    return dated.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(after_cutoff(dated, "order_day")).alias("n_future"))


@query("future_dates", f"{o.issues('high')} SELECT {o.COMMON} FROM issues WHERE issue_type = 'invalid_future_dates'")
def future_dates(spark, sf):
    return flat_issues(checks.future_date_issues(profile_tables(datasets.dirty(spark, sf), DIRTY_META, ("future",))))


@query("fk_orphans", f"""{o.VIEWS} SELECT tbl AS "table", col AS "column", n AS n_rows, hits AS n_orphans, dim_table, dim_pk FROM ({o.orphan_source()})""")
def fk_orphans(spark, sf):
    tables = datasets.dirty(spark, sf)
    return (checks.reference_breaks(tables, profile_tables(tables, DIRTY_META, ()), DIRTY_META)
            .select("table", "column", "n_rows", "n_orphans", "dim_table", "dim_pk"))


@query("fk_orphans_grouped", f"""{o.VIEWS} SELECT tbl AS "table", col AS "column", n AS n_rows, hits AS n_orphans, dim_table, dim_pk FROM ({o.orphan_source()})""")
def fk_orphans_grouped(spark, sf):
    """Key by key, each link in a grouping of its own."""
    tables = datasets.dirty(spark, sf)
    sizes = table_sizes(profile_tables(tables, DIRTY_META, ()))
    return union_all(references.orphan_counts(tables[x.table], x.fk, tables[x.dim], x.pk).agg(
        F.lit(x.table).alias("table"), F.lit(x.fk).alias("column"), F.lit(sizes[x.table]).alias("n_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_orphans"), F.lit(x.dim).alias("dim_table"), F.lit(x.pk).alias("dim_pk"))
        for x, _, _ in checks.reference_links(tables, sizes, DIRTY_META))


#: Keys of orders and customers as other number types, some beyond what a double tells apart, some with fractions.
_MIXED = {
    "big_double": ("CAST({c} + 9007199254740992 AS BIGINT)", "CAST({c} + 9007199254740992 AS DOUBLE)"),
    "double_big": ("CAST({c} AS DOUBLE) + CASE WHEN {c} % 7 = 0 THEN 0.5 ELSE 0 END", "CAST({c} AS BIGINT)"),
    "big_decimal": ("CAST({c} AS BIGINT)", "CAST({c} AS DECIMAL(20,2)) + CAST(CASE WHEN {c} % 5 = 0 THEN 0.25 ELSE 0 END AS DECIMAL(20,2))"),
    "decimal_double": ("CAST({c} * 0.25 AS DECIMAL(18,2))", "CAST({c} AS DOUBLE) * 0.25"),
    "double_double": ("CAST({c} AS DOUBLE) / 8", "CAST({c} AS FLOAT) / 8"),
}
#: What DuckDB compares: all keys as exact decimals, fractions of a double with two places more than any decimal here.
_EXACT = "CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS HUGEINT) AS DECIMAL(38,6)) ELSE CAST({x} AS DECIMAL(38,6)) END"


def _mixed_sql(name: str, fact: str, dim: str) -> str:
    exact = lambda side, sql: (_EXACT if "DOUBLE" in sql or "FLOAT" in sql else "CAST({x} AS DECIMAL(38,6))").format(x=side)        # noqa: E731
    f, d = fact.format(c="o_custkey"), dim.format(c="c_custkey")
    return f"""SELECT 'fact_{name}' AS "table", 'k' AS "column", (SELECT count(*) FROM orders) AS n_rows, count(*) AS n_orphans,
    'dim_{name}' AS dim_table, 'k' AS dim_pk FROM (SELECT {f} AS k FROM orders) f
    WHERE k IS NOT NULL AND {exact('f.k', fact)} NOT IN (SELECT {exact('d.k', dim)} FROM (SELECT {d} AS k FROM customer WHERE c_custkey % 3 <> 0) d)"""


@query("fk_orphans_mixed", " UNION ALL ".join(_mixed_sql(n, *sides) for n, sides in _MIXED.items()))
def fk_orphans_mixed(spark, sf):
    """Keys of different number types are compared exactly, in the check and in the re-count."""
    orders, customers = datasets.read(spark, sf, "orders"), datasets.read(spark, sf, "customer").where("c_custkey % 3 <> 0")
    tables, meta = {}, {}
    for name, (fact, dim) in _MIXED.items():
        tables[f"fact_{name}"] = orders.selectExpr(f"{fact.format(c='o_custkey')} AS k")
        tables[f"dim_{name}"] = customers.selectExpr(f"{dim.format(c='c_custkey')} AS k")
        meta[f"fact_{name}"] = TableMeta("fact", "x", (), {"k": (f"dim_{name}", "k")}, (), (), ())
        meta[f"dim_{name}"] = TableMeta("dimension", name, ("k",), {}, (), (), ())
    profile = profile_tables(tables, meta)
    found = checks.reference_breaks(tables, profile, meta)
    again = verify.verify_issues(tables, checks.reference_issues(tables, profile, meta)).select(F.col("table").alias("t"), "sql_count")
    return (found.join(again, found["table"] == again["t"], "left")
            .withColumn("n_orphans", F.when(F.col("n_orphans") == F.coalesce("sql_count", F.lit(0)), F.col("n_orphans")))
            .select("table", "column", "n_rows", "n_orphans", "dim_table", "dim_pk"))


@query("empty_tables", f"{o.issues('high')} SELECT {o.COMMON} FROM issues WHERE issue_type = 'empty_table'")
def empty_tables(spark, sf):
    return flat_issues(checks.empty_table_issues(profile_tables(datasets.dirty(spark, sf), DIRTY_META)))


@query("all_checks", f"{o.issues('high')} SELECT {o.COMMON}, description, dim_table, dim_pk FROM issues")
def all_checks(spark, sf):
    _, _, issues = dirty_issues(spark, sf)
    return issues.withColumn("columns", F.array_join("columns", ","))


@query("all_checks_normal", f"{o.issues('normal')} SELECT {o.COMMON}, description, dim_table, dim_pk FROM issues")
def all_checks_normal(spark, sf):
    _, _, issues = dirty_issues(spark, sf, "normal")
    return issues.withColumn("columns", F.array_join("columns", ","))


# ---- verification ----------------------------------------------------------------------

_VERIFIED_SQL = """, verified AS (SELECT *, CASE WHEN issue_type = 'duplicate_rows' AND len(cols) = 0 THEN 0.5 ELSE 1.0 END AS confidence FROM issues)"""


@query("verify_counts", f"{o.issues('high')} {_VERIFIED_SQL} SELECT {o.COMMON}, evidence_rows AS sql_count, evidence_rows AS pd_count, confidence FROM verified")
def verify_counts(spark, sf):
    tables, profile, issues = dirty_issues(spark, sf)
    return (verify.verify_issues(tables, issues, "high")
            .withColumn("columns", F.array_join("columns", ",")).drop("description", "dim_table", "dim_pk"))


@query("verify_key_copies", f"""{o.VIEWS} SELECT 'fact_orders' AS "table", 'order_id' AS "columns", count(*) - count(DISTINCT order_id) AS evidence_rows,
  count(*) - count(DISTINCT order_id) AS sql_count, 1.0 AS confidence FROM d_fact_orders
UNION ALL SELECT 'fact_lineitems', 'order_id,line_number', count(*) - count(DISTINCT (order_id, line_number)), count(*) - count(DISTINCT (order_id, line_number)), 1.0
FROM (SELECT * FROM d_fact_lineitems UNION ALL SELECT * FROM d_fact_lineitems WHERE order_id % 5 = 0)""")
def verify_key_copies(spark, sf):
    """Copies of a key and of a key of two columns, counted by the check and again beside the references of their tables."""
    tables = datasets.dirty(spark, sf)
    lines = tables["fact_lineitems"]
    tables["fact_lineitems"] = lines.unionByName(lines.where("order_id % 5 = 0"))
    keys = {"fact_orders": ("order_id",), "fact_lineitems": ("order_id", "line_number")}
    meta = {t: replace(m, primary_keys=keys.get(t, m.primary_keys)) for t, m in DIRTY_META.items()}
    profile = profile_tables(tables, meta)
    issues = checks.duplicate_issues(tables, profile, meta, "high").unionByName(checks.reference_issues(tables, profile, meta))
    found = verify.verify_issues(tables, issues, "high").where("issue_type = 'duplicate_rows'")
    return found.select("table", F.array_join("columns", ",").alias("columns"), "evidence_rows", "sql_count", "confidence")


@query("verify_bracketed", f"{o.issues('high')} {_VERIFIED_SQL} SELECT {o.COMMON}, evidence_rows AS sql_count, evidence_rows AS pd_count, confidence FROM verified")
def verify_bracketed(spark, sf):
    tables, _, issues = dirty_issues(spark, sf)
    return (verify.verify_issues(tables, issues, "high", bracket_rows=20)
            .withColumn("columns", F.array_join("columns", ",")).drop("description", "dim_table", "dim_pk"))


@query("verify_mismatch", f"""{o.issues('high')}, normal AS ({o.outlier_source(3.0)})
SELECT i.issue_id, i.evidence_rows AS pd_count, n.hits AS sql_count,
  round(least(n.hits, i.evidence_rows) / greatest(n.hits, i.evidence_rows, 1), 4) AS confidence
FROM issues i JOIN normal n ON i.tbl = n.tbl AND i.cols[1] = n.col WHERE issue_type = 'numeric_outliers'""")
def verify_mismatch(spark, sf):
    """Issues found at high sensitivity re-counted at normal: the confidence falls."""
    tables = datasets.dirty(spark, sf)
    profile = profile_tables(tables, DIRTY_META)
    issues = checks.outlier_issues(tables, profile, DIRTY_META, "high")
    return (verify.verify_issues(tables, issues, "normal")
            .select("issue_id", "pd_count", "sql_count", "confidence"))


@query("review_queue", f"{o.issues('high')} {_VERIFIED_SQL} SELECT issue_id, confidence, "
       "format('[{}] {} in {} - confidence={:.2f}, evidence_rows={}', issue_id, issue_type, tbl, confidence, evidence_rows) AS prompt "
       "FROM verified WHERE confidence < 0.7")
def review_queue(spark, sf):
    tables, profile, issues = dirty_issues(spark, sf)
    verified = verify.verify_issues(tables, issues, "high")
    return verify.low_confidence(verified).select("issue_id", "confidence", "prompt")


@query("needs_review", f"{o.issues('high')} {_VERIFIED_SQL} SELECT bool_or(confidence < 0.7) AS needs_review, count(*) FILTER (WHERE confidence < 0.7) AS n_low FROM verified")
def needs_review(spark, sf):
    tables, profile, issues = dirty_issues(spark, sf)
    verified = verify.verify_issues(tables, issues, "high")
    return verified.agg(verify.needs_review(verified).alias("needs_review"),
                        F.count_if(F.col("confidence") < config.REVIEW_BELOW).alias("n_low"))


@query("decision_filter", f"{o.issues('high')} SELECT {o.COMMON} FROM issues WHERE issue_id NOT IN ('DDUP_0001', 'DNULL_0002')")
def decision_filter(spark, sf):
    _, _, issues = dirty_issues(spark, sf)
    return flat_issues(verify.apply_decision(issues, "reject ddup_0001, DNULL_0002"))


# ---- drift -----------------------------------------------------------------------------

_MEASURES = [(t, c) for t, cs in o.NUMERIC.items() if t != "fact_returns" for c in cs]
_PROBS = [0.0, *config.SNAPSHOT_PROBS, 1.0]
_J = "least(" + " + ".join(f"CAST(t >= {p}::DOUBLE AS INT)" for p in _PROBS) + ", 10)"
_POINTS_SQL = f"""knots AS ({" UNION ALL ".join(
    f"SELECT '{t}' AS tbl, {o.TABLES.index(t)} AS tpos, '{c}' AS col, {o.COLUMNS[t].index(c)} AS cpos, list_concat(list_concat([min({c})::DOUBLE], "
    f"quantile_cont({c}::DOUBLE, {list(config.SNAPSHOT_PROBS)})), [max({c})::DOUBLE]) AS v FROM {t}" for t, c in _MEASURES)}),
grid AS (SELECT i, CASE WHEN i = 999 THEN 1.0::DOUBLE ELSE i * (1::DOUBLE / 999) END AS t FROM (SELECT unnest(range(1000)) AS i)),
placed AS (SELECT tbl, tpos, col, cpos, i, t, v, {_J} AS j, [{', '.join(f'{p}::DOUBLE' for p in _PROBS)}] AS p FROM knots CROSS JOIN grid),
points AS (SELECT tbl, tpos, col, cpos, i, (v[j + 1] - v[j]) / (p[j + 1] - p[j]) * (t - p[j]) + v[j] AS value FROM placed)"""
_CURRENT_SQL = "current AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, '{c}' AS col, {c}::DOUBLE AS value FROM d_{t}" for t, c in _MEASURES) + ")"
_PSI_SQL = """sorted AS (SELECT tbl, col, list(value ORDER BY value) AS a FROM points GROUP BY ALL),
cuts0 AS (SELECT tbl, col, a, CASE WHEN k = 10 THEN 999::DOUBLE ELSE 999 * (k * 0.1::DOUBLE) END AS pos FROM sorted CROSS JOIN (SELECT unnest(range(11)) AS k)),
cuts AS (SELECT DISTINCT tbl, col, a[floor(pos)::INT + 1] + (a[least(floor(pos)::INT + 2, 1000)] - a[floor(pos)::INT + 1]) * (pos - floor(pos)) AS low FROM cuts0),
spans AS (SELECT *, lead(low) OVER w AS high, lead(low, 2) OVER w IS NULL AS last FROM cuts WINDOW w AS (PARTITION BY tbl, col ORDER BY low)),
bins AS (SELECT s.tbl, s.col, s.low,
  (SELECT count(*) FROM points p WHERE p.tbl = s.tbl AND p.col = s.col AND p.value >= s.low AND (p.value < s.high OR (s.last AND p.value = s.high))) AS r,
  (SELECT count(*) FROM current c WHERE c.tbl = s.tbl AND c.col = s.col AND c.value >= s.low AND (c.value < s.high OR (s.last AND c.value = s.high))) AS c
  FROM spans s WHERE high IS NOT NULL),
shares AS (SELECT tbl, col, CASE WHEN r = 0 THEN 0.0001 ELSE r / greatest(sum(r) OVER w, 1) END AS rs,
  CASE WHEN c = 0 THEN 0.0001 ELSE c / greatest(sum(c) OVER w, 1) END AS cs FROM bins WINDOW w AS (PARTITION BY tbl, col)),
psi AS (SELECT tbl, col, greatest(sum((cs - rs) * ln(cs / rs)), 0) AS psi FROM shares GROUP BY ALL)"""
_KS_SQL = """steps AS (SELECT tbl, col, value, sum(r) AS r, sum(c) AS c FROM (
  SELECT tbl, col, value, 1 AS r, 0 AS c FROM points UNION ALL SELECT tbl, col, value, 0, 1 FROM current WHERE value IS NOT NULL) GROUP BY ALL),
ks AS (SELECT tbl, col, max(abs(fr - fc)) AS d, any_value(nr) AS n_ref, any_value(nc) AS n_cur FROM (SELECT tbl, col,
  sum(r) OVER w / sum(r) OVER g AS fr, sum(c) OVER w / sum(c) OVER g AS fc, sum(r) OVER g AS nr, sum(c) OVER g AS nc FROM steps
  WINDOW w AS (PARTITION BY tbl, col ORDER BY value), g AS (PARTITION BY tbl, col)) GROUP BY ALL),
pvals AS (SELECT *, least(greatest(2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * d * d * (n_ref * n_cur / (n_ref + n_cur))))
  FROM (SELECT unnest(range(1, 101)) AS k)), 0), 1) AS p FROM ks)"""
_DRIFT_HEAD = f"{o.VIEWS}, {_POINTS_SQL}, {_CURRENT_SQL}"


def _snapshot_stats(spark, sf):
    clean = subset(datasets.star(spark, sf), "fact_orders", "fact_lineitems", "fact_events")
    tables = subset(datasets.dirty(spark, sf), *clean)
    base = profile_tables(clean)
    measures = {t: clean[t].select(*DIRTY_META[t].numeric_cols) for t in clean}
    snap = snapshot.build_snapshot(measures, profile=base)
    return drift.snapshot_drift(tables, profile_tables(tables, DIRTY_META), DIRTY_META, snap)


@query("cdf_rebuild", f"""{_DRIFT_HEAD} SELECT tbl AS "table", col AS "column", i AS place, round(value, 6) AS value FROM points""")
def cdf_rebuild(spark, sf):
    clean = datasets.star(spark, sf)
    snap = snapshot.build_snapshot({t: clean[t].select(*DIRTY_META[t].numeric_cols)
                                    for t in ("fact_orders", "fact_lineitems", "fact_events")})
    place = F.row_number().over(Window.partitionBy("table", "column").orderBy("value")) - 1
    return (drift.cdf_points(snap).withColumn("place", place.cast("long"))
            .select("table", "column", "place", F.round("value", 6).alias("value")))


@query("psi", f"""{_DRIFT_HEAD}, {_PSI_SQL} SELECT tbl AS "table", col AS "column", round(psi, 6) AS psi,
CASE WHEN psi < 0.1 THEN 'low' WHEN psi < 0.25 THEN 'medium' ELSE 'high' END AS severity FROM psi""")
def psi(spark, sf):
    return _snapshot_stats(spark, sf).select("table", "column", six("psi"), psi_severity(F.col("psi")).alias("severity"))


@query("ks_stat", f"""{_DRIFT_HEAD}, {_KS_SQL} SELECT tbl AS "table", col AS "column", CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
round(d, 6) AS ks_d, round(p, 3) AS p_value FROM pvals""")
def ks_stat(spark, sf):
    p = kolmogorov_p(F.col("ks_d"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double"))
    return _snapshot_stats(spark, sf).select("table", "column", "n_ref", "n_cur", six("ks_d"), F.round(p, 3).alias("p_value"))


@query("drift_direction", f"""{_DRIFT_HEAD} SELECT tbl AS "table", col AS "column", CASE WHEN abs(rm) < 1e-9 THEN 'shift' WHEN cm / rm > 1.1 THEN 'increase'
WHEN cm / rm < 0.9 THEN 'decrease' ELSE 'shift' END AS direction FROM (SELECT tbl, col, avg(value) AS rm FROM points GROUP BY ALL)
JOIN (SELECT tbl, col, avg(value) AS cm FROM current GROUP BY ALL) USING (tbl, col)""")
def drift_direction(spark, sf):
    return _snapshot_stats(spark, sf).select(
        "table", "column", direction(F.col("ref_mean"), F.col("cur_mean")).alias("direction"))


_TESTS_SQL = """tests AS (SELECT tbl, col, 1 AS pref, CASE WHEN psi < 0.1 THEN 0 WHEN psi < 0.25 THEN 1 ELSE 2 END AS sev, round(least(psi / 0.25, 1), 4) AS metric FROM psi
  UNION ALL SELECT tbl, col, 2, CASE WHEN p >= 0.05 THEN 0 WHEN p >= 0.01 THEN 1 ELSE 2 END, round(d, 4) FROM pvals),
best AS (SELECT *, row_number() OVER (PARTITION BY tbl, col ORDER BY sev DESC, pref) AS place FROM tests WHERE sev > 0),
drifted AS (SELECT 'DRIFT_' || lpad(CAST(row_number() OVER (ORDER BY tpos, cpos) AS VARCHAR), 4, '0') AS issue_id, 'statistical_drift' AS issue_type,
  tbl, [col] AS cols, CASE sev WHEN 2 THEN 'high' ELSE 'medium' END AS severity, metric, CAST(0 AS BIGINT) AS evidence_rows
  FROM best JOIN knots USING (tbl, col) WHERE place = 1)"""
#: After ``scored``: rule issues and drift together, ranked, with the confidence each would get.
DRIFT_RANKED = f"""{_POINTS_SQL}, {_CURRENT_SQL}, {_PSI_SQL}, {_KS_SQL}, {_TESTS_SQL},
everything AS (SELECT issue_id, issue_type, tbl, cols, severity, metric, evidence_rows, bis,
    CASE WHEN issue_type = 'duplicate_rows' AND len(cols) = 0 THEN 0.5 ELSE 1.0 END AS confidence FROM scored
  UNION ALL SELECT d.*, round(2.5::DOUBLE * (CASE severity WHEN 'high' THEN 3 ELSE 2 END) * least(metric, 1) * (1.9::DOUBLE / 6.75::DOUBLE), 6), 0.8 FROM drifted d),
all_ranked AS (SELECT *, row_number() OVER (ORDER BY bis DESC, tbl, issue_type, issue_id) AS rnk FROM everything WHERE bis >= 0.05)"""


@query("drift_issues", f"{_DRIFT_HEAD}, {_PSI_SQL}, {_KS_SQL}, {_TESTS_SQL} SELECT {o.COMMON} FROM drifted")
def drift_issues(spark, sf):
    return flat_issues(drift.drift_issues(_snapshot_stats(spark, sf)))


#: Measures of the facts, and a copy of the line items whose prices have moved beyond all former ones.
_BASELINE = {"fact_orders": ("total_price", "discount_pct"), "fact_lineitems": ("line_number", "quantity", "price", "discount", "tax"), "fact_events": ("value",)}


def _baseline_sql(table: str, column: str, now: str, as_table: str | None = None) -> str:
    """PSI and KS of one whole column of ``now`` against the whole clean column."""
    return f"""SELECT '{as_table or table}' AS "table", '{column}' AS "column", (SELECT count({column}) FROM {table}) AS n_ref, (SELECT count({column}) FROM {now}) AS n_cur, (
  SELECT round(max(abs(fr - fc)), 6) FROM (SELECT sum(sum(r)) OVER (ORDER BY x) / (SELECT count({column}) FROM {table}) AS fr,
    sum(sum(c)) OVER (ORDER BY x) / (SELECT count({column}) FROM {now}) AS fc
    FROM (SELECT {column} AS x, 1 AS r, 0 AS c FROM {table} UNION ALL SELECT {column}, 0, 1 FROM {now}) GROUP BY x)) AS ks_d, (
  WITH cuts AS (SELECT DISTINCT unnest(quantile_cont({column}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS low FROM {table}),
  spans AS (SELECT low, lead(low) OVER (ORDER BY low) AS high, lead(low, 2) OVER (ORDER BY low) IS NULL AS last FROM cuts),
  bins AS (SELECT (SELECT count(*) FROM {table} WHERE {column} >= low AND ({column} < high OR (last AND {column} = high))) AS r,
    (SELECT count(*) FROM {now} WHERE {column} >= low AND ({column} < high OR (last AND {column} = high))) AS c FROM spans WHERE high IS NOT NULL),
  shares AS (SELECT CASE WHEN r = 0 THEN 0.0001 ELSE r / sum(r) OVER () END AS rs, CASE WHEN c = 0 THEN 0.0001 ELSE c / sum(c) OVER () END AS cs FROM bins)
  SELECT round(greatest(sum((cs - rs) * ln(cs / rs)), 0), 6) FROM shares) AS psi"""


_BASELINE_SQL = f"{o.VIEWS}, moved AS (SELECT * REPLACE (price + 1000000 AS price) FROM fact_lineitems) " + " UNION ALL ".join(
    [_baseline_sql(t, c, f"d_{t}") for t, cs in _BASELINE.items() for c in cs]
    + [_baseline_sql("fact_lineitems", "price", "moved", "fact_moved")])


def _baseline(spark, sf, per_bucket=None):
    """Dirty facts against the clean ones as baseline tables, and prices that have moved."""
    star = datasets.star(spark, sf)
    tables, baseline = subset(datasets.dirty(spark, sf), *_BASELINE), subset(star, *_BASELINE)
    baseline["fact_moved"] = star["fact_lineitems"].select("price")
    tables["fact_moved"] = baseline["fact_moved"].withColumn("price", F.col("price") + 1000000)
    meta = {**DIRTY_META, "fact_moved": TableMeta("fact", "moved", (), {}, (), ("price",), ())}
    return (drift.baseline_drift(tables, profile_tables(tables, meta), meta, baseline, per_bucket=per_bucket)
            .select("table", "column", "n_ref", "n_cur", six("ks_d"), six("psi")))


@query("baseline_ks_ranged", _BASELINE_SQL)
def baseline_ks_ranged(spark, sf):
    """The way large columns go: many ranges, here of about 20,000 values."""
    return _baseline(spark, sf, per_bucket=20_000)


@query("baseline_ks", _BASELINE_SQL)
def baseline_ks(spark, sf):
    """Whole-column tests of every measure of every fact."""
    return _baseline(spark, sf)
