"""SQL text of the views and issue tables, used only to state expected results."""

from __future__ import annotations

from tablewarden import config
from tablewarden.plans import datasets as d


def hit(key: str, k: int, every: int = 50) -> str:
    return f"(({key}) * 7919 + {k}) % {every} = 0"


STAR = {
    "fact_orders": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
        o_totalprice AS total_price, CAST(o_orderkey % 11 AS DOUBLE) AS discount_pct,
        o_orderstatus AS status, o_orderpriority AS priority FROM orders""",
    "fact_lineitems": """SELECT l_orderkey AS order_id, l_partkey AS part_id, l_suppkey AS supplier_id,
        l_linenumber AS line_number, l_quantity AS quantity, l_extendedprice AS price,
        l_discount AS discount, l_tax AS tax, l_shipdate AS ship_date FROM lineitem""",
    "fact_events": "SELECT event_id, user_id, ts AS event_date, value, event_type FROM events",
    "fact_returns": "SELECT l_orderkey AS order_id, l_quantity AS quantity FROM lineitem WHERE l_quantity < 0",
    "dim_customers": """SELECT c_custkey AS customer_id, c_name AS customer_name, c_acctbal AS balance,
        c_mktsegment AS segment FROM customer""",
    "dim_parts": """SELECT p_partkey AS part_id, p_name AS part_name, p_brand AS brand,
        p_retailprice AS retail_price FROM part""",
    "dim_suppliers": "SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_acctbal AS balance FROM supplier",
    "dim_users": "SELECT c_custkey AS user_id, c_name AS user_name, c_nationkey AS nation_code FROM customer",
}
_BAD = f"""SELECT order_id,
    CASE WHEN {hit('order_id', d.NULL_KEY)} THEN NULL WHEN {hit('order_id', d.ORPHAN)} THEN customer_id + 1000000
         ELSE customer_id END AS customer_id,
    CASE WHEN {hit('order_id', d.FUTURE)} THEN TIMESTAMP '2099-01-01' ELSE order_date END AS order_date,
    CASE WHEN {hit('order_id', d.OUTLIER)} THEN total_price * 10 ELSE total_price END AS total_price,
    CASE WHEN {hit('order_id', d.PROMO)} THEN discount_pct * 3 ELSE discount_pct END AS discount_pct,
    status, priority FROM fact_orders"""
DIRTY = {
    "d_fact_orders": f"SELECT * FROM bad_orders UNION ALL SELECT * FROM bad_orders WHERE {hit('order_id', d.DUPLICATE)}",
    "d_fact_lineitems": """SELECT order_id, part_id, supplier_id, line_number, quantity, price, discount,
        CASE WHEN order_id % 3 = 0 THEN tax * 3 ELSE tax END AS tax, ship_date FROM fact_lineitems""",
    "d_fact_events": "SELECT * FROM fact_events",
    "d_fact_returns": "SELECT * FROM fact_returns",
    "d_dim_customers": f"""SELECT customer_id, CASE WHEN NOT ({hit('customer_id', d.DIM_NULL, 33)}) THEN customer_name END
        AS customer_name, balance, segment FROM dim_customers""",
    "d_dim_parts": "SELECT * FROM dim_parts",
    "d_dim_suppliers": "SELECT * FROM dim_suppliers",
    "d_dim_users": "SELECT * FROM dim_users",
}
VIEWS = ("WITH " + ",\n".join(f"{n} AS ({q})" for n, q in STAR.items())
         + f",\nbad_orders AS ({_BAD}),\n" + ",\n".join(f"{n} AS ({q})" for n, q in DIRTY.items()))

COLUMNS = {
    "fact_orders": "order_id customer_id order_date total_price discount_pct status priority",
    "fact_lineitems": "order_id part_id supplier_id line_number quantity price discount tax ship_date",
    "fact_events": "event_id user_id event_date value event_type",
    "fact_returns": "order_id quantity",
    "dim_customers": "customer_id customer_name balance segment",
    "dim_parts": "part_id part_name brand retail_price",
    "dim_suppliers": "supplier_id supplier_name balance",
    "dim_users": "user_id user_name nation_code",
}
COLUMNS = {t: c.split() for t, c in COLUMNS.items()}
TABLES = list(COLUMNS)
DATES = {("fact_orders", "order_date"), ("fact_lineitems", "ship_date"), ("fact_events", "event_date")}
NUMERIC = {"fact_orders": ["total_price", "discount_pct"],
           "fact_lineitems": ["line_number", "quantity", "price", "discount", "tax"],
           "fact_events": ["value"], "fact_returns": ["quantity"]}
FOREIGN = [("fact_orders", "customer_id", "dim_customers", "customer_id"),
           ("fact_lineitems", "part_id", "dim_parts", "part_id"),
           ("fact_lineitems", "supplier_id", "dim_suppliers", "supplier_id"),
           ("fact_events", "user_id", "dim_users", "user_id")]
KEYS = {"fact_events": "event_id", "dim_customers": "customer_id", "dim_parts": "part_id",
        "dim_suppliers": "supplier_id", "dim_users": "user_id"}


def _sev(x: str) -> str:
    return f"CASE WHEN {x} >= 0.05 THEN 'high' WHEN {x} >= 0.01 THEN 'medium' ELSE 'low' END"


def column_counts(prefix: str = "d_") -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, {i} AS tpos, '{c}' AS col, {j} AS cpos, count(*) AS n, count(*) - count({c}) AS nulls "
        f"FROM {prefix}{t}" for i, t in enumerate(TABLES) for j, c in enumerate(COLUMNS[t]))


def _numbered(kind: str, source: str, cols: str, share: str, evidence: str, text: str,
              dim_table: str = "''", dim_pk: str = "''") -> str:
    return f"""SELECT '{config.ID_PREFIX[kind]}' || lpad(CAST(row_number() OVER (ORDER BY tpos, cpos) AS VARCHAR), 4, '0') AS issue_id,
        '{kind}' AS issue_type, tbl, {cols} AS cols, {_sev(share)} AS severity, round({share}, 6) AS metric,
        CAST({evidence} AS BIGINT) AS evidence_rows, {text} AS description, {dim_table} AS dim_table, {dim_pk} AS dim_pk
        FROM ({source})"""


def outlier_source(multiplier: float, prefix: str = "d_") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS tbl, {TABLES.index(t)} AS tpos, '{c}' AS col, {COLUMNS[t].index(c)} AS cpos,
        (SELECT count({c}) FROM {prefix}{t}) AS n, q1, q3,
        (SELECT count(*) FROM {prefix}{t} WHERE {c} < q1 - {multiplier} * (q3 - q1) OR {c} > q3 + {multiplier} * (q3 - q1)) AS hits
        FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {prefix}{t})"""
        for t, cs in NUMERIC.items() for c in cs)


def orphan_source() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS tbl, {TABLES.index(t)} AS tpos, '{fk}' AS col, {[f[1] for f in FOREIGN if f[0] == t].index(fk)} AS cpos,
        (SELECT count(*) FROM d_{t}) AS n, count(*) AS hits, '{dim}' AS dim_table, '{pk}' AS dim_pk FROM d_{t} f
        WHERE f.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_{dim} x WHERE x.{pk} = f.{fk})"""
        for t, fk, dim, pk in FOREIGN)


def duplicate_source() -> str:
    parts = []
    for i, t in enumerate(TABLES):
        if t == "fact_returns":
            continue
        key = KEYS.get(t)
        distinct = f"count(DISTINCT {key})" if key else f"(SELECT count(*) FROM (SELECT DISTINCT * FROM d_{t}))"
        cols = f"['{key}']" if key else "CAST([] AS VARCHAR[])"
        how = "primary key columns." if key else "all columns (no primary key found)."
        parts.append(f"SELECT '{t}' AS tbl, {i} AS tpos, 0 AS cpos, count(*) AS n, count(*) - {distinct} AS hits, "
                     f"{cols} AS cols, ' duplicate excess copies in ''{t}'' on {how}' AS how FROM d_{t}")
    return " UNION ALL ".join(parts)


def issues(sensitivity: str = "high") -> str:
    """CTE list ending in ``issues(issue_id, issue_type, tbl, cols, severity, metric, ...)``."""
    high = sensitivity == "high"
    limit = "0.01" if high else "CASE WHEN regexp_matches(col, '(_id|_sk|_key)$') OR regexp_matches(col, 'date|day') THEN 0.01 ELSE 0.05 END"
    mult = config.IQR_MULTIPLIER[sensitivity]
    out_min, dup_min = config.OUTLIER_MIN_SHARE[sensitivity], config.DUPLICATE_MIN_SHARE[sensitivity]
    dates = " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, {TABLES.index(t)} AS tpos, '{c}' AS col, {COLUMNS[t].index(c)} AS cpos, count(*) AS n, "
        f"count(*) FILTER (WHERE {c} > TIMESTAMP '2050-01-01') AS hits FROM d_{t}" for t, c in sorted(DATES))
    null_part = _numbered(
        "missing_values", f"SELECT *, nulls / n AS share FROM (SELECT * FROM column_counts WHERE n > 0) WHERE nulls / n >= {limit}",
        "[col]", "share", "nulls", "format('Column ''{}'' has {:.2f}% missing values.', col, share * 100)")
    dup_part = _numbered(
        "duplicate_rows", f"SELECT *, hits / n AS share FROM ({duplicate_source()}) WHERE hits > 0 AND (hits / n >= {dup_min} OR hits >= 2)",
        "cols", "share", "hits", "'Detected ' || hits || how")
    out_part = _numbered(
        "numeric_outliers", f"SELECT *, hits / n AS share FROM outlier_counts WHERE n >= 20 AND q1 <> q3 AND hits / n >= {out_min}",
        "[col]", "share", "hits", f"'Column ''' || col || ''' has ' || hits || ' IQR outliers (mult={mult}).'")
    date_part = _numbered(
        "invalid_future_dates", f"SELECT *, hits / n AS share FROM ({dates}) WHERE hits > 0",
        "[col]", "share", "hits", "'Column ''' || col || ''' contains ' || hits || ' values beyond 2050-01-01.'")
    fk_part = _numbered(
        "referential_integrity_break", f"SELECT *, hits / n AS share FROM ({orphan_source()}) WHERE hits > 0",
        "[col]", "share", "hits",
        "'Column ''' || col || ''' has ' || hits || ' values not found in ' || dim_table || '.' || dim_pk || '.'",
        "dim_table", "dim_pk")
    empty_part = """SELECT 'EMPTY_' || upper(tbl) AS issue_id, 'empty_table' AS issue_type, tbl, CAST([] AS VARCHAR[]) AS cols,
        'high' AS severity, 1.0 AS metric, 0 AS evidence_rows, 'Table ''' || tbl || ''' contains zero rows.' AS description,
        '' AS dim_table, '' AS dim_pk FROM (SELECT DISTINCT tbl FROM column_counts WHERE n = 0)"""
    return (f"{VIEWS},\ncolumn_counts AS ({column_counts()}),\noutlier_counts AS ({outlier_source(mult)}),\n"
            f"issues AS ({' UNION ALL '.join([null_part, dup_part, out_part, date_part, fk_part, empty_part])})")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def scored(sensitivity: str = "high") -> str:
    """CTE list ending in ``scored`` (issues with the four factors) and ``ranked``."""
    weights = _values([(t, float(w), config.V1_TYPE_WEIGHTS.get(t, 1.0),
                        sum(config.REPORT_SCORES[r] for r in config.REPORTS_BY_TYPE[t]) / config.REPORT_SCORE_TOTAL)
                       for t, w in config.TYPE_WEIGHTS.items()])
    levels = _values(list(config.SEVERITY_WEIGHTS.items()))
    reports = _values([(t, ", ".join(r)) for t, r in config.REPORTS_BY_TYPE.items()])
    return f"""{issues(sensitivity)},
    sizes AS (SELECT tbl, max(n) AS table_rows FROM column_counts GROUP BY tbl),
    weights(issue_type, base_weight, v1_weight, criticality) AS (VALUES {weights}),
    levels(severity, severity_weight) AS (VALUES {levels}),
    reports(issue_type, reports) AS (VALUES {reports}),
    scored0 AS (SELECT i.*, CAST(base_weight AS DOUBLE) AS base_weight, CAST(severity_weight AS DOUBLE) AS severity_weight,
        CAST(criticality AS DOUBLE) AS criticality, CAST(v1_weight AS DOUBLE) AS v1_weight, reports,
        CASE WHEN evidence_rows = 0 THEN least(metric, 1.0)
             ELSE ln(1 + evidence_rows) / ln(1 + greatest(table_rows, evidence_rows)) END AS density
        FROM issues i JOIN sizes USING (tbl) JOIN weights USING (issue_type) JOIN levels USING (severity) JOIN reports USING (issue_type)),
    scored AS (SELECT *, round(base_weight * severity_weight * density * criticality, 6) AS bis FROM scored0),
    ranked AS (SELECT *, row_number() OVER (ORDER BY bis DESC, tbl, issue_type, issue_id) AS rnk FROM scored WHERE bis >= 0.05)"""


COMMON = """issue_id, issue_type, tbl AS "table", array_to_string(cols, ',') AS columns, severity, metric, evidence_rows"""
