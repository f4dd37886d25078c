"""Queries on injection, evaluation, investigation and repair."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tablewarden.operators import checks, evaluate, inject, investigate, repair
from tablewarden.plans import datasets, oracle_views as o
from tablewarden.operators.snapshot import build_snapshot
from tablewarden.plans.queries_checks import DRIFT_RANKED, scratch
from tablewarden.plans.registry import DIRTY_META, dirty_ranked, query, subset
from tablewarden.plans.triage import evaluate_tables
from tablewarden.runtime import local_frame, union_all
from tablewarden.schemas import EVALUATION, TRUTH
from tablewarden.sources import stores

DAY = "yyyy-MM-dd"


def orders_of(spark, sf):
    return datasets.star(spark, sf)["fact_orders"]


def dirty_orders_of(spark, sf):
    return datasets.dirty(spark, sf)["fact_orders"]


def dated(df):
    return df.withColumn("order_date", F.date_format("order_date", DAY))


_ORDERS = "order_id, customer_id, strftime(order_date, '%Y-%m-%d') AS order_date, total_price, discount_pct, status"
_SIX = "order_id customer_id order_date total_price discount_pct status".split()


# ---- injection -------------------------------------------------------------------------

@query("inject_null", f"{o.VIEWS} SELECT order_id, CASE WHEN NOT ({o.hit('order_id', 11)}) THEN customer_id END AS customer_id FROM fact_orders")
def inject_null(spark, sf):
    return inject.inject_nulls(orders_of(spark, sf), "customer_id", datasets.hit("order_id", 11)).select("order_id", "customer_id")


@query("inject_dup", f"{o.VIEWS} SELECT {_ORDERS}, count(*) AS copies FROM (SELECT * FROM fact_orders UNION ALL SELECT * FROM fact_orders WHERE {o.hit('order_id', 7)}) GROUP BY ALL HAVING count(*) > 1")
def inject_dup(spark, sf):
    df = inject.inject_duplicates(orders_of(spark, sf), datasets.hit("order_id", 7))
    return checks.repeated_groups(dated(df).select(*_SIX), _SIX)


@query("inject_future", f"{o.VIEWS} SELECT order_id, strftime(CASE WHEN {o.hit('order_id', 31)} THEN TIMESTAMP '2099-01-01' ELSE order_date END, '%Y-%m-%d') AS order_date FROM fact_orders")
def inject_future(spark, sf):
    df = inject.inject_future(orders_of(spark, sf), "order_date", datasets.hit("order_id", 31))
    return dated(df).select("order_id", "order_date")


@query("inject_fk", f"{o.VIEWS} SELECT order_id, CASE WHEN {o.hit('order_id', 23)} THEN (SELECT max(customer_id) + 999 FROM fact_orders) ELSE customer_id END AS customer_id FROM fact_orders")
def inject_fk(spark, sf):
    orders = orders_of(spark, sf)
    value = inject.invalid_key(orders, "customer_id")
    return inject.inject_orphans(orders, "customer_id", datasets.hit("order_id", 23), value).select("order_id", "customer_id")


@query("inject_outlier", f"{o.VIEWS} SELECT order_id, CASE WHEN {o.hit('order_id', 42)} THEN total_price * 10 ELSE total_price END AS total_price FROM fact_orders")
def inject_outlier(spark, sf):
    return inject.inject_outliers(orders_of(spark, sf), "total_price", datasets.hit("order_id", 42)).select("order_id", "total_price")


@query("inject_promo", f"{o.VIEWS} SELECT order_id, CASE WHEN {o.hit('order_id', 3)} THEN discount_pct * 3 ELSE discount_pct END AS discount_pct, "
       f"CASE WHEN {o.hit('order_id', 3)} THEN '__PROMO_DRIFT__' ELSE priority END AS promo_code FROM fact_orders")
def inject_promo(spark, sf):
    orders = orders_of(spark, sf).withColumnRenamed("priority", "promo_code")
    hit = datasets.hit("order_id", 3)
    df = inject.inject_promo_drift(inject.inject_promo_drift(orders, "discount_pct", hit), "promo_code", hit)
    return df.select("order_id", "discount_pct", "promo_code")


@query("inject_dim_null", f"{o.VIEWS} SELECT customer_id, CASE WHEN NOT ({o.hit('customer_id', 5, 33)}) THEN customer_name END AS customer_name FROM dim_customers")
def inject_dim_null(spark, sf):
    tables = datasets.star(spark, sf)
    table, column = inject.customer_dimension(tables, DIRTY_META)
    return (inject.inject_nulls(tables[table], column, datasets.hit("customer_id", 5, 33))
            .select("customer_id", "customer_name"))


#: Truth of the dirty views: (id, type, table, columns, severity, rows counted by).
_TRUTH = [
    ("I0001", "missing_key_values", "fact_orders", "customer_id", "high", "fact_orders", o.hit("order_id", 11)),
    ("I0002", "duplicate_transactions", "fact_orders", "", "high", "fact_orders", o.hit("order_id", 7)),
    ("I0003", "invalid_future_dates", "fact_orders", "order_date", "medium", "fact_orders", o.hit("order_id", 31)),
    ("I0004", "referential_integrity_break", "fact_orders", "customer_id", "high", "fact_orders", o.hit("order_id", 23)),
    ("I0005", "numeric_outliers", "fact_orders", "total_price", "high", "fact_orders", o.hit("order_id", 42)),
    ("I0006", "promotion_drift", "fact_orders", "discount_pct", "medium", "fact_orders", o.hit("order_id", 3)),
    ("I0007", "dimension_missing_values", "dim_customers", "customer_name", "medium", "dim_customers", o.hit("customer_id", 5, 33)),
]
_TRUTH_SQL = "truth AS (" + " UNION ALL ".join(
    f"SELECT '{i}' AS issue_id, '{k}' AS issue_type, '{t}' AS tbl, {f"['{c}']" if c else 'CAST([] AS VARCHAR[])'} AS cols, "
    f"'{s}' AS severity, count(*) AS row_count, {n + 1} AS pos FROM {source} WHERE {hit}"
    for n, (i, k, t, c, s, source, hit) in enumerate(_TRUTH)) + ")"


def dirty_truth(spark, sf):
    """Ground truth of the dirty views, with the number of rows each defect hit."""
    tables = datasets.star(spark, sf)
    counted = {r["id"]: r["n"] for r in union_all(
        tables[source].agg(F.count_if(F.expr(hit)).alias("n")).select(F.lit(i).alias("id"), "n")
        for i, *_, source, hit in _TRUTH).collect()}
    rows = [(i, k, t, [c] if c else [], counted[i], s, *inject.TRUTH_NOTES[k][:2], {"column": c})
            for i, k, t, c, s, _, _ in _TRUTH]
    return local_frame(spark, rows, TRUTH)


@query("ground_truth", f"""{o.VIEWS}, {_TRUTH_SQL} SELECT issue_id, issue_type, tbl AS "table", array_to_string(cols, ',') AS columns, row_count, severity FROM truth""")
def ground_truth(spark, sf):
    """Written and read back."""
    path = scratch(spark)
    stores.write_truth(dirty_truth(spark, sf), path)
    return stores.load_truth(spark, path).select(
        "issue_id", "issue_type", "table", F.array_join("columns", ",").alias("columns"), "row_count", "severity")


@query("inject_all", f"""{o.VIEWS}, n AS (SELECT (SELECT count(*) FROM fact_orders) AS n, (SELECT count(*) FROM dim_customers) AS d),
k AS (SELECT greatest(1, CAST(floor(n * 0.02) AS BIGINT)) AS a, greatest(1, CAST(floor((n + greatest(1, floor(n * 0.02))) * 0.02) AS BIGINT)) AS b,
  greatest(1, CAST(floor(d * 0.03) AS BIGINT)) AS c FROM n)
SELECT 'I0001' AS issue_id, 'missing_key_values' AS issue_type, 'order_id' AS columns, a AS row_count, a AS n_found FROM k
UNION ALL SELECT 'I0002', 'duplicate_transactions', '', a, a FROM k
UNION ALL SELECT 'I0003', 'invalid_future_dates', 'order_date', b, b FROM k
UNION ALL SELECT 'I0004', 'referential_integrity_break', 'customer_id', b, b FROM k
UNION ALL SELECT 'I0005', 'numeric_outliers', 'total_price', b, b FROM k
UNION ALL SELECT 'I0006', 'promotion_drift', 'discount_pct', b, b FROM k
UNION ALL SELECT 'I0007', 'dimension_missing_values', 'customer_name', c, c FROM k""")
def inject_all(spark, sf):
    """The seeded injector: exactly 2 % (3 %) of the rows per defect, found again in the result."""
    clean = subset(datasets.star(spark, sf), "fact_orders", "dim_customers")
    source = clean["fact_orders"]
    # prices made recognisable so that the inflated ones can be counted exactly
    clean["fact_orders"] = source.withColumn("total_price", F.lit(1.0)).withColumn("discount_pct", F.lit(1.0))
    meta = {"fact_orders": clean_orders_meta(), "dim_customers": DIRTY_META["dim_customers"]}
    out, truth = inject.inject_issues(clean, meta, keys={"fact_orders": "order_id", "dim_customers": "customer_id"})
    facts, dims = out["fact_orders"], out["dim_customers"]
    before = source.agg(F.count(F.lit(1)).alias("n"), F.max("customer_id").alias("top")).first()
    found = facts.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("order_id").alias("ids"),
        F.count_if(F.col("order_date") > F.lit("2098-01-01").cast("timestamp_ntz")).alias("I0003"),
        F.count_if(F.col("customer_id") > before["top"]).alias("I0004"),
        F.count_if(F.col("total_price") == 10).alias("I0005"), F.count_if(F.col("discount_pct") == 3).alias("I0006"))
    wide = found.select((before["n"] - F.col("ids")).alias("I0001"), (F.col("rows") - before["n"]).alias("I0002"),
                        "I0003", "I0004", "I0005", "I0006")
    unnamed = dims.agg(F.count_if(F.col("customer_name").isNull()).alias("I0007"))
    long = (wide.unpivot([], wide.columns, "issue_id", "n_found")
            .unionByName(unnamed.unpivot([], unnamed.columns, "issue_id", "n_found")))
    return truth.join(long, "issue_id").select(
        "issue_id", "issue_type", F.array_join("columns", ",").alias("columns"), "row_count", "n_found")


def clean_orders_meta():
    """Metadata of clean orders, where the key is unique."""
    return replace(DIRTY_META["fact_orders"], primary_keys=("order_id",))


# ---- evaluation ------------------------------------------------------------------------

_PAIRS_SQL = """equal(pred_type, truth_type) AS (VALUES ('missing_values', 'missing_key_values'), ('missing_values', 'dimension_missing_values'),
  ('duplicate_rows', 'duplicate_transactions'), ('numeric_outliers', 'numeric_outliers'), ('invalid_future_dates', 'invalid_future_dates'),
  ('referential_integrity_break', 'referential_integrity_break'), ('statistical_drift', 'promotion_drift'), ('empty_table', 'empty_table')),
pairs AS (SELECT r.issue_id, r.rnk, t.issue_id AS truth_id, t.pos FROM ranked r JOIN equal e ON e.pred_type = r.issue_type
  JOIN truth t ON t.issue_type = e.truth_type AND t.tbl = r.tbl
  WHERE len(r.cols) = 0 OR len(t.cols) = 0 OR list_has_any(r.cols, t.cols))"""


@query("match_pairs", f"{o.scored()}, {_TRUTH_SQL}, {_PAIRS_SQL} SELECT rnk AS pred_pos, pos AS truth_pos FROM pairs")
def match_pairs(spark, sf):
    predicted = evaluate.positions(dirty_ranked(spark, sf), "high")
    pairs = evaluate.match_pairs(predicted, evaluate.truth_positions(dirty_truth(spark, sf)))
    return pairs.select(F.col("pred_pos").cast("long").alias("pred_pos"), F.col("truth_pos").cast("long").alias("truth_pos"))


# In these views every prediction has at most one candidate and so has every truth: greedy = pairs.
_EVAL_SQL = """m AS (SELECT (SELECT count(*) FROM ranked) AS n_pred, (SELECT count(*) FROM truth) AS n_truth, (SELECT count(*) FROM pairs) AS tp,
  (SELECT count(*) FROM pairs WHERE rnk <= 5) AS hits)
SELECT '{name}' AS strategy, tp AS true_positives, n_pred - tp AS false_positives, n_truth - tp AS false_negatives,
  round(tp / n_pred, 4) AS precision, round(tp / n_truth, 4) AS recall,
  round(2 * (tp / n_pred) * (tp / n_truth) / (tp / n_pred + tp / n_truth), 4) AS f1,
  round(hits / least(5, n_truth), 4) AS top_5_recall, round((n_pred - tp) / n_pred, 4) AS noise_rate,
  round(hits / least(5, n_pred), 4) AS summary_accuracy, n_pred AS predicted_issues, n_truth AS ground_truth_issues FROM m"""


def _metrics(spark, sf, sensitivity: str):
    predicted = evaluate.positions(dirty_ranked(spark, sf, sensitivity), sensitivity)
    return evaluate.evaluation_metrics(predicted, evaluate.truth_positions(dirty_truth(spark, sf)))


@query("eval_metrics", f"{o.scored()}, {_TRUTH_SQL}, {_PAIRS_SQL}, {_EVAL_SQL.format(name='high')}")
def eval_metrics(spark, sf):
    return _metrics(spark, sf, "high")


@query("eval_metrics_normal", f"{o.scored('normal')}, {_TRUTH_SQL}, {_PAIRS_SQL}, {_EVAL_SQL.format(name='normal')}")
def eval_metrics_normal(spark, sf):
    return _metrics(spark, sf, "normal")


@query("strategy_pivot", f"""{o.scored()}, {_TRUTH_SQL}, {_PAIRS_SQL}, e AS (WITH {_EVAL_SQL.format(name='high')}),
long AS (UNPIVOT e ON precision, recall, f1, top_5_recall, noise_rate, summary_accuracy INTO NAME metric VALUE v)
SELECT metric, format('{{:.4f}}', v) AS high, 'n/a' AS other FROM long""")
def strategy_pivot(spark, sf):
    return evaluate.strategy_pivot(_metrics(spark, sf, "high"), ["high", "other"])


@query("eval_store", f"{o.scored()}, {_TRUTH_SQL}, {_PAIRS_SQL}, {_EVAL_SQL.format(name='high')}")
def eval_store(spark, sf):
    path = scratch(spark)
    stores.write_evaluation(_metrics(spark, sf, "high"), path)
    return stores.load_evaluation(spark, path).select(*[c for c in EVALUATION.names if c not in ("wall_seconds", "error")])


_STRATEGY_SQL = """{name}_pairs AS (SELECT r.rnk FROM {ranked} r JOIN equal e ON e.pred_type = r.issue_type JOIN truth t ON t.issue_type = e.truth_type AND t.tbl = r.tbl
  WHERE len(r.cols) = 0 OR len(t.cols) = 0 OR list_has_any(r.cols, t.cols)),
{name} AS (SELECT '{strategy}' AS strategy, (SELECT count(*) FROM {ranked}) AS n_pred, (SELECT count(*) FROM truth) AS n_truth,
  (SELECT count(*) FROM {name}_pairs) AS tp, (SELECT count(*) FROM {name}_pairs WHERE rnk <= 5) AS hits)"""


@query("eval_strategies", f"""{o.scored('normal')}, {DRIFT_RANKED}, {_TRUTH_SQL}, {_PAIRS_SQL},
{_STRATEGY_SQL.format(name='a', ranked='ranked', strategy='A_baseline')}, {_STRATEGY_SQL.format(name='b', ranked='ranked', strategy='B_supervisor')},
{_STRATEGY_SQL.format(name='c', ranked='all_ranked', strategy='C_full')},
m AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT strategy, tp AS true_positives, n_pred - tp AS false_positives, n_truth - tp AS false_negatives, round(tp / n_pred, 4) AS precision,
  round(tp / n_truth, 4) AS recall, round(2 * (tp / n_pred) * (tp / n_truth) / (tp / n_pred + tp / n_truth), 4) AS f1,
  round(hits / least(5, n_truth), 4) AS top_5_recall, round((n_pred - tp) / n_pred, 4) AS noise_rate, round(hits / least(5, n_pred), 4) AS summary_accuracy,
  n_pred AS predicted_issues, n_truth AS ground_truth_issues FROM m""")
def eval_strategies(spark, sf):
    """Checks alone, with re-count, and with drift, scored on the dirty views at normal sensitivity."""
    clean = datasets.star(spark, sf)
    snapshot = build_snapshot(subset(clean, "fact_orders", "fact_lineitems", "fact_events"))
    scored = evaluate_tables(datasets.dirty(spark, sf), dirty_truth(spark, sf), snapshot, "normal", DIRTY_META)
    return scored.select(*[c for c in EVALUATION.names if c not in ("wall_seconds", "error")])


# ---- investigation ---------------------------------------------------------------------

@query("orphan_top20", f"""{o.VIEWS} SELECT customer_id AS invalid_fk_value, count(*) AS affected_rows FROM d_fact_orders f
WHERE customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_dim_customers c WHERE c.customer_id = f.customer_id)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def orphan_top20(spark, sf):
    t = datasets.dirty(spark, sf)
    return investigate.orphan_values(t["fact_orders"], "customer_id", t["dim_customers"], "customer_id")


@query("orphan_rows", f"""{o.VIEWS} SELECT {_ORDERS} FROM d_fact_orders f
WHERE customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_dim_customers c WHERE c.customer_id = f.customer_id)""")
def orphan_rows(spark, sf):
    t = datasets.dirty(spark, sf)
    return dated(investigate.orphan_rows(t["fact_orders"], "customer_id", t["dim_customers"], "customer_id")).select(*_SIX)


@query("orphan_rows_shuffled", f"""{o.VIEWS} SELECT {_ORDERS} FROM d_fact_orders f
WHERE customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_dim_customers c WHERE c.customer_id = f.customer_id)""")
def orphan_rows_shuffled(spark, sf):
    """The way many unknown keys go: frequent keys are looked up where their rows lie, the others are shuffled."""
    t = datasets.dirty(spark, sf)
    rows = investigate.orphan_rows(t["fact_orders"], "customer_id", t["dim_customers"], "customer_id", broadcast_rows=0, hot_rows=12)
    return dated(rows).select(*_SIX)


@query("dup_rate", f"""{o.VIEWS}, d AS (SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d_fact_orders)) AS duplicate_rows FROM d_fact_orders)
SELECT *, round(100.0 * duplicate_rows / total_rows, 2) AS dup_pct FROM d""")
def dup_rate(spark, sf):
    return investigate.duplication_rate(dirty_orders_of(spark, sf))


@query("dup_groups", f"""{o.VIEWS} SELECT order_id, customer_id, total_price, status, occurrences FROM (
SELECT *, count(*) OVER (PARTITION BY order_id, customer_id, order_date, total_price, discount_pct, status, priority) AS occurrences FROM d_fact_orders)
WHERE occurrences > 1 ORDER BY occurrences DESC, order_id LIMIT 20""")
def dup_groups(spark, sf):
    return (investigate.duplicate_rows(dirty_orders_of(spark, sf))
            .select("order_id", "customer_id", "total_price", "status", "occurrences"))


@query("outlier_bounds", f"""{o.VIEWS} SELECT round(quantile_cont(total_price, 0.25), 6) AS q1, round(quantile_cont(total_price, 0.75), 6) AS q3,
round(quantile_cont(total_price, 0.75) - quantile_cont(total_price, 0.25), 6) AS iqr, min(total_price) AS min_val, max(total_price) AS max_val,
round(avg(total_price), 4) AS mean_val FROM d_fact_orders""")
def outlier_bounds(spark, sf):
    b = investigate.outlier_bounds(dirty_orders_of(spark, sf), "total_price")
    return b.select(F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), F.round("iqr", 6).alias("iqr"),
                    "min_val", "max_val", F.round("mean_val", 4).alias("mean_val"))


_FENCE = "fence AS (SELECT quantile_cont(total_price, 0.25) AS q1, quantile_cont(total_price, 0.75) AS q3 FROM d_fact_orders), " \
         "b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM fence)"


@query("outlier_extremes", f"{o.VIEWS}, {_FENCE} SELECT total_price FROM d_fact_orders, b WHERE total_price < lo OR total_price > hi ORDER BY 1 LIMIT 20")
def outlier_extremes(spark, sf):
    return investigate.extreme_values(dirty_orders_of(spark, sf), "total_price")


@query("null_rate", f"""{o.VIEWS} SELECT count(*) AS total_rows, count(*) - count(customer_id) AS null_count,
round(100.0 * (count(*) - count(customer_id)) / count(*), 2) AS null_pct FROM d_fact_orders""")
def null_rate(spark, sf):
    return investigate.null_rate(dirty_orders_of(spark, sf), "customer_id")


@query("future_freq", f"{o.VIEWS} SELECT strftime(order_date, '%Y-%m-%d') AS order_date, count(*) AS row_count FROM d_fact_orders WHERE order_date > TIMESTAMP '2050-01-01' GROUP BY 1")
def future_freq(spark, sf):
    return dated(investigate.future_values(dirty_orders_of(spark, sf), "order_date"))


@query("dist_stats", f"""{o.VIEWS} SELECT count(*) AS row_count, round(min(total_price), 4) AS min_val, round(max(total_price), 4) AS max_val,
round(avg(total_price), 4) AS mean_val, round(stddev_samp(total_price), 4) AS std_val, round(median(total_price), 4) AS median_val FROM d_fact_orders""")
def dist_stats(spark, sf):
    return investigate.distribution(dirty_orders_of(spark, sf), "total_price")


@query("recent_rows", f"{o.VIEWS} SELECT order_id, customer_id, total_price FROM fact_orders ORDER BY order_id DESC LIMIT 20")
def recent_rows(spark, sf):
    return investigate.recent_rows(orders_of(spark, sf), "order_id").select("order_id", "customer_id", "total_price")


@query("row_counts", f"{o.VIEWS} SELECT 'fact_returns' AS \"table\", count(*) AS row_count FROM d_fact_returns UNION ALL SELECT 'fact_orders', count(*) FROM d_fact_orders")
def row_counts(spark, sf):
    t = datasets.dirty(spark, sf)
    return union_all(investigate.row_count(t[n]).select(F.lit(n).alias("table"), "row_count") for n in ("fact_returns", "fact_orders"))


@query("sigma_rows", f"""{o.VIEWS}, s AS (SELECT avg(total_price) AS m, stddev_pop(total_price) AS s FROM d_fact_orders)
SELECT order_id, total_price FROM d_fact_orders, s WHERE total_price < m - 3 * s OR total_price > m + 3 * s""")
def sigma_rows(spark, sf):
    return investigate.sigma_rows(dirty_orders_of(spark, sf), "total_price").select("order_id", "total_price")


@query("drift_stats", f"""{o.VIEWS} SELECT round(avg(total_price), 4) AS current_avg, round(stddev_pop(total_price), 4) AS current_std,
min(total_price) AS current_min, max(total_price) AS current_max FROM d_fact_orders""")
def drift_stats(spark, sf):
    d = investigate.drift_stats(dirty_orders_of(spark, sf), "total_price")
    return d.select(F.round("current_avg", 4).alias("current_avg"), F.round("current_std", 4).alias("current_std"), "current_min", "current_max")


@query("sample_rows")
def sample_rows(spark, sf):
    return investigate.sample_rows(dated(dirty_orders_of(spark, sf)))


@query("sample_rows_inside", "SELECT least(count(*), 20) AS n_rows, least(count(*), 20) AS n_inside FROM orders")
def sample_rows_inside(spark, sf):
    """The sampled rows are rows of the table, and as many as asked for."""
    orders = datasets.read(spark, sf, "orders")
    some = local_frame(spark, investigate.sample_rows(orders.select("o_orderkey", "o_custkey")).collect(), "o_orderkey long, o_custkey long")
    inside = orders.join(F.broadcast(some), ["o_orderkey", "o_custkey"], "left_semi").agg(F.count(F.lit(1)).alias("n_inside"))
    return some.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(inside)          # one row each


# ---- repair ----------------------------------------------------------------------------

_ORPHAN = "customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_dim_customers c WHERE c.customer_id = f.customer_id)"


def _with_dim(spark, sf):
    t = datasets.dirty(spark, sf)
    return t["fact_orders"], "customer_id", t["dim_customers"], "customer_id"


@query("fix_drop_orphans", f"{o.VIEWS} SELECT {_ORDERS} FROM d_fact_orders f WHERE NOT ({_ORPHAN})")
def fix_drop_orphans(spark, sf):
    return dated(repair.drop_orphans(*_with_dim(spark, sf))).select(*_SIX)


@query("fix_placeholder_dim", f"""{o.VIEWS} SELECT customer_id, customer_name, balance, segment FROM d_dim_customers
UNION ALL SELECT DISTINCT customer_id, NULL, NULL, NULL FROM d_fact_orders f WHERE {_ORPHAN}""")
def fix_placeholder_dim(spark, sf):
    return repair.add_placeholder_dimension(*_with_dim(spark, sf))


_NULL_FK_SQL = f"{o.VIEWS} SELECT order_id, CASE WHEN NOT ({_ORPHAN}) THEN customer_id END AS customer_id, total_price, status FROM d_fact_orders f"


@query("fix_null_fk", _NULL_FK_SQL)
def fix_null_fk(spark, sf):
    return repair.null_orphans(*_with_dim(spark, sf)).select("order_id", "customer_id", "total_price", "status")


@query("fix_null_fk_shuffled", _NULL_FK_SQL)
def fix_null_fk_shuffled(spark, sf):
    """The way many orphan keys go: only those of few rows are shuffled."""
    return repair.null_orphans(*_with_dim(spark, sf), broadcast_rows=0, hot_rows=12).select("order_id", "customer_id", "total_price", "status")


@query("fix_dedupe_nested", """SELECT DISTINCT user_id, event_type, CAST(value AS VARCHAR) AS value FROM events""")
def fix_dedupe_nested(spark, sf):
    """Events as maps: only rows whose maps are equal are copies."""
    events = datasets.read(spark, sf, "events").select("user_id", "event_type", F.col("value").cast("string").alias("value"))
    nested = events.select(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), "event_type", F.lit("value"), "value").alias("what"))
    return repair.dedupe_rows(nested).select(F.col("what")["user"].cast("long").alias("user_id"), F.col("what")["type"].alias("event_type"),
                                             F.col("what")["value"].alias("value"))


@query("fix_dedupe", f"{o.VIEWS} SELECT DISTINCT {_ORDERS}, priority FROM d_fact_orders")
def fix_dedupe(spark, sf):
    return dated(repair.dedupe_rows(dirty_orders_of(spark, sf))).select(*_SIX, "priority")


@query("fix_dedupe_key", """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_partkey, l_suppkey FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def fix_dedupe_key(spark, sf):
    lines = datasets.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return (repair.dedupe_on_key(lines, ["l_orderkey", "l_linenumber"], "l_shipdate")
            .withColumn("l_shipdate", F.date_format("l_shipdate", DAY)))


@query("fix_winsorise", f"{o.VIEWS}, {_FENCE} SELECT order_id, round(least(greatest(total_price, lo), hi), 6) AS total_price FROM d_fact_orders, b")
def fix_winsorise(spark, sf):
    return repair.winsorise(dirty_orders_of(spark, sf), "total_price").select("order_id", F.round("total_price", 6).alias("total_price"))


@query("fix_drop_outliers", f"{o.VIEWS}, {_FENCE} SELECT order_id, total_price FROM d_fact_orders, b WHERE NOT (total_price < lo OR total_price > hi)")
def fix_drop_outliers(spark, sf):
    return repair.drop_outliers(dirty_orders_of(spark, sf), "total_price").select("order_id", "total_price")


_PRICED = "CASE WHEN customer_id IS NOT NULL THEN total_price END"


def priced(spark, sf):
    """Orders whose price is also missing where the customer is."""
    return dirty_orders_of(spark, sf).withColumn("total_price", F.when(F.col("customer_id").isNotNull(), F.col("total_price")))


@query("fix_keep_inside", f"""{o.VIEWS}, p AS (SELECT order_id, {_PRICED} AS x FROM d_fact_orders),
f AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM p)
SELECT order_id, x AS total_price FROM p, f WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def fix_keep_inside(spark, sf):
    return repair.keep_inside(priced(spark, sf), "total_price").select("order_id", "total_price")


@query("fix_mean_fill", f"{o.VIEWS}, p AS (SELECT order_id, {_PRICED} AS x FROM d_fact_orders) SELECT order_id, round(coalesce(x, (SELECT avg(x) FROM p)), 4) AS total_price FROM p")
def fix_mean_fill(spark, sf):
    return repair.fill_mean(priced(spark, sf), "total_price").select("order_id", F.round("total_price", 4).alias("total_price"))


@query("fix_sentinel_fill", f"{o.VIEWS} SELECT customer_id, coalesce(customer_name, 'UNKNOWN') AS customer_name FROM d_dim_customers")
def fix_sentinel_fill(spark, sf):
    return repair.fill_sentinel(datasets.dirty(spark, sf)["dim_customers"], "customer_name").select("customer_id", "customer_name")


@query("fix_dropna", f"{o.VIEWS} SELECT order_id, customer_id FROM d_fact_orders WHERE customer_id IS NOT NULL")
def fix_dropna(spark, sf):
    return repair.drop_missing(dirty_orders_of(spark, sf), "customer_id").select("order_id", "customer_id")


@query("fix_null_flag", f"{o.VIEWS} SELECT order_id, customer_id, customer_id IS NULL AS customer_id_is_null FROM d_fact_orders")
def fix_null_flag(spark, sf):
    return repair.flag_missing(dirty_orders_of(spark, sf), "customer_id").select("order_id", "customer_id", "customer_id_is_null")


_FUTURE = "order_date > TIMESTAMP '2050-01-01'"


@query("fix_future_null", f"{o.VIEWS} SELECT order_id, strftime(CASE WHEN NOT ({_FUTURE}) THEN order_date END, '%Y-%m-%d') AS order_date FROM d_fact_orders")
def fix_future_null(spark, sf):
    return dated(repair.null_future(dirty_orders_of(spark, sf), "order_date")).select("order_id", "order_date")


@query("fix_future_9999", f"{o.VIEWS} SELECT order_id, CASE WHEN {_FUTURE} THEN '9999-12-31' ELSE strftime(order_date, '%Y-%m-%d') END AS order_date FROM d_fact_orders")
def fix_future_9999(spark, sf):
    return dated(repair.open_end_future(dirty_orders_of(spark, sf), "order_date")).select("order_id", "order_date")


@query("fix_future_drop", f"{o.VIEWS} SELECT order_id, strftime(order_date, '%Y-%m-%d') AS order_date FROM d_fact_orders WHERE NOT ({_FUTURE})")
def fix_future_drop(spark, sf):
    return dated(repair.drop_future(dirty_orders_of(spark, sf), "order_date")).select("order_id", "order_date")


@query("require_rows", f"{o.VIEWS} SELECT 'fact_orders' AS \"table\", count(*) AS n_rows, false AS failed FROM d_fact_orders UNION ALL SELECT 'fact_returns', count(*), count(*) = 0 FROM d_fact_returns")
def require_rows(spark, sf):
    out = []
    for name, df in subset(datasets.dirty(spark, sf), "fact_orders", "fact_returns").items():
        try:
            repair.require_rows(df, name)
            failed = False
        except ValueError:
            failed = True
        out.append(investigate.row_count(df).select(F.lit(name).alias("table"), F.col("row_count").alias("n_rows"), F.lit(failed).alias("failed")))
    return union_all(out)
