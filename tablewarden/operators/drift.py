"""Distribution drift of fact measures: PSI and two-sample Kolmogorov-Smirnov.

A reference is a short list of weighted points per column (rebuilt from a snapshot) or a whole
baseline column.  Against points, one scan of the current table counts the values below and up
to every point; that settles both tests exactly, because the largest gap between a step
function and another distribution lies at a step or just before it.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden import config
from tablewarden.functions.quantiles import as_double, exact_quantiles, rank_counts
from tablewarden.functions.scoring import direction, kolmogorov_p, ks_severity, psi_severity, severity_rank
from tablewarden.operators.checks import Meta, no_issues
from tablewarden.operators.profile import Tables, profile_tables
from tablewarden.runtime import is_numeric, local_frame, settled, side_by_side, union_all
from tablewarden.schemas import ISSUE
from tablewarden.sources.stores import load_snapshot

POINTS = "table string, column string, value double, weight long"
STATS = ("table string, table_pos int, column string, col_pos int, n_ref long, n_cur long, "
         "ref_mean double, cur_mean double, psi double, ks_d double")
#: Values per range bucket in the full two-sample test.
VALUES_PER_BUCKET = 2_000_000
log = logging.getLogger(__name__)


# --------------------------------------------------------------------------------------
# Reference points from a snapshot
# --------------------------------------------------------------------------------------

def _interpolated(t: Column, probs: Column, values: Column, knots: int) -> Column:
    j = F.least(F.size(F.filter(probs, lambda p: p <= t)), F.lit(knots - 1)) - 1
    x0, x1 = F.get(probs, j), F.get(probs, j + 1)
    y0, y1 = F.get(values, j), F.get(values, j + 1)
    return (y1 - y0) / (x1 - x0) * (t - x0) + y0


def cdf_points(snapshot: DataFrame, n: int = config.REFERENCE_POINTS) -> DataFrame:
    """n evenly spaced quantiles, linear between min, the stored quantiles and max."""
    probs = F.concat(F.array(F.lit(0.0)), F.col("q_probs"), F.array(F.lit(1.0)))
    values = F.concat(F.array(F.coalesce("min", F.get("q_values", F.lit(0)))), F.col("q_values"),
                      F.array(F.coalesce("max", F.element_at("q_values", -1))))
    knots = len(config.SNAPSHOT_PROBS) + 2
    step = 1.0 / (n - 1)
    return (snapshot.where("q_values IS NOT NULL")
            .select("table", "column", probs.alias("_p"), values.alias("_v"),
                    F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
            .withColumn("t", F.when(F.col("i") == n - 1, 1.0).otherwise(F.col("i") * step))
            .select("table", "column",
                    _interpolated(F.col("t"), F.col("_p"), F.col("_v"), knots).alias("value"),
                    F.lit(1).cast("long").alias("weight")))


def histogram_points(snapshot: DataFrame) -> DataFrame:
    """For snapshots without quantiles: bin midpoints, weighted by their scaled count."""
    total = F.aggregate("hist_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    scale = F.greatest(F.lit(1), F.floor(F.try_divide(F.lit(1000), total)))
    return (snapshot.where("q_values IS NULL AND hist_counts IS NOT NULL AND size(hist_edges) >= 2")
            .select("table", "column", "hist_edges", F.coalesce(scale, F.lit(1)).alias("scale"),
                    F.posexplode("hist_counts").alias("i", "n"))
            .select("table", "column",
                    ((F.get("hist_edges", F.col("i")) + F.get("hist_edges", F.col("i") + 1)) / 2).alias("value"),
                    (F.col("n") * F.col("scale")).cast("long").alias("weight"))
            .where("weight > 0"))


def reference_points(snapshot: DataFrame) -> DataFrame:
    return cdf_points(snapshot).unionByName(histogram_points(snapshot))


def _weighted_quantile(values: np.ndarray, upto: np.ndarray, p: float) -> float:
    """Linear quantile of the points repeated by weight, without repeating them."""
    position = (int(upto[-1]) - 1) * p
    low = math.floor(position)
    high = min(low + 1, int(upto[-1]) - 1)
    a, b = (values[np.searchsorted(upto, k, side="right")] for k in (low, high))
    return float(a + (b - a) * (position - low))


def psi_breaks(values: np.ndarray, weights: np.ndarray, bins: int = config.PSI_BINS) -> list[float]:
    upto = np.cumsum(weights)
    return sorted({_weighted_quantile(values, upto, p) for p in np.linspace(0, 1, bins + 1)})


# --------------------------------------------------------------------------------------
# The two statistics over counted bins and points
# --------------------------------------------------------------------------------------

def psi_from_bins(bins: DataFrame, *keys: str) -> DataFrame:
    """PSI over rows ``(keys, n_ref, n_cur)``; empty shares become 1e-4, result floored at 0."""
    total = lambda c: F.greatest(F.sum(c).over(Window.partitionBy(*keys)), F.lit(1))
    share = lambda c: F.when(F.col(c) == 0, config.PSI_EMPTY_SHARE).otherwise(F.col(c) / total(c))
    shares = bins.withColumn("r", share("n_ref")).withColumn("c", share("n_cur"))
    return shares.groupBy(*keys).agg(
        F.greatest(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))), F.lit(0.0)).alias("psi"))


def ks_from_points(points: DataFrame, *keys: str) -> DataFrame:
    """Largest gap over rows ``(keys, ref_lt, ref_le, cur_lt, cur_le, n_ref, n_cur)``."""
    gap = lambda side: F.abs(F.col(f"ref_{side}") / F.col("n_ref") - F.col(f"cur_{side}") / F.col("n_cur"))
    return points.groupBy(*keys).agg(F.max(F.greatest(gap("lt"), gap("le"))).alias("ks_d"))


def drift_columns(tables: Tables, profile: DataFrame, meta: Meta) -> list[dict]:
    """Fact measures with enough values to compare, with their profile."""
    stats = {(r["table"], r["column"]): r for r in profile.collect()}
    out = []
    for pos, (t, df) in enumerate(tables.items()):
        if t in meta and not meta[t].is_fact:
            continue
        for i, c in enumerate(df.columns):
            if (t in meta and c not in meta[t].numeric_cols) or not is_numeric(df, c):
                continue
            s = stats[t, c]
            n = s["n_rows"] - s["n_null"]
            if n >= config.MIN_ROWS_FOR_STATS:
                out.append({"table": t, "table_pos": pos, "column": c, "col_pos": i,
                            "n_cur": n, "cur_mean": s["mean"]})
    return out


def snapshot_drift(tables: Tables, profile: DataFrame, meta: Meta, snapshot: DataFrame) -> DataFrame:
    """PSI and KS of every fact measure against a snapshot: one scan per fact."""
    spark = profile.sparkSession
    reference: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
    collected: dict[tuple[str, str], list[tuple[float, int]]] = {}
    for r in reference_points(snapshot).collect():          # at most 1000 points per column
        collected.setdefault((r["table"], r["column"]), []).append((r["value"], r["weight"]))
    for key, pairs in collected.items():
        pairs.sort()
        reference[key] = (np.array([v for v, _ in pairs]), np.array([w for _, w in pairs]))
    compared = [c for c in drift_columns(tables, profile, meta)
                if (c["table"], c["column"]) in reference
                and reference[c["table"], c["column"]][1].sum() >= config.MIN_REFERENCE_POINTS]
    breaks_of = {(c["table"], c["column"]): psi_breaks(*reference[c["table"], c["column"]]) for c in compared}
    scanned = list(dict.fromkeys(c["table"] for c in compared))
    ranks_of = dict(zip(scanned, side_by_side(lambda t: rank_counts(tables[t], {
        c: [*reference[t, c][0].tolist(), *breaks] for (own, c), breaks in breaks_of.items() if own == t}), scanned)))
    bins, points, heads = [], [], []
    for t, ranks in ranks_of.items():
        for c in (c for c in compared if c["table"] == t):
            name, (values, weights) = c["column"], reference[t, c["column"]]
            total, at = int(weights.sum()), ranks[c["column"]]
            heads.append((t, c["table_pos"], name, c["col_pos"], total, c["n_cur"],
                          float((values * weights).sum() / total), c["cur_mean"]))
            upto = np.concatenate([[0], np.cumsum(weights)])
            below = lambda x, side: int(upto[np.searchsorted(values, x, side=side)])
            for v in np.unique(values).tolist():
                points.append((t, name, below(v, "left"), below(v, "right"), *at[v], total, c["n_cur"]))
            edges = breaks_of[t, name]
            for j in range(len(edges) - 1):
                last = j == len(edges) - 2
                low, high = edges[j], edges[j + 1]
                bins.append((t, name,
                             below(high, "right" if last else "left") - below(low, "left"),
                             at[high][1 if last else 0] - at[low][0]))
    keys = ("table", "column")
    head = local_frame(spark, heads, "table string, table_pos int, column string, col_pos int, "
                                     "n_ref long, n_cur long, ref_mean double, cur_mean double")
    psi = psi_from_bins(local_frame(spark, bins, "table string, column string, n_ref long, n_cur long"), *keys)
    ks = ks_from_points(local_frame(spark, points, "table string, column string, ref_lt long, ref_le long, "
                                                   "cur_lt long, cur_le long, n_ref long, n_cur long"), *keys)
    return (head.join(psi, list(keys), "left").join(ks, list(keys), "left")
            .withColumn("psi", F.coalesce("psi", F.lit(0.0)))
            .select("table", "table_pos", "column", "col_pos", "n_ref", "n_cur",
                    "ref_mean", "cur_mean", "psi", "ks_d"))


# --------------------------------------------------------------------------------------
# Whole baseline tables
# --------------------------------------------------------------------------------------

def value_counts(df: DataFrame, columns: list[str], held: int = 500_000) -> DataFrame:
    """Rows ``(column, value, n)``; a task counts equal values before they leave it, ``held`` values of a column at a time."""
    def fold(batches):
        waiting = [[np.zeros(0), np.zeros(0, np.int64)] for _ in columns]

        def flush(i):
            values, n = waiting[i]
            waiting[i] = [np.zeros(0), np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array([columns[i]] * len(values), pa.string()), pa.array(values), pa.array(n)],
                                              names=["column", "value", "n"])

        for batch in batches:
            for i in range(len(columns)):
                values = batch.column(i).to_numpy(zero_copy_only=False)
                values, n = np.unique(values[~np.isnan(values)] + 0.0, return_counts=True)        # no sign on a zero
                both, place = np.unique(np.concatenate([waiting[i][0], values]), return_inverse=True)
                waiting[i] = [both, np.bincount(place, np.concatenate([waiting[i][1], n]), len(both)).astype(np.int64)]
                if len(both) > held:
                    yield flush(i)
        for i in range(len(columns)):
            yield flush(i)

    return df.select(*[as_double(df, c).alias(c) for c in columns]).mapInArrow(fold, "column string, value double, n long")


def ranged_counts(reference: DataFrame, current: DataFrame, columns: list[str], ranges: int) -> DataFrame:
    """Rows ``(column, value, r, c, part)``: both samples' counts of each value, sorted by range over ``ranges`` partitions.

    Spark draws the ranges from both samples, so a column that has moved is split as well.  Counts are added up where the ranges
    lie, without another shuffle, and written, so that every later step sees the same parts.
    """
    zero = F.lit(0).cast("long")
    both = (value_counts(reference, columns).select("column", "value", F.col("n").alias("r"), zero.alias("c"))
            .unionByName(value_counts(current, columns).select("column", "value", zero.alias("r"), F.col("n").alias("c"))))
    dealt = both.repartitionByRange(ranges, "column", "value")
    added = dealt.groupBy("column", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    return settled(added.withColumn("part", F.spark_partition_id()))


def two_sample_ks(reference: DataFrame, current: DataFrame, columns: list[str], n_rows: int,
                  per_bucket: int | None = None) -> DataFrame:
    """Exact KS distance of whole columns: rows ``(column, n_ref, n_cur, ks_d)``.

    Equal values collapse to counts first, and these are sorted by range.  Running sums are local to a part and start from the
    part's offset, one row each, so no window spans a whole column and the plan holds no values.  ``n_rows`` are the rows
    of both.
    """
    ranges = max(1, math.ceil(n_rows * len(columns) / (per_bucket or VALUES_PER_BUCKET)))
    counted = ranged_counts(reference, current, columns, ranges)
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column")
    offsets = counted.groupBy("column", "part").agg(F.sum("r").alias("pr"), F.sum("c").alias("pc")).select(
        "column", "part", F.coalesce(F.sum("pr").over(before), F.lit(0)).alias("r0"),
        F.coalesce(F.sum("pc").over(before), F.lit(0)).alias("c0"),
        F.sum("pr").over(whole).alias("n_ref"), F.sum("pc").over(whole).alias("n_cur"))
    running = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    gaps = (counted.withColumn("ru", F.sum("r").over(running)).withColumn("cu", F.sum("c").over(running))
            .join(offsets, ["column", "part"])
            .withColumn("gap", F.abs((F.col("r0") + F.col("ru")) / F.col("n_ref")
                                     - (F.col("c0") + F.col("cu")) / F.col("n_cur"))))
    return gaps.groupBy("column").agg(F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"),
                                      F.max("gap").alias("ks_d"))


def baseline_drift(tables: Tables, profile: DataFrame, meta: Meta, baseline: Tables,
                   per_bucket: int | None = None) -> DataFrame:
    """PSI and KS of every fact measure against whole baseline tables."""
    spark = profile.sparkSession
    shared = {t: df for t, df in baseline.items() if t in tables}
    if not shared:
        return local_frame(spark, [], STATS)
    base_stats = {(r["table"], r["column"]): r for r in profile_tables(shared).collect()}
    parts = []
    for t, ref in shared.items():
        mine = [c for c in drift_columns(tables, profile, meta)
                if c["table"] == t and c["column"] in ref.columns and is_numeric(ref, c["column"])]
        counts = {c["column"]: base_stats[t, c["column"]]["n_rows"] - base_stats[t, c["column"]]["n_null"]
                  for c in mine}
        mine = [c for c in mine if counts[c["column"]] >= config.MIN_REFERENCE_POINTS]
        if not mine:
            continue
        names = [c["column"] for c in mine]
        deciles = [float(p) for p in np.linspace(0, 1, config.PSI_BINS + 1)]
        bounds = {c: (base_stats[t, c]["min"], base_stats[t, c]["max"]) for c in names}
        cuts = {c: sorted(set(q.values())) for c, q in
                exact_quantiles(ref, {c: deciles for c in names}, counts, bounds).items()}
        ref_at, cur_at = rank_counts(ref, cuts), rank_counts(tables[t], cuts)
        bins = []
        for c in names:
            for j in range(len(cuts[c]) - 1):
                low, high, top = cuts[c][j], cuts[c][j + 1], int(j == len(cuts[c]) - 2)
                bins.append((c, ref_at[c][high][top] - ref_at[c][low][0], cur_at[c][high][top] - cur_at[c][low][0]))
        psi = psi_from_bins(local_frame(spark, bins, "column string, n_ref long, n_cur long"), "column")
        ks = two_sample_ks(ref, tables[t], names, max(counts[c["column"]] + c["n_cur"] for c in mine), per_bucket)
        head = local_frame(spark, [(t, c["table_pos"], c["column"], c["col_pos"],
                                    base_stats[t, c["column"]]["mean"], c["cur_mean"]) for c in mine],
                           "table string, table_pos int, column string, col_pos int, ref_mean double, cur_mean double")
        parts.append(head.join(psi, "column", "left").join(ks, "column", "left")
                     .withColumn("psi", F.coalesce("psi", F.lit(0.0)))
                     .select("table", "table_pos", "column", "col_pos", "n_ref", "n_cur",
                             "ref_mean", "cur_mean", "psi", "ks_d"))
    return union_all(parts) if parts else local_frame(spark, [], STATS)


# --------------------------------------------------------------------------------------
# Issues
# --------------------------------------------------------------------------------------

def drift_tests(stats: DataFrame) -> DataFrame:
    """One row per column and test, with severity, metric and text."""
    shift = direction(F.col("ref_mean"), F.col("cur_mean"))
    p = kolmogorov_p(F.col("ks_d"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double"))
    with_p = stats.withColumn("p_value", p).withColumn("shift", shift)
    keys = ["table", "table_pos", "column", "col_pos"]
    psi = with_p.select(
        *keys, F.lit("psi").alias("test"), psi_severity(F.col("psi")).alias("severity"),
        F.round(F.least(F.col("psi") / config.PSI_RED, F.lit(1.0)), 4).alias("metric"),
        F.format_string(f"PSI=%.4f on %s.%s: %s distribution shift (%s). Thresholds: "
                        f"medium≥{config.PSI_AMBER}, high≥{config.PSI_RED}.",
                        F.col("psi"), F.col("table"), F.col("column"), psi_severity(F.col("psi")),
                        F.col("shift")).alias("description"))
    ks = with_p.where("ks_d IS NOT NULL").select(
        *keys, F.lit("ks").alias("test"), ks_severity(F.col("p_value")).alias("severity"),
        F.round("ks_d", 4).alias("metric"),
        F.format_string("KS D=%.4f, p=%.4f on %s.%s: statistically significant distribution change "
                        f"(α={config.KS_ALPHA}).", F.col("ks_d"), F.col("p_value"), F.col("table"),
                        F.col("column")).alias("description"))
    return psi.unionByName(ks)


def drift_issues(stats: DataFrame) -> DataFrame:
    """Per column the more severe test (PSI on a tie); stable columns give nothing."""
    best = Window.partitionBy("table", "column").orderBy(
        F.desc(severity_rank(F.col("severity"))), F.desc("test"))
    found = (drift_tests(stats).where("severity <> 'low'")
             .withColumn("place", F.row_number().over(best)).where("place = 1"))
    return found.select(
        F.concat(F.lit(config.ID_PREFIX["statistical_drift"]),
                 F.lpad(F.row_number().over(Window.orderBy("table_pos", "col_pos")).cast("string"), 4, "0")).alias("issue_id"),
        F.lit("statistical_drift").alias("issue_type"), "table", F.array("column").alias("columns"),
        "severity", "metric", F.lit(0).cast("long").alias("evidence_rows"), "description",
        F.lit("").alias("dim_table"), F.lit("").alias("dim_pk"))


def detect_drift(tables: Tables, meta: Meta, profile: DataFrame | None = None,
                 snapshot: DataFrame | None = None, baseline: Tables | None = None,
                 snapshot_path: str | None = None, tag: str = "baseline") -> DataFrame:
    """Drift issues against a snapshot if given, else baseline tables, else the saved tag; with none of them a warning."""
    profile = profile_tables(tables, meta) if profile is None else profile
    if snapshot is None and baseline is None:
        snapshot = load_snapshot(profile.sparkSession, snapshot_path, tag) if snapshot_path else None
        if snapshot is None:
            log.warning("no snapshot %s; drift is skipped", tag)
    if snapshot is not None:
        stats = snapshot_drift(tables, profile, meta, snapshot)
    elif baseline is not None:
        stats = baseline_drift(tables, profile, meta, baseline)
    else:
        return no_issues(profile.sparkSession)
    return local_frame(profile.sparkSession, drift_issues(stats).collect(), ISSUE)
