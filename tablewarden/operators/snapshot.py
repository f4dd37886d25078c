"""Column snapshots: the statistics kept as a baseline.  Raw rows are never stored."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden import config
from tablewarden.functions.quantiles import bucket_counts, exact_quantiles
from tablewarden.operators.profile import Tables, profile_tables
from tablewarden.runtime import is_numeric, local_frame, quoted, settled, side_by_side, small_or_shuffled, text_sql, union_all
from tablewarden.schemas import SNAPSHOT


def histogram_edges(low: float, high: float, n_values: int) -> list[float]:
    """Equal-width edges, min(20, n) bins; a constant column is widened by half a unit."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    return [float(x) for x in np.linspace(low, high, min(config.SNAPSHOT_BINS, n_values) + 1)]


def histograms(df: DataFrame, edges: Mapping[str, list[float]]) -> dict[str, list[int]]:
    """Counts per bin; every bin is closed on the left, the last one on both sides."""
    edges = {c: e for c, e in edges.items() if e}
    if not edges:
        return {}
    out = {c: [0] * (len(e) - 1) for c, e in edges.items()}
    for r in bucket_counts(df, {c: e[1:-1] for c, e in edges.items()}).collect():
        out[r["column"]][r["bucket"]] = r["n"]
    return out


#: Values a frequency sketch keeps, and its guarantee: no value of more than 2 x SKETCH_ERROR / TRACKED of the rows is missed.
TRACKED, SKETCH_ERROR = 2048, 2.625


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(column, value, h)`` of the non-missing values as text, with their 8-byte hash; one scan."""
    cells = ", ".join(f"struct({text_sql(c)} AS column, CAST({quoted(c)} AS STRING) AS value)" for c in columns)
    return df.selectExpr(f"inline(array({cells}))").where("value IS NOT NULL").withColumn("h", F.xxhash64("value"))


def _sketched(df: DataFrame, columns: list[str]) -> tuple[dict[str, int], dict[str, list[tuple[int, int]]]]:
    """Non-missing values of each column, and hashes of its frequent ones with estimated counts, from one scan with
    mergeable sketches."""
    asked = []
    for k, c in enumerate(columns):
        x = f"CAST({quoted(c)} AS STRING)"
        asked += [F.expr(f"count({x})").alias(f"n{k}"),
                  F.expr(f"approx_top_k(CASE WHEN {x} IS NOT NULL THEN xxhash64({x}) END, {TRACKED}, {TRACKED})").alias(f"top{k}")]
    row = df.agg(*asked).first()
    found = {c: [(i["item"], i["count"]) for i in row[f"top{k}"] or () if i["item"] is not None] for k, c in enumerate(columns)}
    return {c: row[f"n{k}"] for k, c in enumerate(columns)}, found


def _by_hash(df: DataFrame, columns: list[str], top: int) -> DataFrame:
    """(column, h) of every value that can be among the first, when no sketch can tell: all values grouped by hash.

    Only hashes, counts and the first seven bytes are shuffled.  Values that tie with the last one in count and in these
    bytes all stay.
    """
    start = F.conv(F.rpad(F.hex(F.substring(F.encode("value", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    groups = _cells(df, columns).groupBy("column", "h").agg(F.count(F.lit(1)).alias("n"), F.min(start).alias("start"))
    place = F.rank().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc("start")))
    return groups.withColumn("place", place).where(F.col("place") <= top).select("column", "h")


def _recounted(df: DataFrame, columns: list[str], wanted: DataFrame) -> DataFrame:
    """Exact counts, by text, of the values whose hash is wanted."""
    chosen = _cells(df, columns).join(wanted, ["column", "h"], "left_semi")
    return chosen.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: list[str], top: int = config.SNAPSHOT_TOP_VALUES) -> DataFrame:
    """The most frequent values per column (column, value, n, place); equal counts are ordered by value.  Exact.

    A sketch over hashes names the frequent values and one scan counts these by text.  That settles a column whose
    candidates are all its values, or whose last place is more frequent than anything the sketch may have missed.
    Other columns, such as texts that are all different, are grouped by hash.  No text leaves its task but candidates.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    n_values, frequent = _sketched(df, columns)
    missed = {c: 2 * SKETCH_ERROR / TRACKED * n for c, n in n_values.items()}
    hopeful = [c for c in columns if sum(n for _, n in frequent[c]) >= n_values[c]
               or sum(n > missed[c] for _, n in frequent[c]) >= top]               # estimates are never too small
    parts, open_ = [], [c for c in columns if c not in hopeful]
    if hopeful:
        wanted = local_frame(df.sparkSession, [(c, h) for c in hopeful for h, _ in frequent[c]], "column string, h long")   # TRACKED a column
        counted = settled(_recounted(df, hopeful, F.broadcast(wanted)))
        ranked = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
        sums = {r["column"]: r["n"] for r in counted.groupBy("column").agg(F.sum("n").alias("n")).collect()}
        last = {r["column"]: r["n"] for r in ranked.where(F.col("place") == top).select("column", "n").collect()}
        unsettled = [c for c in hopeful if sums.get(c, 0) != n_values[c] and last.get(c, 0) <= missed[c]]
        open_ += unsettled
        parts.append(ranked.where(~F.col("column").isin(unsettled)))
    if open_:
        wanted = settled(_by_hash(df, open_, top))
        again = _recounted(df, open_, small_or_shuffled(wanted))
        parts.append(again.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top))
    return union_all(parts)


def numeric_columns(df: DataFrame, rows: Mapping[str, object]) -> list[str]:
    return [c for c in df.columns
            if is_numeric(df, c) and rows[c]["n_rows"] > rows[c]["n_null"]]


def build_snapshot(tables: Tables, tag: str = "baseline", profile: DataFrame | None = None) -> DataFrame:
    """One row per column of every table.

    Three scans per table: the shared profile, the quantiles, and histogram counters; text
    columns add a sketch, a count of its candidates, and a grouping by hash where that settles nothing.  The result is a row per column.
    """
    profile = profile_tables(tables, measures=("missing", "range", "moments")) if profile is None else profile
    stats: dict[str, dict[str, object]] = {}
    for r in profile.collect():
        stats.setdefault(r["table"], {})[r["column"]] = r
    fractions: dict[tuple[str, str], dict[str, float]] = {}

    def frequent(_) -> None:
        texts = {t: cs for t, df in tables.items() if (cs := [c for c in df.columns if c not in numeric_columns(df, stats[t])])}
        tops = side_by_side(lambda t: top_values(tables[t], texts[t]).withColumn("table", F.lit(t)), texts)
        for r in union_all(tops).orderBy("table", "column", "place").collect() if tops else ():
            s = stats[r["table"]][r["column"]]
            fractions.setdefault((r["table"], r["column"]), {})[r["value"]] = r["n"] / (s["n_rows"] - s["n_null"])

    def numbers(t: str):
        df = tables[t]
        numeric = numeric_columns(df, stats[t])
        counts = {c: stats[t][c]["n_rows"] - stats[t][c]["n_null"] for c in numeric}
        bounds = {c: (stats[t][c]["min"], stats[t][c]["max"]) for c in numeric}
        edges = {c: histogram_edges(*bounds[c], counts[c]) for c in numeric}
        return exact_quantiles(df, {c: config.SNAPSHOT_PROBS for c in numeric}, counts, bounds), edges, histograms(df, edges)

    found = side_by_side(lambda job: job[0](job[1]), [(frequent, None), *((numbers, t) for t in tables)])
    measured = dict(zip(tables, found[1:]))
    rows = []
    for t, df in tables.items():
        q, edges, bins = measured[t]
        for c in df.columns:
            s = stats[t][c]
            head = (tag, t, c, s["dtype"], s["n_rows"], s["n_null"])
            if c in q:
                rows.append((*head, s["mean"], s["std"], s["min"], s["max"],
                             q[c][0.25], q[c][0.50], q[c][0.75], q[c][0.95],
                             list(config.SNAPSHOT_PROBS), [q[c][p] for p in config.SNAPSHOT_PROBS],
                             bins[c], edges[c], None))
            else:
                rows.append((*head, *[None] * 12, fractions.get((t, c), {})))
    return local_frame(profile.sparkSession, rows, SNAPSHOT)
