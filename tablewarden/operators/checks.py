"""Rule checks: missing values, duplicates, outliers, future dates, broken references.

Each check returns issue rows (bounded by the number of columns).  Data rows stay in Spark:
counters come from the shared profile or from one aggregate per table, and the aggregates of
all tables run as one job.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden import config
from tablewarden.functions import names
from tablewarden.functions.quantiles import as_double, exact_quantiles
from tablewarden.functions.scoring import severity
from tablewarden.operators.profile import Tables, profile_tables, table_sizes
from tablewarden.operators.references import Link, key_uses
from tablewarden.runtime import (INTEGER_TYPES, comparable_column, is_numeric, is_plain, local_frame, quoted, settled,
                                 side_by_side, union_all)
from tablewarden.schemas import ISSUE, TableMeta

log = logging.getLogger(__name__)
Meta = Mapping[str, TableMeta]

#: Above this many rows full-row duplicates are first narrowed by row hash.
HASH_FIRST_ROWS = 10_000_000


def no_issues(spark) -> DataFrame:
    return local_frame(spark, [], ISSUE)


def _issues(found: DataFrame, issue_type: str, columns: Column, share: Column,
            evidence: Column, text: Column) -> DataFrame:
    """Common shape; ``found`` carries table, table_pos, col_pos and maybe dim_table/dim_pk."""
    order = Window.orderBy("table_pos", "col_pos")     # a row per issue, never per data row
    for name in ("dim_table", "dim_pk"):
        if name not in found.columns:
            found = found.withColumn(name, F.lit(""))
    return found.select(
        F.concat(F.lit(config.ID_PREFIX[issue_type]),
                 F.lpad(F.row_number().over(order).cast("string"), 4, "0")).alias("issue_id"),
        F.lit(issue_type).alias("issue_type"), "table", columns.alias("columns"),
        severity(share).alias("severity"), F.round(share, 6).alias("metric"),
        evidence.cast("long").alias("evidence_rows"), text.alias("description"),
        "dim_table", "dim_pk")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


# --------------------------------------------------------------------------------------
# Missing values
# --------------------------------------------------------------------------------------

def strict_columns(spark, meta: Meta) -> DataFrame:
    """Keys and dates by metadata; these use the strict limit."""
    rows = sorted({(t, c) for t, m in meta.items()
                   for c in (*m.primary_keys, *m.foreign_keys, *m.date_cols)})
    return local_frame(spark, rows, "table string, column string")


def null_rates(profile: DataFrame, meta: Meta, sensitivity: str = "normal") -> DataFrame:
    """Per column: missing rows, their share, and the limit that applies."""
    strict = strict_columns(profile.sparkSession, meta).withColumn("strict", F.lit(True))
    key_limit, other_limit = (
        (config.NULL_LIMIT_HIGH_SENSITIVITY,) * 2 if sensitivity == "high"
        else (config.NULL_LIMIT_KEY, config.NULL_LIMIT_OTHER))
    return (profile.join(strict, ["table", "column"], "left")
            .withColumn("strict", F.coalesce("strict", F.lit(False)) | names.is_key(F.col("column")))
            .withColumn("null_share", _share("n_null", "n_rows"))
            .withColumn("null_limit", F.when(F.col("strict"), key_limit).otherwise(other_limit)))


def null_issues(profile: DataFrame, meta: Meta, sensitivity: str = "normal") -> DataFrame:
    found = (null_rates(profile, meta, sensitivity)
             .where("n_rows > 0 AND null_share >= null_limit"))
    return _issues(
        found, "missing_values", F.array("column"), F.col("null_share"), F.col("n_null"),
        F.format_string("Column '%s' has %.2f%% missing values.", F.col("column"), F.col("null_share") * 100))


# --------------------------------------------------------------------------------------
# Duplicates
# --------------------------------------------------------------------------------------

def repeated_groups(df: DataFrame, columns: list[str], n_rows: int | None = None,
                    hash_first: int = HASH_FIRST_ROWS) -> DataFrame:
    """Groups of equal rows over ``columns`` with more than one copy (``copies``).

    Wide rows in large tables: a first pass groups 8-byte row hashes and finds which of them
    repeat at all.  Few repeated hashes are broadcast, so only suspect rows are compared in
    full; equal hashes of different rows are told apart there.  With many repeats the full
    grouping runs directly, as it does for two whole numbers, hardly wider than a hash.  Maps and
    variants are compared in a canonical form; the group shows one of its own values.
    """
    forms = {c: f"_key_{i}" for i, c in enumerate(columns) if not is_plain(df.schema[c].dataType)}
    rows = df.select(*[F.col(quoted(c)) for c in columns],
                     *[comparable_column(df, c).alias(form) for c, form in forms.items()])
    keys = [F.col(forms[c] if c in forms else quoted(c)) for c in columns]
    narrow = len(columns) <= 2 and all(isinstance(df.schema[c].dataType, INTEGER_TYPES) for c in columns)
    if len(columns) > 1 and not narrow and (n_rows or 0) > hash_first:
        hashed = rows.withColumn("_h", F.xxhash64(*keys))
        twice = settled(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h"))
        if twice.limit(config.BROADCAST_ROWS + 1).count() <= config.BROADCAST_ROWS:
            rows = hashed.join(F.broadcast(twice), "_h", "left_semi").drop("_h")
    shown = [F.first(F.col(quoted(c))).alias(c) for c in forms]
    return (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), *shown).where("copies > 1")
            .select(*map(quoted, columns), "copies"))


def excess_copies(df: DataFrame, columns: list[str], n_rows: int | None = None,
                  hash_first: int = HASH_FIRST_ROWS) -> DataFrame:
    """One row: copies beyond the first of each group; missing keys equal each other."""
    return (repeated_groups(df, columns, n_rows, hash_first)
            .agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("excess")))


def duplicate_issues(tables: Tables, profile: DataFrame, meta: Meta, sensitivity: str = "normal") -> DataFrame:
    sizes = table_sizes(profile)
    parts = []
    for pos, (t, df) in enumerate(tables.items()):
        if not sizes.get(t):
            continue
        keys = list(meta[t].primary_keys)
        text = ("Detected %d duplicate excess copies in '%s' on primary key columns." if keys else
                "Detected %d duplicate excess copies in '%s' on all columns (no primary key found).")
        parts.append(excess_copies(df, keys or df.columns, sizes[t]).select(
            F.lit(t).alias("table"), F.lit(pos).alias("table_pos"), F.lit(0).alias("col_pos"),
            F.lit(sizes[t]).cast("long").alias("n_rows"), "excess",
            F.array(*[F.lit(k) for k in keys]).cast("array<string>").alias("keys"),
            F.format_string(text, F.col("excess"), F.lit(t)).alias("text")))
    if not parts:
        return no_issues(profile.sparkSession)
    share = _share("excess", "n_rows")
    found = union_all(parts).where(
        (F.col("excess") > 0)
        & ((share >= config.DUPLICATE_MIN_SHARE[sensitivity]) | (F.col("excess") >= 2)))
    return _issues(found, "duplicate_rows", F.col("keys"), share, F.col("excess"), F.col("text"))


# --------------------------------------------------------------------------------------
# Outliers
# --------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Fence:
    column: str
    q1: float
    q3: float

    def bounds(self, multiplier: float) -> tuple[float, float]:
        iqr = self.q3 - self.q1
        return self.q1 - multiplier * iqr, self.q3 + multiplier * iqr


def quartile_fences(df: DataFrame, columns: list[str], counts: Mapping[str, int] | None = None,
                    bounds: Mapping[str, tuple[float, float]] | None = None,
                    bracket_rows: int = config.BRACKET_ROWS) -> dict[str, Fence]:
    """Exact interpolated quartiles per column."""
    found = exact_quantiles(df, {c: (0.25, 0.75) for c in columns}, counts, bounds, bracket_rows)
    return {c: Fence(c, q[0.25], q[0.75]) for c, q in found.items()}


def beyond(df: DataFrame, fence: Fence, multiplier: float) -> Column:
    """True for values strictly outside the fence; missing values are never outside."""
    low, high = fence.bounds(multiplier)
    x = as_double(df, fence.column)
    return F.coalesce((x < low) | (x > high), F.lit(False))


def outlier_counts(tables: Tables, profile: DataFrame, meta: Meta, multiplier: float) -> DataFrame:
    """Rows ``(table, column, n_values, n_outliers, q1, q3)`` for fact measures with a spread."""
    values = {(r["table"], r["column"]): r for r in profile.collect()}

    def count_table(place: tuple[int, str]) -> DataFrame | None:
        pos, t = place
        df = tables[t]
        counts = {c: values[t, c]["n_rows"] - values[t, c]["n_null"]
                  for c in meta[t].numeric_cols if is_numeric(df, c)}
        counts = {c: n for c, n in counts.items() if n >= config.MIN_ROWS_FOR_STATS}
        bounds = {c: (values[t, c]["min"], values[t, c]["max"]) for c in counts}
        fences = {c: f for c, f in quartile_fences(df, list(counts), counts, bounds).items() if f.q1 != f.q3}
        if not fences:
            return None
        row = df.agg(*[F.count_if(beyond(df, f, multiplier)).alias(f"o{i}")
                       for i, f in enumerate(fences.values())])
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(t).alias("table"), F.lit(pos).alias("table_pos"),
                     F.lit(c).alias("column"), F.lit(df.columns.index(c)).alias("col_pos"),
                     F.lit(counts[c]).cast("long").alias("n_values"),
                     F.col(f"o{i}").alias("n_outliers"),
                     F.lit(f.q1).alias("q1"), F.lit(f.q3).alias("q3"))
            for i, (c, f) in enumerate(fences.items())])))

    facts = [(pos, t) for pos, t in enumerate(tables) if meta[t].is_fact]
    parts = [p for p in side_by_side(count_table, facts) if p is not None]
    if not parts:
        return local_frame(profile.sparkSession, [], "table string, table_pos int, column string, col_pos int, n_values long, "
                "n_outliers long, q1 double, q3 double")
    return union_all(parts)


def outlier_issues(tables: Tables, profile: DataFrame, meta: Meta, sensitivity: str = "normal") -> DataFrame:
    multiplier = config.IQR_MULTIPLIER[sensitivity]
    share = _share("n_outliers", "n_values")
    found = (outlier_counts(tables, profile, meta, multiplier)
             .where(share >= config.OUTLIER_MIN_SHARE[sensitivity]))
    return _issues(
        found, "numeric_outliers", F.array("column"), share, F.col("n_outliers"),
        F.format_string(f"Column '%s' has %d IQR outliers (mult={multiplier}).",
                        F.col("column"), F.col("n_outliers")))


# --------------------------------------------------------------------------------------
# Future dates
# --------------------------------------------------------------------------------------

def future_date_issues(profile: DataFrame, meta: Meta | None = None) -> DataFrame:
    """Any date-named column with a value after the fixed cutoff (same at both sensitivities)."""
    found = profile.where("n_future > 0")
    return _issues(
        found, "invalid_future_dates", F.array("column"), _share("n_future", "n_rows"), F.col("n_future"),
        F.format_string(f"Column '%s' contains %d values beyond {config.FUTURE_CUTOFF_DATE}.",
                        F.col("column"), F.col("n_future")))


# --------------------------------------------------------------------------------------
# Broken references
# --------------------------------------------------------------------------------------

def reference_links(tables: Tables, sizes: Mapping[str, int], meta: Meta) -> list[tuple[Link, int, int]]:
    """Foreign keys that can be checked, with the places of their table and of the key in it."""
    return [(Link(t, fk, dim, pk), pos, i)
            for pos, (t, df) in enumerate(tables.items()) if meta[t].is_fact and sizes.get(t)
            for i, (fk, (dim, pk)) in enumerate(meta[t].foreign_keys.items())
            if dim in tables and sizes.get(dim) and pk in tables[dim].columns and fk in df.columns]


def reference_breaks(tables: Tables, profile: DataFrame, meta: Meta) -> DataFrame:
    """Rows per foreign key: ``n_orphans`` and the dimension it points at.  Every table is read once for all its keys."""
    sizes = table_sizes(profile)
    links = reference_links(tables, sizes, meta)
    catalog = local_frame(
        profile.sparkSession, [(k, x.table, pos, x.fk, i, sizes[x.table], x.dim, x.pk) for k, (x, pos, i) in enumerate(links)],
        "link int, table string, table_pos int, column string, col_pos int, n_rows long, dim_table string, dim_pk string")
    shape = [F.col(c) for c in ("table", "table_pos", "column", "col_pos", "n_rows", "n_orphans", "dim_table", "dim_pk")]
    if not links:
        return catalog.withColumn("n_orphans", F.lit(0).cast("long")).select(*shape)
    broken = key_uses(tables, [x for x, _, _ in links]).where("NOT known").groupBy("link").agg(F.sum("rows").alias("n"))
    return (catalog.join(broken, "link", "left").withColumn("n_orphans", F.coalesce("n", F.lit(0)).cast("long")).select(*shape))


def reference_issues(tables: Tables, profile: DataFrame, meta: Meta, sensitivity: str = "normal") -> DataFrame:
    found = reference_breaks(tables, profile, meta).where("n_orphans > 0")
    return _issues(
        found, "referential_integrity_break", F.array("column"), _share("n_orphans", "n_rows"),
        F.col("n_orphans"),
        F.format_string("Column '%s' has %d values not found in %s.%s.", F.col("column"),
                        F.col("n_orphans"), F.col("dim_table"), F.col("dim_pk")))


# --------------------------------------------------------------------------------------
# Empty tables, and everything together
# --------------------------------------------------------------------------------------

def empty_table_issues(profile: DataFrame) -> DataFrame:
    """One issue per empty table, named by the whole table; names that differ in case only stay as they are."""
    alike = F.count(F.lit(1)).over(Window.partitionBy(F.upper("table")))
    empty = profile.where("n_rows = 0").select("table", "table_pos").distinct()
    return empty.select(
        F.concat(F.lit("EMPTY_"), F.when(alike == 1, F.upper("table")).otherwise(F.col("table"))).alias("issue_id"),
        F.lit("empty_table").alias("issue_type"), "table",
        F.array().cast("array<string>").alias("columns"), F.lit("high").alias("severity"),
        F.lit(1.0).alias("metric"), F.lit(0).cast("long").alias("evidence_rows"),
        F.format_string("Table '%s' contains zero rows.", F.col("table")).alias("description"),
        F.lit("").alias("dim_table"), F.lit("").alias("dim_pk"))


#: What the checks read off the profile.
NEEDS = ("missing", "future", "range")

CHECKS: dict[str, Callable[..., DataFrame]] = {
    "missing_values": lambda tables, profile, meta, s: null_issues(profile, meta, s),
    "duplicate_rows": duplicate_issues,
    "numeric_outliers": outlier_issues,
    "invalid_future_dates": lambda tables, profile, meta, s: future_date_issues(profile, meta),
    "referential_integrity_break": reference_issues,
}


def run_checks(tables: Tables, meta: Meta, sensitivity: str = "normal",
               profile: DataFrame | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All checks over non-empty tables, plus empty-table issues.

    Returns the issues and the checks that failed with their error.  One failing check never
    hides the others.  Checks are submitted from a few driver threads so their jobs overlap.
    """
    profile = profile_tables(tables, meta, NEEDS) if profile is None else profile
    spark = profile.sparkSession
    sizes = table_sizes(profile)
    filled = {t: df for t, df in tables.items() if sizes.get(t)}
    failures: list[tuple[str, str]] = []

    def run(name: str) -> list:
        try:
            return CHECKS[name](filled, profile, {t: meta[t] for t in filled}, sensitivity).collect()
        except Exception as error:        # noqa: BLE001 - isolate and report any failing check
            log.warning("check %s failed: %s", name, error)
            failures.append((name, str(error)))
            return []

    rows = empty_table_issues(profile).collect()
    if filled:
        with ThreadPoolExecutor(max_workers=len(CHECKS)) as pool:
            for part in pool.map(run, CHECKS):
                rows += part
    return local_frame(spark, rows, ISSUE), failures
