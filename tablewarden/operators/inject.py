"""Known defects for evaluation: seeded row picks, seven defects, and their ground truth."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.quantiles import rank_counts, select_ranks
from tablewarden.operators.metadata import infer_metadata
from tablewarden.operators.profile import Tables
from tablewarden.functions import names
from tablewarden.runtime import is_integer, is_numeric, local_frame, quoted, settled
from tablewarden.schemas import TRUTH, TableMeta

FACT_SHARE, DIMENSION_SHARE = 0.02, 0.03
OUTLIER_FACTOR, PROMO_FACTOR, FK_STEP = 10, 3, 999
FK_WITHOUT_VALUES = 999999
FK_TEXT, PROMO_TEXT = "__INVALID_FK__", "__PROMO_DRIFT__"
FUTURE_TEXT, FUTURE_INT = "2099-01-01", 20990101
_BITS = 1 << 52          # hashes stay exact as doubles

#: (area, impact, severity) recorded for each injected type.
TRUTH_NOTES = {
    "missing_key_values": ("sales", "one row in fifty has no customer to be joined with", "high"),
    "duplicate_transactions": ("sales", "copied rows are added up a second time", "high"),
    "invalid_future_dates": ("time", "rows fall behind the end of every calendar", "medium"),
    "referential_integrity_break": ("warehouse joins", "inner joins leave these rows out", "high"),
    "numeric_outliers": ("sales metrics", "a multiplied value outweighs the rest of its group", "high"),
    "promotion_drift": ("campaign performance", "discounts no longer add up to what was granted", "medium"),
    "dimension_missing_values": ("customer dimension", "these customers form a group without a name", "medium"),
}


# --------------------------------------------------------------------------------------
# Picking rows
# --------------------------------------------------------------------------------------

def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """``_row``: a stable identity per row.

    Without a unique key the rows are numbered and written to the checkpoint folder once, so
    a task that runs again after a lost executor sees the same numbers.
    """
    if key is not None:
        return df.withColumn("_row", F.struct(F.col(quoted(key)).cast("string").alias("id"), F.lit(0).alias("copy")))
    return settled(df.withColumn("_row", F.struct(
        F.monotonically_increasing_id().cast("string").alias("id"), F.lit(0).alias("copy"))))


def pick_rows(df: DataFrame, share: float, seed: int, n_rows: int | None = None) -> tuple[Column, int]:
    """Condition that holds for exactly max(1, int(n * share)) rows, and that number.

    Rows are ordered by a seeded hash of ``_row`` and the hash of the k-th is found by bracket
    selection, so nothing is sorted or gathered.  Equal hashes at the border are split by a
    second hash.
    """
    n = df.count() if n_rows is None else n_rows
    if n == 0:
        return F.lit(False), 0
    k = min(max(1, int(n * share)), n)

    def border(rows: DataFrame, salt: int, wanted: int, size: int) -> tuple[Column, float, int]:
        h = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("_row.id"), F.col("_row.copy")), F.lit(_BITS)).cast("double")
        hashed = rows.select(h.alias("h"))
        edge = select_ranks(hashed, {"h": {wanted - 1}}, {"h": size}, {"h": (0.0, float(_BITS))})["h"][wanted - 1]
        below, upto = rank_counts(hashed, {"h": [edge]})["h"][edge]
        return h, edge, below, upto

    h, edge, below, upto = border(df, 0, k, n)
    if upto == k:
        return h <= edge, k
    h2, edge2, _, _ = border(df.where(h == edge), 1, k - below, upto - below)
    return (h < edge) | ((h == edge) & (h2 <= edge2)), k


# --------------------------------------------------------------------------------------
# Defects: df, column, condition -> df
# --------------------------------------------------------------------------------------

def _replace(df: DataFrame, column: str, hit: Column, value) -> DataFrame:
    kind = df.schema[column].dataType
    value = (value if isinstance(value, Column) else F.lit(value)).cast(kind)
    return df.withColumn(column, F.when(hit, value).otherwise(F.col(quoted(column))))


def inject_nulls(df: DataFrame, column: str, hit: Column) -> DataFrame:
    return _replace(df, column, hit, F.lit(None))


def inject_duplicates(df: DataFrame, hit: Column) -> DataFrame:
    copies = df.where(hit)
    if "_row" in df.columns:
        copies = copies.withColumn("_row", F.struct(F.col("_row.id").alias("id"), F.lit(1).alias("copy")))
    return df.unionByName(copies)


def future_value(df: DataFrame, column: str):
    return FUTURE_INT if is_integer(df, column) else FUTURE_TEXT


def inject_future(df: DataFrame, column: str, hit: Column) -> DataFrame:
    return _replace(df, column, hit, F.lit(future_value(df, column)))


def invalid_key(df: DataFrame, column: str):
    """A key value no dimension row has: above the largest number, or a marker text."""
    if not is_numeric(df, column):
        empty = df.where(F.col(quoted(column)).isNotNull()).isEmpty()
        return FK_WITHOUT_VALUES if empty else FK_TEXT
    top = df.agg(F.max(quoted(column)).alias("m")).first()["m"]
    return FK_WITHOUT_VALUES if top is None else int(top) + FK_STEP


def inject_orphans(df: DataFrame, column: str, hit: Column, value) -> DataFrame:
    return _replace(df, column, hit, value)


def inject_outliers(df: DataFrame, column: str, hit: Column, factor: int = OUTLIER_FACTOR) -> DataFrame:
    return _replace(df, column, hit, F.col(quoted(column)) * factor)


def inject_promo_drift(df: DataFrame, column: str, hit: Column) -> DataFrame:
    value = F.col(quoted(column)) * PROMO_FACTOR if is_numeric(df, column) else F.lit(PROMO_TEXT)
    return _replace(df, column, hit, value)


# --------------------------------------------------------------------------------------
# The whole injector
# --------------------------------------------------------------------------------------

def target_fact(tables: Tables, meta: Mapping[str, TableMeta]) -> str:
    return next((t for t in tables if meta[t].is_fact), next(iter(tables)))


def missing_key_target(df: DataFrame, meta: TableMeta, key_columns: list[str]) -> str | None:
    return next(iter((*meta.primary_keys, *meta.foreign_keys, *key_columns)), None)


def customer_dimension(tables: Tables, meta: Mapping[str, TableMeta]) -> tuple[str, str] | None:
    """First dimension named after customers, with its first text column."""
    for t, df in tables.items():
        if "customer" in t.lower() and not meta[t].is_fact:
            text = next((f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)), None)
            return (t, text) if text else None
    return None


def inject_issues(tables: Tables, meta: Mapping[str, TableMeta] | None = None, seed: int = 42,
                  keys: Mapping[str, str] | None = None,
                  pick: Callable[[DataFrame, float, int], tuple[Column, int]] | None = None,
                  ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Seven defects in fixed order; returns the new tables and the ground truth.

    ``keys`` names a unique column per table that already identifies rows; ``pick`` replaces
    the seeded exact choice of rows.
    """
    keys, pick = dict(keys or {}), pick or pick_rows
    if meta is None:
        meta = infer_metadata(tables)
        for t, m in meta.items():          # an inferred fact key is unique: no row numbers needed
            if m.is_fact and m.primary_keys:
                keys.setdefault(t, m.primary_keys[0])
    out = dict(tables)
    fact = target_fact(tables, meta)
    m = meta[fact]
    df = with_row_id(tables[fact], keys.get(fact))
    truth: list[tuple] = []

    def record(kind: str, table: str, columns: list[str], n: int, share: float, **more) -> None:
        area, impact, level = TRUTH_NOTES[kind]
        parameters = {"fraction": str(share), **({"column": columns[0]} if columns else {}),
                      **{k: str(v) for k, v in more.items()}}
        truth.append((f"I{len(truth) + 1:04d}", kind, table, columns, n, level, area, impact, parameters))

    spark = df.sparkSession
    catalogue = local_frame(spark, [(c,) for c in tables[fact].columns], "c string")
    key_columns = {r["c"] for r in catalogue.where(names.is_key(F.col("c"))).collect()}
    target = missing_key_target(df, m, [c for c in tables[fact].columns if c in key_columns])
    if target is not None:
        hit, n = pick(df, FACT_SHARE, seed)
        if n:
            df = inject_nulls(df, target, hit)
            record("missing_key_values", fact, [target], n, FACT_SHARE)
    hit, n = pick(df, FACT_SHARE, seed + 1)
    if n:
        df = inject_duplicates(df, hit)
        record("duplicate_transactions", fact, [], n, FACT_SHARE)
    if m.date_cols:
        c = m.date_cols[0]
        hit, n = pick(df, FACT_SHARE, seed + 2)
        df, value = inject_future(df, c, hit), future_value(df, c)
        record("invalid_future_dates", fact, [c], n, FACT_SHARE, value=value)
    if m.foreign_keys:
        c = next(iter(m.foreign_keys))
        hit, n = pick(df, FACT_SHARE, seed + 3)
        value = invalid_key(df, c)
        df = inject_orphans(df, c, hit, value)
        record("referential_integrity_break", fact, [c], n, FACT_SHARE, bad_value=value)
    if m.numeric_cols:
        c = m.numeric_cols[0]
        hit, n = pick(df, FACT_SHARE, seed + 4)
        df = inject_outliers(df, c, hit)
        record("numeric_outliers", fact, [c], n, FACT_SHARE, multiplier=OUTLIER_FACTOR)
    if m.promo_cols:
        c = m.promo_cols[0]
        hit, n = pick(df, FACT_SHARE, seed + 5)
        df = inject_promo_drift(df, c, hit)
        record("promotion_drift", fact, [c], n, FACT_SHARE)
    out[fact] = df.drop("_row")
    found = customer_dimension(tables, meta)
    if found is not None:
        t, c = found
        dim = with_row_id(tables[t], keys.get(t))
        hit, n = pick(dim, DIMENSION_SHARE, seed + 6)
        if n:
            out[t] = inject_nulls(dim, c, hit).drop("_row")
            record("dimension_missing_values", t, [c], n, DIMENSION_SHARE)
    return out, local_frame(spark, truth, TRUTH)
