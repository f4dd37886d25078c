"""Repairs as transforms from DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden import config
from tablewarden.functions.dates import after_cutoff, parsed_sql
from tablewarden.functions.quantiles import as_double
from tablewarden.operators.checks import beyond, quartile_fences
from tablewarden.operators.references import HOT_ROWS, marked, orphan_counts
from tablewarden.runtime import comparable_column, is_integer, is_plain, present, quoted

REPAIR_MULTIPLIER = config.IQR_MULTIPLIER["high"]
OPEN_END_DATE, OPEN_END_LIMIT = "9999-12-31", "9999-01-01"


def drop_orphans(df: DataFrame, fk: str, dim: DataFrame, pk: str, broadcast_rows: int = config.BROADCAST_ROWS,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fact rows with a known key; rows without any key are kept."""
    rows, orphan = marked(df, fk, dim, pk, broadcast_rows, hot_rows)
    return rows.where(~F.col(orphan)).drop(orphan)


def add_placeholder_dimension(df: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """The dimension plus one otherwise empty row per orphan key."""
    missing = orphan_counts(df, fk, dim, pk).select(
        F.col("key").cast(dim.schema[pk].dataType).alias(pk))
    return dim.unionByName(missing, allowMissingColumns=True)


def null_orphans(df: DataFrame, fk: str, dim: DataFrame, pk: str, broadcast_rows: int = config.BROADCAST_ROWS,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Unknown keys become missing; all rows stay."""
    rows, orphan = marked(df, fk, dim, pk, broadcast_rows, hot_rows)
    fixed = F.when(~F.col(orphan), F.col(quoted(fk))).alias(fk)
    return rows.select(*[fixed if c == fk else F.col(quoted(c)) for c in df.columns])


def dedupe_rows(df: DataFrame) -> DataFrame:
    """One of each set of equal rows.  Maps and variants are compared too, in a canonical form."""
    forms = {c: f"_key_{i}" for i, c in enumerate(df.columns) if not is_plain(df.schema[c].dataType)}
    wide = df.withColumns({form: comparable_column(df, c) for c, form in forms.items()}) if forms else df
    return wide.dropDuplicates([forms.get(c, c) for c in df.columns]).select(*map(quoted, df.columns))


def dedupe_on_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by ``order``; remaining columns break ties.

    An aggregate (``min`` of a row struct) rather than a window: partial results are formed
    before the shuffle, so a key with very many rows sends one row per task.
    """
    rest = [order, *[c for c in df.columns if c not in keys and c != order]]
    plain = all(is_plain(df.schema[c].dataType) for c in df.columns)
    row = F.struct(*[F.col(quoted(c)) for c in (rest if plain else df.columns)])
    if plain:
        return (df.groupBy(*map(quoted, keys)).agg(F.min(row).alias("_first"))
                .select(*[F.col(quoted(c)) if c in keys else F.col(f"_first.{quoted(c)}").alias(c) for c in df.columns]))
    placed = F.struct(*[comparable_column(df, c) for c in rest])
    return (df.groupBy(*[comparable_column(df, c).alias(f"_key_{i}") for i, c in enumerate(keys)])
            .agg(F.min_by(row, placed).alias("_first")).select("_first.*"))


def winsorise(df: DataFrame, column: str, multiplier: float = REPAIR_MULTIPLIER) -> DataFrame:
    """Values outside the fence move onto it; missing values stay missing."""
    fence = quartile_fences(df, [column]).get(column)
    if fence is None:
        return df
    low, high = fence.bounds(multiplier)
    x = as_double(df, column)
    return df.withColumn(column, F.when(x < low, low).when(x > high, high).otherwise(x))


def drop_outliers(df: DataFrame, column: str, multiplier: float = REPAIR_MULTIPLIER) -> DataFrame:
    """Rows outside the fence go; rows without a value stay."""
    fence = quartile_fences(df, [column]).get(column)
    return df if fence is None else df.where(~beyond(df, fence, multiplier))


def keep_inside(df: DataFrame, column: str, multiplier: float = REPAIR_MULTIPLIER) -> DataFrame:
    """Rows with a value inside the fence, bounds included; rows without a value go."""
    fence = quartile_fences(df, [column]).get(column)
    if fence is None:
        return df.where(F.lit(False))
    return df.where(as_double(df, column).between(*fence.bounds(multiplier)))


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    mean = df.agg(F.avg(as_double(df, column)).alias("mean")).first()["mean"]
    return df.withColumn(column, F.coalesce(present(df, column), F.lit(mean).cast("double")))


def fill_sentinel(df: DataFrame, column: str, value="UNKNOWN") -> DataFrame:
    return df.withColumn(column, F.coalesce(present(df, column), F.lit(value)))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(present(df, column).isNotNull())


def flag_missing(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_is_null", present(df, column).isNull())


def null_future(df: DataFrame, column: str, cutoff: str = config.FUTURE_CUTOFF_DATE) -> DataFrame:
    return df.withColumn(column, F.when(~after_cutoff(df, column, cutoff), F.col(quoted(column))))


def open_end_future(df: DataFrame, column: str, cutoff: str = config.FUTURE_CUTOFF_DATE) -> DataFrame:
    """Future dates before the year 9999 become the open-end date 9999-12-31."""
    c, kind = F.col(quoted(column)), df.schema[column].dataType
    if is_integer(df, column):
        value, early = F.lit(int(OPEN_END_DATE.replace("-", ""))), c < int(OPEN_END_LIMIT.replace("-", ""))
    elif isinstance(kind, T.StringType):
        value, early = F.lit(OPEN_END_DATE), F.expr(parsed_sql(quoted(column))) < F.lit(OPEN_END_LIMIT).cast("timestamp")
    else:
        value, early = F.lit(OPEN_END_DATE), c < F.lit(OPEN_END_LIMIT).cast(kind)
    return df.withColumn(column, F.when(after_cutoff(df, column, cutoff) & early, value.cast(kind)).otherwise(c))


def drop_future(df: DataFrame, column: str, cutoff: str = config.FUTURE_CUTOFF_DATE) -> DataFrame:
    return df.where(~after_cutoff(df, column, cutoff))


def require_rows(df: DataFrame, table: str) -> DataFrame:
    """The table itself, or an error when it holds no rows (stops at the first row found)."""
    if df.isEmpty():
        raise ValueError(f"table {table} is empty; check the job that loads it")
    return df
