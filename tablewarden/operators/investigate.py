"""Investigation queries an analyst runs on one issue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden import config
from tablewarden.functions.dates import after_cutoff
from tablewarden.functions.quantiles import as_double, exact_quantiles
from tablewarden.operators.checks import (Fence, beyond, excess_copies, quartile_fences, repeated_groups)
from tablewarden.operators.references import HOT_ROWS, marked, orphan_counts
from tablewarden.runtime import comparable_column, present, quoted

TOP = 20


def orphan_values(df: DataFrame, fk: str, dim: DataFrame, pk: str, top: int = TOP) -> DataFrame:
    """Foreign-key values without a dimension row, most used first."""
    return (orphan_counts(df, fk, dim, pk)
            .select(F.col("key").alias("invalid_fk_value"), F.col("n").alias("affected_rows"))
            .orderBy(F.desc("affected_rows"), "invalid_fk_value").limit(top))


def duplication_rate(df: DataFrame, n_rows: int | None = None) -> DataFrame:
    total = df.count() if n_rows is None else n_rows
    return (excess_copies(df, df.columns, total).withColumn("total_rows", F.lit(total).cast("long"))
            .select("total_rows", F.col("excess").alias("duplicate_rows"),
                    F.round(F.try_divide(100.0 * F.col("excess"), F.col("total_rows")), 2).alias("dup_pct")))


def duplicate_rows(df: DataFrame, top: int = TOP, n_rows: int | None = None) -> DataFrame:
    """Rows that occur more than once with ``occurrences``, most copied first.

    Groups are counted with map-side partial counts and cut to the first ``top`` before they
    are laid out as rows again, so a row with very many copies never fills one task.
    """
    columns = df.columns
    order = [F.desc("occurrences"), *[comparable_column(df, c) for c in columns]]
    groups = (repeated_groups(df, columns, n_rows).withColumnRenamed("copies", "occurrences")
              .orderBy(*order).limit(top))
    return (groups.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("occurrences"), F.lit(top)))))
            .orderBy(*order).limit(top).drop("_copy"))


def outlier_bounds(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, range and mean of one column."""
    fence = quartile_fences(df, [column])
    q1, q3 = (fence[column].q1, fence[column].q3) if column in fence else (None, None)
    x = as_double(df, column)
    return df.agg(
        F.lit(q1).cast("double").alias("q1"), F.lit(q3).cast("double").alias("q3"),
        (F.lit(q3).cast("double") - F.lit(q1).cast("double")).alias("iqr"),
        F.min(x).alias("min_val"), F.max(x).alias("max_val"), F.avg(x).alias("mean_val"))


def extreme_values(df: DataFrame, column: str, multiplier: float = config.IQR_MULTIPLIER["high"],
                   top: int = TOP, fence: Fence | None = None) -> DataFrame:
    """The smallest ``top`` values outside the fence, in order."""
    fence = fence or quartile_fences(df, [column]).get(column)
    hit = beyond(df, fence, multiplier) if fence else F.lit(False)
    return df.where(hit).select(quoted(column)).orderBy(quoted(column)).limit(top)


def null_rate(df: DataFrame, column: str) -> DataFrame:
    n = F.count(F.lit(1))
    missing = n - F.count(present(df, column))
    return df.agg(n.alias("total_rows"), missing.alias("null_count"),
                  F.round(F.try_divide(100.0 * missing, n), 2).alias("null_pct"))


def future_values(df: DataFrame, column: str, cutoff: str = config.FUTURE_CUTOFF_DATE) -> DataFrame:
    """Each date after the cutoff with its row count, earliest first."""
    return (df.where(after_cutoff(df, column, cutoff)).groupBy(quoted(column))
            .agg(F.count(F.lit(1)).alias("row_count")).orderBy(quoted(column)))


def distribution(df: DataFrame, column: str) -> DataFrame:
    x = as_double(df, column)
    q = exact_quantiles(df, {column: (0.5,)})
    median = q[column][0.5] if column in q else None
    four = lambda c, name: F.round(c, 4).alias(name)
    return df.agg(F.count(F.lit(1)).alias("row_count"), four(F.min(x), "min_val"), four(F.max(x), "max_val"),
                  four(F.avg(x), "mean_val"), four(F.stddev_samp(x), "std_val"),
                  four(F.lit(median).cast("double"), "median_val"))


def recent_rows(df: DataFrame, order: str, top: int = TOP) -> DataFrame:
    """The last rows by an explicit order column (a table in Spark has no row number)."""
    return df.orderBy(F.desc(quoted(order))).limit(top)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def orphan_rows(df: DataFrame, fk: str, dim: DataFrame, pk: str, broadcast_rows: int = config.BROADCAST_ROWS,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Whole fact rows whose key has no dimension row.  Rows without a key, and those of very frequent keys, are not shuffled."""
    rows, orphan = marked(df, fk, dim, pk, broadcast_rows, hot_rows)
    return rows.where(F.col(orphan)).drop(orphan)


def sigma_rows(df: DataFrame, column: str, sigmas: float = 3.0) -> DataFrame:
    """Rows further than three population standard deviations from the mean."""
    x = as_double(df, column)
    stats = df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")).first()
    if stats["mean"] is None:
        return df.where(F.lit(False))
    return df.where((x < stats["mean"] - sigmas * stats["std"]) | (x > stats["mean"] + sigmas * stats["std"]))


def drift_stats(df: DataFrame, column: str) -> DataFrame:
    x = as_double(df, column)
    return df.agg(F.avg(x).alias("current_avg"), F.stddev_pop(x).alias("current_std"),
                  F.min(x).alias("current_min"), F.max(x).alias("current_max"))


def sample_rows(df: DataFrame, top: int = TOP) -> DataFrame:
    """Any ``top`` rows, for issue types without a query of their own."""
    return df.limit(top)
