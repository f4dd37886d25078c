"""Far-future dates in integer, text and typed columns.

Written as SQL text: one parsed string per column is much cheaper to build than a tree of
column calls when a profile covers hundreds of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden import config
from tablewarden.runtime import is_integer, quoted


def parsed_sql(text: str) -> str:
    """ISO dates, ISO datetimes with or without zone, and compact ``yyyyMMdd``."""
    return (f"coalesce(try_cast({text} AS TIMESTAMP), CASE WHEN trim({text}) RLIKE '^[0-9]{{8}}$' "
            f"THEN try_to_timestamp(trim({text}), 'yyyyMMdd') END)")


def after_cutoff_sql(df: DataFrame, name: str, cutoff: str = config.FUTURE_CUTOFF_DATE) -> str:
    """SQL condition: the value lies strictly after ``cutoff``; never null."""
    column, kind = quoted(name), df.schema[name].dataType
    if is_integer(df, name):
        return f"coalesce({column} > {int(cutoff.replace('-', ''))}, false)"
    if isinstance(kind, T.StringType):
        return f"coalesce({parsed_sql(column)} > TIMESTAMP '{cutoff}', false)"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return f"coalesce({column} > CAST('{cutoff}' AS {kind.simpleString()}), false)"
    return "false"


def after_cutoff(df: DataFrame, name: str, cutoff: str = config.FUTURE_CUTOFF_DATE) -> Column:
    return F.expr(after_cutoff_sql(df, name, cutoff))
