"""One scan per table for everything that needs only counters."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.dates import after_cutoff_sql
from tablewarden.runtime import is_integer, is_numeric, local_copy, present, present_sql, text_sql, union_all
from tablewarden.schemas import PROFILE, TableMeta

Tables = Mapping[str, DataFrame]


def is_date_column(name: str, table: str, meta: Mapping[str, TableMeta] | None) -> bool:
    if meta is not None and table in meta:
        return name in meta[table].date_cols
    return "date" in name.lower() or "day" in name.lower()


#: What can be measured besides row counts.  Who reads a profile says what it needs, and the plan holds only that.
MEASURES = ("missing", "future", "range", "moments")
#: Size of a distinct sketch, as a power of two, and a bound of its relative error (six standard deviations).
DISTINCT_BITS, DISTINCT_ERROR = 12, 0.1


def profile_plan(tables: Tables, meta: Mapping[str, TableMeta] | None = None, measures: Collection[str] = MEASURES,
                 about: Mapping[str, Collection[str]] | None = None) -> DataFrame:
    """Lazy profile: one global aggregate per table, unpivoted to a row per column.

    Of the measures, ``missing`` counts missing values, ``future`` values of date columns behind the cutoff, ``range`` gives min and
    max and ``moments`` mean and deviation of numbers.  Columns in ``about`` also get a sketched number of distinct values.  What is
    not asked for is null, and columns that nothing is asked of are not read.
    """
    unknown = set(measures) - set(MEASURES)
    if unknown:
        raise ValueError(f"unknown measures: {sorted(unknown)}")
    parts = []
    for pos, (table, df) in enumerate(tables.items()):
        aggregates, cells = ["count(1) AS n_rows"], []
        for i, f in enumerate(df.schema.fields):
            name, x = f.name, present_sql(df, f.name)
            number = f"CAST({x} AS DOUBLE)"
            wanted = {}
            if "missing" in measures:
                wanted["k"] = f"count({x})"
            if "future" in measures and is_date_column(name, table, meta):
                wanted["f"] = f"count_if({after_cutoff_sql(df, name)})"
            if is_numeric(df, name):
                if "range" in measures:
                    wanted |= {"lo": f"min({number})", "hi": f"max({number})"}
                if "moments" in measures:
                    wanted |= {"mu": f"avg({number})", "sd": f"stddev_pop({number})"}
            if name in (about or {}).get(table, ()):
                value = x if is_integer(df, name) and f.dataType.simpleString() in ("int", "bigint") else f"CAST({x} AS STRING)"
                wanted["d"] = f"hll_sketch_estimate(hll_sketch_agg({value}, {DISTINCT_BITS}))"
            aggregates += [f"{expression} AS {tag}{i}" for tag, expression in wanted.items()]
            held = lambda tag, kind: f"{tag}{i}" if tag in wanted else f"CAST(NULL AS {kind})"        # noqa: E731, B023
            missing = f"n_rows - k{i}" if "k" in wanted else "CAST(NULL AS BIGINT)"
            cells.append(
                f"named_struct('column', {text_sql(name)}, 'col_pos', {i}, "
                f"'dtype', {text_sql(f.dataType.simpleString())}, 'n_null', {missing}, "
                f"'n_future', {held('f', 'BIGINT')}, 'min', {held('lo', 'DOUBLE')}, 'max', {held('hi', 'DOUBLE')}, "
                f"'mean', {held('mu', 'DOUBLE')}, 'std', {held('sd', 'DOUBLE')}, 'n_about', {held('d', 'BIGINT')})")
        if cells:
            parts.append(df.selectExpr(*aggregates).selectExpr(
                f"{text_sql(table)} AS table", f"{pos} AS table_pos", "n_rows",
                f"inline(array({', '.join(cells)}))"))
    return union_all(parts).select(*PROFILE.names)


def profile_tables(tables: Tables, meta: Mapping[str, TableMeta] | None = None, measures: Collection[str] = MEASURES,
                   about: Mapping[str, Collection[str]] | None = None) -> DataFrame:
    """The profile as a frozen catalogue (a row per column), so no check scans again for it."""
    return local_copy(profile_plan(tables, meta, measures, about))


def table_sizes(profile: DataFrame) -> dict[str, int]:
    """Row counts per table, read off the profile."""
    return {r["table"]: r["n_rows"] for r in profile.select("table", "n_rows").distinct().collect()}


def distinct_counts(tables: Tables, columns: Mapping[str, list[str]]) -> DataFrame:
    """Exact distinct non-missing values: rows ``(table, column, n_distinct)``.

    Every column gets its own aggregate (partial distinct before the shuffle) and all run in
    one job; several distinct counts in one aggregate would copy each row once per column.
    """
    return union_all(
        tables[t].agg(F.countDistinct(present(tables[t], c)).alias("n_distinct"))
        .select(F.lit(t).alias("table"), F.lit(c).alias("column"), "n_distinct")
        for t, cs in columns.items() for c in cs)
