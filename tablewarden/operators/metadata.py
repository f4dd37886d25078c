"""Table roles, keys and column kinds, from names and uniqueness."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions import names
from tablewarden.operators.profile import DISTINCT_ERROR, Tables, distinct_counts, profile_tables
from tablewarden.runtime import is_numeric, local_copy, local_frame
from tablewarden.schemas import TableMeta

_COLUMN_CATALOG = "table string, table_pos int, column string, col_pos int, dtype string, numeric boolean"


def column_meta(tables: Tables) -> DataFrame:
    """One row per column: role, entity and kind by name.  Reads schemas, never rows."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, tp, f.name, cp, f.dataType.simpleString(), is_numeric(df, f.name))
            for tp, (t, df) in enumerate(tables.items())
            for cp, f in enumerate(df.schema.fields)]
    c = F.col("column")
    return (local_frame(spark, rows, _COLUMN_CATALOG)
            .withColumn("role", names.table_role(F.col("table")))
            .withColumn("table_entity", names.table_entity(F.col("table")))
            .withColumn("is_key", names.is_key(c))
            .withColumn("entity", names.key_entity(c))
            .withColumn("is_date", names.is_date_name(c))
            .withColumn("is_numeric", F.col("numeric") & ~F.col("is_key") & ~F.col("is_date"))
            .withColumn("is_promo", names.is_promo_name(c))
            .drop("numeric"))


def key_candidates(catalog: DataFrame) -> DataFrame:
    """Key columns named after their table; all key columns where none is."""
    own = F.coalesce(F.col("entity") == F.col("table_entity"), F.lit(False))
    any_own = F.max(own).over(Window.partitionBy("table"))
    return (catalog.where("is_key").withColumn("own", own).withColumn("any_own", any_own)
            .where(F.col("own") | ~F.col("any_own")).drop("any_own"))


def key_columns(tables: Tables) -> dict[str, list[str]]:
    """Columns that can be keys by their names, for which a profile should tell the number of distinct values."""
    out: dict[str, list[str]] = {}
    for r in column_meta(tables).where("is_key").select("table", "column").collect():
        out.setdefault(r["table"], []).append(r["column"])
    return out


def _cannot_be_unique(row) -> bool:
    """What the profile alone rules out: missing values, far fewer distinct values than rows by a sketch, or more rows
    than integers in the range."""
    if row["n_null"] > 0:
        return True
    if row["n_about"] is not None and row["n_about"] < (1 - DISTINCT_ERROR) * row["n_rows"]:
        return True
    whole = row["dtype"] in ("tinyint", "smallint", "int", "bigint")
    return bool(whole and row["n_rows"] and row["max"] - row["min"] < 0.999 * (row["n_rows"] - 1))


def unique_columns(tables: Tables, profile: DataFrame, columns: Mapping[str, list[str]]) -> set[tuple[str, str]]:
    """Which of the given columns hold a different value in every row (exact)."""
    facts = {(r["table"], r["column"]): r for r in profile.collect()}
    asked: dict[str, list[str]] = {}
    for t, cs in columns.items():
        for c in cs:
            if not _cannot_be_unique(facts[t, c]):
                asked.setdefault(t, []).append(c)
    if not asked:
        return set()
    return {(r["table"], r["column"]) for r in distinct_counts(tables, asked).collect()
            if r["n_distinct"] == facts[r["table"], r["column"]]["n_rows"]}


def primary_keys(tables: Tables, profile: DataFrame, catalog: DataFrame) -> dict[str, str]:
    """First unique candidate; a dimension without one takes its first candidate."""
    candidates: dict[str, list[str]] = {}
    for r in key_candidates(catalog).orderBy("table_pos", "col_pos").collect():
        candidates.setdefault(r["table"], []).append(r["column"])
    unique = unique_columns(tables, profile, candidates)
    facts = {r["table"] for r in catalog.where("role = 'fact'").select("table").distinct().collect()}
    out = {}
    for table, cs in candidates.items():
        hit = next((c for c in cs if (table, c) in unique), None)
        if hit is None and table not in facts:
            hit = cs[0]
        if hit is not None:
            out[table] = hit
    return out


def foreign_keys(tables: Tables, profile: DataFrame, catalog: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Fact key columns joined to the dimension of the same entity.

    Of several dimensions for one entity the last one counts.  A unique dimension column with
    the fact column's own name is preferred over a differently named key of that dimension.
    """
    spark = catalog.sparkSession
    pk = local_frame(spark, list(keys.items()) or [("", "")], "table string, pk string")
    dims = (catalog.where("role = 'dimension'").select("table", "table_pos", "table_entity").distinct()
            .join(pk, "table")
            .groupBy("table_entity").agg(F.max_by(F.struct("table", "pk"), "table_pos").alias("dim")))
    links = (catalog.where("role = 'fact' AND is_key AND entity <> table_entity").join(pk, "table", "left")
             .where(F.col("pk").isNull() | (F.col("column") != F.col("pk")))
             .join(dims.withColumnRenamed("table_entity", "entity"), "entity")
             .select("table", "table_pos", F.col("column").alias("fk"), "col_pos",
                     F.col("dim.table").alias("dim_table"), F.col("dim.pk").alias("dim_pk")))
    links = local_copy(links)
    same_name: dict[str, list[str]] = {}
    for r in links.collect():
        if r["fk"] != r["dim_pk"] and r["fk"] in tables[r["dim_table"]].columns:
            if r["fk"] not in same_name.setdefault(r["dim_table"], []):
                same_name[r["dim_table"]].append(r["fk"])
    better = unique_columns(tables, profile, same_name)
    if not better:
        return links
    better_df = local_frame(spark, sorted(better), "dim_table string, fk string")
    return (links.join(better_df.withColumn("named", F.lit(True)), ["dim_table", "fk"], "left")
            .withColumn("dim_pk", F.when(F.col("named"), F.col("fk")).otherwise(F.col("dim_pk")))
            .select(*links.columns))


def infer_metadata(tables: Tables, profile: DataFrame | None = None,
                   override: Mapping[str, TableMeta] | None = None) -> dict[str, TableMeta]:
    """Role, keys and column kinds for every table; ``override`` entries are taken as given."""
    if override and all(t in override for t in tables):
        return {t: override[t] for t in tables}
    profile = profile_tables(tables, measures=("missing", "range"), about=key_columns(tables)) if profile is None else profile
    catalog = local_copy(column_meta(tables))
    keys = primary_keys(tables, profile, catalog)
    links: dict[str, dict[str, tuple[str, str]]] = {}
    for r in foreign_keys(tables, profile, catalog, keys).orderBy("table_pos", "col_pos").collect():
        links.setdefault(r["table"], {})[r["fk"]] = (r["dim_table"], r["dim_pk"])
    out: dict[str, TableMeta] = {}
    columns: dict[str, list] = {t: [] for t in tables}
    for r in catalog.orderBy("table_pos", "col_pos").collect():
        columns[r["table"]].append(r)
    for table, cs in columns.items():
        if not cs:
            out[table] = TableMeta(role="fact" if "fact" in table.lower() else "dimension")
            continue
        out[table] = TableMeta(
            role=cs[0]["role"], entity=cs[0]["table_entity"],
            primary_keys=(keys[table],) if table in keys else (),
            foreign_keys=links.get(table, {}),
            date_cols=tuple(c["column"] for c in cs if c["is_date"]),
            numeric_cols=tuple(c["column"] for c in cs if c["is_numeric"]),
            promo_cols=tuple(c["column"] for c in cs if c["is_promo"]))
    out.update({t: m for t, m in (override or {}).items() if t in tables})
    return out


def mismatched_links(tables: Tables, meta: Mapping[str, TableMeta]) -> list[tuple[str, str, str, str]]:
    """Foreign keys whose type differs from the key they point at (compared as text)."""
    out = []
    for t, m in meta.items():
        for fk, (dim, pk) in m.foreign_keys.items():
            if dim in tables and is_numeric(tables[t], fk) != is_numeric(tables[dim], pk):
                out.append((t, fk, dim, pk))
    return out
