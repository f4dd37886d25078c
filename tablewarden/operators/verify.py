"""Independent re-count of every issue with Spark SQL, and the review gate.

The checks count through the DataFrame path (shared profile, bracket quantiles, anti joins).
Here each issue is counted again from SQL text over temporary views with different relational
forms, so the two numbers can disagree and the agreement means something.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden import config
from tablewarden.functions.dates import parsed_sql
from tablewarden.functions.quantiles import exact_quantiles
from tablewarden.functions.scoring import confidence
from tablewarden.operators.profile import Tables
from tablewarden.runtime import FLOAT_TYPES, INTEGER_TYPES, NUMERIC_TYPES, is_integer, local_frame, quoted, text_sql

log = logging.getLogger(__name__)
#: A re-count is (issue id, count) or a fixed confidence.


def _missing(df: DataFrame, c: str) -> str:
    column = quoted(c)
    if isinstance(df.schema[c].dataType, FLOAT_TYPES):
        return f"({column} IS NULL OR isnan({column}))"
    return f"{column} IS NULL"


def null_counts(df: DataFrame, issues: list) -> list[str]:
    return [f"count(CASE WHEN {_missing(df, i['columns'][0])} THEN 1 END)" for i in issues]


def outlier_counts(df: DataFrame, issues: list, multiplier: float, bracket_rows: int = config.BRACKET_ROWS) -> list[str]:
    """Fences from quartiles as literals, and their proof in the same statement.

    ``percentile_cont`` would hold a column in one reducer.  The statement instead counts the rows on both sides of each
    quartile, so a wrong one shows up as a null count.
    """
    found = exact_quantiles(df, {c: (0.25, 0.75) for c in sorted({i["columns"][0] for i in issues})}, bracket_rows=bracket_rows)
    counts = []
    for c in (i["columns"][0] for i in issues):
        q1, q3 = (f"CAST({found[c][p]!r} AS DOUBLE)" for p in (0.25, 0.75))
        x, live = f"CAST({quoted(c)} AS DOUBLE)", f"NOT {_missing(df, c)}"
        n = f"count(CASE WHEN {live} THEN 1 END)"
        rank = lambda op, q: f"count(CASE WHEN {live} AND {x} {op} {q} THEN 1 END)"        # noqa: E731
        # position (n-1)p is interpolated between two ranks; both sides must hold it
        certified = " AND ".join(f"{rank('<', q)} <= ({n} - 1) * {p} + 1 AND {rank('<=', q)} >= floor(({n} - 1) * {p}) + 1"
                                 for p, q in ((0.25, q1), (0.75, q3)))
        outside = f"{live} AND ({x} < {q1} - {multiplier} * ({q3} - {q1}) OR {x} > {q3} + {multiplier} * ({q3} - {q1}))"
        counts.append(f"CASE WHEN {certified} THEN count(CASE WHEN {outside} THEN 1 END) END")
    return counts


def future_counts(df: DataFrame, issues: list) -> list[str]:
    counts = []
    for c in (i["columns"][0] for i in issues):
        column = quoted(c)
        if is_integer(df, c):
            hit = f"{column} > {config.FUTURE_CUTOFF_INT}"
        elif df.schema[c].dataType.simpleString() == "string":
            hit = f"CAST({parsed_sql(column)} AS DATE) > DATE '{config.FUTURE_CUTOFF_DATE}'"
        else:
            hit = f"TRY_CAST({column} AS DATE) > DATE '{config.FUTURE_CUTOFF_DATE}'"
        counts.append(f"count(CASE WHEN {hit} THEN 1 END)")
    return counts


def _one_row(issues: list, counts: list[str], source: str) -> str:
    """(issue_id, sql_count) of issues from aggregates of one source."""
    named = ", ".join(f"{expression} AS n{k}" for k, expression in enumerate(counts))
    pairs = ", ".join(f"named_struct('issue_id', {text_sql(i['issue_id'])}, 'sql_count', n{k})" for k, i in enumerate(issues))
    return f"SELECT inline(array({pairs})) FROM (SELECT {named} FROM {source}) counted"


def counting_sql(view: str, df: DataFrame, issues: list, multiplier: float, bracket_rows: int) -> str:
    """Missing values, outliers and future dates of one table as filtered counts of one scan."""
    by_type = {"missing_values": null_counts, "invalid_future_dates": future_counts,
               "numeric_outliers": lambda d, i: outlier_counts(d, i, multiplier, bracket_rows)}
    named = []
    for kind, build in by_type.items():
        mine = [i for i in issues if i["issue_type"] == kind]
        named += zip(mine, build(df, mine)) if mine else []
    return _one_row([i for i, _ in named], [expression for _, expression in named], view)


def _key_text(df: DataFrame, c: str, other: DataFrame, other_c: str) -> str:
    """A key as text that is equal for equal keys of both columns, and null for a missing one.

    A double meets whole numbers and decimals by its exact value, never the other way round.
    """
    kind, against = df.schema[c].dataType, other.schema[other_c].dataType
    x = f"CASE WHEN NOT {_missing(df, c)} THEN {quoted(c)} END"
    as_text = f"CAST({x} AS STRING)"
    if not (isinstance(kind, NUMERIC_TYPES) and isinstance(against, NUMERIC_TYPES)):
        return f"CAST(unix_micros({x}) AS STRING)" if kind == against == T.TimestampType() else as_text
    scale = max(k.scale if isinstance(k, T.DecimalType) else 0 for k in (kind, against))
    exact = f"DECIMAL(38,{scale})"
    if not isinstance(kind, FLOAT_TYPES):
        return f"coalesce(CAST(TRY_CAST({x} AS {exact}) AS STRING), {as_text})"
    x = f"CAST({x} AS DOUBLE)"
    if isinstance(against, FLOAT_TYPES):
        return f"CAST({x} + CAST(0 AS DOUBLE) AS STRING)"
    near = f"TRY_CAST({x} AS {exact})"
    held = f"CASE WHEN CAST({near} AS DOUBLE) = {x} THEN CAST({near} AS STRING) ELSE concat('~', {x}) END"
    if scale:
        return held
    return f"CASE WHEN {x} % 1 = 0 AND abs({x}) < 9223372036854775808D THEN CAST(TRY_CAST({x} AS BIGINT) AS STRING) ELSE {held} END"


def _copied(df: DataFrame, c: str) -> str:
    """A part of a key as its copies are counted: whole numbers, decimals and plain text as they are, all else by its JSON text."""
    kind, column = df.schema[c].dataType, quoted(c)
    if isinstance(kind, (*INTEGER_TYPES, T.DecimalType)) or kind.simpleString() == "string":
        return column
    return f"CASE WHEN {column} IS NOT NULL THEN to_json(named_struct('k', {column})) END"


def copies_sql(view: str, df: DataFrame, issues: list) -> str:
    """Copies of the keys of one table: the rows beyond one for each different key; a row with a missing key part has no key."""
    counts = [f"count(1) - count(DISTINCT {', '.join(_copied(df, c) for c in i['columns'])})" for i in issues]
    return _one_row(issues, counts, view)


def references_sql(view: str, df: DataFrame, issues: list, tables: Tables, views: Mapping[str, str]) -> str:
    """Broken references of one table, from one scan that groups all their keys together.

    A reference is LEFT JOIN ... IS NULL over its used values, which are counted first, so no key is hot.  What finds nothing is
    summed where it lies; rows of one reference never meet in one task.  Keys that are whole numbers on both sides stay so.
    """
    def key(place: int, one: DataFrame, c: str, other: DataFrame, other_c: str) -> str:
        whole = isinstance(one.schema[c].dataType, INTEGER_TYPES) and isinstance(other.schema[other_c].dataType, INTEGER_TYPES)
        n, s = (f"CAST({quoted(c)} AS BIGINT)", "''") if whole else ("0L", _key_text(one, c, other, other_c))
        return f"named_struct('place', {place}, 'n', {n}, 's', {s})"

    items, known = [], []
    for k, i in enumerate(issues):
        fk, pk, dim = i["columns"][0], i["dim_pk"], tables[i["dim_table"]]
        items.append(key(k, df, fk, dim, pk))
        known.append(f"SELECT inline(array({key(k, dim, pk, df, fk)})) FROM {views[i['dim_table']]}")
    used = (f"SELECT place, n, s, count(1) AS uses FROM (SELECT inline(array({', '.join(items)})) FROM {view}) t "
            "WHERE n IS NOT NULL AND s IS NOT NULL GROUP BY place, n, s")
    held = f"SELECT DISTINCT place, n, s FROM ({' UNION ALL '.join(known)}) h"
    broken = f"SELECT u.place, u.uses FROM ({used}) u LEFT JOIN ({held}) d ON d.place = u.place AND d.n = u.n AND d.s = u.s WHERE d.place IS NULL"
    return _one_row(issues, [f"coalesce(sum(CASE WHEN place = {k} THEN uses END), 0)" for k in range(len(issues))], f"({broken}) b")


def keys_sql(view: str, df: DataFrame, issues: list, tables: Tables, views: Mapping[str, str]) -> str:
    """Copies of keys and broken references of one table; a scan for each of the two, as what they shuffle has nothing in common."""
    copies = [i for i in issues if i["issue_type"] == "duplicate_rows"]
    broken = [i for i in issues if i["issue_type"] != "duplicate_rows"]
    parts = ([copies_sql(view, df, copies)] if copies else []) + ([references_sql(view, df, broken, tables, views)] if broken else [])
    return " UNION ALL ".join(parts)


def _fixed(issue, tables: Tables) -> float | None:
    """Confidence of issues that no query can re-count; None for the others."""
    kind = issue["issue_type"]
    if kind == "statistical_drift":
        return config.DRIFT_CONFIDENCE
    if kind == "empty_table":
        return 1.0
    if issue["table"] not in tables:
        return config.FALLBACK_CONFIDENCE
    if kind in ("missing_values", "numeric_outliers", "invalid_future_dates"):
        return None if issue["columns"] else config.FALLBACK_CONFIDENCE
    if kind == "duplicate_rows":
        return None if issue["columns"] else config.FALLBACK_CONFIDENCE
    if kind == "referential_integrity_break":
        known = issue["columns"] and issue["dim_pk"] and issue["dim_table"] in tables
        return None if known else config.FALLBACK_CONFIDENCE
    return config.FALLBACK_CONFIDENCE


KEYED = ("duplicate_rows", "referential_integrity_break")


def _statements(tables: Tables, views: Mapping[str, str], open_issues: list, sensitivity: str, bracket_rows: int,
                alone: bool = False) -> list[tuple[list, callable]]:
    """A statement that counts and one that groups keys for each table; ``alone``: one for each (table, type), and each key."""
    groups: dict[tuple, list] = {}
    for i in open_issues:
        keyed = i["issue_type"] in KEYED
        groups.setdefault((i["table"], keyed, (i["issue_type"], keyed and i["issue_id"]) if alone else None), []).append(i)
    multiplier = config.IQR_MULTIPLIER[sensitivity]
    out = []
    for (t, keyed, _), issues in groups.items():
        view, df = views[t], tables[t]
        out.append((issues, (lambda v=view, d=df, i=issues: keys_sql(v, d, i, tables, views)) if keyed else
                    (lambda v=view, d=df, i=issues: counting_sql(v, d, i, multiplier, bracket_rows))))
    return out


def verify_issues(tables: Tables, issues: DataFrame, sensitivity: str = "normal",
                  bracket_rows: int = config.BRACKET_ROWS) -> DataFrame:
    """Issues with ``sql_count``, ``pd_count`` (the check's count) and ``confidence``.

    Each table is scanned once for counts, once for copies of keys and once for references, all as one job.  If that fails each issue type of a
    table runs alone, and only the failing ones fall back to confidence 0.50 with the check's own count.
    """
    spark = issues.sparkSession
    found = issues.collect()                                  # a row per issue
    # the place of an issue names it here: ids come from outside and may repeat
    rows = [{**r.asDict(), "issue_id": str(n)} for n, r in enumerate(found)]
    fixed = [(i["issue_id"], i["evidence_rows"] if i["issue_type"] != "empty_table" else 0, value)
             for i in rows if (value := _fixed(i, tables)) is not None]
    open_issues = [i for i in rows if _fixed(i, tables) is None]
    token = uuid.uuid4().hex[:8]
    views = {t: f"tw_{token}_{n}" for n, t in enumerate(tables)}
    for t, df in tables.items():
        df.createOrReplaceTempView(views[t])
    try:
        statements = _statements(tables, views, open_issues, sensitivity, bracket_rows)
        counted: list[tuple] = []
        try:
            if statements:
                text = " UNION ALL ".join(f"SELECT * FROM ({build()})" for _, build in statements)
                counted = [(r["issue_id"], r["sql_count"], None) for r in spark.sql(text).collect()]
        except Exception as error:        # noqa: BLE001 - find the failing group
            log.warning("joint re-count failed, running groups alone: %s", error)
            counted = []
            for group, build in _statements(tables, views, open_issues, sensitivity, bracket_rows, alone=True):
                try:
                    counted += [(r["issue_id"], r["sql_count"], None) for r in spark.sql(build()).collect()]
                except Exception as single:   # noqa: BLE001
                    log.warning("re-count of %s failed: %s", [i["issue_id"] for i in group], single)
                    counted += [(i["issue_id"], i["evidence_rows"], config.FALLBACK_CONFIDENCE) for i in group]
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    evidence = {i["issue_id"]: i["evidence_rows"] for i in rows}
    counted = [(k, evidence[k], config.FALLBACK_CONFIDENCE) if n is None else (k, n, f) for k, n, f in counted]
    counts = {k: (n, value) for k, n, value in [*fixed, *counted]}
    schema = T.StructType([*issues.schema.fields, T.StructField("sql_count", T.LongType()), T.StructField("fixed", T.DoubleType())])
    joined = local_frame(spark, [(*r, *counts.get(str(n), (None, None))) for n, r in enumerate(found)], schema)
    return (joined.withColumn("pd_count", F.col("evidence_rows"))
            .withColumn("confidence", F.coalesce("fixed", confidence(F.col("sql_count"), F.col("pd_count"))))
            .drop("fixed").select(*issues.columns, "sql_count", "pd_count", "confidence"))


# --------------------------------------------------------------------------------------
# Review gate
# --------------------------------------------------------------------------------------

def low_confidence(verified: DataFrame, below: float = config.REVIEW_BELOW) -> DataFrame:
    """The review queue, with the line an analyst sees."""
    return verified.where(F.col("confidence") < below).withColumn(
        "prompt", F.format_string("[%s] %s in %s - confidence=%.2f, evidence_rows=%d", F.col("issue_id"),
                                  F.col("issue_type"), F.col("table"), F.col("confidence"),
                                  F.col("evidence_rows")))


def needs_review(verified: DataFrame) -> Column:
    return F.coalesce(F.bool_or(F.col("confidence") < config.REVIEW_BELOW), F.lit(False))


def apply_decision(verified: DataFrame, decision: str | None) -> DataFrame:
    """``approve all`` keeps everything; ``reject ID1,ID2`` removes those ids in any case."""
    text = (decision or "").strip().lower()
    if not text or text == "approve all":
        return verified
    ids = {p.strip() for p in text.removeprefix("reject").split(",") if p.strip()}
    rejected = local_frame(verified.sparkSession, [(i,) for i in sorted(ids)], "rejected string")
    return verified.join(rejected, F.lower("issue_id") == F.col("rejected"), "left_anti")
