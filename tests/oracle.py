"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def differences(spark_df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    duck_names = [d[0] for d in result.description]
    expected = rows_of(duck_names, result.fetchall())
    if sorted(spark_df.columns) != sorted(duck_names):
        return [f"columns {sorted(spark_df.columns)} != {sorted(duck_names)}"]
    actual = rows_of(spark_df.columns, spark_df.collect())
    if len(actual) != len(expected):
        return [f"rows {len(actual)} != {len(expected)}", f"spark {actual[:6]}", f"duck {expected[:6]}"]
    bad = [(a, e) for a, e in zip(actual, expected)
           if any(x != y or type(x) is bool != type(y) is bool for x, y in zip(a, e))]
    return [f"{len(bad)} of {len(actual)} rows differ"] + [f"spark {a} | duck {e}" for a, e in bad[:3]] if bad else []


def main(sf_dir: str, only: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf_dir), e.oracle_sql()
    names = [n for n in e.queries() if not only or any(n.startswith(o) for o in only)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = e.queries()[name](spark, sf_dir)
            found = differences(df, con, sqls[name]) if name in sqls else []
            rows = "" if name in sqls else f" rows-only {df.count()}"
        except Exception as error:        # noqa: BLE001
            found, rows = [f"{type(error).__name__}: {str(error)[:700]}"], ""
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s{rows}", *found, sep="\n     " if found else " ", flush=True)
    print(f"{len(names) - failed}/{len(names)} match")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
