"""Folders and single files of tables; temp views; schema listing; previews."""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Mapping
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden import config
from tablewarden.runtime import local_frame, quoted

log = logging.getLogger(__name__)
_NUMBER = r"^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"
_WHOLE = r"^\\s*[+-]?[0-9]+\\s*$"


# --------------------------------------------------------------------------------------
# CSV with the cell conventions of the triage
# --------------------------------------------------------------------------------------

def _text_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", multiline: bool = True,
              schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=multiline,
                          encoding=encoding, enforceSchema=False).csv(path)


def broken_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files of a CSV table whose quoted values hold line breaks, and the others.

    A value that goes on behind a line break leaves a line with an odd number of quotes.  One scan counts them line by line,
    in which any file is split; it returns a row per file.
    """
    lines = spark.read.option("encoding", "ISO-8859-1").text(path)                 # a quote is the same byte in all encodings read here
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    found = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_or(odd).alias("odd")).collect()
    files = {flag: [unquote(r["file"]) for r in found if r["odd"] == flag] for flag in (True, False)}
    return files[True], files[False]


def _cells_of(spark: SparkSession, path: str, encoding: str, multiline: bool | None) -> DataFrame:
    """A CSV table as text.  Where ``multiline`` is None, only files with line breaks inside values are read by one task each."""
    if multiline is not None:
        return _text_csv(spark, path, encoding, multiline)
    whole, split = broken_files(spark, path)
    if not whole or not split:
        return _text_csv(spark, path, encoding, bool(whole))
    schema = _text_csv(spark, path, encoding).schema
    return _text_csv(spark, split, encoding, False, schema).unionByName(_text_csv(spark, whole, encoding, True, schema))


def _missing(column: str) -> str:
    marks = ", ".join("'" + m + "'" for m in config.CSV_MISSING)
    return f"CASE WHEN {column} NOT IN ({marks}) THEN {column} END"


def typed_csv(text: DataFrame) -> tuple[DataFrame, int]:
    """Columns cast to bigint, double or boolean where every present cell allows it.

    One aggregate over the file decides all columns, and also counts cells with undecodable
    characters.  Pass a schema to ``read_csv`` to skip this scan.
    """
    checks = ["count(1) AS n_rows"]
    for i, c in enumerate(text.columns):
        x = _missing(quoted(c))
        checks += [f"count({x}) AS n{i}",
                   f"count(CASE WHEN {x} RLIKE '{_WHOLE}' THEN try_cast({x} AS BIGINT) END) AS w{i}",
                   f"count_if({x} RLIKE '{_NUMBER}' OR lower({x}) IN ('inf', '-inf', 'infinity', '-infinity')) AS d{i}",
                   f"count_if(lower({x}) IN ('true', 'false')) AS b{i}",
                   f"count_if(contains({quoted(c)}, '�')) AS u{i}"]
    row = text.selectExpr(*checks).first()
    casts, undecodable = [], 0
    for i, c in enumerate(text.columns):
        n, x = row[f"n{i}"], _missing(quoted(c))
        undecodable += row[f"u{i}"]
        kind = ("DOUBLE" if n == 0 else "BIGINT" if row[f"w{i}"] == n else "DOUBLE" if row[f"d{i}"] == n
                else "BOOLEAN" if row[f"b{i}"] == n else None)
        casts.append(f"CAST({x} AS {kind}) AS {quoted(c)}" if kind else f"{x} AS {quoted(c)}")
    return text.selectExpr(*casts), undecodable


def given_types(text: DataFrame, schema: T.StructType) -> tuple[DataFrame, int]:
    """The cells of ``typed_csv`` cast to a given schema, by column name; a cell that does not fit becomes null."""
    casts, texts = [], []
    for field in schema.fields:
        if field.name not in text.columns:
            casts.append(f"CAST(NULL AS {field.dataType.simpleString()}) AS {quoted(field.name)}")
            continue
        if isinstance(field.dataType, T.StringType):
            texts.append(quoted(field.name))
        casts.append(f"try_cast({_missing(quoted(field.name))} AS {field.dataType.simpleString()}) AS {quoted(field.name)}")
    undecodable = text.selectExpr(f"count_if({' OR '.join(f'contains({c}, {chr(39)}�{chr(39)})' for c in texts)}) AS u").first()["u"] if texts else 0
    return text.selectExpr(*casts), undecodable


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool | None = None) -> DataFrame:
    """A CSV table.  Cells are cleaned alike with and without a schema, which spares the scan that finds types.

    Quoted values may hold line breaks.  A scan of the lines finds the files where they do, which a task reads as a whole each;
    others are split however large they are.  ``multiline`` True or False spares that scan and holds for all files.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    typed = typed_csv if schema is None else lambda text: given_types(text, schema)
    df, undecodable = typed(_cells_of(spark, path, "UTF-8", multiline))
    if undecodable:
        df, _ = typed(_cells_of(spark, path, "ISO-8859-1", multiline))
    return df


# --------------------------------------------------------------------------------------
# Folders
# --------------------------------------------------------------------------------------

def list_tables(spark: SparkSession, folder: str) -> list[tuple[str, str, str]]:
    """``(table, path, format)`` for each CSV or parquet entry of a folder, by name.

    Files are listed by Spark and folded to one row per table.  A table is a file or a folder
    of part files; entries without bytes and denormalized extracts are skipped.
    """
    root = folder.rstrip("/")
    bare = re.sub(r"^[a-z0-9]+:(//)?", "", root)
    path = F.col("path")
    tail = F.element_at(F.split(path, re.escape(bare + "/"), 2), -1)
    files = (spark.read.format("binaryFile").options(recursiveFileLookup=True).load(root)
             .select(tail.alias("tail"), "length")
             .where(F.lower("tail").rlike(r"\.(csv|parquet)$") & ~F.col("tail").rlike(r"(^|/)[_.]"))
             .groupBy(F.substring_index("tail", "/", 1).alias("entry"),
                      F.lower(F.regexp_extract("tail", r"\.(\w+)$", 1)).alias("format"))
             .agg(F.sum("length").alias("size")).where("size > 0").orderBy("entry"))
    out = []
    for r in files.collect():                                                # a row per table
        name = re.sub(r"\.(csv|parquet)$", "", r["entry"], flags=re.I).removesuffix("_injected")
        if "denormalized" not in name.lower():
            out.append((name, f"{root}/{r['entry']}", r["format"]))
    return out


def load_folder(spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType | str] | None = None,
                multiline: bool | None = None) -> dict[str, DataFrame]:
    """Every table of a folder.  ``schemas`` spares the typing scan of large CSV tables."""
    return {name: (spark.read.parquet(path) if kind == "parquet"
                   else read_csv(spark, path, (schemas or {}).get(name), multiline))
            for name, path, kind in list_tables(spark, folder)}


def load_source(spark: SparkSession, source: str, folders: Mapping[str, str]) -> dict[str, DataFrame]:
    """The ``clean`` or ``injected`` tables from their configured folders."""
    if source not in ("clean", "injected"):
        raise ValueError(f"source must be 'clean' or 'injected', got {source!r}")
    try:
        tables = load_folder(spark, folders[source])
    except Exception as error:            # noqa: BLE001 - a missing folder surfaces as an analysis error
        if "PATH_NOT_FOUND" not in str(error) and not isinstance(error, KeyError):
            raise
        tables = {}
    if not tables and source == "injected":
        raise FileNotFoundError("no injected tables found; run the injection first")
    return tables


def table_name(path: str) -> str:
    """File name as a table name: lower case, anything but word characters becomes ``_``."""
    return re.sub(r"\W", "_", PurePosixPath(path).stem.lower())


def load_adhoc(spark: SparkSession, paths: list[str]) -> tuple[dict[str, DataFrame], list[str]]:
    """Named files as tables, with a warning for each file left out."""
    tables: dict[str, DataFrame] = {}
    warnings: list[str] = []
    for path in paths:
        name = PurePosixPath(path).name
        try:
            if path.lower().endswith(".parquet"):
                df = spark.read.parquet(path)
            else:
                df = _text_csv(spark, path)
                df = read_csv(spark, path) if df.columns else df
            if not df.columns:
                warnings.append(f"`{name}` has no columns — skipped.")
            elif df.isEmpty():
                warnings.append(f"`{name}` is empty — skipped.")
            else:
                tables[table_name(path)] = df
        except Exception as error:        # noqa: BLE001 - one unreadable file must not stop the rest
            warnings.append(f"`{name}` failed to load: {error}")
    return tables, warnings


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Replace the folder by these tables, one folder of part files each.

    All tables are written beside it first; only then does the new folder take the place of the old one.  A folder that
    the tables are read from is refused: its files would go before they were read again.
    """
    root = folder.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    own = fs.makeQualified(path(root)).toUri().getPath() + "/"
    for name, df in tables.items():
        if any(path(f).toUri().getPath().startswith(own) for f in df.inputFiles()):
            raise ValueError(f"table {name} is read from {root}, which cannot be replaced at the same time")
    fresh = f"{root}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        if fmt == "csv":
            df.write.options(header=True, quote='"', escape='"',
                             timestampFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
                             timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(f"{fresh}/{name}.csv")
        else:
            df.write.parquet(f"{fresh}/{name}.parquet")
    aside = f"{root}.{uuid.uuid4().hex}.old"
    if fs.exists(path(root)) and not fs.rename(path(root), path(aside)):           # the old tables exist until the new ones do
        raise OSError(f"the tables are in {fresh}; {root} could not be moved aside")
    if not fs.rename(path(fresh), path(root)):
        raise OSError(f"the tables are in {fresh} and the former ones in {aside}; they could not be moved to {root}")
    fs.delete(path(aside), True)


# --------------------------------------------------------------------------------------
# Catalog
# --------------------------------------------------------------------------------------

def register(tables: Mapping[str, DataFrame], overwrite: bool = True) -> list[str]:
    """Temp views by table name; without ``overwrite`` existing views stay.  Returns new names."""
    made = []
    for name, df in tables.items():
        if overwrite or not df.sparkSession.catalog.tableExists(name):
            df.createOrReplaceTempView(name)
            made.append(name)
    return made


def describe(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows ``(table, position, column, type)``, from schemas only."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, f.name, f.dataType.simpleString())
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return local_frame(spark, rows, "table string, position int, column string, type string")


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)
