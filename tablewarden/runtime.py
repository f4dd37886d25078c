"""Small helpers around the session: scratch space, checked broadcasts, unions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablewarden import config

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


In = TypeVar("In")
Out = TypeVar("Out")


def side_by_side(fn: Callable[[In], Out], items: Iterable[In], width: int = 4) -> list[Out]:
    """``fn`` over a few independent jobs, submitted together so that the cluster stays busy."""
    items = list(items)
    if len(items) < 2:
        return [fn(i) for i in items]
    with ThreadPoolExecutor(max_workers=width) as pool:
        return list(pool.map(fn, items))


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, and so see the same folders."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    In local mode a temporary folder will do, and goes with the process.  On a cluster executors could not see it, so an
    unnamed folder is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not is_local(context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tablewarden-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so later reads all see the same rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_frame(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """A catalogue-sized frame built from driver values as a local relation.

    Spark evaluates projections and filters over it while planning, without tasks.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    maps = [isinstance(f.dataType, T.MapType) for f in schema.fields]
    records = [dict(zip(schema.names, (list(v.items()) if m and v is not None else v
                                       for v, m in zip(row, maps))))
               for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, to_arrow_schema(schema)), schema)


def local_copy(df: DataFrame) -> DataFrame:
    """Freeze a catalogue-sized result (one row per column or issue, never per data row)."""
    return local_frame(df.sparkSession, df.collect(), df.schema)


def small_or_shuffled(df: DataFrame, limit: int = config.BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting; above ``limit`` the join stays a shuffle.

    The count stops as soon as the limit is passed.  The caller passes a relation it has
    ``settled`` or persisted, so the count is not a second run of the plan behind it.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def present_sql(df: DataFrame, name: str) -> str:
    """The column with NaN read as missing, the way the triage counts it."""
    column = quoted(name)
    if isinstance(df.schema[name].dataType, FLOAT_TYPES):
        return f"nanvl({column}, CAST(NULL AS DOUBLE))"
    return column


def present(df: DataFrame, name: str):
    return F.expr(present_sql(df, name))


def text_sql(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def is_integer(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType
    return isinstance(kind, INTEGER_TYPES) or (
        isinstance(kind, T.DecimalType) and kind.scale == 0)


def is_plain(kind: T.DataType) -> bool:
    """Whether Spark can group and order values of a type as they are; maps and variants it cannot."""
    if isinstance(kind, T.ArrayType):
        return is_plain(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(is_plain(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def comparable(value: Column, kind: T.DataType) -> Column:
    """``value`` in a form that can be grouped and ordered, equal exactly where the values are.

    A map becomes its entries in the order of their keys, a variant its canonical JSON text with its type; both at
    any depth.
    """
    if is_plain(kind):
        return value
    if isinstance(kind, T.VariantType):
        return F.struct(F.schema_of_variant(value).alias("kind"), F.to_json(value).alias("text"))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[comparable(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), fields)
    entries = F.transform(F.map_entries(value), lambda e: F.struct(
        e["key"].alias("key"), comparable(e["value"], kind.valueType).alias("value")))
    return F.sort_array(entries)


def comparable_column(df: DataFrame, name: str) -> Column:
    return comparable(F.col(quoted(name)), df.schema[name].dataType)
