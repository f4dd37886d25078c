"""Foreign keys against the keys they point at, all of a set of tables in one grouping.

Every table is read once.  A fact emits (link, key) for each of its foreign keys, a dimension for each link that points at it, and
both are grouped together with partial sums: a task sends one row for each key, however many rows share it, and rows without
a key send none.  Keys of a link are brought into one form first, so that equal numbers meet whatever their types.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden import config
from tablewarden.runtime import FLOAT_TYPES, INTEGER_TYPES, NUMERIC_TYPES, present, quoted, settled, union_all, unused

#: Rows of one key from which on it is looked up where its rows lie, instead of being shuffled.
HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Link:
    table: str
    fk: str
    dim: str
    pk: str


def key_form(x: Column, kind: T.DataType, other: T.DataType) -> Column:
    """A key as struct (n, s), equal for equal keys of the two types; null for a missing one.

    Whole numbers of 64 bits are in ``n``, all else is text in ``s``.  Numbers are compared exactly: a double equals a bigint or a
    decimal only if it stands for that very number (for a decimal with a scale: if it is the double nearest to it), never
    because the other side would lose digits as a double.  A fraction equals no whole number.  Keys of other different types are
    compared as text.
    """
    def number(n: Column) -> Column:
        return F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))

    def text(s: Column, mark: str = ":") -> Column:
        return F.struct(F.lit(0).cast("long").alias("n"), F.concat(F.lit(mark), s.cast("string")).alias("s"))

    if isinstance(kind, NUMERIC_TYPES) and isinstance(other, NUMERIC_TYPES):
        scale = max(k.scale if isinstance(k, T.DecimalType) else 0 for k in (kind, other))
        exact = f"decimal(38,{scale})"
        if isinstance(kind, INTEGER_TYPES) and isinstance(other, INTEGER_TYPES):
            form = number(x)
        elif isinstance(kind, FLOAT_TYPES):
            d = x.cast("double")
            if isinstance(other, FLOAT_TYPES):
                form = text(d + F.lit(0.0))                        # no sign on a zero
            elif scale:
                near = d.try_cast(exact)
                form = F.when(near.cast("double") == d, text(near)).otherwise(text(d, "~"))
            else:
                whole = F.rint(d) == d
                form = (F.when(whole & (F.abs(d) < 2.0 ** 63), number(d.try_cast("long")))
                        .when(whole & (F.abs(d) < 1e38), text(d.try_cast(exact))).otherwise(text(d, "~")))
        elif scale:
            form = text(F.coalesce(x.try_cast(exact).cast("string"), x.cast("string")))
        else:
            small = x.try_cast("long")
            form = F.when(small.isNotNull(), number(small)).otherwise(text(x))
    elif kind == other and isinstance(kind, T.TimestampType):
        form = number(F.unix_micros(x))
    elif kind == other and isinstance(kind, T.BinaryType):
        form = text(F.hex(x))
    else:
        form = text(x)
    return F.when(x.isNotNull(), form)


def _forms(fact: DataFrame, fk: str, dim: DataFrame, pk: str) -> tuple[Column, Column]:
    kinds = fact.schema[fk].dataType, dim.schema[pk].dataType
    return key_form(present(fact, fk), *kinds), key_form(present(dim, pk), *kinds[::-1])


def key_uses(tables: Mapping[str, DataFrame], links: Sequence[Link]) -> DataFrame:
    """(link, n, s, rows, known) for each key of each link, given by its place: rows of the fact, and whether the dimension has it."""
    emitted: dict[str, list[Column]] = {}
    # keys that are all whole numbers are grouped without the text, which would be empty
    whole = all(isinstance(tables[t].schema[c].dataType, INTEGER_TYPES) for x in links for t, c in ((x.table, x.fk), (x.dim, x.pk)))
    keys = ["link", "n"] if whole else ["link", "n", "s"]
    for i, link in enumerate(links):
        used, held = _forms(tables[link.table], link.fk, tables[link.dim], link.pk)
        for t, form, rows, known in ((link.table, used, 1, False), (link.dim, held, 0, True)):
            item = F.struct(F.lit(i).alias("link"), *[form[k].alias(k) for k in keys[1:]],
                            F.lit(rows).cast("long").alias("rows"), F.lit(known).alias("known"))
            emitted.setdefault(t, []).append(F.when(form.isNotNull(), item))
    parts = []
    for t, items in emitted.items():
        one = items[0] if len(items) == 1 else F.explode(F.array(*items))
        parts.append(tables[t].select(one.alias("key")).where("key IS NOT NULL").select("key.*"))
    found = union_all(parts).groupBy(*keys).agg(F.sum("rows").alias("rows"), F.bool_or("known").alias("known"))
    return found.select("link", "n", F.lit("").alias("s") if whole else "s", "rows", "known")


def orphan_counts(df: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """Rows ``(key, n)``: foreign-key values without a dimension row.

    Both sides are grouped by key in a single shuffle: the fact sends one row per key and task, so a key that a third of all
    rows share never gathers anywhere, and there is no join.
    """
    used, held = _forms(df, fk, dim, pk)
    both = (df.select(used.alias("form"), present(df, fk).alias("value"), F.lit(1).cast("long").alias("rows"), F.lit(False).alias("known"))
            .unionByName(dim.select(held.alias("form"), F.lit(None).cast(df.schema[fk].dataType).alias("value"),
                                    F.lit(0).cast("long").alias("rows"), F.lit(True).alias("known"))))
    return (both.where("form IS NOT NULL").groupBy("form.n", "form.s")
            .agg(F.min("value").alias("key"), F.sum("rows").alias("count"), F.bool_or("known").alias("known"))
            .where("NOT known").select("key", F.col("count").alias("n")))


def marked(df: DataFrame, fk: str, dim: DataFrame, pk: str, broadcast_rows: int = config.BROADCAST_ROWS,
           hot_rows: int = HOT_ROWS) -> tuple[DataFrame, str]:
    """``df`` with one more column, true where the key is unknown, and that column's name.

    The keys are counted first.  Few unknown keys are broadcast.  Otherwise keys of very many rows, known or not, are broadcast
    with their answer; there are at most BROADCAST_ROWS of them, as each has at least that share of all rows.  Their rows, and
    those without a key, stay where they are, and only the others are shuffled, none of whose keys is large.
    """
    uses = key_uses({"fact": df, "dim": dim}, [Link("fact", fk, "dim", pk)])
    kept = settled(uses.where((~F.col("known")) | (F.col("rows") >= hot_rows)).where("rows > 0"))
    size = F.octet_length("s") + 16
    facts = kept.agg(F.count_if(~F.col("known")).alias("n"), F.sum(F.when(~F.col("known"), size)).alias("bytes"),
                     F.sum(F.when(F.col("rows") >= hot_rows, F.col("rows"))).alias("hot")).first()
    n, s, flag, sure = (unused(df, name) for name in ("key_n", "key_s", "orphan", "sure"))
    form = _forms(df, fk, dim, pk)[0]
    keyed = df.withColumns({n: form["n"], s: form["s"]})
    renamed = kept.select(F.col("n").alias(n), F.col("s").alias(s), (~F.col("known")).alias(sure), "rows")
    columns = [F.col(quoted(c)) for c in df.columns]
    answer = F.coalesce(F.col(quoted(sure)), F.lit(False)).alias(flag)
    if facts["n"] <= broadcast_rows and (facts["bytes"] or 0) <= config.BROADCAST_BYTES:
        few = renamed.where(F.col(sure)).select(n, s, sure)
        return keyed.join(F.broadcast(few), [n, s], "left").select(*columns, answer), flag
    bound = max(hot_rows, -(-(facts["hot"] or 0) // config.BROADCAST_ROWS))
    hot = renamed.where(F.col("rows") >= bound).select(n, s, sure)
    looked = keyed.join(F.broadcast(hot), [n, s], "left")
    here = looked.where(F.col(n).isNull() | F.col(sure).isNotNull()).select(*columns, answer)
    cold = renamed.where(F.col(sure) & (F.col("rows") < bound)).select(n, s, sure)
    rest = looked.where(F.col(n).isNotNull() & F.col(sure).isNull()).drop(sure).hint("merge").join(cold, [n, s], "left")
    return here.unionByName(rest.select(*columns, answer)), flag
