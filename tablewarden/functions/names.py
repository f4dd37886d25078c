"""Column meaning read from names, as expressions over a catalogue of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden import config

_SUFFIX = "|".join(config.KEY_SUFFIXES)


def norm(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def key_stem(column: Column) -> Column:
    """Name without its key suffix; null where it has none."""
    name = F.trim(column)
    return F.when(is_key(column), F.regexp_extract(name, rf"(?i)^(.*)(?:{_SUFFIX})$", 1))


def key_suffix(column: Column) -> Column:
    name = F.trim(column)
    return F.when(is_key(column), F.lower(F.regexp_extract(name, rf"(?i)({_SUFFIX})$", 1)))


def is_key(column: Column) -> Column:
    return F.trim(column).rlike(rf"(?i)(?:{_SUFFIX})$")


def singular(word: Column) -> Column:
    w = norm(word)
    n = F.length(w)
    return (F.when(w == "sales", w)
            .when(w.endswith("ies") & (n > 3), F.concat(w.substr(F.lit(1), n - 3), F.lit("y")))
            .when(w.endswith("sses") & (n > 4), w.substr(F.lit(1), n - 2))
            .when(w.endswith("ses") & (n > 3), w.substr(F.lit(1), n - 1))
            .when(w.endswith("s") & ~w.endswith("ss") & (n > 1), w.substr(F.lit(1), n - 1))
            .otherwise(w))


def table_entity(table: Column) -> Column:
    """``dim_customers`` and ``fact_customers_normalized`` both speak of a ``customer``."""
    bare = F.regexp_replace(F.trim(F.lower(table)), r"^(?:dim_|fact_)", "")
    words = F.filter(F.split(bare, "_"),
                     lambda w: (w != "") & ~w.isin(*config.NAME_NOISE))
    return singular(F.coalesce(F.get(words, F.lit(0)), bare))


def key_entity(column: Column) -> Column:
    stem = norm(key_stem(column))
    return F.when(stem != "", singular(stem))


def table_role(table: Column) -> Column:
    return F.when(F.lower(table).contains("fact"), "fact").otherwise("dimension")


def is_date_name(column: Column) -> Column:
    return column.rlike("(?i)date|day")


def is_promo_name(column: Column) -> Column:
    return column.rlike("(?i)" + "|".join(config.PROMO_WORDS))
