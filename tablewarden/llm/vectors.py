"""What the vector searches share: usable vectors, matrices of a column, blocks of queries against blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector: str = "embedding", zero: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, ``vec`` (doubles) and the columns ``also`` of the rows that can take part.

    Left out: null ids, null or empty vectors, vectors with a null, NaN or infinite component, and zero vectors unless
    ``zero`` is set.
    """
    vec = F.col(vector).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(~bad)
    if not zero:
        rows = rows.where(F.exists(vec, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"), *also)


def by_dimension(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension in a list column: the rows that have it, and their matrix."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        out[d] = rows, (flat.reshape(-1, d) if len(rows) == len(lengths) else flat[starts[rows][:, None] + np.arange(d)])
    return out


def block_of(n: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")


def spread(n: int) -> Column:
    """One row for each block number below ``n``."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def smallest(order: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest values of ``order``, ties to the smaller id; of equal ids only the best."""
    near = np.arange(len(order))
    while True:
        some = 2 * k
        if len(near) > 4 * some:
            near = np.flatnonzero(order <= np.partition(order, some - 1)[some - 1])
        ranked = near[np.lexsort((ids[near], order[near]))]
        first = np.sort(np.unique(ids[ranked], return_index=True)[1])
        if len(first) >= k or len(near) == len(order):
            return ranked[first[:k]]
        k, wanted = 4 * k, k                                     # many rows share an id: look further
        found = smallest(order, ids, k)
        return found[:wanted]


def best(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """The ``k`` best of each query over all blocks.  Rows that share a vec_id count once, by the best of them."""
    score = F.col("score").asc() if ascending else F.col("score").desc()
    one = found.groupBy("query_id", "vec_id").agg((F.min if ascending else F.max)("score").alias("score"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(score, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
