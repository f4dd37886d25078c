"""Exact top-k by inner product, over buckets of vectors of similar length.

Vectors become whole numbers.  They are range-sorted by length into buckets.  The first bucket gives each query a score
that its k-th best cannot fall below.  In another bucket that score, over the lengths of the query and of the
longest vector there, is a threshold on the cosine.  Above 1 the bucket is out.  A high threshold prunes by
coordinates: on the query's largest coordinates, a vector that close to it can only lie in an interval.  A low one prunes
by length alone.  What is left is multiplied out, in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import column, stored
from tablewarden.llm.vectors import best, block_of, by_dimension, smallest, spread, usable

#: Vectors of a bucket, queries of a block, coordinates looked at, and the cosine from which they are.
ROWS, QUERIES_EACH, FOCUS, STEEP = 8192, 2048, 4, 0.3
FOUND = "query_id long, vec_id long, score long"


def products(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles; one that does not fit into 64 bits is an error."""
    most = float(np.abs(matrix).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query)
    if most < 2 ** 53:
        return (matrix @ query).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in matrix]
    if any(not -2 ** 63 <= x < 2 ** 63 for x in exact):
        raise OverflowError("an inner product does not fit into 64 bits")
    return np.array(exact, np.int64)


def candidates(matrix: np.ndarray, lengths: np.ndarray, query: np.ndarray, floor: float) -> np.ndarray:
    """Rows whose product with ``query`` may reach ``floor``; lengths fall from row to row."""
    size = float(np.linalg.norm(query))
    if not np.isfinite(floor) or size == 0 or floor <= 0:
        return np.arange(len(matrix))
    # length pruning: |v| |q| >= floor; a little is added for rounding
    rows = np.arange(np.searchsorted(-lengths, -(floor / size) * (1 - 1e-9), side="right"))
    if not len(rows):
        return rows
    cosine = floor / (size * lengths[0]) * (1 - 1e-9)
    if cosine >= STEEP:
        unit = query / size
        least = floor / (size * lengths) * (1 - 1e-9)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            t, u = np.minimum(least[rows], 1), unit[f]
            reach = np.sqrt(np.maximum((1 - t ** 2) * (1 - u ** 2), 0))
            lowest = np.where(u <= -t, -1.0, t * u - reach) - 1e-9
            highest = np.where(u >= t, 1.0, t * u + reach) + 1e-9
            own = matrix[rows, f] / lengths[rows]
            rows = rows[(own >= lowest) & (own <= highest)]
    return rows


def search(queries: pa.Table, bucket: pa.Table, k: int) -> pa.Table:
    found_q, found_v, found_s = [], [], []
    if queries.num_rows and bucket.num_rows:
        ids, query_ids = column(bucket, "vec_id").to_numpy(), column(queries, "vec_id").to_numpy()
        floors = column(queries, "floor").to_numpy(zero_copy_only=False).astype(float)
        rows_of = by_dimension(column(bucket, "vec"))
        for d, (mine, q) in by_dimension(column(queries, "vec")).items():
            if d not in rows_of:
                continue
            at, vecs = rows_of[d]
            order = np.argsort(-np.linalg.norm(vecs, axis=1), kind="stable")
            vecs, own = vecs[order], ids[at][order]
            lengths = np.maximum(np.linalg.norm(vecs, axis=1), 1e-300)
            for i, row in enumerate(mine.tolist()):
                rows = candidates(vecs, lengths, q[i], floors[row])
                rows = rows[own[rows] != query_ids[row]]
                score = products(vecs[rows], q[i])
                top = smallest(-score, own[rows], k) if len(rows) else rows
                found_q.append(np.full(len(top), query_ids[row]))
                found_v.append(own[rows][top])
                found_s.append(score[top])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)      # noqa: E731
    return pa.table({"query_id": pa.array(join(found_q)), "vec_id": pa.array(join(found_v)), "score": pa.array(join(found_s))})


def top_products(rows: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, vector: str = "embedding",
                 rows_each: int = ROWS) -> DataFrame:
    """For each row where ``is_query`` (over vec_id) holds, the ``k`` highest inner products with other rows.

    Components become floor(scale * x).  Ties go to the smaller vec_id.  Vectors that cannot take part are left out (see
    ``usable``; zero vectors do take part), and vectors of another dimension than the query's are not compared.  Rows
    that share a vec_id count once, and never for themselves.  An empty table gives an empty result.
    """
    whole = F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("double"))
    vectors = usable(rows, vector).select("vec_id", whole.alias("vec"))
    vectors = vectors.withColumn("size", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))
    vectors = stored(vectors, "mips-vectors")
    n, n_queries = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    buckets, query_blocks = max(1, -(-n // rows_each)), max(1, -(-n_queries // QUERIES_EACH))
    order = [F.col("size").desc(), F.xxhash64("vec_id")]
    sorted_rows = stored(vectors.repartitionByRange(buckets, *order).withColumn("bucket", F.spark_partition_id()), "mips-buckets")
    longest = sorted_rows.groupBy("bucket").agg(F.max("size").alias("longest"))        # one row for each bucket
    edges = {r["bucket"]: r["longest"] for r in longest.collect()}
    first = min(edges, default=0)
    queries = vectors.where(is_query).select("vec_id", "vec", "size", block_of(query_blocks).alias("qb"))
    blocks = sorted_rows.drop("size").withColumn("qb", spread(query_blocks))

    def meet(asked: DataFrame, held: DataFrame) -> DataFrame:
        pairs = asked.groupBy("qb", "bucket").cogroup(held.groupBy("qb", "bucket"))
        return pairs.applyInArrow(lambda a, b: search(a, b, k), FOUND)

    opening = queries.select("vec_id", "vec", "qb", F.lit(first).alias("bucket"), F.lit(None).cast("double").alias("floor"))
    seed = stored(meet(opening, blocks.where(F.col("bucket") == first)), "mips-first")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    distinct = seed.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    floors = (distinct.withColumn("place", place).where(F.col("place") == k)
              .select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor")))
    by_size = sorted(((b, s) for b, s in edges.items() if b != first), key=lambda x: -x[1])
    open_buckets = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(float(s)).alias("s")) for b, s in by_size)) if by_size else None
    if open_buckets is None:
        return best(seed, k, ascending=False)
    asked = (queries.join(floors, "vec_id", "left")
             .withColumn("at", F.explode(F.filter(open_buckets, lambda x: F.col("floor").isNull() | (x["s"] * F.col("size") * (1 + 1e-9) >= F.col("floor")))))
             .select("vec_id", "vec", "qb", F.col("at.b").alias("bucket"), "floor"))
    return best(seed.unionByName(meet(asked, blocks.where(F.col("bucket") != first))), k, ascending=False)
