"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, scaled to length 1 and rotated at random; the code keeps one sign bit of each coordinate, packed,
with two scalars: the length, and the inner product of vector and code.  The product of code and query over that
scalar estimates the inner product of vector and query, with an error that is bounded with high probability.  Only
vectors whose lower bound of the distance is within the k-th upper bound are looked at in full; a vec_id counts once
for that, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import column, nonempty, stored
from tablewarden.llm.vectors import best, block_of, by_dimension, smallest, spread, usable

#: Rows and queries of a block; width of the error bound in standard errors.
ROWS, QUERIES_EACH, WIDTH = 8192, 2048, 4.0
INDEX = "vec_id long, vec array<double>, code binary, length double, aligned double"


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each dimension: sums over batches first, then one row for each coordinate."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            for d, (rows, matrix) in by_dimension(column(batch, "vec")).items():
                yield pa.RecordBatch.from_pydict({"d": [d], "n": [len(rows)], "s": [matrix.sum(axis=0).tolist()]},
                                                 schema=pa.schema([("d", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]))

    parts = vectors.mapInArrow(sums, "d int, n long, s array<double>")
    means = (parts.select("d", "n", F.posexplode("s").alias("i", "x")).groupBy("d", "i")
             .agg((F.sum("x") / F.sum("n")).alias("x")).groupBy("d").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m")))
    return {r["d"]: np.nan_to_num(np.array([m["x"] for m in r["m"]]), posinf=0, neginf=0) for r in means.collect()}


def index(vectors: DataFrame, middle: dict[int, np.ndarray]) -> DataFrame:
    """Every vector with its code."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            n = batch.num_rows
            codes, lengths, aligned = [b""] * n, np.zeros(n), np.ones(n)
            for d, (rows, matrix) in by_dimension(column(batch, "vec")).items():
                centred = matrix - middle[d]
                size = np.linalg.norm(centred, axis=1)
                unit = centred / np.where(size > 0, size, 1)[:, None] @ rotation(d).T
                lengths[rows] = size
                aligned[rows] = np.maximum(np.abs(unit).sum(axis=1) / np.sqrt(d), 1e-9)
                packed = np.packbits(unit > 0, axis=1)
                for r, bits in zip(rows.tolist(), packed):
                    codes[r] = bits.tobytes()
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "vec"), pa.array(codes, pa.binary()),
                                              pa.array(lengths), pa.array(aligned)], ["vec_id", "vec", "code", "length", "aligned"])

    return vectors.mapInArrow(code, INDEX)


def nearest(rows: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", rows_each: int = ROWS) -> DataFrame:
    """For each row where ``is_query`` (over vec_id) holds, the ``k`` nearest other rows found, by Euclidean distance.

    Every row is indexed and every block of rows is searched for every block of queries, so a task holds one block of
    each.  Vectors that cannot take part are left out (see ``usable``); vectors of another dimension than the query's are not
    compared.  Distances are exact, on the original vectors.  Rows that share a vec_id count once, and never for
    themselves.  An empty table gives an empty result.
    """
    vectors = usable(rows, vector, zero=False)
    coded = stored(index(vectors, centres(vectors)), "ann-index")
    n, n_queries = coded.agg(F.count("*"), F.count_if(is_query)).first()
    row_blocks, query_blocks = max(1, -(-n // rows_each)), max(1, -(-n_queries // QUERIES_EACH))
    left = coded.where(is_query).select("vec_id", "vec", "length", block_of(query_blocks).alias("qb"), spread(row_blocks).alias("rb"))
    right = coded.withColumn("rb", block_of(row_blocks)).withColumn("qb", spread(query_blocks))
    middle = centres(vectors)

    def search(queries: pa.Table, block: pa.Table) -> pa.Table:
        found_q, found_v, found_s = [], [], []
        if queries.num_rows and block.num_rows:
            ids, codes = column(block, "vec_id").to_numpy(), column(block, "code")
            lengths, aligned = column(block, "length").to_numpy(), column(block, "aligned").to_numpy()
            query_ids = column(queries, "vec_id").to_numpy()
            rows_of = by_dimension(column(block, "vec"))
            for d, (mine, q) in by_dimension(column(queries, "vec")).items():
                if d not in rows_of:
                    continue
                at, vecs = rows_of[d]
                packed = np.frombuffer(b"".join(codes.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                signs = np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1
                turned = (q - middle[d]) @ rotation(d).T
                size, fit, own = lengths[at], aligned[at], ids[at]
                error = WIDTH * np.sqrt(np.maximum(1 - fit ** 2, 0) / max(1, d - 1)) / fit
                by_id = np.argsort(own, kind="stable")
                kinds, starts = np.unique(own[by_id], return_index=True)
                for first in range(0, len(mine), 256):
                    part = turned[first:first + 256]
                    norm = np.linalg.norm(part, axis=1)
                    inner = (part.astype(np.float32) @ signs.T).astype(np.float64) / np.sqrt(d) / fit
                    middle_of = size ** 2 + norm[:, None] ** 2 - 2 * size * inner
                    slack = 2 * size * norm[:, None] * error + 1e-6 * (size ** 2 + norm[:, None] ** 2)
                    for i in range(len(part)):
                        row = mine[first + i]
                        other = own != query_ids[row]
                        # one bound for each id, the smallest of its rows: k rows of one id are one neighbour
                        upper = np.minimum.reduceat((middle_of[i] + slack[i])[by_id], starts)[kinds != query_ids[row]]
                        if not len(upper):
                            continue
                        edge = np.partition(upper, min(k, len(upper)) - 1)[min(k, len(upper)) - 1]
                        chosen = np.flatnonzero(other & (middle_of[i] - slack[i] <= edge))
                        exact = np.sqrt(((vecs[chosen] - q[first + i]) ** 2).sum(axis=1))
                        top = smallest(exact, own[chosen], k)
                        found_q.append(np.full(len(top), query_ids[row]))
                        found_v.append(own[chosen][top])
                        found_s.append(exact[top])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)      # noqa: E731
        return pa.table({"query_id": pa.array(join(found_q, np.int64)), "vec_id": pa.array(join(found_v, np.int64)),
                         "score": pa.array(join(found_s, np.float64))})

    pairs = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb"))
    return best(pairs.applyInArrow(search, "query_id long, vec_id long, score double"), k, ascending=True)
