"""Hard negatives by threshold joins over an inverted index with norm bounds.

Rows are range-sorted by label and length into blocks.  A join asks, for each anchor, for the rows of a block whose inner product
with it lies in one of the anchor's score windows.  Coordinates are taken in the order of their weight in the block.  Of each
row the last ones are left out of the index: those whose norm, times the longest anchor's, stays below every threshold.
Partial scores grow by some coordinates at a time, and a row is given up as soon as its partial score and the product of
the two remaining norms cannot reach the window any more.  What is left gets its exact score from the coordinates left out.

Positives are found with the k-th best score of one block as the threshold.  For negatives the threshold begins close below each
window's upper end and is lowered, a join a round, for the anchors whose windows are not full yet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import column, discard, stored
from tablewarden.llm.vectors import block_of, by_dimension, spread, usable

#: Rows of a block, anchors of a block, bytes of vectors in either, coordinates added at a time, pairs looked at together.
ROWS, ANCHORS, BLOCK_BYTES, STEP, PAIRS = 4096, 4096, 16_000_000, 16, 200_000
#: How far from its upper end a window is searched in each round; the last round reaches its lower end.
REACH = (1 / 16, 1 / 4, 1.0)
#: Relative slack of bounds computed in floating point.
SLACK = 1e-9
FOUND = "anchor_id long, vec_id long, score long"


@dataclass
class Index:
    """Rows of a block, those with the most indexed coordinates first."""
    matrix: np.ndarray          # coordinates in the order of ``dims``
    dims: np.ndarray
    rows: np.ndarray            # where each row of the matrix stood before
    indexed: np.ndarray         # number of indexed coordinates of each row, whole steps
    rest: np.ndarray            # norm of each row's coordinates from step s on, one column a step


def build(vectors: np.ndarray, longest: float, threshold: float) -> Index:
    """An index for anchors of at most the length ``longest`` and scores of at least ``threshold``."""
    weight = (vectors ** 2).sum(axis=0)
    dims = np.argsort(-weight, kind="stable")
    matrix = vectors[:, dims]
    steps = range(0, matrix.shape[1] + STEP, STEP)
    tail = np.cumsum((matrix ** 2)[:, ::-1], axis=1)[:, ::-1]
    rest = np.sqrt(np.stack([tail[:, s] if s < matrix.shape[1] else np.zeros(len(matrix)) for s in steps], axis=1))
    open_steps = (rest * longest * (1 + SLACK) >= threshold).sum(axis=1) if threshold > 0 else np.full(len(matrix), rest.shape[1])
    indexed = np.minimum(open_steps * STEP, matrix.shape[1])
    order = np.argsort(-indexed, kind="stable")
    return Index(matrix[order], dims, order, indexed[order], rest[order])


def exact(rows: np.ndarray, anchors: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Inner products of pairs of whole numbers: ``scores`` where doubles hold them exactly, else with unbounded numbers."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * rows.shape[1]
    if most < 2 ** 53:
        return scores.astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(rows.tolist(), anchors.tolist())]
    if any(not -2 ** 63 <= s < 2 ** 63 for s in whole):
        raise OverflowError("an inner product does not fit into 64 bits")
    return np.array(whole, np.int64)


def matches(index: Index, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and score of the allowed pairs whose score is from ``low`` to ``high`` of the anchor."""
    anchors = anchors[:, index.dims]
    tail = np.cumsum((anchors ** 2)[:, ::-1], axis=1)[:, ::-1]
    rest = np.sqrt(np.concatenate([tail[:, ::STEP], np.zeros((len(anchors), 1))], axis=1))
    most = np.where(high == 2 ** 63 - 1, np.inf, high)      # an open window also shows scores that are too large
    n = int((index.indexed > 0).sum())                      # rows without indexed coordinates cannot reach any threshold
    at, who = np.nonzero(allowed[index.rows[:n]])
    score = np.zeros(len(at))
    done = np.zeros(len(at), np.int64)
    for step, begin in enumerate(range(0, index.matrix.shape[1], STEP)):
        part = slice(begin, begin + STEP)
        go = index.indexed[at] > begin                      # the posting list of these coordinates
        if go.all():
            score += np.einsum("ij,ij->i", index.matrix[at, part], anchors[who, part])
            done[:] = step + 1
        elif go.any():
            score[go] += np.einsum("ij,ij->i", index.matrix[at[go], part], anchors[who[go], part])
            done[go] = step + 1
        more = index.rest[at, done] * rest[who, done]
        margin = more + SLACK * (index.rest[at, 0] * rest[who, 0] + 1)
        stay = (score + margin >= low[who]) & (score - margin <= most[who])
        at, who, score, done = at[stay], who[stay], score[stay], done[stay]
    for step, begin in enumerate(range(0, index.matrix.shape[1], STEP)):
        late = done <= step                                 # the coordinates left out
        if late.any():
            part = slice(begin, begin + STEP)
            score[late] += np.einsum("ij,ij->i", index.matrix[at[late], part], anchors[who[late], part])
    whole = exact(index.matrix[at], anchors[who], score)
    fine = (whole >= low[who]) & (whole <= high[who])
    return index.rows[at[fine]], who[fine], whole[fine]


def first_in_window(scores: np.ndarray, ids: np.ndarray, floor: int, ceiling: int, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores from ``floor`` to ``ceiling``, ties to the smaller id."""
    inside = np.flatnonzero((scores >= floor) & (scores <= ceiling))
    return inside[np.lexsort((ids[inside], -scores[inside]))[:k]]


def search(asked: pa.Table, block: pa.Table, k: int, same: bool) -> pa.Table:
    """For each anchor and each of its windows the first ``k`` rows of the block with the same label, or with others."""
    out_a, out_v, out_s = [], [], []
    if asked.num_rows and block.num_rows:
        ids, labels = column(block, "vec_id").to_numpy(), column(block, "label").to_numpy()
        anchor_ids, anchor_labels = column(asked, "vec_id").to_numpy(), column(asked, "label").to_numpy()
        floors, ceilings = column(asked, "floors").to_pylist(), column(asked, "ceilings").to_pylist()
        low, high = np.array([min(f) for f in floors], np.int64), np.array([max(c) for c in ceilings], np.int64)
        of_dimension = by_dimension(column(block, "vec"))
        for d, (mine, vectors) in by_dimension(column(asked, "vec")).items():
            if d not in of_dimension:
                continue
            at, matrix = of_dimension[d]
            index = build(matrix, float(np.sqrt((vectors ** 2).sum(axis=1)).max()), float(low[mine].min()))
            each = max(1, PAIRS // len(at))
            for i in range(0, len(mine), each):
                some = mine[i:i + each]
                alike = labels[at][:, None] == anchor_labels[some]
                allowed = (alike if same else ~alike) & (ids[at][:, None] != anchor_ids[some])
                rows, who, scores = matches(index, vectors[i:i + each], low[some], high[some], allowed)
                order = np.argsort(who, kind="stable")
                rows, who, scores = rows[order], who[order], scores[order]
                edges = np.searchsorted(who, np.arange(len(some) + 1))
                for j, anchor in enumerate(some.tolist()):
                    own, found = ids[at][rows[edges[j]:edges[j + 1]]], scores[edges[j]:edges[j + 1]]
                    if not len(own):
                        continue
                    taken = [first_in_window(found, own, f, c, k) for f, c in set(zip(floors[anchor], ceilings[anchor]))]
                    taken = np.unique(np.concatenate(taken))
                    out_a.append(np.full(len(taken), anchor_ids[anchor]))
                    out_v.append(own[taken])
                    out_s.append(found[taken])
    join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))      # noqa: E731
    return pa.table({"anchor_id": join(out_a), "vec_id": join(out_v), "score": join(out_s)})


def best_first(found: DataFrame, k: int, *per: str) -> DataFrame:
    """The ``k`` highest scores per key with their rank, ties to the smaller vec_id."""
    place = F.row_number().over(Window.partitionBy(*per).orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def share(score: Column, percent: int, up: bool) -> Column:
    """``percent`` hundredths of a whole score, rounded up or down to a whole number."""
    times, hundred = F.lit(percent) * score, F.lit(100)
    below = F.call_function("div", times - F.pmod(times, hundred), hundred)
    return below + (F.pmod(times, hundred) > 0).cast("long") if up else below


def whole_vectors(rows: DataFrame, vector: str, scale: float) -> DataFrame:
    """vec_id, label, vec (whole numbers) and size of the rows that take part, one row for each vec_id."""
    kept = usable(rows.where(F.col("label").isNotNull()), vector, also=("label",))
    whole = F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("double"))
    one = kept.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "vec")).alias("row"))
    one = one.select("vec_id", "row.label", F.expr("row.vec").alias("vec")).withColumn("vec", whole)
    return one.withColumn("size", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: float = 256.0, vector: str = "embedding", rows_each: int = ROWS) -> DataFrame:
    """For each anchor and each of its positives the ``negatives`` highest scored rows of other labels in the positive's window.

    Components become floor(scale * x); scores are their inner products, ties go to the smaller vec_id.  Anchors are the rows where
    ``is_anchor`` (over vec_id) holds.  An anchor's positives are its ``positives`` highest scored other rows of the same label, all
    if fewer.  The window of a positive of score p reaches from ``low`` to ``high`` hundredths of p, both ends included, and so is
    empty for a negative p.  Returns anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Rows with a null id or label, or a null or empty vector, or one with a null, NaN or infinite component, take no part.  A vec_id
    that occurs in several rows takes part once, with its smallest label and then smallest vector, so repeated rows change
    nothing.  Vectors of another dimension than the anchor's are not compared.  A score beyond 64 bits is an error.
    Other columns are not read.  An empty table, or one without anchors, gives an empty result.
    """
    vectors = stored(whole_vectors(rows, vector, scale), "negatives-vectors")
    n, n_anchors, total = vectors.agg(F.count("*"), F.count_if(is_anchor), F.sum(F.size("vec"))).first()
    if not n_anchors:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    bytes_each = -(-8 * total // n)
    n_blocks = max(-(-n // rows_each), -(-8 * total // BLOCK_BYTES))
    n_groups = max(-(-n_anchors // ANCHORS), -(-bytes_each * n_anchors // BLOCK_BYTES))
    order = [F.col("label"), F.col("size").desc(), F.xxhash64("vec_id")]
    held = stored(vectors.repartitionByRange(n_blocks, *order).withColumn("block", F.spark_partition_id()), "negatives-blocks")
    discard(vectors)
    edges = stored(held.groupBy("label", "block").agg(F.max("size").alias("longest")), "negatives-edges")
    anchors = stored(held.where(is_anchor).drop("block").withColumn("ab", block_of(n_groups)), "negatives-anchors")
    blocks = held.select("vec_id", "label", "vec", "block").withColumn("ab", spread(n_groups))
    none, all_of_them = F.lit(-2 ** 63).cast("long"), F.lit(2 ** 63 - 1)

    def meet(asked: DataFrame, k: int, same: bool) -> DataFrame:
        """``asked``: vec_id, label, vec, ab, block, floors, ceilings."""
        asked = asked.select("vec_id", "label", "vec", "ab", "block", "floors", "ceilings")
        pairs = asked.groupBy("ab", "block").cogroup(blocks.groupBy("ab", "block"))
        return pairs.applyInArrow(lambda a, b: search(a, b, k, same), FOUND)

    # positives: the k-th best of the label's first block is a threshold for its other blocks
    first_block = edges.groupBy("label").agg(F.min("block").alias("block"))
    opening = anchors.join(first_block, "label").withColumn("floors", F.array(none)).withColumn("ceilings", F.array(all_of_them))
    seed = stored(meet(opening, positives, True), "negatives-seed")
    floors = best_first(seed, positives, "anchor_id").where(F.col("rank") == positives).select(F.col("anchor_id").alias("vec_id"), F.col("score").alias("floor"))
    known = anchors.join(floors, "vec_id", "left").join(edges.join(first_block, ["label", "block"], "left_anti"), "label")
    reach = F.col("longest") * F.col("size") * (1 + SLACK) + 1
    known = known.where(F.col("floor").isNull() | (reach >= F.col("floor")))
    known = known.withColumn("floors", F.array(F.coalesce("floor", none))).withColumn("ceilings", F.array(all_of_them))
    chosen = best_first(seed.unionByName(meet(known, positives, True)), positives, "anchor_id")
    score = F.col("score")
    chosen = chosen.select("anchor_id", F.col("vec_id").alias("positive_id"), score.alias("positive_score"),
                           share(score, low, True).alias("bottom"), share(score, high, False).alias("top"))
    chosen = stored(chosen, "negatives-positives")

    # negatives: lower the thresholds until the windows are full
    longest = edges.groupBy("block").agg(F.max("longest").alias("longest"))
    open_windows = chosen.where("bottom <= top").select("anchor_id", "positive_id", "bottom", "top", F.col("top").alias("ceiling"))
    found = None
    for i, part in enumerate(REACH):
        width = F.floor((F.col("top") - F.col("bottom")) * F.lit(part)).cast("long")
        floor = F.greatest("bottom", F.col("top") - width) if part < 1 else F.col("bottom")
        wanted = stored(open_windows.withColumn("floor", floor), f"negatives-open-{i}")
        lists = wanted.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("floor", "ceiling")).alias("w"), F.min("floor").alias("least"))
        asked = (anchors.join(lists, "vec_id").withColumn("block", spread(n_blocks)).join(longest, "block").where(reach >= F.col("least"))
                 .withColumn("floors", F.col("w.floor")).withColumn("ceilings", F.col("w.ceiling")))
        new = stored(meet(asked, negatives, False), f"negatives-found-{i}")
        found = new if found is None else found.unionByName(new)
        if part < 1:
            counts = (found.join(wanted, "anchor_id").where("score between floor and top").groupBy("anchor_id", "positive_id")
                      .agg(F.countDistinct("vec_id").alias("n")))
            open_windows = (wanted.join(counts, ["anchor_id", "positive_id"], "left").where(F.coalesce("n", F.lit(0)) < negatives)
                            .where("floor > bottom").select("anchor_id", "positive_id", "bottom", "top", (F.col("floor") - 1).alias("ceiling")))
    inside = found.distinct().join(chosen, "anchor_id").where("score between bottom and top")
    ranked = best_first(inside, negatives, "anchor_id", "positive_id")
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
