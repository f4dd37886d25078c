"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous rounds.

Pieces are range-sorted by length (longest first), and so known by their rank; sequences are known by number.  Equal
pieces and sequences of equal gaps are handled as runs, in two kinds of rows: (length, first rank, how many) and (gap,
first sequence, how many).  A round deals both to bands of sizes, sweeps each band for the successor of every
length among the gaps, settles conflicts by rank, and writes gaps and pieces that are left for the next round
(``plan``).  Placing a piece is then a lookup of its rank among the placed runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import column, nonempty, partitions_for, stored
from tablewarden.llm.pieces import shared_encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Kinds of rows between rounds.  ``first`` is a rank for pieces and a sequence for gaps; a placed run of ``count`` pieces
#: from rank ``first`` has ``each`` of them in every sequence from ``sequence`` on, at ``offset`` and behind it.
PIECE, GAP, PLACED = 0, 1, 2
STATE = "kind int, size long, first long, count long, sequence long, each long, offset long"
ARROW_STATE = pa.schema([pa.field(f.split()[0], pa.int32() if f.endswith("int") else pa.int64()) for f in STATE.split(", ")])
#: Bands of sizes in the rounds after new sequences were opened; the last number stays.
BANDS = (4, 1)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """The ids of every whole text and ``end_id``, cut only where longer than ``capacity``.

    ``tokenizer`` is the path of a file of the tokenizers library, readable on every executor.  A null text counts
    as empty: one piece with the end id alone.  Repeated ids each give their own pieces.  ``keep_ids`` adds the
    ids themselves.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared_encoder(tokenizer)
        for batch in nonempty(batches):
            doc_ids = column(batch, "doc_id")
            for at, texts in slices(column(batch, "text")):
                flat, counts = encode(texts)
                ends = np.cumsum(counts)
                rows, numbers, starts, lengths, sums, kept = [], [], [], [], [], []
                for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist())):
                    ids = np.append(flat[end - count:end], np.uint32(end_id)).astype("<u4")
                    for number, start in enumerate(range(0, count + 1, capacity)):
                        part = ids[start:start + capacity]
                        rows.append(at + i)
                        numbers.append(number)
                        starts.append(start)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.tobytes()))
                        kept.append(part) if keep_ids else None
                out = [doc_ids.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                       pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(kept).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(cut, PIECES + (", ids array<int>" if keep_ids else ""))


def sweep(sizes: np.ndarray, kinds: np.ndarray, firsts: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """One round over the runs of a band of sizes, larger sizes first: rows of ``STATE``.

    Gaps are laid on a stack as their sizes come up, so its top is the successor of the length at hand: the smallest gap
    that holds it.  Pieces take gaps in the order of rank, as many pieces of one length as a gap holds, and longer pieces
    come first where several want the same gap.  A gap that took pieces is through for the round; what is left of it, and
    runs that found nothing, come out again for the next one.
    """
    out, stack = [], []
    for at in np.lexsort((firsts, -kinds, -sizes)).tolist():          # of equal sizes gaps come before pieces
        size, first, left = int(sizes[at]), int(firsts[at]), int(counts[at])
        if kinds[at] == GAP:
            stack.append((size, first, left))
            continue
        while left and stack:
            gap, sequence, many = stack.pop()
            each = gap // size
            full = min(many, left // each)
            part = left - full * each if full < many else 0
            for start, n, k in ((sequence, full, each), (sequence + full, int(part > 0), part)):
                if n and k:
                    out.append((PLACED, size, first, n * k, start, k, capacity - gap))
                    first, left = first + n * k, left - n * k
                    if gap > k * size:
                        out.append((GAP, gap - k * size, start, n, None, None, None))
            used = full + (part > 0)
            if used < many:
                stack.append((gap, sequence + used, many - used))
        if left:
            out.append((PIECE, size, first, left, None, None, None))
    return out + [(GAP, *run, None, None, None) for run in stack]


def opened(state: DataFrame, many: int, start: int, capacity: int) -> DataFrame:
    """``state`` after its ``many`` longest pieces took the first places of new sequences, numbered from ``start``.

    The running count is over pieces by length: at most ``capacity`` rows.
    """
    before = F.sum("count").over(Window.orderBy(F.desc("size"), "first")) - F.col("count")
    runs = state.where(F.col("kind") == PIECE).withColumn("before", before)
    runs = runs.withColumn("taken", F.greatest(F.lit(0), F.least("count", F.lit(many) - F.col("before"))))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("sequence", "long"), ("each", "long"), ("offset", "long"))]
    placed = F.struct(F.lit(PLACED).alias("kind"), "size", "first", F.col("taken").alias("count"),
                      (F.col("before") + start).alias("sequence"), F.lit(1).cast("long").alias("each"), F.lit(0).cast("long").alias("offset"))
    gap = F.struct(F.lit(GAP).alias("kind"), (capacity - F.col("size")).alias("size"), (F.col("before") + start).alias("first"),
                   F.col("taken").alias("count"), *none)
    rest = F.struct(F.lit(PIECE).alias("kind"), "size", (F.col("first") + F.col("taken")).alias("first"),
                    (F.col("count") - F.col("taken")).alias("count"), *none)
    new = runs.select(F.explode(F.array(placed, gap, rest)).alias("row")).select("row.*").where("count > 0 and size > 0")
    return new.unionByName(state.where(F.col("kind") == GAP))


def plan(counts: DataFrame, capacity: int) -> tuple[list[DataFrame], int]:
    """From ``(length, n)`` to the runs that the rounds place, one frame a round, and the number of sequences.

    A round deals the runs of lengths and of gaps to bands of sizes and sweeps each band in a task of its own, so that
    pieces first meet gaps that they nearly fill; from round to round bands are wider, until one holds what is left.
    Gaps below the shortest piece go.  Where no piece fits any gap, the longest pieces open as many sequences as the tokens
    that are left fill, and as pieces above half the capacity need.  Rows of a round are bounded by lengths and
    splits of runs at lengths, whatever the number of documents; the driver sees one row of totals a round.
    """
    before = F.sum("n").over(Window.orderBy(F.desc("length"))) - F.col("n")          # one row a length
    none = [F.lit(None).cast("long").alias(c) for c in ("sequence", "each", "offset")]
    state = stored(counts.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), before.alias("first"),
                                 F.col("n").alias("count"), *none), "pack-lengths")
    placed, sequences, bands = [], 0, BANDS[0]

    def swept(groups: pa.Table) -> pa.Table:
        rows = sweep(*(column(groups, c).to_numpy() for c in ("size", "kind", "first", "count")), capacity)
        return pa.table([pa.array(values, field.type) for values, field in zip(zip(*rows), ARROW_STATE)], schema=ARROW_STATE)

    while True:
        piece, gap = F.col("kind") == PIECE, F.col("kind") == GAP
        totals = state.agg(F.min(F.when(piece, F.col("size"))).alias("shortest"), F.max(F.when(gap, F.col("size"))).alias("widest"),
                           F.sum(F.when(piece, F.col("size") * F.col("count"))).alias("tokens"),
                           F.sum(F.when(piece & (F.col("size") * 2 > capacity), F.col("count"))).alias("halves")).first()
        if totals["shortest"] is None:
            return placed, sequences
        state = state.where(piece | (F.col("size") >= totals["shortest"]))
        if (totals["widest"] or 0) < totals["shortest"]:
            many = max(-(-totals["tokens"] // capacity), totals["halves"] or 0)
            state, sequences, bands = stored(opened(state, many, sequences, capacity), "pack-opened"), sequences + many, BANDS[0]
        else:
            band = F.floor((F.col("size") - 1) * bands / capacity)
            state = stored(state.groupBy(band.alias("band")).applyInArrow(swept, STATE), "pack-round")
            bands = BANDS[min(BANDS.index(bands) + 1, len(BANDS) - 1)]
        placed.append(state.where(F.col("kind") == PLACED))
        state = state.where(F.col("kind") != PLACED)


def placements(rounds: list[DataFrame]) -> np.ndarray:
    """Placed runs by rank: first rank, sequence, pieces a sequence, offset, length.

    Every round adds at most a few rows for each length and each gap at hand, both at most ``capacity``, whatever the number
    of documents: the table is a few MB, which the driver collects and sends to the executors once.
    """
    columns = ["first", "sequence", "each", "offset", "size"]
    parts = [np.array([r.column(c).to_numpy() for c in columns], np.int64) for r in (d.select(columns).toArrow() for d in rounds)]
    runs = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
    return runs[:, np.argsort(runs[0])]


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``: their place when sorted by length, longest first.

    A range sort on length and a hash splits a length that a third of all pieces share over many partitions.
    Places inside a partition and the sizes of the partitions (one row for each) give the rank.
    """
    spark = pieces.sparkSession
    n = partitions_for(spark, pieces.count(), 500_000)
    hashed = pieces.withColumn("order_hash", F.xxhash64("doc_id", "piece"))
    order = [F.col("length").desc(), F.col("order_hash")]
    placed = stored(hashed.repartitionByRange(n, *order).sortWithinPartitions(*order, "doc_id", "piece")
                    .withColumn("place", F.monotonically_increasing_id()), "pack-sorted")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")          # one row a partition
    offsets = F.broadcast(sizes.select("part", before.alias("before")))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("part", part).join(offsets, "part").withColumn("rank", rank)
            .drop("part", "before", "place", "order_hash"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its offset there; sequences are filled from offset 0 without gaps.

    Extra columns of ``docs`` are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pack-pieces")
    rounds, _ = plan(pieces.groupBy("length").agg(F.count("*").alias("n")), capacity)
    table = placements(rounds)
    sent = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequences, each, offsets, lengths = sent.value
        for batch in nonempty(batches):
            rank = column(batch, "rank").to_numpy()
            run = np.searchsorted(first, rank, side="right") - 1
            inside = rank - first[run]
            sequence = sequences[run] + inside // each[run]
            offset = offsets[run] + inside % each[run] * lengths[run]
            rest = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in rest] + [pa.array(sequence), pa.array(offset)],
                                             [*rest, "sequence_id", "offset"])

    return ranked(pieces).mapInArrow(place, PIECES + (", ids array<int>" if keep_ids else "")
                                     + ", sequence_id long, offset long")
