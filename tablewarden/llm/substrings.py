"""Removal of passages that repeat across documents, found by difference-cover anchors.

Every two positions modulo a period are, after a shift below the period, both in its difference cover.  Two equal
windows of ``size`` words therefore share an anchor: a shorter window at a cover position in both documents.  Only
anchors are hashed and shuffled, about a fifth of all positions.  Anchors that occur in several documents are extended:

1. Each carries a hash of its context, which is all windows around it.  Where an earlier document has the same anchor in
   the same context, every window around it repeats.  That settles the inside of all copies, a row per anchor.
2. What is left are the first occurrences and the ends of passages.  Of these, anchors that still occur in several
   documents have their windows hashed one by one, to 128 bits, and compared.  This misses nothing: going from an anchor
   to an earlier one in the same context ends at a document whose anchor is left.

Groups of equal hashes are reduced to their smallest and largest document before they are shuffled, so a passage that a
third of all documents share costs a row for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewarden.llm.common import column, discard, nonempty, stored
from tablewarden.llm.pieces import slices
from tablewarden.llm.words import WORK_BYTES, find_words, mix, run_hashes, windows

SIZE = 50
#: Difference covers by period: the differences of two members take every value modulo the period.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def period_for(size: int) -> int:
    """The largest period that leaves anchors of at least a third of ``size``."""
    return max(p for p in COVERS if p == 1 or size - p + 1 >= size / 3)


def anchors(docs: DataFrame, size: int) -> DataFrame:
    """(hash, context, doc_id, at) of every anchor: ``at`` is its first word.

    The context reaches as far as windows that hold the anchor among their first ``period`` words, or as the document does.
    """
    period = period_for(size)
    length = size - period + 1
    in_cover = np.zeros(period, bool)
    in_cover[list(COVERS[period])] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            doc_ids = column(batch, "doc_id").to_numpy()
            for at, texts in slices(column(batch, "text"), WORK_BYTES):
                words = find_words(texts)
                starts, rows = windows(words, length)
                place = starts - words.first[rows]
                keep = in_cover[place % period]
                starts, rows, place = starts[keep], rows[keep], place[keep]
                hashes = words.hashes()
                found = run_hashes(hashes, starts, length)
                before = np.minimum(place, period - 1)
                after = np.minimum(words.counts[rows] - place, size)
                context = mix(run_hashes(hashes, starts - before, before + after, 1) + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc_ids[at + rows]),
                                                  pa.array(place.astype(np.int32))], ["hash", "context", "doc_id", "at"])

    return docs.mapInArrow(run, "hash long, context long, doc_id long, at int")


def shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur in more than one document, with the smallest."""
    ends = rows.groupBy(*keys).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return ends.where("first_doc < last_doc").drop("last_doc")


def repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, around, starts): for each document the windows of ``size`` words that also start in one with a smaller id.

    ``around`` are anchors of which every window repeats, ``starts`` the first words of other windows.
    """
    period = period_for(size)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    every = stored(anchors(plain, size), "passage-anchors")
    common = stored(shared(every, "hash").select("hash"), "passage-common")
    found = stored(every.join(common, "hash"), "passage-found")
    discard(every)
    discard(common)
    # each side of a join is a plain shuffle of a stored table, which Spark can split where a key has very many rows
    earlier = stored(shared(found, "hash", "context"), "passage-earlier")
    placed = stored(found.join(earlier, ["hash", "context"], "left").withColumn("settled", F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False)))
                    .drop("first_doc", "context"), "passage-placed")
    discard(found)
    discard(earlier)
    settled = placed.where("settled").select("doc_id", "at")
    left = placed.where("not settled").select("hash", "doc_id", "at")
    several = stored(shared(left, "hash").select("hash"), "passage-several")
    open_anchors = left.join(several, "hash").groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    open_anchors = stored(open_anchors, "passage-open")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            doc_ids, places = column(batch, "doc_id").to_numpy(), column(batch, "places")
            for at, texts in slices(column(batch, "text"), WORK_BYTES):
                words = find_words(texts)
                part = places.slice(at, len(texts))
                rows = np.repeat(np.arange(len(texts)), part.value_lengths().to_numpy())
                starts = around(part.flatten().to_numpy(), words.first[rows], words.counts[rows], size, period, len(words.starts))
                row = np.searchsorted(np.cumsum(words.counts), starts, side="right")
                place = (starts - words.first[row]).astype(np.int32)
                first, second = (run_hashes(words.hashes(k), starts, size, k).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(doc_ids[at + row]), pa.array(place)],
                                                 ["hash_a", "hash_b", "doc_id", "at"])

    long = plain.hint("merge").join(open_anchors, "doc_id").mapInArrow(extend, "hash_a long, hash_b long, doc_id long, at int")
    long = stored(long, "passage-windows")
    both = ["hash_a", "hash_b"]
    repeats = stored(shared(long, *both), "passage-both")
    later = long.join(repeats, both).where("doc_id > first_doc").select("doc_id", "at")
    every_one = settled.withColumn("whole", F.lit(True)).unionByName(later.withColumn("whole", F.lit(False)))
    lists = every_one.groupBy("doc_id").agg(F.collect_set(F.when(F.col("whole"), F.col("at"))).alias("around"),
                                            F.collect_set(F.when(~F.col("whole"), F.col("at"))).alias("starts"))
    out = stored(lists, "passage-repeats")
    for step in (placed, several, open_anchors, long, repeats):
        discard(step)
    return out


def around(anchor: np.ndarray, first: np.ndarray, count: np.ndarray, size: int, period: int, n_words: int) -> np.ndarray:
    """First words of the windows that hold an anchor among their first ``period`` words.

    ``anchor`` counts within a document whose first word is ``first`` and which has ``count`` words.
    """
    low = np.maximum(anchor - period + 1, 0)
    high = np.minimum(anchor + 1, count - size + 1)
    fine = low < high
    marks = np.bincount(first[fine] + low[fine], minlength=n_words + 1) - np.bincount(first[fine] + high[fine], minlength=n_words + 1)
    return np.flatnonzero(np.cumsum(marks)[:n_words] > 0)


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with n_words, n_removed and kept.

    A word is a run without ASCII white space, unchanged.  Every word is removed that is covered by a window of ``size``
    words whose words also start in a document with a smaller doc_id; windows are judged on the input.  ``kept`` is
    what remains, joined by one space.  A null text has no words.  A null doc_id is never smaller nor larger: its rows
    lose nothing.  Rows that share a doc_id do not take words from each other.  Columns of ``docs`` of these names are
    replaced, all others stay; an empty table gives an empty result.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    period = period_for(size)
    starts = repeated_windows(docs, size).select(F.col("doc_id").alias("__repeats_in"), F.col("around").alias("__repeats_around"),
                                                 F.col("starts").alias("__repeats_starts"))
    made = StructType(list(docs.schema.fields)).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            counts, removed, kept = [], [], []
            for text, anchor, at in zip(column(batch, "text"), column(batch, "__repeats_around"), column(batch, "__repeats_starts")):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                if at.is_valid:
                    near = anchor.values.to_numpy()
                    none = np.zeros(len(near), np.int64)
                    first = np.concatenate([around(near, none, none + n, size, period, n), at.values.to_numpy()])
                    first = first[first + size <= n]
                    gone = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(first + size, minlength=n + 1))[:n] > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                counts.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    # what repeats grows with the texts, so the join is a shuffle at every size
    wide = docs.hint("merge").join(starts, F.col("doc_id").cast("long") == F.col("__repeats_in"), "left").drop("__repeats_in")
    return wide.mapInArrow(cut, made)
