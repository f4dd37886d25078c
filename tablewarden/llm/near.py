"""Similarity join of texts on word shingles with Bayesian pruning of candidates.

Texts with the same set of shingles form a class, and only its first text is compared.  Bands of MinHash values put
representatives into buckets.  A bucket is known by its smallest member, its hub; two texts that share any bucket share
its hub, so each text is sent to its few hubs and no pairs are written out.  A hub with many members is
split into blocks, and each two blocks meet in a task of their own.  There, MinHash values are compared some at a time;
a pair goes as soon as the posterior chance that it reaches the threshold is below the tolerance.  The rest are
verified on whole shingle sets.  A pair is counted only at the smallest hub that both have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import column, nonempty, stored
from tablewarden.llm.components import components
from tablewarden.llm.pieces import ranges, slices
from tablewarden.llm.words import WORK_BYTES, find_words, mix, run_hashes, windows

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values; bands and values of a band (the first BANDS * ROWS of them); values compared at a time; tolerance.
HASHES, BANDS, ROWS, STEP, TOLERANCE = 128, 24, 4, 32, 1e-6
#: Representatives of a block.
BLOCK = 768
_U = np.uint64


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    draw = lambda: rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) << _U(1) | _U(1)      # noqa: E731
    return draw(), draw()


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of each text, without repeats and sorted, and their number.

    A text of fewer words than ``size`` has one shingle of all its words; one without words has none.
    """
    words = find_words(texts)
    hashes = words.hashes()
    starts, rows = windows(words, size)
    values = run_hashes(hashes, starts, size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        rows = np.concatenate([rows, short])
        values = np.concatenate([values, run_hashes(hashes, words.first[short], words.counts[short])])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return values[keep], np.bincount(rows[keep], minlength=len(texts)).astype(np.int64)


def min_hashes(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """HASHES values for each nonempty set, a row each."""
    firsts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(firsts), HASHES), np.uint32)
    if len(firsts):
        for p, (a, c) in enumerate(zip(*_factors())):
            out[:, p] = np.minimum.reduceat(((values ^ c) * a) >> _U(32), firsts)
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """For each row: doc_id, two halves of a fingerprint of its shingle set (null if it has none), and its bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            doc_ids = column(batch, "doc_id")
            for at, texts in slices(column(batch, "text"), WORK_BYTES):
                values, counts = shingle_sets(texts, size)
                some = counts > 0
                firsts = (np.cumsum(counts) - counts)[some]
                marks = np.zeros((2, len(texts)), np.int64)
                bands = np.zeros((len(texts), BANDS), np.int64)
                if len(firsts):
                    marks[0, some] = mix(np.add.reduceat(values, firsts)).view(np.int64)
                    marks[1, some] = mix(np.add.reduceat(mix(values), firsts) + counts[some].astype(np.uint64)).view(np.int64)
                    key = np.zeros((len(firsts), BANDS), np.uint64)
                    kept = min_hashes(values, counts)[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
                    for r in range(ROWS):
                        key = mix(key * _U(0x9E3779B97F4A7C15) + kept[:, :, r] + _U(1))
                    bands[some] = (key ^ np.arange(BANDS, dtype=np.uint64) << _U(58)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(at, len(texts)), *(pa.array(m, mask=~some) for m in marks),
                     pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))],
                    ["doc_id", "mark_a", "mark_b", "bands"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, mark_a long, mark_b long, bands array<long>")


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """After so many compared values, the fewest matches with which a pair stays.

    With a flat prior the posterior of the similarity is a beta distribution; its tail above the threshold is a sum of
    binomial terms.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


class Members:
    """The rows of one block, or of two that meet."""

    def __init__(self, ids, copies, hubs, sets, side):
        self.ids, self.copies, self.hubs, self.sets, self.side = ids, copies, hubs, sets, side
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = min_hashes(self.flat, self.sizes)


def links(m: Members, hub: int, cross: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that reach the threshold and whose smallest common hub this is."""
    n = len(m.ids)
    word = np.unique(m.flat, return_inverse=True)[1] if n > 2 else None
    marked = np.zeros(int(word.max()) + 1 if word is not None else 0, bool)
    left, right = [], []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        small, large = np.minimum(m.sizes[i], m.sizes[j]), np.maximum(m.sizes[i], m.sizes[j])
        j = j[(m.ids[j] != m.ids[i]) & (small >= threshold * large - 1e-9)]
        if cross:
            j = j[m.side[j] != m.side[i]]
        done, matches = 0, np.zeros(len(j), np.int64)
        for upto, least in least_matches(threshold, tolerance):
            if not len(j):
                break
            matches += (m.hashes[j, done:upto] == m.hashes[i, done:upto]).sum(axis=1)
            stay = matches >= least
            j, matches, done = j[stay], matches[stay], upto
        if not len(j):
            continue
        own = m.hubs[i]
        j = np.array([k for k in j.tolist() if len(own) == 1 or min(set(own).intersection(m.hubs[k]), default=hub) == hub], np.int64)
        if not len(j):
            continue
        if word is None:
            shared = np.array([len(np.intersect1d(m.sets[i], m.sets[k], assume_unique=True)) for k in j.tolist()])
        else:
            mine = word[m.starts[i]:m.starts[i] + m.sizes[i]]
            marked[mine] = True
            hit = marked[word[ranges(m.starts[j], m.sizes[j])]]
            shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(m.sizes[j]) - m.sizes[j])
            marked[mine] = False
        j = j[shared >= threshold * (m.sizes[i] + m.sizes[j] - shared) - 1e-9]
        left.append(np.full(len(j), i))
        right.append(j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each position the smallest position it is linked to, directly or over others."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """One row for each member that has links at a hub: node, the root of its group there, and its number of links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(part: pa.Table) -> pa.RecordBatch | None:
            ids = column(part, "rep").to_numpy()
            order = np.argsort(ids, kind="stable")
            sets = [np.frombuffer(s, np.uint64) for s in column(part, "shingles").to_pylist()]
            hubs = column(part, "hubs").to_pylist()
            m = Members(ids[order], column(part, "copies").to_numpy()[order], [hubs[k] for k in order], [sets[k] for k in order],
                        column(part, "block").to_numpy()[order])
            cross = column(part, "i")[0].as_py() != column(part, "j")[0].as_py()
            a, b = links(m, column(part, "hub")[0].as_py(), cross, threshold, tolerance)
            if not len(a):
                return None
            counts = np.bincount(a, m.copies[b], len(ids)) + np.bincount(b, m.copies[a], len(ids))
            some = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(m.ids[some]), pa.array(m.ids[roots(len(ids), a, b)][some]),
                                               pa.array(counts[some].astype(np.int64))], ["node", "root", "links"])

        def groups(table: pa.Table, last: bool) -> Iterator[pa.Table]:
            keys = np.stack([column(table, c).to_numpy() for c in ("hub", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cuts.tolist(), table.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                if b < table.num_rows or last:
                    yield table.slice(a, b - a)
            held.clear()
            if not last:
                held.extend(table.slice(bounds[-2]).to_batches())

        for batch in nonempty(batches):
            table = pa.Table.from_batches([*held, batch])
            for part in groups(table, False):
                if (found := work(part)) is not None:
                    yield found
        if held:
            for part in groups(pa.Table.from_batches(held), True):
                if (found := work(part)) is not None:
                    yield found

    return rows.mapInArrow(run, "node long, root long, links long")


def similar(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, tolerance: float = TOLERANCE,
            block: int = BLOCK) -> DataFrame:
    """doc_id, class_id and n_links of every row.

    ``class_id`` is the smallest doc_id that a text is linked to, directly or over others, by Jaccard similarity of word
    shingles of at least ``threshold``; ``n_links`` is the number of other rows it is itself that similar to.
    Words are runs without ASCII white space, unchanged.  A text of fewer than ``size`` words is one shingle; a
    null text, or one without words, is alone.  Rows that share a doc_id are of one class.  Rows with a null doc_id are left
    out of the comparison: class null, no links.  Extra columns are not read; an empty table gives an empty result.
    """
    marks = ["mark_a", "mark_b"]
    texts = stored(sketches(docs, size), "near-sketches")
    compared = texts.where(F.col("mark_a").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(compared.groupBy(*marks).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"),
                                                  F.min_by("bands", "doc_id").alias("bands")), "near-classes")
    keys = classes.select("rep", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub <> top").drop("top")
    buckets = stored(buckets, "near-buckets")             # a plain shuffle on both sides of the join can be split by Spark
    members = keys.join(buckets, "band").groupBy("rep", "hub").count().drop("count")
    members = stored(members, "near-members")
    hubs = members.groupBy("rep").agg(F.sort_array(F.collect_set("hub")).alias("hubs"))          # at most BANDS
    wanted = classes.select("rep", "copies", *marks).join(hubs, "rep")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            for at, part in slices(column(batch, "text"), WORK_BYTES):
                values, counts = shingle_sets(part, size)
                ends = np.cumsum(counts).tolist()
                data = [values[e - c:e].tobytes() for e, c in zip(ends, counts.tolist())]
                rest = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([column(rest, "rep"), column(rest, "copies"), column(rest, "hubs"), pa.array(data, pa.binary())],
                                                 ["rep", "copies", "hubs", "shingles"])

    plain = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string"))
    held = plain.join(wanted, "rep").select("rep", "copies", "hubs", "text")
    held = stored(held.mapInArrow(sets, "rep long, copies long, hubs array<long>, shingles binary"), "near-sets")
    sizes = members.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    spread = (held.withColumn("hub", F.explode("hubs")).join(sizes, "hub")
              .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "hubs",
                      "shingles"))
    met = spread.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    found = stored(compare(met, threshold, tolerance), "near-links")
    whole = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_rep = linked.join(whole, "node", "left").withColumnRenamed("node", "rep")
    several = classes.select(*marks, "rep", "copies").join(per_rep, "rep", "left").where("copies > 1 or links is not null")
    joined = texts.select("doc_id", *marks).join(several, marks, "left")
    return joined.select("doc_id", F.coalesce("component", "rep", "doc_id").alias("class_id"),
                         (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
