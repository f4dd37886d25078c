"""Exact order statistics without gathering a column in one task.

``percentile`` keeps one value -> count map per column in a single reducer, which is impossible for a column of 10^12
distinct doubles.  The same answer comes from *bracket selection*, at every size.  A mergeable quantile sketch names
values close to a wanted rank on both sides; a scan counts the rows between them exactly, and the few rows of the bracket
that holds the rank are ordered outright.  That is three scans for any spread of values, as the sketch goes by rank: up to
BRACKET_ROWS * SKETCH_ACCURACY / 3 rows, and two more for each further factor of that kind.  A value that fills a third
of the table is a bracket of its own and ends there.  Few rows are ordered in the first scan.

The shuffles carry sketches and counters, whatever the size of the table.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden import config
from tablewarden.runtime import local_frame, present

#: Relative rank error of the sketch is one over this.
SKETCH_ACCURACY = 50_000


def as_double(df: DataFrame, name: str):
    return present(df, name).cast("double")


# --------------------------------------------------------------------------------------
# Counting against break points
# --------------------------------------------------------------------------------------

def bucket_stats(df: DataFrame, breaks: Mapping[str, Sequence[float]]) -> DataFrame:
    """Rows ``(column, bucket, n, lo, hi)``; bucket b holds breaks[b-1] <= x < breaks[b].

    ``breaks`` must be strictly increasing; ``lo`` and ``hi`` are the extreme values found.
    Each task folds its Arrow batches into at most ``len(breaks) + 1`` entries per column, so
    the shuffle carries counters and never values.
    """
    names = list(breaks)
    edges = [np.asarray(breaks[c], dtype=float) for c in names]

    def fold(batches):
        counts = [np.zeros(len(e) + 1, dtype=np.int64) for e in edges]
        lows = [np.full(len(e) + 1, np.inf) for e in edges]
        highs = [np.full(len(e) + 1, -np.inf) for e in edges]
        for batch in batches:
            for i, e in enumerate(edges):
                values = batch.column(i).to_numpy(zero_copy_only=False)
                values = np.sort(values[~np.isnan(values)])
                starts = np.concatenate([[0], np.searchsorted(values, e, side="left"), [len(values)]])
                n = np.diff(starts)
                used = np.flatnonzero(n)
                counts[i] += n
                lows[i][used] = np.minimum(lows[i][used], values[starts[used]])
                highs[i][used] = np.maximum(highs[i][used], values[starts[used + 1] - 1])
        for name, n, lo, hi in zip(names, counts, lows, highs):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)),
                 pa.array(n[used]), pa.array(lo[used]), pa.array(hi[used])],
                names=["column", "bucket", "n", "lo", "hi"])

    doubles = df.select(*[as_double(df, c).alias(c) for c in names])
    return (doubles.mapInArrow(fold, "column string, bucket int, n long, lo double, hi double")
            .groupBy("column", "bucket")
            .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def bucket_counts(df: DataFrame, breaks: Mapping[str, Sequence[float]]) -> DataFrame:
    return bucket_stats(df, breaks).select("column", "bucket", "n")


def rank_edges(points: Sequence[float]) -> list[float]:
    """Break points that separate ``x < p``, ``x = p`` and ``x > p`` for every p."""
    out: list[float] = []
    for p in sorted(set(points)):
        for edge in (p, math.nextafter(p, math.inf)):
            if not out or edge > out[-1]:
                out.append(edge)
    return out


def rank_counts(df: DataFrame, points: Mapping[str, Sequence[float]]) -> dict[str, dict[float, tuple[int, int]]]:
    """For each column and point: (rows below it, rows up to it).  One scan."""
    breaks = {c: rank_edges(p) for c, p in points.items() if p}
    if not breaks:
        return {}
    per_bucket: dict[str, dict[int, int]] = {c: {} for c in breaks}
    for row in bucket_counts(df, breaks).collect():
        per_bucket[row["column"]][row["bucket"]] = row["n"]
    out = {}
    for c, edges in breaks.items():
        # rows strictly below edges[i] lie in buckets 0..i
        below = np.cumsum([per_bucket[c].get(i, 0) for i in range(len(edges))]).tolist()
        at = lambda value: below[bisect.bisect_left(edges, value)]
        out[c] = {p: (at(p), at(math.nextafter(p, math.inf))) for p in set(points[c])}
    return out


# --------------------------------------------------------------------------------------
# Quantiles
# --------------------------------------------------------------------------------------

def exact_quantiles(df: DataFrame, probs: Mapping[str, Sequence[float]],
                    counts: Mapping[str, int] | None = None,
                    bounds: Mapping[str, tuple[float, float]] | None = None,
                    bracket_rows: int = config.BRACKET_ROWS) -> dict[str, dict[float, float]]:
    """Linearly interpolated quantiles per column, as ``{column: {p: value}}``.

    ``counts`` (non-missing rows) and ``bounds`` (smallest, largest value) come from a profile
    when the caller has one, and spare a scan.  Columns without values are left out.
    """
    probs = {c: sorted(set(p)) for c, p in probs.items() if p}
    if not probs:
        return {}
    if counts is None:
        counts, bounds = _counts_and_bounds(df, list(probs))
    probs = {c: p for c, p in probs.items() if counts[c] > 0}
    if not probs:
        return {}
    wanted = {c: {k for x in p for k in _ranks(x, counts[c])[:2]} for c, p in probs.items()}
    found = select_ranks(df, wanted, counts, bounds, bracket_rows)
    out: dict[str, dict[float, float]] = {}
    for c, p in probs.items():
        out[c] = {}
        for x in p:
            low, high, share = _ranks(x, counts[c])
            a, b = found[c][low], found[c][high]
            out[c][x] = a if a == b or share == 0 else a + (b - a) * share
    return out


def _ranks(p: float, n: int) -> tuple[int, int, float]:
    position = (n - 1) * p
    low = math.floor(position)
    return low, min(low + 1, n - 1), position - low


def _counts_and_bounds(df: DataFrame, columns: list[str]):
    row = df.agg(*[f(as_double(df, c)).alias(f"{t}{i}") for i, c in enumerate(columns)
                   for t, f in (("n", F.count), ("a", F.min), ("z", F.max))]).first()
    return ({c: row[f"n{i}"] for i, c in enumerate(columns)},
            {c: (row[f"a{i}"], row[f"z{i}"]) for i, c in enumerate(columns)})


@dataclass(frozen=True)
class _Bracket:
    """``inside`` rows lie in [low, high], ``skipped`` rows below it."""
    low: float
    high: float
    skipped: int
    inside: int


def _edges(values: DataFrame, brackets: Mapping[str, Mapping[_Bracket, set[int]]]) -> dict[str, list[float]]:
    """Break points around the wanted ranks, by one sketch for each bracket, all in one scan."""
    asked = [(c, b, ranks) for c, of in brackets.items() for b, ranks in of.items()]
    sketches = []
    for i, (c, b, ranks) in enumerate(asked):
        x = F.col(f"`{c}`")
        shares = sorted({min(1.0, max(0.0, (k - b.skipped) / b.inside + side * 1.5 / SKETCH_ACCURACY)) for k in ranks for side in (-1, 0, 1)})
        inside = F.when((x >= F.lit(b.low)) & (x <= F.lit(b.high)), x)
        sketches.append(F.percentile_approx(inside, F.array(*map(F.lit, shares)), F.lit(SKETCH_ACCURACY)).alias(f"e{i}"))
    found = values.agg(*sketches).first()
    out: dict[str, set[float]] = {c: set() for c in brackets}
    for i, (c, b, _) in enumerate(asked):
        for point in (b.low, b.high, *found[f"e{i}"]):
            out[c] |= {point, math.nextafter(point, math.inf)}
    return {c: sorted(e) for c, e in out.items()}


def select_ranks(df: DataFrame, wanted: Mapping[str, set[int]], counts: Mapping[str, int] | None = None,
                 bounds: Mapping[str, tuple[float, float]] | None = None,
                 bracket_rows: int = config.BRACKET_ROWS) -> dict[str, dict[int, float]]:
    """Values at 0-based ranks of each sorted column."""
    values = df.select(*[as_double(df, c).alias(c) for c in wanted])
    if counts is None or bounds is None:
        counts, bounds = _counts_and_bounds(values, list(wanted))
    done: dict[str, dict[int, float]] = {c: {} for c in wanted}
    open_: dict[str, dict[_Bracket, set[int]]] = {
        c: {_Bracket(*bounds[c], 0, counts[c]): set(ranks)} for c, ranks in wanted.items() if ranks}

    while True:
        small: dict[str, dict[_Bracket, set[int]]] = {}
        large: dict[str, dict[_Bracket, set[int]]] = {}
        for c, brackets in open_.items():
            for b, ranks in brackets.items():
                if b.low == b.high:
                    done[c].update(dict.fromkeys(ranks, b.low))
                else:
                    (small if b.inside <= bracket_rows else large).setdefault(c, {})[b] = ranks
        for c, rank, value in _order_inside(values, small) if small else ():
            done[c][rank] = value
        if not large:
            return done
        edges = _edges(values, large)
        slices: dict[str, dict[int, tuple]] = {c: {} for c in edges}
        for r in bucket_stats(values, edges).collect():
            slices[r["column"]][r["bucket"]] = (r["n"], r["lo"], r["hi"])
        open_ = {}
        for c, brackets in large.items():
            for b, ranks in brackets.items():
                first = bisect.bisect_right(edges[c], b.low)
                last = bisect.bisect_right(edges[c], b.high)
                below, waiting = b.skipped, sorted(ranks)
                for bucket in range(first, last + 1):
                    n, lo, hi = slices[c].get(bucket, (0, 0.0, 0.0))
                    mine = {k for k in waiting if below <= k < below + n}
                    if mine:
                        open_.setdefault(c, {})[_Bracket(lo, hi, below, n)] = mine
                    below += n


def _order_inside(values: DataFrame, brackets: Mapping[str, Mapping[_Bracket, set[int]]]) -> list[tuple[str, int, float]]:
    """Order the few values inside each small bracket and read off the wanted ranks."""
    names = list(brackets)
    spans: list[list[tuple[int, float, float]]] = []
    asked: list[tuple[int, str, int, int]] = []
    for c in names:
        spans.append([])
        for b, ranks in brackets[c].items():
            key = len({k for k, *_ in asked})
            spans[-1].append((key, b.low, b.high))
            asked += [(key, c, k, k - b.skipped) for k in ranks]

    def inside(batches):
        for batch in batches:
            for i, ranges in enumerate(spans):
                values = batch.column(i).to_numpy(zero_copy_only=False)
                values = np.sort(values[~np.isnan(values)])
                for key, low, high in ranges:
                    found, n = np.unique(values[np.searchsorted(values, low, side="left"):
                                                np.searchsorted(values, high, side="right")], return_counts=True)
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(found), key, dtype=np.int32)), pa.array(found), pa.array(n.astype(np.int64))],
                            names=["k", "v", "n"])

    tally = (values.select(*[f"`{c}`" for c in names]).mapInArrow(inside, "k int, v double, n long")
             .groupBy("k", "v").agg(F.sum("n").alias("n")))
    # a window per bracket: at most ``bracket_rows`` values each
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = local_frame(values.sparkSession, asked, "k int, c string, rank long, at long")
    rows = (tally.withColumn("upto", upto).join(F.broadcast(ranks), "k")       # a row per wanted rank
            .where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
            .select("c", "rank", "v").collect())
    return [(r["c"], r["rank"], r["v"]) for r in rows]
