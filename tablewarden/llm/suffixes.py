"""Removal of byte strings that occurred earlier, by a sparse suffix array over chosen anchors.

A window is ``length`` consecutive bytes of one text.  Its anchor is the gram in it whose mixed value is smallest, the first of
these; that depends on the window alone, so equal windows have equal anchors in equal places.  Windows next to each other mostly
share their anchor and form a run, about thirty windows for a length of 100.  A run crosses the network as one row:

1. Runs whose gram occurs once are done.  A run whose whole stretch of bytes is also one of an earlier document repeats
   window by window (told by 128 bits of hashes); a hash group is reduced to its smallest document before it is shuffled.
2. Of what is left, first stretches whose gram others share, the bytes are fetched.  Stretches of a gram are the suffixes that
   begin at it, and the prefixes that end before it, read backwards.  Both are ordered by deep-shallow sorting.  Two windows
   are equal when they reach the anchor after as many bytes, the prefixes share these, and the suffixes share the rest:
   a class of windows is a pair of intervals in the two orders, cut where common prefixes are too short.
3. A gram of very many stretches is dealt to blocks.  Each block is sorted by itself and puts out its different windows,
   hashed to 128 bits, which are reduced again across the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewarden.llm.common import column, discard, nonempty, stored
from tablewarden.llm.deepsort import Strings, deep_shallow
from tablewarden.llm.fim import as_bytes
from tablewarden.llm.pieces import slices
from tablewarden.llm.words import mix

LENGTH = 100
#: Stretches of a block, bytes of text anchored at once, depth of the multikey quicksort in front of and behind the anchor.
BLOCK, WORK_BYTES, BEHIND, AHEAD = 4096, 1_000_000, 16, 8
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
RUN = "gram long, context long, doc_id long, tag int, place long"
ID, TAG, SPANS = "__suffix_id", "__suffix_tag", "__suffix_spans"


def gram_of(length: int) -> int:
    """Bytes of a gram: long enough to be rare, short enough to leave many windows to an anchor."""
    if not 20 <= length <= 2 ** 16:
        raise ValueError("a repeated string has from 20 to 65536 bytes")
    return 2 * length // 5


def eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data),), (1,)).copy()


def hash_pieces(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A 64-bit hash of each piece of at least 8 bytes, eight bytes at a time; the last eight may overlap."""
    value = mix(lengths.astype(np.uint64) + seed)
    for at in range(0, int(lengths.max(initial=0)) - 7, 8):
        inside = lengths >= at + 8
        if inside.all():
            value = (value ^ mix(words[starts + at] + seed)) * _B
        else:
            value[inside] = (value[inside] ^ mix(words[starts[inside] + at] + seed)) * _B
    return mix(value ^ mix(words[starts + lengths - 8] ^ seed))


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows, anchor, hash of the gram and of the stretch for each run in a slice."""
    gram = gram_of(length)
    span = length - gram + 1                                    # grams of a window
    m = len(data) - length + 1
    if m <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    words = eight(data)
    value = words[:len(data) - gram + 1] * _A
    value ^= words[gram - 8:len(data) - 7] * _B
    value ^= value >> _U(29)
    value *= _C
    value = (value >> _U(32)).astype(np.uint32)
    least, have = value, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[:len(least) - (span - have)], least[span - have:])
    begins = offsets[:-1]
    change = np.empty(m, bool)
    change[0] = True
    change[1:] = (least[1:] != least[:-1]) | (value[:m - 1] == least[:-1])
    change[begins[begins < m]] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], m) - 1
    row = np.searchsorted(offsets, first, side="right") - 1
    last = np.minimum(last, offsets[row + 1] - length)
    fine = first <= last
    first, last, row = first[fine], last[fine], row[fine]
    anchor = first + np.lib.stride_tricks.sliding_window_view(value, span)[first].argmin(axis=1)
    grams = hash_pieces(words, anchor, np.full(len(anchor), gram), _A)
    stretch = hash_pieces(words, first, last - first + length, _C) + mix((anchor - first).astype(np.uint64))
    return row, first, last - first + 1, anchor, grams, stretch


def packed(start: np.ndarray, before: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """First window, bytes from there to the anchor, number of windows: one number that orders by the first."""
    return start << 32 | before << 16 | windows


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """A row for each run.  Of runs of one text that are alike only the first has its hashes; others are known to repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            doc_ids, tags = column(batch, ID).to_numpy(), column(batch, TAG).to_numpy()
            for at, texts in slices(column(batch, "text"), WORK_BYTES):
                _, data, offsets = as_bytes(texts)
                for c in range(0, max(len(data) - length + 1, 1), WORK_BYTES * 2):          # a long text: some windows at a time
                    stop = min(c + 2 * WORK_BYTES + length - 1, len(data))
                    row, first, windows, anchor, grams, stretch = runs(data[c:stop], np.clip(offsets, c, stop) - c, length)
                    order = np.lexsort((stretch, grams, row))
                    again = np.zeros(len(row), bool)
                    a, b = order[:-1], order[1:]
                    again[b] = (row[a] == row[b]) & (grams[a] == grams[b]) & (stretch[a] == stretch[b])
                    place = packed(first + c - offsets[row], anchor - first, windows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams.view(np.int64), mask=again), pa.array(stretch.view(np.int64), mask=again), pa.array(doc_ids[at + row]),
                         pa.array(tags[at + row]), pa.array(place)], ["gram", "context", "doc_id", "tag", "place"])

    return docs.mapInArrow(run, RUN)


def fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (id, tag, list of gram, block, blocks and place) with the bytes of each stretch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in nonempty(batches):
            doc_ids, tags, lists = column(batch, ID).to_numpy(), column(batch, TAG).to_numpy(), column(batch, "places")
            counts = lists.value_lengths().to_numpy()
            for i, text in enumerate(column(batch, "text")):
                if (doc_ids[i], tags[i]) == before:                # the same row again: its stretches are there already
                    continue
                before = doc_ids[i], tags[i]
                data = text.as_buffer()
                items = lists.slice(i, 1).flatten()
                place = items.field("place").to_numpy()
                start, _, windows = unpacked(place)
                held = [data[s:e] for s, e in zip(start.tolist(), (start + windows + length - 1).tolist())]
                n = int(counts[i])
                yield pa.RecordBatch.from_arrays(
                    [items.field("gram"), items.field("block"), items.field("blocks"), pa.array(np.full(n, doc_ids[i])),
                     pa.array(np.full(n, tags[i])), pa.array(place), pa.array([bytes(h) for h in held], pa.binary())],
                    ["gram", "block", "blocks", "doc_id", "tag", "place", "stretch"])

    texts = docs.select(ID, TAG, "text").hint("merge").join(wanted, [ID, TAG])
    return texts.mapInArrow(run, "gram long, block int, blocks int, doc_id long, tag int, place long, stretch binary")


def compare(group: np.ndarray, doc_ids: np.ndarray, tags: np.ndarray, place: np.ndarray, data: np.ndarray, offsets: np.ndarray,
            length: int) -> tuple[np.ndarray, np.ndarray]:
    """For stretches in contiguous groups: which of each one's windows repeat, and which exist; a column for each number of
    bytes before the anchor."""
    start, before, windows = unpacked(place)
    n, span = len(place), length - gram_of(length) + 1
    anchor = offsets[:-1] + before
    order, shared = deep_shallow(Strings(data, anchor, offsets[1:] - anchor), group, gram_of(length) + AHEAD)
    mirrored = Strings(data[::-1], len(data) - anchor, before)
    order_back, shared_back = deep_shallow(mirrored, group, BEHIND)
    by_id = np.lexsort((start, tags, doc_ids))
    exists = np.zeros((n, span), bool)
    repeats = np.zeros((n, span), bool)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(span):
        some = by_id[(before[by_id] >= d) & (before[by_id] - windows[by_id] < d)]
        if not len(some):
            continue
        exists[some, d] = True
        ahead[order] = np.cumsum(shared < length - d)               # intervals of suffixes alike in so many bytes
        behind[order_back] = np.cumsum(shared_back < d)
        key = ahead[some] * (n + 1) + behind[some]
        rank = np.argsort(key, kind="stable")
        some, key = some[rank], key[rank]
        new = np.append(True, key[1:] != key[:-1])
        smallest = doc_ids[some][np.flatnonzero(new)][np.cumsum(new) - 1]
        same_text = np.append(False, (doc_ids[some[1:]] == doc_ids[some[:-1]]) & (tags[some[1:]] == tags[some[:-1]])) & ~new
        repeats[some, d] = (doc_ids[some] > smallest) | same_text
    return repeats, exists


def sorted_out(stretches: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows (doc_id, tag, place), and, for grams in several blocks, other windows with two hashes."""
    def work(part: pa.Table) -> pa.RecordBatch:
        value = {c: column(part, c).to_numpy() for c in ("gram", "block", "blocks", "doc_id", "tag", "place")}
        order = np.lexsort([value[c] for c in ("place", "tag", "doc_id", "block", "gram")])
        value = {c: v[order] for c, v in value.items()}
        fresh = np.append(True, np.any([value[c][1:] != value[c][:-1] for c in ("gram", "block", "doc_id", "tag", "place")], axis=0))
        value, order = {c: v[fresh] for c, v in value.items()}, order[fresh]             # a row fetched twice counts once
        held = column(part, "stretch").to_pylist()
        pieces = [held[i] for i in order.tolist()]
        size = np.array([len(p) for p in pieces], np.int64)
        offsets = np.append(0, np.cumsum(size))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        group = np.cumsum(np.append(True, (value["gram"][1:] != value["gram"][:-1]) | (value["block"][1:] != value["block"][:-1])))
        repeats, exists = compare(group, value["doc_id"], value["tag"], value["place"], data, offsets, length)
        start, before, windows = unpacked(value["place"])
        # columns from the most bytes before the anchor to the fewest are windows in the order of the text
        forward = np.pad(repeats[:, ::-1], ((0, 0), (1, 1)))
        edges = np.diff(forward.astype(np.int8), axis=1)
        who, begin = np.nonzero(edges == 1)
        end = np.nonzero(edges == -1)[1]
        most = repeats.shape[1] - 1
        first = start[who] + before[who] - (most - begin)
        spread = exists & ~repeats & (value["blocks"] > 1)[:, None]
        other, d = np.nonzero(spread)
        anchor = offsets[:-1] + before
        eights = eight(data)
        full = np.full(len(other), length)
        hashes = [hash_pieces(eights, anchor[other] - d, full, seed).view(np.int64) for seed in (_A, _C)]
        none = len(who)
        rows = np.concatenate([who, other])
        place = np.concatenate([packed(first, np.zeros_like(first), end - begin), packed(start[other] + before[other] - d, np.zeros_like(other), np.ones_like(other))])
        blank = np.arange(len(rows)) < none
        pad = np.zeros(none, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([pad, hashes[0]]), mask=blank), pa.array(np.concatenate([pad, hashes[1]]), mask=blank),
             pa.array(value["doc_id"][rows]), pa.array(value["tag"][rows]), pa.array(place)], ["hash_a", "hash_b", "doc_id", "tag", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in nonempty(batches):
            gram, block = column(batch, "gram").to_numpy(), column(batch, "block").to_numpy()
            cuts = np.flatnonzero((gram[1:] != gram[:-1]) | (block[1:] != block[:-1])) + 1
            if held and (column(held[-1], "gram")[-1].as_py(), column(held[-1], "block")[-1].as_py()) != (gram[0], block[0]):
                cuts = np.append(0, cuts)
            if len(cuts):
                ready = [*held, batch.slice(0, int(cuts[-1]))]
                held = [batch.slice(int(cuts[-1]))]
                yield work(pa.Table.from_batches(ready))
            else:
                held.append(batch)
        if held:
            yield work(pa.Table.from_batches(held))

    dealt = stretches.repartition("gram", "block").sortWithinPartitions("gram", "block")
    return dealt.mapInArrow(run, "hash_a long, hash_b long, doc_id long, tag int, place long")


def repeated_windows(docs: DataFrame, length: int, block: int) -> DataFrame:
    """(doc_id, tag, place) of runs of windows that repeat; ``docs`` has the columns ID, TAG and text."""
    every = stored(anchored(docs, length), "suffix-runs")
    own = F.xxhash64("context", "doc_id", "tag", "place")
    grams = every.where("gram is not null").groupBy("gram").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").select("gram")
    grams = stored(grams, "suffix-grams")
    # both sides of a join are plain shuffles of stored tables, which Spark can split where a key has very many rows
    found = stored(every.where("gram is not null").hint("merge").join(grams, "gram"), "suffix-found")
    discard(grams)
    inside = stored(every.where("gram is null").select("doc_id", "tag", "place"), "suffix-inside")
    discard(every)
    firsts = stored(found.groupBy("gram", "context").agg(F.min("doc_id").alias("first_doc")), "suffix-firsts")
    several = firsts.groupBy("gram").count().where("count > 1").select("gram", F.lit(True).alias("open"))
    several = stored(several, "suffix-several")
    judged = stored(found.hint("merge").join(firsts, ["gram", "context"]).withColumn("later", F.col("doc_id") > F.col("first_doc")), "suffix-judged")
    discard(found)
    discard(firsts)
    settled = judged.where("later").select("doc_id", "tag", "place")
    # a text may hold equal stretches in two of its parts; they are compared like different ones
    alone = judged.where("not later").groupBy("gram", "context", "doc_id", "tag").count().where("count > 1").select("gram", F.lit(True).alias("open"))
    wanted = several.unionByName(alone).distinct()
    open_runs = judged.where("not later").select("gram", "doc_id", "tag", "place").hint("merge").join(wanted.select("gram"), "gram")
    open_runs = stored(open_runs.distinct(), "suffix-open")
    sizes = open_runs.groupBy("gram").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = open_runs.hint("merge").join(sizes, "gram").withColumn("block", F.pmod(F.xxhash64("doc_id", "tag", "place"), F.col("blocks")).cast("int"))
    lists = dealt.groupBy(F.col("doc_id").alias(ID), F.col("tag").alias(TAG)).agg(F.collect_list(F.struct("gram", "block", "blocks", "place")).alias("places"))
    stretches = stored(fetched(docs, lists, length), "suffix-stretches")
    discard(several)
    discard(open_runs)
    compared = stored(sorted_out(stretches, length), "suffix-compared")
    discard(stretches)
    spans = compared.where("hash_a is null").select("doc_id", "tag", "place")
    both = ["hash_a", "hash_b"]
    across = compared.where("hash_a is not null")
    per_text = stored(across.groupBy(*both, "doc_id", "tag").agg(F.min("place").alias("first_place")), "suffix-across")
    per_hash = per_text.groupBy(*both).agg(F.min("doc_id").alias("first_doc"))
    again = (across.hint("merge").join(per_text, [*both, "doc_id", "tag"]).join(per_hash.hint("merge"), both)
             .where("doc_id > first_doc or place > first_place").select("doc_id", "tag", "place"))
    out = inside.unionByName(settled).unionByName(spans).unionByName(again)
    out = stored(out.groupBy("doc_id", "tag").agg(F.collect_set("place").alias(SPANS)), "suffix-spans")
    for step in (inside, judged, compared, per_text):
        discard(step)
    return out


def merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the longest stretches that ranges cover; ranges of a row that touch are one."""
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    if not len(row):
        return row, begin, end
    reach = np.maximum.accumulate(end)                             # rows lie one behind the other, so this never reaches into the next
    new = np.append(True, (begin[1:] > reach[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    return row[first], begin[first], np.append(reach[first[1:] - 1], reach[-1])


def remove_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept.

    Texts are their UTF-8 bytes.  Every byte is removed that is covered by ``length`` consecutive bytes of its text which also
    start earlier: in a row with a smaller doc_id, or before in the same text.  Strings may overlap and are judged on
    the input.  ``kept`` are the other bytes (binary, as characters may be cut), ``n_spans`` the number of longest removed
    stretches.  ``block`` bounds the stretches that are sorted together; it changes no result.

    A null text is empty and keeps an empty ``kept``.  A null doc_id is neither smaller nor larger than another: such rows lose
    nothing and take nothing.  Rows that share a doc_id do not take bytes from each other.  Texts of any length are judged
    whole, some windows at a time.  Columns of ``docs`` that are named like a new one are replaced, all others stay.
    An empty table gives an empty result.
    """
    gram_of(length)                                                # the length is in its bounds
    made = ["n_bytes", "n_removed", "n_spans", "kept"]
    docs = docs.drop(*made)
    names = docs.columns
    schema = StructType(list(docs.schema.fields)).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias(ID), F.hash(text).alias(TAG), text.alias("text"))
    spans = repeated_windows(plain.where(F.col(ID).isNotNull() & F.col("text").isNotNull()), length, block)
    spans = spans.select(F.col("doc_id").alias(ID), F.col("tag").alias(TAG), SPANS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            places = column(batch, SPANS)
            for at, part in slices(column(batch, "text").cast(pa.string()), WORK_BYTES):
                n = len(part)
                _, data, offsets = as_bytes(part)
                mine = places.slice(at, n)
                count = np.nan_to_num(mine.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                start, _, windows = unpacked(mine.flatten().to_numpy())
                row = np.repeat(np.arange(n), count)
                begin = offsets[row] + start
                row, begin, end = merged(row, begin, begin + windows + length - 1)
                removed = np.bincount(row, end - begin, n).astype(np.int64)
                borders = np.append(np.stack([begin, end], axis=1).ravel(), len(data))
                lengths = np.diff(np.append(0, borders))
                stay = np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)
                left = np.append(0, np.cumsum(np.diff(offsets) - removed))
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[stay])])
                rest = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [*(column(rest, c) for c in names), pa.array(np.diff(offsets)), pa.array(removed),
                     pa.array(np.bincount(row, minlength=n)), kept.cast(pa.binary())], [*names, *made])

    keyed = docs.withColumn(ID, F.col("doc_id").cast("long")).withColumn(TAG, F.hash(text))
    return keyed.hint("merge").join(spans, [ID, TAG], "left").mapInArrow(cut, schema)
