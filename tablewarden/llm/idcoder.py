"""An adaptive context-mixing range coder for token ids, and files of token ids in it.

Model of one block, reset at its start: the id last seen after the two ids before (order 2) and the id last seen
after the one before (order 1) are predictions with a confidence each.  The coder first codes which of them is right,
or neither, with the mean of an adaptive distribution under both confidences and one under no context at all.
Else the id follows by order 0: its number of binary digits under adaptive counts, then the digits.
The range coder is carryless, on 64-bit integers, and puts out words of 32 bits.

Blocks are independent, so numpy codes many of them side by side, one id of each per step: each block is a lane.
A file is a Parquet folder of frames.  A frame holds whole documents, in ascending order of doc_id, as blocks with a
checksum each, and the lengths of the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import column, nonempty
from tablewarden.llm.pieces import shared_encoder, slices

#: Ids of a block; of a frame (whole documents up to about that); ids coded side by side.
BLOCK, FRAME, AT_ONCE = 1024, 131_072, 6_000_000
MOST_BITS = 20                       # ids below 2^20 - 1
_T1, _T2 = 512, 1024                # context slots of a lane
_RELEARN = 64                        # steps after which the order-0 table follows its counts
_U, _WORD = np.uint64, np.uint64(1 << 32)


class _Lanes:
    """Model and coder state of blocks coded side by side; the first ``m`` lanes are still busy.

    Chances are of 4096; the order-0 table is of 256.  Intervals are kept in 64 bits.  When one is below 2^32 a word
    of 32 bits goes out; where its ends differ in that word, the part behind the border is given up first.
    """

    def __init__(self, n: int):
        self.n = n
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, _U(2**64 - 1))
        self.before, self.last = np.zeros(n, np.int32), np.zeros(n, np.int32)
        lane = np.arange(n)
        # arrays of two rows are of order 2 and of order 1: both are worked on at once.  A slot of all lanes lies together,
        # so that slots in common use stay in the processor's cache
        self.base = np.stack([lane, lane + n * _T2])
        self.tables = np.zeros(n * (_T1 + _T2), np.int32)
        self.joint = np.full(n * 16, 600 << 16 | 600, np.int32)          # that of order 1 above 16 bits of that of order 2
        self.joint_base = lane * 16
        self.plain = np.full((2, n), 600, np.int32)
        self.counts = np.ones((n, MOST_BITS), np.int32)
        self.seen: list[np.ndarray] = []                                   # places in the counts of ids coded since the last relearn

    def relearn(self, m: int, decoding: bool = False) -> None:
        """The order-0 table of each lane: its counts scaled to 256, none below 1.  A digit's start is above 16 bits of its width."""
        if self.seen:
            self.counts += 16 * np.bincount(np.concatenate(self.seen), minlength=self.counts.size).reshape(self.counts.shape).astype(np.int32)
            self.seen.clear()
        counts = self.counts[:m]
        sums = np.cumsum(counts, axis=1)
        upper = (sums * (256 - MOST_BITS) // sums[:, -1:] + np.arange(1, MOST_BITS + 1)).astype(np.int32)
        width = np.diff(upper, axis=1, prepend=np.int32(0))
        self.spans = ((upper - width << 16) | width).ravel()
        if decoding:
            self.digit_at = np.repeat(np.tile(np.arange(MOST_BITS, dtype=np.uint8), m), width.ravel())
        counts += 1
        counts >>= 1                                                       # older counts fade

    def predict(self, m: int) -> None:
        mixed = self.last[:m] * np.int32(40503)
        self.at = np.empty((2, m), np.int64)
        np.multiply(mixed >> 5 & _T1 - 1, self.n, out=self.at[1])
        mixed ^= self.before[:m] * np.int32(30271)
        np.multiply(mixed >> 4 & _T2 - 1, self.n, out=self.at[0])
        self.at += self.base[:, :m]
        self.held = self.tables.take(self.at)
        self.ids, self.sure = self.held >> 2, self.held & 3
        self.context = self.joint_base[:m] + (self.sure[0] * 4 + self.sure[1])
        pair, self.j = self.joint.take(self.context), np.empty((2, m), np.int32)
        np.bitwise_and(pair, 0xFFFF, out=self.j[0])
        np.right_shift(pair, 16, out=self.j[1])
        share = self.j + self.plain[:, :m]
        share >>= 1
        share += 1
        self.f0, self.f1 = share
        self.f01 = self.f0 + self.f1

    def narrow(self, m: int, hits: np.ndarray) -> np.ndarray:
        """Take the part of the interval for: order 2 was right, order 1 was (``hits``), neither.  Lanes of the last."""
        two, one = hits
        none = ~(two | one)
        each = self.range[:m] >> _U(12)
        start = self.f0 * one + self.f01 * none
        width = self.f0 * two + self.f1 * one + (4096 - self.f01) * none
        self.low[:m] += each * start.astype(np.uint64)
        np.multiply(each, width.astype(np.uint64), out=self.range[:m])
        return np.flatnonzero(none)

    def update(self, m: int, symbol: np.ndarray, right: np.ndarray, hits: np.ndarray) -> None:
        """``symbol`` is the id plus 1; ``right`` are the predictions equal to it, ``hits`` the first of each lane."""
        target = hits * np.int32(4080)
        step = target - self.j
        step >>= 4
        step += self.j
        self.joint[self.context] = step[1] << 16 | step[0]
        target -= self.plain[:, :m]
        target >>= 6
        self.plain[:, :m] += target
        # right: surer, up to 3; wrong: less sure, and replaced when not sure any more
        change = (right & (self.sure < 3)).view(np.int8) - (~right).view(np.int8)
        self.tables[self.at] = np.where(right | (self.sure > 1), self.held + change, symbol << 2 | 1)
        self.before[:m], self.last[:m] = self.last[:m], symbol

    def short(self, m: int) -> np.ndarray:
        """Lanes whose next word is due, their interval cut to one value of it."""
        rows = np.flatnonzero(self.range[:m] < _WORD)
        if len(rows):
            low, rng = self.low.take(rows), self.range.take(rows)
            left = _WORD - (low & _U(0xFFFFFFFF))
            self.range[rows] = np.minimum(rng, left) << _U(32)
            self.low[rows] = low << _U(32)
            self.words = low >> _U(32)
        return rows


def encode_blocks(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """Each block of ids as bytes."""
    if not blocks:
        return []
    lengths = np.array([len(b) for b in blocks])
    order = np.argsort(-lengths, kind="stable")
    sizes, longest = lengths[order], int(lengths.max())
    ids = np.zeros((len(blocks), longest), np.int32)
    for lane, i in enumerate(order):
        ids[lane, :sizes[lane]] = blocks[i]
    if ids.size and int(ids.max()) + 1 >= 1 << MOST_BITS:
        raise ValueError(f"ids must be below {(1 << MOST_BITS) - 1}")
    state = _Lanes(len(blocks))
    number = np.uint16 if len(blocks) < 1 << 16 else np.int64                # short ones are sorted by digits
    lanes: list[np.ndarray] = []
    out: list[np.ndarray] = []
    busy = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")

    def emit(rows: np.ndarray) -> None:
        if len(rows):
            lanes.append(rows.astype(number))
            out.append(state.words.astype(np.uint32))

    for step in range(longest):
        m = int(busy[step])
        if step % _RELEARN == 0:
            state.relearn(m)
            symbols = np.ascontiguousarray(ids[:, step:step + _RELEARN].T) + np.int32(1)
            log2 = (symbols.astype(np.float32).view(np.int32) >> 23) - 127         # exponents: symbols are exact below 2^24
        symbol = symbols[step % _RELEARN, :m]
        state.predict(m)
        right = state.ids == symbol
        hits = right.copy()
        hits[1] &= ~right[0]
        rows = state.narrow(m, hits)
        emit(state.short(m))
        if len(rows):
            value = symbol.take(rows)
            digits = log2[step % _RELEARN].take(rows)
            at = rows * MOST_BITS + digits
            span = state.spans.take(at)
            state.seen.append(at)
            bits = digits.astype(np.uint64)
            each = state.range.take(rows) >> _U(8)
            low = state.low.take(rows) + each * (span >> 16).astype(np.uint64)
            each = each * (span & 0xFFFF).astype(np.uint64) >> bits
            state.low[rows] = low + each * (value.astype(np.uint64) - (_U(1) << bits))
            state.range[rows] = each
            emit(state.short(m))
        state.update(m, symbol, right, hits)
    coded: list[bytes] = [b""] * len(blocks)
    last = (state.low + np.minimum(state.range - _U(1), _WORD - _U(1)) >> _U(32)).astype(np.uint32)      # one more word lies inside
    lane_of = np.concatenate([*lanes, np.arange(len(blocks), dtype=number)])
    words = np.concatenate([*out, last])[np.argsort(lane_of, kind="stable")].astype(">u4")
    ends = np.cumsum(np.bincount(lane_of, minlength=len(blocks)))
    for lane, i in enumerate(order):
        if sizes[lane]:
            coded[i] = words[ends[lane - 1] if lane else 0:ends[lane]].tobytes()
    return coded


def decode_blocks(coded: Sequence[bytes], lengths: Sequence[int]) -> list[np.ndarray]:
    """The ids of each block, from its bytes and their number."""
    if not coded:
        return []
    lengths = np.array(lengths)
    order = np.argsort(-lengths, kind="stable")
    sizes, longest = lengths[order], int(lengths.max())
    words = np.frombuffer(b"".join(coded[i] + bytes(8) for i in order), ">u4").astype(np.uint32)
    spans = np.array([len(coded[i]) // 4 + 2 for i in order])
    at = np.cumsum(spans) - spans
    code = words[at].astype(np.uint64) << _U(32) | words[at + 1]
    ends = np.cumsum(spans) - 1                                        # behind the end: a word of zeros
    at += 2
    state = _Lanes(len(coded))
    ids = np.zeros((len(coded), longest), np.uint32)
    symbols = np.zeros((_RELEARN, len(coded)), np.int32)
    busy = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")

    def absorb(rows: np.ndarray) -> None:
        if len(rows):
            here = at[rows]
            code[rows] = code.take(rows) << _U(32) | words.take(np.minimum(here, ends.take(rows)))
            at[rows] = here + 1

    for step in range(longest):
        m = int(busy[step])
        if step % _RELEARN == 0:
            state.relearn(m, decoding=True)
        state.predict(m)
        each, ahead = state.range[:m] >> _U(12), code[:m] - state.low[:m]
        hits = np.empty((2, m), bool)
        np.less(ahead, each * state.f0.astype(np.uint64), out=hits[0])
        np.less(ahead, each * state.f01.astype(np.uint64), out=hits[1])
        hits[1] &= ~hits[0]
        rows = state.narrow(m, hits)
        absorb(state.short(m))
        symbol = np.where(hits[0], state.ids[0], state.ids[1])
        if len(rows):
            each, low, here = state.range.take(rows) >> _U(8), state.low.take(rows), code.take(rows)
            slot = np.minimum((here - low) // each, _U(255)).astype(np.int64)
            digits = state.digit_at.take(rows * 256 + slot)
            place = rows * MOST_BITS + digits
            span = state.spans.take(place)
            state.seen.append(place)
            bits = digits.astype(np.uint64)
            low += each * (span >> 16).astype(np.uint64)
            each = each * (span & 0xFFFF).astype(np.uint64) >> bits
            rest = np.minimum((here - low) // each, (_U(1) << bits) - _U(1))
            state.low[rows] = low + each * rest
            state.range[rows] = each
            symbol[rows] = (rest + (_U(1) << bits)).astype(np.int32)
            absorb(state.short(m))
        symbols[step % _RELEARN, :m] = symbol
        if (step + 1) % _RELEARN == 0 or step + 1 == longest:
            ids[:, step - step % _RELEARN:step + 1] = (symbols[:step % _RELEARN + 1] - np.int32(1)).T
        state.update(m, symbol, state.ids == symbol, hits)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(coded)
    for lane, i in enumerate(order):
        out[i] = ids[lane, :sizes[lane]]
    return out


FILES = ("part int, frame int, n_ids long, doc_ids array<long>, doc_lengths array<long>, block_lengths array<int>, "
         "block_sums array<long>, blocks array<binary>")


def _frames(docs: list[tuple[int | None, np.ndarray]]) -> Iterator[tuple[list, list, np.ndarray]]:
    """Whole documents together, up to about FRAME ids."""
    ids, parts, size = [], [], 0
    for doc_id, part in docs:
        if parts and size + len(part) > FRAME:
            yield ids, [len(p) for p in parts], np.concatenate(parts)
            ids, parts, size = [], [], 0
        ids.append(doc_id)
        parts.append(part)
        size += len(part)
    if parts:
        yield ids, [len(p) for p in parts], np.concatenate(parts)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """The ids of every whole text, each followed by ``end_id``, into files in ascending order of doc_id.

    A null text counts as empty: its end id alone.  Rows with the same doc_id are written next to each other; a null
    doc_id comes first.  Extra columns are not read; an empty table gives files without frames.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, frame = shared_encoder(tokenizer), TaskContext.get().partitionId(), 0
        waiting: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal frame
            frames = list(_frames(waiting))
            blocks = [ids[i:i + BLOCK] for _, _, ids in frames for i in range(0, len(ids), BLOCK)]
            coded = iter(encode_blocks(blocks))
            for doc_ids, lengths, ids in frames:
                sizes = [min(BLOCK, len(ids) - i) for i in range(0, len(ids), BLOCK)]
                own = [next(coded) for _ in sizes]
                yield pa.RecordBatch.from_pylist([{
                    "part": part, "frame": frame, "n_ids": len(ids), "doc_ids": doc_ids, "doc_lengths": lengths,
                    "block_lengths": sizes, "block_sums": [zlib.crc32(b) for b in own], "blocks": own}], schema)
                frame += 1
            waiting.clear()

        schema = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("n_ids", pa.int64()),
                            ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())),
                            ("block_lengths", pa.list_(pa.int32())), ("block_sums", pa.list_(pa.int64())),
                            ("blocks", pa.list_(pa.binary()))])
        for batch in nonempty(batches):
            doc_ids = column(batch, "doc_id").to_pylist()
            for at, texts in slices(column(batch, "text")):
                flat, counts = encode(texts)
                ends = np.cumsum(counts)
                for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist())):
                    waiting.append((doc_ids[at + i], np.append(flat[end - count:end], np.uint32(end_id))))
                    size += count + 1
                if size >= AT_ONCE:
                    yield from flush()
                    size = 0
        yield from flush()

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = max(plain.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = plain.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(code, FILES).write.parquet(path)


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32, and with ``keep_ids`` its ids.

    ``start`` counts the ids of all documents before it.  A block whose checksum is wrong raises an error.
    """
    files = spark.read.schema(FILES).parquet(path)
    sizes = files.groupBy("part", "frame").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")            # one row for each part
    within = F.sum("n").over(Window.partitionBy("part").orderBy("frame")) - F.col("n")
    starts = sizes.withColumn("within", within).drop("n").join(
        F.broadcast(parts.select("part", before.alias("before"))), "part")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            totals = np.cumsum(column(batch, "n_ids").to_numpy())
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(totals, (totals[at - 1] if at else 0) + AT_ONCE, side="right")))
                yield from frames(batch.slice(at, stop - at).to_pylist())
                at = stop

    def frames(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        coded = [b for r in rows for b in r["blocks"]]
        for data, expected in zip(coded, (s for r in rows for s in r["block_sums"])):
            if zlib.crc32(data) != expected:
                raise ValueError("a block of token ids is damaged: its checksum is wrong")
        decoded = iter(decode_blocks(coded, [n for r in rows for n in r["block_lengths"]]))
        for r in rows:
            ids = np.concatenate([next(decoded) for _ in r["blocks"]]).astype("<u4")
            lengths = np.array(r["doc_lengths"], np.int64)
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
            many = len(lengths)
            out = [pa.array(r["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64()),
                   pa.array([r["part"]] * many, pa.int32()), pa.array([r["frame"]] * many, pa.int32())]
            names = ["doc_id", "inside", "n_tokens", "ids_crc32", "part", "frame"]
            if keep_ids:
                bounds = np.concatenate([[0], ends]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    kept = ", ids array<int>" if keep_ids else ""
    rows = files.mapInArrow(decode, "doc_id long, inside long, n_tokens long, ids_crc32 long, part int, frame int" + kept)
    start = (F.col("before") + F.col("within") + F.col("inside")).alias("start")
    return rows.join(starts, ["part", "frame"]).select("doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))
