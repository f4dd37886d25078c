"""Fill-in-middle: texts cut in three and put in another order, so that a model learns to fill a gap.

Cuts are counted in code points or in lines, and texts are held as UTF-8 bytes.  A slice of texts has one sparse index of
exceptions: where its multibyte characters begin and how many bytes beyond one they have taken up to there.  Between
exceptions a code point is a byte, so a binary search in the index and a subtraction turn byte cuts into code points and
back; spans of ASCII are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewarden.llm.common import column, nonempty
from tablewarden.llm.pieces import slices

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
#: Bytes of text worked on at once; one longer text is a slice of its own.
WORK_BYTES = 4_000_000
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")
_DRAWS = "__fim_draws"


def check_markers(markers: Sequence[str]) -> None:
    """Markers must be told apart wherever they are put between texts that hold none of them."""
    for a in markers:
        for b in markers:
            overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) if a else True
            if overlap or (a is not b and a in b):
                raise ValueError(f"markers {a!r} and {b!r} overlap, or are empty")
    if len(set(markers)) != 3:
        raise ValueError("three different markers are needed")


@dataclass
class Exceptions:
    """The multibyte characters of a slice: byte places, code point places, and excess bytes up to and with each."""
    places: np.ndarray
    points: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        places = np.flatnonzero(data >= 0xC0)
        lead = data[places]
        own = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.concatenate([np.zeros(1, np.int64), np.cumsum(own)])
        return cls(places, places - excess[:-1], excess)

    def to_points(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before byte cuts that lie between characters."""
        return cuts - self.excess[np.searchsorted(self.places, cuts)]

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """Bytes before code point cuts."""
        return points + self.excess[np.searchsorted(self.points, points)]


def as_bytes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts without nulls, their bytes one after the other, and where each begins and ends there."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return texts, data, offsets - offsets[0]


def cuts_of(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its number of units and, in bytes and in code points of the slice, its begin and two cuts."""
    index = Exceptions.of(data)
    begin, end = offsets[:-1], offsets[1:]
    first = index.to_points(begin)
    if unit == "lines":
        breaks = np.flatnonzero(data == 10) + 1                        # bytes after each line break
        before, upto = np.searchsorted(breaks, begin, side="right"), np.searchsorted(breaks, end, side="right")
        open_end = (end > begin) & (data[np.maximum(end - 1, 0)] != 10 if len(data) else False)
        n = upto - before + open_end
    else:
        n = index.to_points(end) - first
    low, high = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1).T
    if unit == "lines":
        ends = np.concatenate([breaks, [0]])
        cut = [np.where(k == 0, begin, np.where(k > upto - before, end, ends[np.minimum(before + np.maximum(k, 1) - 1, len(breaks))]))
               for k in (low, high)]
        points = [index.to_points(c) for c in cut]
    else:
        points = [first + k for k in (low, high)]
        cut = [index.to_bytes(p) for p in points]
    return n, np.stack([begin, *cut, end]), np.stack([first, *points])


def draws(doc_id: Column, seed: int) -> Column:
    """Four numbers below 2^32 from the hash of seed and id; a null id counts as an empty one."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def fill_in_middle(docs: DataFrame, unit: str = "lines", seed: int = SEED, rate: int = 100, spm: int = 50,
                   markers: Sequence[str] = MARKERS) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output.

    A text has n units: lines (each with its break; the last may have none) or code points (``unit`` "chars").  Two cuts
    and the form are drawn from the hash of ``seed`` and doc_id, so a rerun or another order of rows changes nothing.
    Of 100 texts about ``rate`` are transformed, of these about ``spm`` of 100 with the suffix first:

    * psm: P prefix S suffix M middle, with the ``markers`` for P, S and M
    * spm: S suffix P prefix M middle
    * plain: the text itself, where it is not drawn, is empty, or holds a marker; prefix_chars and middle_chars are null

    A null text counts as empty; a null doc_id as an empty id; rows that share a doc_id are cut by the same draws, each in
    its own text.  Texts of any length are cut whole; one longer than 4 MB is worked on alone.  Columns of ``docs`` that are
    named like a new one are replaced, all others stay.  An empty table gives an empty result.
    """
    check_markers(markers)
    if unit not in ("lines", "chars"):
        raise ValueError("unit is 'lines' or 'chars'")
    docs = docs.drop(*MADE)
    names = docs.columns
    made = (StructType(list(docs.schema.fields)).add("n", "long").add("form", "string").add("prefix_chars", "long")
            .add("middle_chars", "long").add("output", "string"))
    mark = [m.encode() for m in markers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            drawn = column(batch, _DRAWS).flatten().to_numpy().reshape(-1, 4)
            for at, part in slices(column(batch, "text"), WORK_BYTES):
                texts, data, offsets = as_bytes(part)
                mine = drawn[at:at + len(texts)]
                n, cut, points = cuts_of(data, offsets, mine, unit)
                plain = (np.diff(offsets) == 0) | (mine[:, 2] % 100 >= rate)
                for m in markers:
                    plain |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
                first = mine[:, 3] % 100 < spm
                held, out = data.tobytes(), []
                for p, s, (b, x, y, e) in zip(plain.tolist(), first.tolist(), cut.T.tolist()):
                    if p:
                        out.append(held[b:e])
                    elif s:
                        out.append(b"".join((mark[1], held[y:e], mark[0], held[b:x], mark[2], held[x:y])))
                    else:
                        out.append(b"".join((mark[0], held[b:x], mark[1], held[y:e], mark[2], held[x:y])))
                form = np.where(plain, "plain", np.where(first, "spm", "psm"))
                rest = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(column(rest, c) for c in names), pa.array(n), pa.array(form.tolist(), pa.string()),
                     pa.array(points[1] - points[0], mask=plain), pa.array(points[2] - points[1], mask=plain),
                     pa.array(out, pa.binary()).cast(pa.string())], [*names, *MADE])

    return docs.withColumn(_DRAWS, draws(F.col("doc_id"), seed)).mapInArrow(run, made)


def restore(done: DataFrame, markers: Sequence[str] = MARKERS) -> DataFrame:
    """``done`` with ``restored``: the exact text that ``output`` was made from, told by ``form`` alone.

    No other column is read.  A null output or an unknown form gives null; an output that lacks the markers of its form is an
    error.  A column of this name is replaced.
    """
    check_markers(markers)
    p, s, m = markers
    orders = {"psm": (p, s, m), "spm": (s, p, m)}
    output, form = F.col("output"), F.col("form")

    def parts(order: Sequence[str]) -> tuple[Column, Column, Column]:
        a, b, c = order
        second = F.locate(b, output)                       # no text holds a marker, so the first one found is the one put there
        third = F.locate(c, output)
        fine = output.startswith(a) & (second > 0) & (third > second)
        start = F.when(fine, F.lit(len(a) + 1)).otherwise(F.raise_error(F.lit("an output without its markers")).cast("int"))
        piece = lambda begin, end: F.substring(output, begin, end - begin)          # noqa: E731
        return piece(start, second), piece(second + len(b), third), F.substring(output, third + len(c), F.length(output))

    prefix, suffix, middle = parts(orders["psm"])
    suffix_, prefix_, middle_ = parts(orders["spm"])
    text = (F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix_, middle_, suffix_)))
    return done.withColumn("restored", text)
