"""Words of whole text columns and hashes of runs of words, for all rows of a slice at once in numpy.

A word is a longest run of bytes other than space and \\t to \\r, which is the same as on characters in UTF-8.
Hashes are polynomials over bytes, then over mixed word hashes, so that the hash of any run comes from two running sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd factors of the polynomials: over bytes and over words, for a first and a second hash.
_BYTE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_U = np.uint64
#: Bytes of text worked on at once: powers and running sums take 8 bytes for each of them, several times.
WORK_BYTES = 1_000_000
#: Bytes hashed at once, of a text longer than that: what powers and sums of bytes take does not grow with the text.
PART_BYTES = 2_000_000
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), _U(base))
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@dataclass
class Words:
    """Where the words of a slice are, in its bytes, and how many each row has."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """The number of the first word of each row."""
        return np.cumsum(self.counts) - self.counts

    def hashes(self, which: int = 0) -> np.ndarray:
        """The hash of each word; a word's hash does not depend on where it stands, so long slices are hashed in parts."""
        base, sizes = _BYTE[which], self.ends - self.starts
        values, at = np.zeros(len(self.starts), np.uint64), 0
        while at < len(self.starts):
            start = int(self.starts[at])
            stop = int(np.searchsorted(self.ends, start + PART_BYTES, side="right"))
            if stop <= at:                                       # one word longer than a part
                values[at], at = _sum(self.data[start:int(self.ends[at])], base), at + 1
                continue
            part = self.data[start:int(self.ends[stop - 1])].astype(np.uint64) + _U(1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _power(base, len(part)))])
            first, last = self.starts[at:stop] - start, self.ends[at:stop] - start
            values[at:stop] = (sums[last] - sums[first]) * _power(_inverse(base), len(part) + 1)[first]
            at = stop
        return mix(values + sizes.astype(np.uint64) * _U(0x9FB21C651E98DF25))


def _sum(data: np.ndarray, base: int) -> np.uint64:
    """The polynomial of a run of bytes of any length."""
    total = 0
    for at in range(0, len(data), PART_BYTES):
        part = data[at:at + PART_BYTES].astype(np.uint64) + _U(1)
        total += int((part * _power(base, len(part))).sum(dtype=np.uint64)) * pow(base, at, 1 << 64)
    return _U(total % (1 << 64))


def find_words(texts: pa.Array) -> Words:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None and len(offsets) else np.zeros(0, np.uint8)
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)                    # a row ends or begins before this byte
    edge[offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(data, starts, ends, counts)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int, which: int = 0) -> np.ndarray:
    """The hash of each run of words, from the hashes of all words in order."""
    base = _WORD[which]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _power(base, len(hashes)))])
    size = np.asarray(lengths).astype(np.uint64)
    value = (sums[starts + lengths] - sums[starts]) * _power(_inverse(base), len(hashes) + 1)[starts]
    return mix(value + size * _U(0x8EBC6AF09C88C6E3))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of every run of ``size`` words inside one row."""
    n = np.maximum(words.counts - size + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n - words.first, n), rows
