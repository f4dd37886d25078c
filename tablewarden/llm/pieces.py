"""Tokenising columns of whole texts piece by piece, each different piece once.

A piece starts where the splitting patterns of the tokenizers used here end a match whatever follows, so their output on
a text is the output on its pieces in order.  That is so where white space begins, between an ASCII letter and an ASCII mark
behind it, and between a letter and a single line break or tab before it.  Inside a run of white space, where patterns look
ahead, no piece starts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered by a worker.  Later new pieces are encoded each time they occur, so memory is bounded.
REMEMBERED = 900_000
#: Bytes of the longest piece that is remembered; of the longest one that is looked up by its bytes as two numbers.
LONGEST, SHORT = 256, 16
#: Bytes of text that are worked on at once; one longer text is its own slice.
SLICE_BYTES = 2_000_000

Encode = Callable[[Sequence[str]], list[Sequence[int]]]
Flat = tuple[np.ndarray, np.ndarray]

#: Kinds of bytes; from ``_SOLID`` on they may end a piece before white space.  Control characters are of no kind.
_SPACE, _SOLID, _LETTER, _MARK = 1, 2, 3, 4
_KIND = np.array([_SPACE if b in b"\t\n\v\f\r " else 0 if b < 0x20 or b == 0x7F else _LETTER if chr(b).isalpha() and b < 0x80
                  else _SOLID if b >= 0x80 or chr(b).isdigit() else _MARK for b in range(256)], np.uint8)


#: The bytes of a 64-bit number, first byte lowest, that belong to a piece of 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a string array, with the row they start at, of about ``most`` bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start in the UTF-8 bytes of texts that lie one after the other, text i from ``bounds[i]`` on."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    kind = _KIND[data]
    runs = np.flatnonzero((kind[1:] == _SPACE) & (kind[:-1] >= _SOLID)) + 1
    far = runs[data[runs - 1] >= 0x80]                       # behind a character of several bytes: is it white space?
    second, third = data[far - 2], data[np.maximum(far - 3, 0)]
    unsure = (second == 0xC2) | ((third == 0xE2) & ((second == 0x80) | (second == 0x81)))
    unsure |= ((third == 0xE1) & ((second == 0x9A) | (second == 0xA0))) | ((third == 0xE3) & (second == 0x80))
    cut[runs] = True
    cut[far[unsure]] = False
    lines = runs[(data[runs] != 0x20) & (runs < n - 1)]
    cut[lines[cut[lines] & (kind[lines + 1] == _LETTER)] + 1] = True
    cut[1:n] |= (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
    cut[bounds] = True
    return np.flatnonzero(cut[:n])


def hashed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the first 16 bytes (zeros behind the end) and the length of each piece, and bytes 8 to 15 as a number.

    Each step of the hash can be undone: pieces of at most 16 bytes that agree in hash, length and that number are equal.
    """
    padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    words = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))           # the 8 bytes from each byte on
    first = words[starts] & _FIRST[np.minimum(lengths, 8)]
    second = words[starts + 8] & _FIRST[np.clip(lengths - 8, 0, 8)]
    mixed = first * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed += second
    mixed += lengths.astype(np.uint64)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    return mixed, second


def flattened(ids: Sequence[Sequence[int]]) -> Flat:
    """All ids one after the other, and how many each sequence has."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


class PieceEncoder:
    """Token ids of every text of a column by ``encode``, which maps texts to id sequences.

    An ``encode`` with an attribute ``flat`` is asked by that: it maps UTF-8 pieces to all their ids and the number of each.
    Remembered pieces wait in the dictionary ``known``; the short ones move on, many at a time, to arrays indexed by a hash
    of their bytes, where all pieces of a slice are looked up at once and compared in full.
    """

    def __init__(self, encode: Encode, remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self.flat: Callable[[list[bytes]], Flat] = getattr(encode, "flat", None) or (lambda pieces: flattened(encode([p.decode() for p in pieces])))
        self.known: dict[bytes, int] = {}
        self.index = pd.Index(np.zeros(0, np.uint64))
        self.second, self.size, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int32)
        self.pool, self.edges = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64)    # ids, and the byte where those of each piece start
        self.n_pieces = self.n_kept = self.waiting = 0

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        at, to = int(self.edges[self.n_pieces]) // 4, self.n_pieces + len(lengths)
        while at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        while to >= len(self.edges):
            self.edges = np.concatenate([self.edges, np.zeros_like(self.edges)])
        self.pool[at:at + len(ids)] = ids
        self.edges[self.n_pieces + 1:to + 1] = 4 * (at + np.cumsum(lengths))
        self.n_pieces = to

    def _indexed(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Where each piece is in the arrays, -1 for those that the index does not hold."""
        if not len(self.index):
            return np.full(len(starts), -1)
        mixed, second = hashed(data, starts, lengths)
        place = self.index.get_indexer(mixed)
        same = (self.second[place] == second) & (self.size[place] == lengths) & (place >= 0)
        return np.where(same, self.number[place], -1)

    def _move(self) -> None:
        """Short pieces go from the dictionary to the index; one whose hash another piece has stays."""
        short = [p for p in self.known if len(p) <= SHORT]
        size = np.fromiter(map(len, short), np.int64, len(short))
        mixed, second = hashed(np.frombuffer(b"".join(short), np.uint8), np.cumsum(size) - size, size)
        take = np.zeros(len(short), bool)
        take[np.unique(mixed, return_index=True)[1]] = True
        take &= self.index.get_indexer(mixed) < 0
        number = np.array([self.known.pop(short[i]) for i in np.flatnonzero(take).tolist()], np.int32)
        self.index = pd.Index(np.concatenate([self.index.to_numpy(), mixed[take]]))
        self.second, self.number = np.concatenate([self.second, second[take]]), np.concatenate([self.number, number])
        self.size = np.concatenate([self.size, size[take].astype(np.uint8)])
        self.waiting = 0

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Where each piece that is not in the index is in the arrays; new ones are encoded and added, those to remember first."""
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            size = np.fromiter((len(pieces[i]) for i in new.tolist()), np.int64, len(new))
            order = np.argsort(size > LONGEST, kind="stable")
            new, size = new[order], size[order]
            base, asked = self.n_pieces, [pieces[i] for i in new.tolist()]
            self._add(*self.flat(asked))
            at[new] = np.arange(base, base + len(new))
            keep = min(max(0, self.remembered - self.n_kept), int((size <= LONGEST).sum()))
            self.known.update(zip(asked[:keep], range(base, base + keep)))
            self.n_kept += keep
            self.waiting += int((size[:keep] <= SHORT).sum())
        return at

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and the number of ids of each text; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        if data is None or bounds[-1] == bounds[0]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data, bounds = data.slice(int(bounds[0]), int(bounds[-1] - bounds[0])), bounds - bounds[0]
        raw = np.frombuffer(data, np.uint8)
        starts = piece_starts(raw, bounds)
        edges = np.append(starts, len(data)).astype(np.int64)
        which = self._indexed(raw, starts, np.diff(edges))
        rest = np.flatnonzero(which < 0)
        if len(rest):
            pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), data])
            coded = pieces.take(pa.array(rest)).dictionary_encode()
            which[rest] = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        each = pa.Array.from_buffers(pa.large_binary(), self.n_pieces, [None, pa.py_buffer(self.edges), pa.py_buffer(self.pool)])
        _, before, out = each.take(pa.array(which)).buffers()
        before = np.frombuffer(before, np.int64)[:len(which) + 1] // 4
        self.n_pieces = self.n_kept                                    # what is not remembered goes
        if self.waiting >= (4096 if self.n_kept == self.remembered else max(16_384, len(self.index) // 4)):
            self._move()
        ids = np.frombuffer(out, np.uint32)[:before[-1]] if before[-1] else np.zeros(0, np.uint32)
        return ids, np.diff(before[np.searchsorted(starts, bounds)])


@lru_cache(maxsize=4)
def shared_encoder(path: str) -> PieceEncoder:
    """One encoder a worker process for each vocabulary file of the tokenizers library."""
    return PieceEncoder(library_encoder(path))


def library_encoder(path: str) -> Encode:
    """The tokenizers library over a vocabulary file, without special tokens.

    Short texts go to it in long strings, joined by a separator that is one token of its own and never merges:
    a call for each would take twice the time.  Pieces that start with a space end each other, so where ids stand for
    bytes they need no separator: their ids are told apart by the bytes that these stand for.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    os.environ["TOKENIZERS_PARALLELISM"] = "false"          # Spark has one task a core already
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def each(texts: Sequence[str]) -> list[Sequence[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def stands_alone(mark: str) -> bool:
        return all(len(alone) == 1 and joined == [*left, *alone, *right] for joined, left, right, alone in
                   (each([left + mark + right, left, right, mark]) for left, right in (("a", " b"), ("A.", "b,"), ("'s", ".b"))))

    mark = next((m for m in ("\n", "7") if stands_alone(m)), None)
    mark_id = each([mark])[0][0] if mark else None
    n_bytes = None
    if tokenizer.normalizer is None and isinstance(tokenizer.pre_tokenizer, ByteLevel) and tokenizer.pre_tokenizer.use_regex \
            and not tokenizer.pre_tokenizer.add_prefix_space:
        vocabulary = tokenizer.get_vocab()                                   # a character of a token stands for a byte
        n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        n_bytes[list(vocabulary.values())] = list(map(len, vocabulary))

    def encode(texts: Sequence[str]) -> list[Sequence[int]]:
        out: list[Sequence[int] | None] = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if mark and 0 < len(t) < 64 and mark not in t and t.isprintable()
                 and t[0].isascii() and t[-1] != " " and t[:2] != "  "]
        groups = [short[i:i + 500] for i in range(0, len(short), 500)]
        for group, ids in zip(groups, each([mark.join(texts[i] for i in g) for g in groups])):
            cuts = np.flatnonzero(np.array(ids) == mark_id).tolist()
            if len(cuts) == len(group) - 1:
                for i, a, b in zip(group, [-1, *cuts], [*cuts, len(ids)]):
                    out[i] = ids[a + 1:b]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, each([texts[i] for i in rest])):
            out[i] = ids
        return out

    # pieces of printable ASCII and Latin letters, told by their bytes, as in ``encode`` by their characters
    alone = re.compile(rb"(?!  )[%b](?:[%b]|[\xc3-\xc5][\x80-\xbf]){0,62}(?<! )" % ((rb" -68-~" if mark == "7" else rb" -~",) * 2)).fullmatch
    spaced = re.compile(rb" (?! )(?:[ -~]|[\xc3-\xc5][\x80-\xbf]){1,62}(?<! )").fullmatch

    def flat(pieces: list[bytes]) -> Flat:
        many = [2 if n_bytes is not None and spaced(p) else 1 if mark is not None and alone(p) else 0 for p in pieces]
        many = np.array(many, np.uint8)
        places, rest = [], np.flatnonzero(many == 0).tolist()
        lengths, found, order = np.zeros(len(pieces), np.int64), [], []
        for kind in (1, 2):
            of_kind = np.flatnonzero(many == kind)
            places += [(kind, of_kind[i:i + 500]) for i in range(0, len(of_kind), 500)]
        lines = [(mark.encode() if kind == 1 else b"").join([pieces[i] for i in g.tolist()]).decode() for kind, g in places]
        for (kind, group), ids in zip(places, each(lines)):
            ids = np.array(ids, np.uint32)
            if kind == 1:
                cuts = np.flatnonzero(ids == mark_id)
                fits, taken, ids = len(cuts) == len(group) - 1, np.diff(cuts, prepend=-1, append=len(ids)) - 1, np.delete(ids, cuts)
            else:
                ends = np.cumsum(n_bytes[ids])
                due = np.cumsum([len(pieces[i]) for i in group.tolist()])
                last = np.searchsorted(ends, due)
                fits = ends[-1] == due[-1] and bool((ends[last] == due).all())
                taken = np.diff(last, prepend=-1)
            if fits:
                lengths[group] = taken
                found.append(ids)
                order.append(group)
            else:
                rest.extend(group.tolist())
        ids, lengths[rest] = flattened(encode([pieces[i].decode() for i in rest]))
        found.append(ids)
        order = np.concatenate([*order, np.array(rest, np.int64)])
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(found)[ranges(starts, lengths)], lengths

    encode.flat = flat
    return encode
