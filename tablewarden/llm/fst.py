"""Byte-level BPE as a finite-state transducer, and its decoder.

In byte-pair encoding by merge ranks, ids in a row are the encoding of their bytes exactly if each is the encoding of its
own bytes and each two neighbours are the encoding of theirs.  So one transducer, over the trie of the vocabulary, can
read bytes from left to right: it holds the ways to cut what it has read into such ids, with an unfinished
last one.  Ways that differ only in the last few ids share what comes before, and that is put out at once: the lookahead
is no longer than the longest entry.  Sets of ways are states; states and their moves are made when first met.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import column, nonempty
from tablewarden.llm.pieces import PieceEncoder, slices

#: States kept before the transducer starts anew; it grows again with what it meets.
MOST_STATES = 150_000
#: Ids decoded at once.
DECODE_IDS = 65_536


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks, self.most_states = ranks, most_states
        self.word_of = [b""] * (max(ranks.values(), default=-1) + 1)
        self.child: list[dict[int, int]] = [{}]
        self.id_at = [-1]
        for word, i in ranks.items():
            self.word_of[i] = word
            node = 0
            for b in word:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = len(self.child)
                    self.child[node][b] = nxt
                    self.child.append({})
                    self.id_at.append(-1)
                node = nxt
            self.id_at[node] = i
        self.own: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self.number((((), -1, 0),))

    def number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def merged(self, word: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank until none can be merged."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, before: int, i: int) -> bool:
        """Whether id ``i`` may follow ``before`` (-1: nothing)."""
        whole = self.own.get(i)
        if whole is None:
            whole = self.own[i] = self.merged(self.word_of[i]) == [i]
        if not whole or before < 0:
            return whole
        ok = self.pairs.get((before, i))
        if ok is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            ok = self.pairs[before, i] = self.merged(self.word_of[before] + self.word_of[i]) == [before, i]
        return ok

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        ways = []
        for waiting, last, node in self.states[state]:
            nxt = self.child[node].get(byte)
            if nxt is not None:
                ways.append((waiting, last, nxt))
            i = self.id_at[node]
            if i >= 0 and byte in self.child[0] and self.fits(last, i):
                ways.append(((*waiting, i), i, self.child[0][byte]))
        if not ways:
            raise ValueError("the vocabulary lacks a byte of the text")
        shared = 0
        shortest = min(len(w[0]) for w in ways)
        while shared < shortest and len({w[0][shared] for w in ways}) == 1:
            shared += 1
        out = ways[0][0][:shared]
        found = self.number(tuple((w[shared:], last, node) for w, last, node in ways)), out
        self.moves[state << 8 | byte] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        """The ids of one match of the splitting pattern."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self.states) > self.most_states:
            self.reset()
        state, out, moves = self.start, [], self.moves
        for byte in word:
            found = moves.get(state << 8 | byte)
            if found is None:
                found = self.move(state, byte)
            state, ids = found
            if ids:
                out += ids
        for waiting, last, node in self.states[state]:
            i = self.id_at[node]
            if i >= 0 and self.fits(last, i):
                return [*out, *waiting, i]
        return self.merged(word)                     # an entry that no merges lead to


class Utf8Stream:
    """An incremental UTF-8 decoder: bytes in parts of any size, text out as soon as it is whole."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def open_bytes(data: bytes) -> int:
        """How many bytes at the end begin a character that is not whole yet."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
                return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self.open_bytes(data)
        self.held = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode(ids: Sequence[int], word_of: Sequence[bytes]) -> Iterator[str]:
    """Text of ids, part by part; bytes that are no UTF-8 become U+FFFD."""
    stream = Utf8Stream()
    for at in range(0, len(ids), DECODE_IDS):
        part = ids[at:at + DECODE_IDS]
        yield stream.feed(b"".join(map(word_of.__getitem__, part.tolist() if isinstance(part, np.ndarray) else part)))
    yield stream.end()


@lru_cache(maxsize=2)
def shared_transducer(path: str, pattern: str) -> tuple[Transducer, PieceEncoder, list[str]]:
    """One transducer and one memory of pieces a worker process."""
    import regex

    # the libraries that made these files call white space what Unicode does
    split = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))
    made = Transducer(read_ranks(path))

    def encode(texts: Iterable[str]) -> list[list[int]]:
        return [[i for match in split.findall(text) for i in made.encode(match.encode())] for text in texts]

    return made, PieceEncoder(encode), [str(i) for i in range(len(made.word_of))]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; with ``keep`` the ids and decoded text too.

    ``ranks`` is the path of a rank file, readable on every executor, and ``pattern`` the splitting pattern without
    capturing groups.  A null text counts as empty.  Extra columns are not read; repeated rows each give a row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, encoder, names = shared_transducer(ranks, pattern)
        for batch in nonempty(batches):
            doc_ids = column(batch, "doc_id")
            for at, texts in slices(column(batch, "text")):
                flat, counts = encoder(texts)
                ends = np.cumsum(counts).tolist()
                sums, decoded, kept, plain = [], [], [], []
                for end, count in zip(ends, counts.tolist()):
                    ids = flat[end - count:end]
                    sums.append(hashlib.sha256(",".join(map(names.__getitem__, ids.tolist())).encode()).hexdigest())
                    digest, parts = hashlib.sha256(), []
                    for part in decode(ids, made.word_of):
                        digest.update(part.encode())
                        parts.append(part) if keep else None
                    decoded.append(digest.hexdigest())
                    kept.append(ids.tolist()) if keep else None
                    plain.append("".join(parts)) if keep else None
                out = [doc_ids.slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
                columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    out += [pa.array(kept, pa.list_(pa.int32())), pa.array(plain, pa.string())]
                    columns += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, columns)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
                            + (", ids array<int>, decoded string" if keep else ""))
