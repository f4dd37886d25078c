"""Pieces, packing, id files and the transducer against the libraries and brute force."""

import bisect
import hashlib
import random
import sys
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablewarden.llm import fst, idcoder, packing, pieces
from tablewarden.llm.common import scratch_path
from tablewarden.llm.pieces import PieceEncoder, library_encoder, shared_encoder

from .conftest import EDGE_TEXTS

WORD, BYTE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = st.text(alphabet="ab cdé ñ日😀\t\n\x1c  '\"!7123 ", max_size=60)


def whole(path, text):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(ODD, min_size=1, max_size=5))
def test_pieces_equal_whole_texts(path, texts):
    flat, counts = shared_encoder(path)(pa.array(texts))
    ends = np.cumsum(counts)
    assert [flat[e - n:e].tolist() for e, n in zip(ends, counts)] == [whole(path, t) for t in texts]


MIXED = st.text(alphabet="aBé.,'!_-5 \n\t\r\x00\x1f\u0301\xa0\x85»\u1680\u180e\u2009\u2029\u202f\u205f\u3000、日İſK😀", max_size=24)


@lru_cache
def loaded(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(MIXED, st.lists(MIXED, max_size=6).map(" ".join), st.lists(MIXED, max_size=6).map("\n".join)), max_size=6))
def test_pieces_cut_at_marks_and_lines_equal_whole_texts(path, texts):
    shared, library = shared_encoder(path), loaded(path)
    for encoder in (shared, PieceEncoder(shared.encode, remembered=4)):
        for part in (pa.array([None, *texts], pa.string()), pa.array(["it's", *texts], pa.string()).slice(1)):
            flat, counts = encoder(part)
            ends = np.cumsum(counts)
            assert [flat[e - n:e].tolist() for e, n in zip(ends, counts)] == [library.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]


def test_a_word_is_encoded_once_whatever_mark_follows():
    asked = []
    library = library_encoder(BYTE)
    encoder = PieceEncoder(lambda texts: asked.extend(texts) or library(texts))
    for text in (" word, word. word; word", " word: word\n word! word?"):
        assert encoder(pa.array([text]))[0].tolist() == whole(BYTE, text)
    assert asked.count(" word") == 1
    long = "x" * 5000
    assert encoder(pa.array([long]))[0].tolist() == whole(BYTE, long) and long.encode() not in encoder.known


def test_full_memory_changes_nothing():
    small = PieceEncoder(library_encoder(BYTE), remembered=3)
    texts = pa.array(["one two three four five", None, "six seven one", "a  b", ""] * 3)
    big = PieceEncoder(library_encoder(BYTE))
    for part in (texts, texts.slice(2, 5)):
        a, b = small(part), big(part)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert len(small.known) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(min_size=1, max_size=70), st.sampled_from([" word", "7", " 7a", "a\nb", "\n", "  x", "x ", " é", "Éa", " ж", " a\u00ad", "ſ", "<|endoftext|>"])), max_size=30))
def test_new_pieces_are_encoded_together_as_one_by_one(texts):
    for path in (BYTE, WORD):
        ids, lengths = shared_encoder(path).encode.flat([t.encode() for t in texts])
        assert [i.tolist() for i in np.split(ids, np.cumsum(lengths))[:-1]] == [loaded(path).encode(t, add_special_tokens=False).ids for t in texts]


def many_words(n):
    rng = np.random.default_rng(n)
    return [rng.integers(97, 123, k, np.uint8).tobytes().decode() for k in rng.integers(1, 24, n)]


def test_remembered_short_pieces_are_looked_up_all_at_once():
    """Only pieces of more than 16 bytes go one by one through the dictionary once the short ones are in the index."""
    encoder = PieceEncoder(library_encoder(BYTE))
    words = many_words(40_000)
    texts = pa.array([" ".join(words[k:k + 100]) for k in range(0, len(words), 100)])
    first, counts = encoder(texts)
    assert first.tolist() == [i for t in texts.to_pylist() for i in loaded(BYTE).encode(t, add_special_tokens=False).ids]
    asked, numbers = [], encoder._numbers
    encoder._numbers = lambda part: asked.extend(part) or numbers(part)
    again, counts_again = encoder(texts)
    assert again.tolist() == first.tolist() and counts_again.tolist() == counts.tolist()
    assert asked and min(map(len, asked)) > pieces.SHORT


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_that_look_alike_are_told_apart_in_the_index(path):
    odd = ["a", "a\0", "a\0\0", "\0a", "b" * 8, "b" * 9, "b" * 16, "b" * 17, "b" * 16 + "c", "b" * 15 + "c", "c" + "b" * 15, "é" * 8, "é" * 8 + "x"]
    encoder = PieceEncoder(library_encoder(path))
    encoder(pa.array([" ".join(many_words(40_000))]))
    assert len(encoder.index) > 10_000
    for text in (" ".join(odd), " ".join(o[:-1] for o in odd), "\0", " ", "\n\n"):
        for _ in range(2):
            flat, counts = encoder(pa.array([text, "", None, text]))
            ids = loaded(path).encode(text, add_special_tokens=False).ids
            assert flat.tolist() == 2 * ids and counts.tolist() == [len(ids), 0, 0, len(ids)]
            encoder._move()                                                 # the odd ones are in the index the second time
    data = np.frombuffer("".join(odd).encode(), np.uint8)
    size = np.array([len(o.encode()) for o in odd])
    short = size <= pieces.SHORT
    mixed, _ = pieces.hashed(data, np.cumsum(size) - size, size)
    assert len(set(mixed[short].tolist())) == short.sum()


def test_spaced_words_need_no_separator_where_ids_stand_for_bytes():
    lines = []

    class Spy:
        def __init__(self, inner): self.inner = inner
        def __getattr__(self, name): return getattr(self.inner, name)
        def __setattr__(self, name, value): self.__dict__.__setitem__(name, value) if name == "inner" else setattr(self.inner, name, value)
        def encode_batch_fast(self, texts, **kw): return lines.extend(texts) or self.inner.encode_batch_fast(texts, **kw)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("tokenizers.Tokenizer", type("T", (), {"from_file": staticmethod(lambda p: Spy(Tokenizer.from_file(p)))}))
        flat = library_encoder(BYTE).flat
    lines.clear()
    words = [" one", " two7", " 77", " Ärger", " it's", " ×÷", " ...", " <|endoftext|>"] * 100
    ids, lengths = flat([w.encode() for w in words])
    assert [i.tolist() for i in np.split(ids, np.cumsum(lengths))[:-1]] == [loaded(BYTE).encode(w, add_special_tokens=False).ids for w in words]
    assert "".join(lines) == "".join(words)


def test_short_new_words_take_no_python_step_each():
    """Words of ASCII and Latin letters are told by their bytes, and their ids cut out of long lists in numpy."""
    encoder = PieceEncoder(library_encoder(BYTE))
    texts = pa.array([" ".join(f"wörd{i}x" for i in range(k, k + 500)) for k in range(0, 5000, 500)])
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event == "call" and frame.f_code.co_filename == pieces.__file__ and frame.f_code.co_name in ("<lambda>", "encode", "each")

    sys.setprofile(count)
    try:
        ids, _ = encoder(texts)
    finally:
        sys.setprofile(None)
    assert ids.tolist() == [i for t in texts.to_pylist() for i in loaded(BYTE).encode(t, add_special_tokens=False).ids] and steps < 10


def test_special_strings_are_plain_text():
    assert shared_encoder(BYTE)(pa.array(["<|endoftext|> x"]))[0].tolist() == whole(BYTE, "<|endoftext|> x")


# ---- packing

def best_fit_decreasing(counts, capacity):
    """Number of sequences when pieces, longest first, each take the smallest gap that holds them."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect.bisect_left(gaps, length)
            gap = gaps.pop(at) if at < len(gaps) else capacity
            bisect.insort(gaps, gap - length)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from([packing.PIECE, packing.GAP]), st.integers(1, 40), st.integers(1, 6)), max_size=14))
def test_sweep_gives_every_piece_the_successor_that_longer_ones_left(rows):
    capacity, seen, at = 40, [], [0, 0]
    for kind, size, count in rows:
        seen.append((size, kind, at[kind], count))
        at[kind] += count
    out = packing.sweep(*(np.array(c, np.int64) for c in zip(*seen)), capacity) if seen else []
    sizes = {first + i: size for size, kind, first, n in seen for i in range(n) if kind == packing.GAP}
    free, want, left = sorted((g, s) for s, g in sizes.items()), {}, []
    for size, kind, first, n in sorted(seen, key=lambda r: (-r[0], r[2])):
        room, sequence = 0, None
        for piece in range(first, first + n) if kind == packing.PIECE else ():
            if room < size and free and free[-1][0] >= size:
                room, sequence = free.pop(bisect.bisect_left(free, (size,)))
            if room < size:
                left.append((piece, size))
                continue
            room -= size
            want.setdefault(sequence, []).append((size, piece))
    got, rest = {}, []
    for kind, size, first, n, sequence, each, offset in out:
        for i in range(n) if kind == packing.PLACED else ():
            got.setdefault(sequence + i // each, []).append((size, first + i))
        rest += [(first + i, size) for i in range(n)] if kind == packing.PIECE else []
    assert sorted(rest) == sorted(left)
    assert sorted((sizes[s], sorted(v)) for s, v in got.items()) == sorted((sizes[s], sorted(v)) for s, v in want.items())
    after = {first + i: size for kind, size, first, n, *_ in out if kind == packing.GAP for i in range(n)}
    assert after == {s: g - sum(x for x, _ in got.get(s, [])) for s, g in sizes.items() if g > sum(x for x, _ in got.get(s, []))}


@pytest.mark.parametrize("counts, capacity", [
    ({n: 1 + n * 37 % 23 for n in range(1, 65)}, 64),
    ({n: 40 for n in range(9, 31, 3)}, 100),
    ({1: 1000, 33: 400, 64: 3}, 64),             # a third of the pieces has one length
    ({64: 5}, 64), ({1: 1}, 64), ({33: 7, 31: 7}, 64)])
def test_rounds_place_every_piece_in_about_as_few_sequences_as_best_fit_decreasing(spark, counts, capacity):
    rounds, sequences = packing.plan(spark.createDataFrame(list(counts.items()), "length long, n long"), capacity)
    fill, ranks = {}, []
    runs = packing.placements(rounds).T.tolist()
    ends = [first for first, *_ in runs[1:]] + [sum(counts.values())]
    for (first, sequence, each, offset, length), end in zip(runs, ends):
        for i in range(end - first):
            ranks.append((first + i, length))
            fill.setdefault(sequence + i // each, []).append((offset + i % each * length, length))
    assert ranks == list(enumerate(n for n in sorted(counts, reverse=True) for _ in range(counts[n])))
    assert set(fill) == set(range(sequences))
    for places in fill.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0] + [n for _, n in sorted(places)])[:-1].tolist()
        assert sum(n for _, n in places) <= capacity
    best = best_fit_decreasing(counts, capacity)
    assert sequences <= best + 1 + best // 100


def test_pack_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, WORD).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want, counts, library = {}, {}, Tokenizer.from_file(WORD)
    library.encode_special_tokens = True
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            want[r["doc_id"], piece] = (start, len(part), zlib.crc32(part.tobytes()))
            counts[len(part)] = counts.get(len(part), 0) + 1
    assert len(rows) == len(want) and got == want
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in fill.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0] + [n for _, n in sorted(places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 4096
    best = best_fit_decreasing(counts, 4096)
    assert len(fill) <= best + 1 + best // 100


def test_pack_edge_texts(edge_docs):
    rows = packing.pack(edge_docs, WORD, capacity=64, keep_ids=True).collect()
    got = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    for doc_id, text in dict(EDGE_TEXTS).items():
        ids = whole(WORD, text or "") + [1]
        copies = sum(d == doc_id for d, _ in EDGE_TEXTS)
        pieces = sorted({(p, s, tuple(i)) for p, s, i in got[doc_id]})
        assert [i for _, _, part in pieces for i in part] == ids
        assert [s for _, s, _ in pieces] == list(range(0, len(ids), 64)) and len(got[doc_id]) == copies * len(pieces)
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in fill.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0] + [n for _, n in sorted(places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 64


def test_pack_no_rows(no_docs):
    assert packing.pack(no_docs, WORD).count() == 0


# ---- id files

@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, (1 << 20) - 2)), max_size=200), max_size=6))
def test_blocks_round_trip(blocks):
    blocks = [np.array(b, np.int64) for b in blocks]
    coded = idcoder.encode_blocks(blocks)
    back = idcoder.decode_blocks(coded, [len(b) for b in blocks])
    assert [b.tolist() for b in back] == [b.tolist() for b in blocks]


def test_blocks_repeat_cheaply_and_alone():
    block = np.tile(np.arange(50), 20)
    noise = np.random.default_rng(1).integers(0, 50_000, 1000)
    one, two = idcoder.encode_blocks([block, noise])
    assert len(one) < 500 and len(two) < 2300
    assert idcoder.encode_blocks([block]) == [one]            # a block does not depend on those beside it
    with pytest.raises(ValueError):
        idcoder.encode_blocks([np.array([1 << 20])])


def test_block_bytes_stay_and_words_are_gathered_by_lane():
    """Files that are there stay readable: the bytes of fixed blocks, of many lengths, as of the first version of the steps."""
    rng = np.random.default_rng(5)
    blocks = [rng.zipf(1.3, n) % 50_000 for n in (1024, 1024, 700, 1, 64, 65, 0, 333)]
    assert zlib.crc32(b"|".join(idcoder.encode_blocks(blocks))) == 715018294


def test_files_of_edge_texts(spark, edge_docs):
    path = scratch_path(spark, "test-ids")
    idcoder.write_ids(edge_docs, path, BYTE)
    rows = idcoder.read_ids(spark, path, keep_ids=True).orderBy("start").collect()
    expected = sorted(EDGE_TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in rows] == [i for i, _ in expected]
    start = 0
    for r, (_, text) in zip(rows, expected):
        ids = whole(BYTE, text or "") + [0]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_files_without_rows_and_damaged_blocks(spark, no_docs):
    path = scratch_path(spark, "test-ids")
    idcoder.write_ids(no_docs, path, BYTE)
    assert idcoder.read_ids(spark, path).count() == 0
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    idcoder.write_ids(docs, path + "-a", BYTE)
    files = spark.read.parquet(path + "-a")
    files.selectExpr("part", "frame", "n_ids", "doc_ids", "doc_lengths", "block_lengths", "block_sums",
                     "transform(blocks, b -> cast('damaged' as binary)) AS blocks").write.parquet(path + "-b")
    with pytest.raises(Exception, match="checksum"):
        idcoder.read_ids(spark, path + "-b").collect()


# ---- the transducer

@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=fst.read_ranks(RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.one_of(ODD, st.text(max_size=40)))
def test_transducer_equals_library(tik, text):
    made, encoder, _ = fst.shared_transducer(RANKS, P.PATTERN)
    ids, _ = encoder(pa.array([text]))
    assert ids.tolist() == tik.encode_ordinary(text)
    assert "".join(fst.decode(ids, made.word_of)) == text


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(MIXED, st.lists(MIXED, max_size=6).map("\n".join)), max_size=5))
def test_transducer_on_pieces_cut_at_marks_and_lines_equals_library(tik, texts):
    flat, counts = fst.shared_transducer(RANKS, P.PATTERN)[1](pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    assert [flat[e - n:e].tolist() for e, n in zip(ends, counts)] == [tik.encode_ordinary(t) for t in texts]


def test_transducer_reads_a_word_once_whatever_mark_follows(tik):
    asked = []
    encoder = PieceEncoder(lambda texts: asked.extend(texts) or [tik.encode_ordinary(t) for t in texts])
    encoder(pa.array([" unreadably, unreadably. unreadably\nUnreadably!"]))
    assert sorted(asked) == sorted([" unreadably", ",", ".", "\n", "Unreadably", "!"])


def test_transducer_starts_anew_when_full(tik):
    made = fst.Transducer(fst.read_ranks(RANKS), most_states=20)
    for word in ("internationalization", " understandings", "zzzzzzzzqqqq", "日本語テキスト"):
        assert made.encode(word.encode()) == tik.encode_ordinary(word)


@settings(max_examples=100, deadline=None)
@given(data=st.one_of(st.binary(max_size=40), st.text(max_size=20).map(str.encode)), cut=st.integers(1, 5))
def test_streamed_decoding_equals_whole(data, cut):
    stream = fst.Utf8Stream()
    parts = [stream.feed(data[i:i + cut]) for i in range(0, len(data), cut)] + [stream.end()]
    try:
        assert "".join(parts) == data.decode()
    except UnicodeDecodeError:
        assert "�" in "".join(parts)


def test_transducer_edge_texts(edge_docs, no_docs, tik):
    rows = fst.encode_decode(edge_docs, RANKS, P.PATTERN, keep=True).collect()
    assert len(rows) == len(EDGE_TEXTS)
    text_of = dict(EDGE_TEXTS)
    for r in rows:
        text = text_of[r["doc_id"]] or ""
        ids = tik.encode_ordinary(text)
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), ids, text)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert fst.encode_decode(no_docs, RANKS, P.PATTERN).count() == 0
    random.seed(0)
