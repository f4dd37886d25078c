"""Removal of repeated byte strings against a plain loop, and the sort behind it."""

import numpy as np
import pyarrow as pa
import pytest

from tablewarden.llm import suffixes
from tablewarden.llm.deepsort import BlindTrie, Strings, deep_shallow


def brute(rows, length):
    """Rows by doc_id; a string is taken by a smaller doc_id, or by an earlier start in the same text."""
    starts = {}
    for i, text in rows:
        if i is not None and text:
            data = text.encode()
            for s in range(len(data) - length + 1):
                starts.setdefault(data[s:s + length], []).append((i, text, s))
    first = {body: (min(i for i, _, _ in all_), all_) for body, all_ in starts.items()}
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1) if i is not None else ():
            smallest, all_ = first[data[s:s + length]]
            if smallest < i or any(j == i and t == text and r < s for j, t, r in all_):
                gone[s:s + length] = True
        spans = int((np.diff(np.append(0, gone.astype(np.int8))) == 1).sum())
        out.append((i, text, len(data), int(gone.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~gone])))
    return sorted(map(repr, out))


def answer(spark, rows, length, block=suffixes.BLOCK):
    docs = spark.createDataFrame([(i, t, "kept", 5) for i, t in rows], "doc_id long, text string, other string, n_bytes int").repartition(3)
    done = suffixes.remove_repeats(docs, length, block)
    assert done.columns == ["doc_id", "text", "other", "n_bytes", "n_removed", "n_spans", "kept"]
    return sorted(map(repr, ((r["doc_id"], r["text"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in done.collect())))


def texts(seed, n, length):
    """Texts that share passages whole, cut, one behind the other, and with single changes."""
    rng = np.random.default_rng(seed)
    letters = list("abcd ñ日")
    passages = ["".join(rng.choice(letters, int(rng.integers(length // 2, 4 * length)))) for _ in range(6)] + ["a" * 3 * length, "ab" * length]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            p = passages[rng.integers(len(passages))]
            kind = rng.integers(4)
            if kind == 1:
                a, b = sorted(rng.integers(0, len(p) + 1, 2))
                p = p[a:b]
            elif kind == 2 and p:
                k = int(rng.integers(len(p)))
                p = p[:k] + "X" + p[k + 1:]
            parts.append(p if kind != 3 else "".join(rng.choice(letters, int(rng.integers(1, length)))))
        rows.append((int(rng.integers(0, 3 * n)), "".join(parts)))
    return rows


@pytest.mark.parametrize("length,block", [(24, 4096), (40, 7), (100, 4096)])
def test_equals_brute_force(spark, length, block):
    rows = texts(length, 70, length) + [(None, "a" * 300), (None, "a" * 300), (5, None), (6, ""), (7, "a" * (length - 1)), (8, "a" * length), (9, "a" * (length + 1)),
                                        (-3, "ab" * 200), (50, "same row " * 30), (50, "same row " * 30), (50, "other same row " * 30)]
    assert answer(spark, rows, length, block) == brute(rows, length)


def test_one_passage_in_very_many_contexts(spark):
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefgh "), 90))
    around = ["".join(rng.choice(list("abcdefgh "), 40)) for _ in range(400)]
    rows = [(i, around[i] + passage + around[(7 * i) % 400]) for i in range(400)]
    want = brute(rows, 60)
    assert answer(spark, rows, 60, 32) == want and answer(spark, rows, 60) == want


def test_parts_of_a_text_hold_each_window_once():
    text = "".join(np.random.default_rng(4).choice(list("abcdefgh "), 1900))
    for row in (text + "x" * 5000 + text, "y" + text[300:900], "x" * 120, "short"):
        _, data, offsets = suffixes.as_bytes(pa.array([row]))
        covered = np.zeros(len(data), int)
        for c in range(0, max(len(data) - 99, 1), 1400):
            stop = min(c + 1499, len(data))
            _, first, windows, *_ = suffixes.runs(data[c:stop], np.clip(offsets, c, stop) - c, 100)
            for f, w in zip(first + c, windows):
                covered[f:f + w] += 1
        assert (covered == (np.arange(len(data)) <= len(data) - 100)).all()


def test_very_long_text(spark):
    text = "".join(np.random.default_rng(1).choice(list("abcdefghijklm "), 3_000_000))
    rows = [(1, text), (2, "b" * 5_000_000), (3, "start " + text[1_000_000:2_500_000] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixes.remove_repeats(docs).select("doc_id", "n_removed", "n_spans").collect()}
    assert got[1] == (0, 0) and got[2] == (4_999_999, 1) and got[3][1] == 1 and 1_500_000 <= got[3][0] <= 1_500_004


def test_empty_table_and_bounds(spark, no_docs):
    assert suffixes.remove_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeats(no_docs, 10)


def test_deep_shallow_order_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        base = [bytes(rng.integers(0, 3, 60).astype(np.uint8)) for _ in range(4)]
        made = [base[rng.integers(4)][:rng.integers(60)] + bytes(rng.integers(0, 3, int(rng.integers(30))).astype(np.uint8)) for _ in range(n)]
        group = np.sort(rng.integers(0, 4, n))
        size = np.array([len(m) for m in made])
        strings = Strings(np.frombuffer(b"".join(made) + b"end", np.uint8), np.cumsum(size) - size, size)
        order, shared = deep_shallow(strings, group, int(rng.choice([8, 16, 32])))
        assert [(group[i], made[i]) for i in order] == sorted(zip(group, made))
        for k in range(1, n):
            a, b = made[order[k - 1]], made[order[k]]
            if group[order[k - 1]] == group[order[k]]:
                assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            else:
                assert shared[k] == -1


def test_blind_trie_orders_equal_and_ended_strings():
    texts_ = [b"abc", b"", b"ab", b"abc", b"abd", b"\x00", b"ab\x00", b"\xff"]
    assert [texts_[i] for i in BlindTrie(texts_).sorted()] == sorted(texts_)
