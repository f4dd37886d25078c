"""Fill-in-middle against plain Python."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import fim

TEXTS = [None, "", "one line", "a\nb\nc\n", "\n\n\n", "no end\nhere", "ñandú\n日本語\n😀 end\nx", "é" * 300 + "\n" + "y" * 300 + "\n😀", "holds <M> mark\n",
         "almost < S>\n<<\nP>", "tail <\nS>\nx\n", "crlf\r\nnext\r\n", "word " * 200_000 + "\n" + "日本\n" * 50_000, " sep\x0bnot\x0ca\x85line\n"]


def plain(doc_id, text, unit, rate, spm, markers):
    p, s, m = markers
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "lines" else list(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(k in text for k in markers) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(x), len(y), s + z + p + x + m + y
    return len(units), "psm", len(x), len(y), p + x + s + z + m + y


@pytest.mark.parametrize("unit,rate,spm,markers", [("lines", 100, 50, fim.MARKERS), ("chars", 100, 50, fim.MARKERS), ("lines", 60, 10, ("<pre>", "<suf>", "<mid>"))])
def test_equals_plain_python(spark, unit, rate, spm, markers):
    rows = [(i, t) for k, t in enumerate(TEXTS) for i in (k, 100 + k, -k, 10 ** 15 + k)] + [(None, "x\ny\n"), (3, "a\nb\nc\n"), (3, "other\n")]
    docs = spark.createDataFrame([(i, t, "taken", 5, "mine") for i, t in rows], "doc_id long, text string, form string, n int, extra string").repartition(3)
    done = fim.restore(fim.fill_in_middle(docs, unit, rate=rate, spm=spm, markers=markers), markers)
    got = sorted(map(repr, ((r["doc_id"], r["text"], r["extra"], r["restored"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])
                            for r in done.collect())))
    want = sorted(map(repr, ((i, t, "mine", t or "", *plain(i, t, unit, rate, spm, markers)) for i, t in rows)))
    assert got == want
    assert set(done.columns) == {"doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output", "restored"}


def test_exceptions_convert_both_ways():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("ab\nñ日😀"), 4000))
    _, data, _ = fim.as_bytes(pa.array([text]))
    index = fim.Exceptions.of(data)
    cuts = np.arange(len(text) + 1)
    at = np.array([len(text[:c].encode()) for c in cuts])
    assert (index.to_bytes(cuts) == at).all() and (index.to_points(at) == cuts).all()
    assert len(index.places) == sum(ord(c) > 127 for c in text)


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("ab", "ba", "x"), ("aba", "q", "x"), ("", "q", "x"), ("<P>", "P", "x")])
def test_markers_that_cannot_be_told_apart(markers):
    with pytest.raises(ValueError):
        fim.check_markers(markers)


def test_empty_table_and_bad_outputs(spark, no_docs):
    assert fim.restore(fim.fill_in_middle(no_docs)).count() == 0
    odd = spark.createDataFrame([(None, "psm"), ("x", None), ("x", "unknown")], "output string, form string")
    assert [r["restored"] for r in fim.restore(odd).collect()] == [None, None, None]
    bad = spark.createDataFrame([("no markers", "psm")], "output string, form string")
    with pytest.raises(Exception, match="without its markers"):
        fim.restore(bad).select(F.length("restored")).collect()
