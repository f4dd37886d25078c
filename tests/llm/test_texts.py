"""Language, quality, near copies, repeated passages and main text against brute force and edge rows."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import html_text, langid, near, quality, substrings, words
from tablewarden.llm.common import held_out, table
from tablewarden.llm.components import components

from .conftest import EDGE_TEXTS
from .hand_pages import made_pages

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_words_are_hashed_alike_in_parts(monkeypatch):
    texts = pa.array(["some words of a text", None, "", "a" * 40 + " b " + "c" * 7 + "  d", "ä" * 30, "words of a"])
    found = words.find_words(texts)
    want = [found.hashes(k).tolist() for k in (0, 1)]
    for size in (1, 3, 7, 8, 40, 64):
        monkeypatch.setattr(words, "PART_BYTES", size)
        assert [found.hashes(k).tolist() for k in (0, 1)] == want
    assert want[0][-3:] == [want[0][k] for k in (1, 2, 3)]              # "words of a" again


@pytest.mark.parametrize("text", ["seven77 " * 2_500_000, "x" * 20_000_000])
def test_hashing_a_long_text_takes_little_memory(text):
    found = words.find_words(pa.array([text]))
    tracemalloc.start()
    assert len(found.hashes()) == len(text.split())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250_000_000                              # a sum and powers over all bytes alone would be 480 MB


def test_held_out_is_crc32_of_the_id(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), held_out().alias("h")).collect()
    assert all(r["h"] == held(r["doc_id"]) for r in rows)


# ---- language

def test_language_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    found = langid.identify(docs, langid.train(docs)).where(held_out()).select("lang", "lang_pred", "accepted", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98 and np.mean([r["accepted"] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edge_rows(spark, edge_docs, no_docs):
    learned = {"en": b"the quick brown fox jumps over the lazy dog " * 20, "de": "der schnelle braune fuchs springt über den hund ".encode() * 20}
    rows = {r["doc_id"]: r for r in langid.identify(edge_docs, learned).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 and not rows[i]["accepted"] for i in (2, 3, 4, 5))
    assert rows[1]["lang_pred"] == "en" and rows[1]["accepted"] and rows[7]["score"] == rows[1]["score"]
    assert set(edge_docs.columns) | {"margin", "accepted"} == set(langid.identify(edge_docs, learned).columns)
    assert langid.identify(edge_docs, {}).where("lang_pred <> 'und' or accepted").count() == 0
    assert langid.train(no_docs) == {} and langid.identify(no_docs, learned).count() == 0


def test_language_learns_only_from_its_rows(spark):
    docs = [i for i in range(400) if held(i)]
    frame = spark.createDataFrame([(i, "abc def ghi", "xx") for i in docs] + [(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.train(frame) == {}


def test_language_rejects_mixed_and_unlearned_texts(spark):
    docs = table(spark, SF, "documents")
    own = collections.defaultdict(list)
    for r in docs.where(held_out() & (F.length("text") > 600)).orderBy("doc_id").collect():
        own[r["lang"]].append(r["text"])
    mixed = [a[:n] + " " + b[:n] for x, y in (("en", "de"), ("fr", "es"), ("de", "fr")) for n in (300, 600) for a, b in zip(own[x][:15], own[y][:15])]
    draw = random.Random(3)
    noise = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 10))) for _ in range(n)) for n in (5, 20, 100, 400) for _ in range(25)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(mixed + noise)], "doc_id long, text string").repartition(4)
    accepted = {r["doc_id"]: r["accepted"] for r in langid.identify(frame, langid.train(docs)).collect()}
    assert len(mixed) > 50 and np.mean([accepted[i] for i in range(len(mixed))]) < 0.4
    assert np.mean([accepted[i] for i in range(len(mixed), len(accepted))]) < 0.05


def test_language_learns_from_all_of_a_text(spark):
    free = [i for i in range(300) if not held(i)]
    frame = spark.createDataFrame([(i, "heading " * 50 + f"inside{i} " * 200, "xx") for i in free] + [(1000 + i, "short words", "yy") for i in free],
                                  "doc_id long, text string, lang string")
    learned = langid.train(frame, texts=16, text_chars=200)
    assert learned["xx"].count(b"inside") > learned["xx"].count(b"heading") and len(learned["xx"]) <= 16 * 201
    assert set(learned["yy"].split()) == {b"short", b"words"} and learned == langid.train(frame.repartition(7), texts=16, text_chars=200)


# ---- quality

def test_quality_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = quality.classify(docs, quality.train(docs, labels)).where(held_out()).join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.95


def test_quality_rules_equal_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.random((900, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7)).astype(float)
    model = quality.fit(x, y, ["a", "b", "c"])
    frame = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = np.array([r[0] for r in frame.select(model.score({n: F.col(n) for n in "abc"})).collect()])
    total = np.full(len(x), model.intercept)
    for rule, weight in zip(model.rules, model.weights):
        total += weight * np.logical_and.reduce([(x[:, i] > at) if above else (x[:, i] <= at) for i, above, at in rule])
    assert np.allclose(got, 1 / (1 + np.exp(-total))) and np.mean((got >= 0.5) == y) > 0.97
    assert 0 < len(model.rules) < 200


def test_quality_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(edge_docs, labels)
    rows = quality.classify(edge_docs, model).collect()
    assert len(rows) == len(EDGE_TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    score = collections.defaultdict(set)
    for r in rows:
        score[dict(EDGE_TEXTS)[r["doc_id"]] or ""].add(r["score"])
    assert all(len(s) == 1 for s in score.values())
    nothing = quality.train(no_docs, labels.limit(0))
    assert quality.classify(no_docs, nothing).count() == 0
    assert quality.classify(edge_docs, nothing).where("predicted = 0").count() == 0


# ---- near copies

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_near(rows, threshold=0.8):
    sets = [(i, shingles(t)) for i, t in rows]
    parent, links = {i: i for i, _ in rows}, collections.Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and len(s & t) >= threshold * len(s | t) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: (top(i), links[i]) for i, _ in rows}


def family(n, seed, words=60, changes=12):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(changes)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block", [7, 768])
def test_near_equals_brute_force(spark, block):
    texts = [*family(40, 1, changes=6), *family(40, 2), *family(10, 3, words=7), *["a b", "a b", "a b c", "", None, "q " * 50, "q " * 70]]
    rows = list(enumerate(texts, 100))
    random.Random(4).shuffle(rows)
    got = near.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=block).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute_near(rows)


def test_near_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.similar(docs).collect()} == brute_near(rows)


def test_near_edge_rows(edge_docs, no_docs):
    rows = near.similar(edge_docs).collect()
    assert len(rows) == len(EDGE_TEXTS)
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["class_id"], r["n_links"]))
    assert by[1] == {(1, 2)} and by[7] == {(1, 2)} and by[2] == {(2, 0)} and by[3] == {(3, 0)} and by[None] == {(None, 0)}
    assert near.similar(no_docs).count() == 0


def test_least_matches_keeps_true_pairs():
    for n, least in near.least_matches(0.8, 1e-6):
        rng = np.random.default_rng(n)
        assert (rng.binomial(n, 0.8, 100_000) < least).mean() < 2e-5 and least > 0.25 * n


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (5, 5), (102, 100)]
    random.Random(1).shuffle(pairs)
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 1 for i in range(2, 61)}, 101: 100, 102: 100}


# ---- repeated passages

def brute_passages(rows, size):
    first, out = {}, {}
    for i, text in sorted(rows):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first.setdefault(tuple(w[k:k + size]), i) < i:
                gone[k:k + size] = [True] * size
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("size", [3, 12, 50])
def test_passages_equal_brute_force(spark, size):
    rng = random.Random(size)
    passages = [[f"p{rng.randrange(40)}" for _ in range(rng.randrange(size - 1, 3 * size))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(30))]
            words += rng.choice(passages)[rng.randrange(3):]
        rows.append((i, " ".join(words)))
    rows += [(60, rows[5][1]), (61, None), (62, ""), (63, "same " * 200), (64, "same " * 150)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute_passages(rows, size)


def test_covers():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substrings.period_for(50) == 31


def test_passages_edge_rows(edge_docs, no_docs):
    kept = substrings.remove_repeats(edge_docs.withColumn("around", F.lit(1)).withColumn("starts", F.lit("mine")))
    assert {(r["around"], r["starts"]) for r in kept.collect()} == {(1, "mine")}
    cut = substrings.remove_repeats(edge_docs)
    assert set(cut.columns) == set(edge_docs.columns) | {"n_removed", "kept"}
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert rows[6]["n_removed"] == 0 and rows[6]["n_words"] == 30_000 and rows[2]["kept"] == "" and rows[None]["n_removed"] == 0
    assert cut.count() == len(EDGE_TEXTS) and substrings.remove_repeats(no_docs).count() == 0


def test_passage_query_digest(spark):
    from tablewarden.llm.queries import QUERIES
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = {i: (n, r, hashlib.sha256(k.encode()).hexdigest()) for i, (n, r, k) in brute_passages(rows, 50).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op2_repeated_passages"](spark, SF).collect()}
    assert got == want and sum(r for _, r, _ in want.values()) > 0


# ---- main text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li>News</li></ul></nav><div class="ad">Buy this now</div>
<article><h1>A head &lt;line&gt;</h1><p><b>First   para<br>goes&nbsp;on</b><p>Second &copy para, wi<i>th</i> a tail.</p><!-- <p>hidden</p> -->
</article><footer>&copy; someone</footer></body></html>"""


def test_leaves():
    got = [(leaf.path[-1], leaf.text) for leaf in html_text.leaves(PAGE)]
    assert got == [("title", "T & t"), ("li", "Home"), ("li", "News"), ("div ad", "Buy this now"), ("h1", "A head <line>"),
                   ("p", "First para goes on"), ("p", "Second © para, with a tail."), ("footer", "© someone")]
    assert html_text.leaves(None) == [] and html_text.leaves("") == [] and html_text.leaves("<p>") == []
    assert [leaf.text for leaf in html_text.leaves("a < b <c d='>' \n <script>")] == ["a < b"]


def test_gradients():
    rng = np.random.default_rng(0)
    x, y, mask = rng.standard_normal((3, 4, html_text.INPUTS)), rng.integers(0, 2, (3, 4)).astype(float), np.ones((3, 4), bool)
    mask[1, 2:] = False
    w = html_text.new_weights()

    def loss():
        both = np.concatenate([html_text._run(x, mask, w, s) for s in "fb"], axis=2)
        p = html_text._sigmoid(both @ w["V"] + w["c"])
        return -(np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0)).sum() / mask.sum()
    grad = html_text._gradients(x, y, mask, w)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        down = loss()
        w[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-6


def test_main_text_of_pages(spark):
    pages = table(spark, SF, "pages")
    weights = html_text.train(pages)
    got = {r["page_id"]: r for r in html_text.extract(pages, weights).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(leaf.text for leaf in html_text.leaves(inside))
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    edge = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<nav>menu</nav>", "x"), (4, "u", PAGE, "x"), (4, "u", PAGE, "x")],
                                 "page_id long, url string, html string, text string")
    rows = html_text.extract(edge, weights).collect()
    text = "A head <line> First para goes on Second © para, with a tail."
    assert sorted((r["page_id"], r["text"]) for r in rows) == [(1, ""), (2, ""), (3, ""), (4, text), (4, text)]
    assert html_text.extract(edge.limit(0), html_text.train(edge.limit(0))).count() == 0


def test_main_text_of_held_out_and_hand_made_pages(spark):
    pages = table(spark, SF, "pages")
    mine = F.crc32(F.col("page_id").cast("string").cast("binary")) % 4 == 2
    weights = html_text.train(pages.where(~mine))
    for r in html_text.extract(pages.where(mine), weights).join(pages.select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(leaf.text for leaf in html_text.leaves(inside))
    made = list(made_pages())
    frame = spark.createDataFrame([(i, None, page) for i, (page, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(frame, weights).collect()}
    right = sum(got[i] == " ".join(leaf.text for leaf in html_text.leaves(inside)) for i, (_, inside) in enumerate(made))
    assert right >= 0.95 * len(made) and len(made) >= 40


def test_unseen_layouts():
    rng = random.Random(5)
    main = [[f"Sentence {k} of text number {n}, with some more words in it." * rng.randint(1, 4) for k in range(12)] for n in range(30)]
    chrome = [f"short {n}" if n % 2 else f"Some longer words {n} on the side of the page." for n in range(60)]

    def pages(n, draw):
        made = [html_text.laid_out(draw.choice(main), chrome, draw) for _ in range(n)]
        return [html_text.vectors(p) for p, _ in made], [np.array(y, float) for _, y in made]
    weights = html_text.fit(*pages(300, rng))
    x, y = pages(80, random.Random(6))
    wrong = sum(((p >= 0.5) != t).sum() for p, t in zip(html_text.chances(x, weights), y))
    assert wrong / sum(map(len, y)) < 0.06


def test_main_text_learns_from_whole_pages(spark, monkeypatch):
    page = ("<html><body><article>" + "".join(f"<p>paragraph {i} of a long page</p>" for i in range(100)) + "</article><section class='comments'>"
            + "".join(f"<p>comment {i}</p>" for i in range(20)) + "</section><footer>the end</footer></body></html>")
    seen = []
    monkeypatch.setattr(html_text, "fit", lambda x, y, **_: seen.append((x, y)) or {})
    html_text.train(spark.createDataFrame([(page,)], "html string"), sample=4)
    x, y = seen[0]
    real = list(zip(x, y))[:-4 * html_text.LAYOUTS]                   # the made layouts come last
    assert [len(p) for p, _ in real] == [121] and real[0][1].tolist() == [1] * 100 + [0] * 21
    told = [None if i == 90 else True for i in range(170)]
    got = [(p[0].text, len(t)) for p, t in html_text.pieces([html_text.Leaf((), str(i)) for i in range(170)], told, 512, 80)]
    assert got == [("0", 80), ("160", 10)]
