"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import ann, mips
from tablewarden.llm.common import table

def asked():
    return F.col("vec_id") % 100 == 0


SCHEMA = "vec_id long, embedding array<float>, score double"


def rows_of(spark, seed=1, n=700):
    rng = np.random.default_rng(seed)
    made = [(i, (rng.standard_normal(12) * rng.choice([0.1, 1, 5])).astype("float32").tolist(), 0.0) for i in range(n)]
    made += [(1000, made[7][1], 0.0), (1001, made[7][1], 0.0), (900, made[7][1], 0.0)]                       # ties
    made += [(1100, None, 0.0), (1101, [], 0.0), (1102, [1.0, None] * 6, 0.0), (1103, [float("nan")] * 12, 0.0), (1104, [float("inf")] * 12, 0.0),
             (1200, [0.0] * 12, 0.0), (None, [1.0] * 12, 0.0), (1300, [1.0, 2.0], 0.0), (1301, [2.0, 2.0], 0.0), (5, made[5][1], 0.0)]
    return made, spark.createDataFrame(made, SCHEMA).repartition(4)


def usable(rows, zero):
    out = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = np.array(v, "float32").astype(float)
    return out


def brute(vectors, score, best):
    out = {}
    for q, v in vectors.items():
        if q % 100 == 0:
            found = sorted((best * score(v, w), i) for i, w in vectors.items() if i != q and len(w) == len(v))[:10]
            out[q] = [(i, best * s) for s, i in found]
    return out


def answer(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("each", [90, 8192])
def test_products_equal_brute_force(spark, each):
    rows, frame = rows_of(spark)
    whole = {i: [int(x) for x in np.floor(v * 1024)] for i, v in usable(rows, True).items()}
    want = brute(whole, lambda a, b: sum(x * y for x, y in zip(a, b)), -1)
    assert answer(mips.top_products(frame, asked(), rows_each=each)) == {q: f for q, f in want.items() if f}


def test_pruning_keeps_all_that_reach_the_floor():
    rng = np.random.default_rng(3)
    m = rng.standard_normal((2000, 6)) * rng.random((2000, 1))
    m = m[np.argsort(-np.linalg.norm(m, axis=1))]
    size = np.linalg.norm(m, axis=1)
    pruned = 0
    for q in m[::100]:
        for floor in np.quantile(m @ q, [0.2, 0.9, 0.99, 0.999]):
            rows = mips.candidates(m, size, q, float(floor))
            assert set(np.flatnonzero(m @ q >= floor)) <= set(rows.tolist())
            pruned += len(m) - len(rows)
    assert pruned > 0


def test_large_numbers_stay_exact():
    big = np.array([[2.0 ** 40, 3.0], [2.0 ** 62, 2.0 ** 62]])
    assert mips.products(big[:1], np.array([2.0 ** 20, 1.0])).tolist() == [2 ** 60 + 3]
    with pytest.raises(OverflowError):                     # a capped product would tie with others
        mips.products(big, np.array([2.0 ** 20, 1.0]))


@pytest.mark.parametrize("each", [90, 8192])
def test_neighbours_recall_and_scores(spark, each):
    rows, frame = rows_of(spark, 2)
    want = brute(usable(rows, False), lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), 1)
    got = answer(ann.nearest(frame, asked(), rows_each=each))
    assert set(got) == {q for q, f in want.items() if f}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    assert hits >= 0.98 * sum(map(len, want.values()))
    vectors = usable(rows, False)
    for q, found in got.items():
        assert len(found) == len(want[q])
        for i, s in found:
            assert s == np.sqrt(((vectors[i] - vectors[q]) ** 2).sum())


@pytest.mark.parametrize("each", [90, 8192])
def test_rows_of_one_id_hide_no_neighbours(spark, each):
    rng = np.random.default_rng(4)
    at, others = rng.standard_normal(64), rng.standard_normal((300, 64))
    made = [(100, at.astype("float32").tolist(), 0.0)]
    made += [(7, (at + 0.01 * rng.standard_normal(64)).astype("float32").tolist(), 0.0) for _ in range(25)]
    made += [(1001 + i, v.astype("float32").tolist(), 0.0) for i, v in enumerate(others) if (1001 + i) % 100]
    frame = spark.createDataFrame(made, SCHEMA).repartition(4)
    nearest, q = {}, np.array(made[0][1], "float32").astype(float)
    for i, v, _ in made[1:]:
        s = float(np.sqrt(((np.array(v, "float32").astype(float) - q) ** 2).sum()))
        nearest[i] = min(s, nearest.get(i, s))
    want = sorted((s, i) for i, s in nearest.items())[:10]
    assert answer(ann.nearest(frame, asked(), rows_each=each)) == {100: [(i, s) for s, i in want]}


def test_recall_on_the_table(spark):
    frame = table(spark, "/root/testdata/sf0.1", "embeddings")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in frame.collect()}
    want = brute(vectors, lambda a, b: float(((a - b) ** 2).sum()), 1)
    got = answer(ann.nearest(frame, asked()))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)


def test_error_bound_holds():
    rng = np.random.default_rng(8)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal(64)
    unit, turned = x / np.linalg.norm(x, axis=1)[:, None] @ ann.rotation(64).T, ann.rotation(64) @ (q / np.linalg.norm(q))
    fit = np.abs(unit).sum(axis=1) / 8
    estimate = np.where(unit > 0, 1, -1) @ turned / 8 / fit
    error = ann.WIDTH * np.sqrt(1 - fit ** 2) / np.sqrt(63) / fit
    assert (np.abs(estimate - unit @ turned) <= error).mean() > 0.999


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(none, asked()).count() == 0 and mips.top_products(none, asked()).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0], 0.0)], SCHEMA)
    assert ann.nearest(one, asked()).count() == 0 and mips.top_products(one, asked()).count() == 0
