"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, size string"


def brute(rows, k=5, m=10, low=30, high=90):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = (label, [float(np.float32(x)) for x in v])
        kept[i] = min(kept.get(i, whole), whole)
    kept = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in kept.items() if i != a and len(w) == len(v))
        for p, i, _ in [s for s in scored if s[2] == label][:k]:
            inside = [(n, j) for n, j, other in scored if other != label and low * -p <= 100 * -n <= high * -p][:m]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(inside)]
    return sorted(out)


def answer(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, label, 0.0, "taken") for i, v, label in rows], SCHEMA).repartition(4)
    found = negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, **more)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found.collect())


def made(seed, n=900, dim=24, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, dim))
    label = rng.choice(labels, n, p=[0.6, 0.3, 0.07, 0.03])
    v = centres[label] * rng.choice([0.0, 0.5, 1.0], n)[:, None] + rng.standard_normal((n, dim)) * rng.choice([0.2, 1, 4], n)[:, None]
    return [(i, v[i].tolist(), int(label[i])) for i in range(n)]


@pytest.mark.parametrize("each", [60, 4096])
def test_equals_brute_force(spark, each):
    rows = made(5)
    rows += [(2000 + i, rows[i % 3][1], 1) for i in range(40)]                                    # ties
    rows += [(3000, None, 1), (3100, [1.0] * 24, None), (None, [1.0] * 24, 1), (3200, [float("nan")] * 24, 1), (3300, [1.0, None] * 12, 1),
             (3400, [], 2), (3500, [0.0] * 24, 2), (3600, [1.0, 2.0], 2), (3601, [1.0, 1.0], 2), (3602, [2.0, 1.0], 3), (3700, [float("inf")] * 24, 0),
             (7, rows[8][1], 3), (7, rows[7][1], 0), (100, rows[100][1], rows[100][2]), (3800, [1e9] * 24, 9), (3900, [1.0, 1.0, 1.0], 0)]
    want = brute(rows)
    assert any(r[2] == 10 for r in want) and len({r[0] for r in want}) > 5
    assert answer(spark, rows, rows_each=each) == want


def test_other_windows_and_counts(spark):
    rows = made(6, 400, 8)
    assert answer(spark, rows, positives=3, negatives=4, low=0, high=100, rows_each=50) == brute(rows, 3, 4, 0, 100)


def test_one_id_and_one_vector_on_a_third_of_the_rows(spark):
    rows = made(7, 600, 16)
    rows += [(7, rows[7][1], 2)] * 300 + [(10_000 + i, rows[11][1], 1) for i in range(400)]
    assert answer(spark, rows, rows_each=100) == brute(rows)


def test_few_or_no_rows(spark):
    assert answer(spark, []) == []
    assert answer(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert answer(spark, [(100, [1.0], 1)]) == []
    assert answer(spark, [(100, [1.0], 1), (2, [2.0], 1), (3, [1.0], 2)]) == [(100, 2, 1, 3, 131072, 65536)]


def test_scores_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        answer(spark, [(100, [1e12], 1), (2, [1e12], 1)])


def test_index_leaves_out_only_what_cannot_reach():
    rng = np.random.default_rng(1)
    rows, anchors = (np.floor(100 * rng.standard_normal((k, 40)) * np.linspace(3, 0.05, 40)) for k in (500, 30))
    scores = rows @ anchors.T
    longest = float(np.sqrt((anchors ** 2).sum(axis=1)).max())
    for quantile in (0.5, 0.9, 0.999):
        low = np.quantile(scores, quantile, axis=0).astype(np.int64)
        high = low + 200_000
        index = negatives.build(rows, longest, float(low.min()))
        r, a, s = negatives.matches(index, anchors, low, high, np.ones(scores.shape, bool))
        want = np.argwhere((scores >= low) & (scores <= high))
        assert sorted(zip(r.tolist(), a.tolist())) == sorted(map(tuple, want.tolist()))
        assert (scores[r, a] == s).all()
    assert (index.indexed < 40).any()
