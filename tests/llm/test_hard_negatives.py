"""Hard negatives against all inner products."""

import math

import numpy as np
import pytest

from carelens.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id string, rank int"


def brute(rows, anchors, positives=5, negatives=5, percent=80):
    ok = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [max(-hn.LIMIT, min(hn.LIMIT, math.floor(256 * float(np.float32(x))))) for x in v]
        ok[i] = min(ok.get(i, (label, q)), (label, q))
    out = []
    for a in ok:
        if not anchors(a):
            continue
        s = {i: sum(x * y for x, y in zip(ok[a][1], q, strict=False)) for i, (_, q) in ok.items() if i != a}
        first = sorted((-s[i], i) for i in s if ok[i][0] == ok[a][0])[:positives]
        for p, i in first:
            band = sorted((-s[j], j) for j in s if ok[j][0] != ok[a][0] and -percent * p <= 100 * s[j] <= -100 * p)
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(band[:negatives])]
    return sorted(out)


def vectors(seed=1, n=600, dims=16, spread=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dims))
    at = rng.integers(0, 12, n)
    v = centre[at] + spread * rng.normal(size=(n, dims))
    v = (v * rng.uniform(0.2, 2, (n, 1))).astype(np.float32)
    return [(i, v[i].tolist(), int(at[i] % 4)) for i in range(n)]


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


def got(df):
    return sorted(tuple(r) for r in df.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_equal_to_all_products(spark):
    rows = vectors()
    assert got(hn.mine(frame(spark, rows), hn.F.col("id") % 10 == 0)) == brute(rows, lambda a: a % 10 == 0)


def test_awkward_rows(spark):
    rows = vectors(seed=2, n=200)
    rows += [(None, [1.0] * 16, 1), (300, None, 1), (301, [1.0] * 16, None), (302, [float("nan")] + [1.0] * 15, 1),
             (303, [float("inf")] + [1.0] * 15, 1), (304, [None] + [1.0] * 15, 1), (310, [], 2), (311, [0.5], 2),
             (312, [0.0] * 16, 3), (320, [1e30] * 16, 3), (320, [1e30] * 16, 3), (50, [1.0] * 16, 0), (330, [-1.0] * 16, 9)]
    assert got(hn.mine(frame(spark, rows), hn.F.col("id") % 10 == 0)) == brute(rows, lambda a: a % 10 == 0)


def test_hot_vector_ties_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "CLUSTER_ANCHORS", 7)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 20)
    rows = vectors(seed=3, n=300)
    same = rows[0][1]
    rows += [(1000 + i, same, i % 3) for i in range(200)]  # a hot vector in all labels but one
    assert got(hn.mine(frame(spark, rows), hn.F.col("id") % 10 == 0)) == brute(rows, lambda a: a % 10 == 0)


def test_empty_tables(spark):
    assert got(hn.mine(frame(spark, []), hn.F.col("id") % 10 == 0)) == []
    assert got(hn.mine(frame(spark, vectors(n=9)[1:]), hn.F.col("id") % 100 == 0)) == []


@pytest.mark.parametrize("spread", [0.1, 0.4])
def test_walk_stops_early_and_loses_nothing(spread):
    rows = vectors(seed=4, n=4000, dims=32, spread=spread)
    v = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float))
    some = np.arange(0, 4000, 100)
    centre = hn.centroids(v[some])
    cluster = np.argmax(v[some] @ centre.T, axis=1)
    block = hn.Block(some, np.zeros(len(some), int), v[some], cluster, centre)
    best = hn.Best(len(some), 5)
    need = np.full(len(some), -np.inf)

    def take(m, scores, part):
        best.add(m, scores, part)
        need[m] = best.kth(m)

    done = hn.walk(block, v, need, take)
    for m in range(len(some)):
        p = v @ block.vectors[m]
        assert [(-s, i) for s, i in best.rows[m]] == [(p[i], i) for i in np.lexsort((np.arange(4000), -p))[:5]]
    assert done < 0.6 * len(some) * 4000
