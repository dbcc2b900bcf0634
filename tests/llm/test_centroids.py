import hashlib
import random

import numpy as np
import pytest

from ledgerspark.llm import centroids as K

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, x string, distance string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "x", "d", "n") for i, v in rows], SCHEMA)


def brute(rows, k, rounds, dims=64):
    kept = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    def far(a, b):
        return sum((p - q) ** 2 for p, q in zip(a, b))
    cents = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    def near(v):
        return min(range(len(cents)), key=lambda c: (far(v, cents[c]), c))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        groups = [[v for c2, (_, v) in zip(own, kept) if c2 == c] for c in range(len(cents))]
        cents = [[sum(col) // len(g) for col in zip(*g)] if g else cents[c] for c, g in enumerate(groups)]
    out = [(i, near(v), far(v, cents[near(v)])) for i, v in kept]
    every = sum(s for *_, s in out)
    return sorted(
        (i is None, i or 0, c, s, sum(t for _, d, t in out if d == c), every, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
        for i, c, s in out
    )


def found(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("wide", [3, 1000, 1 << 40])
def test_nearest_equals_full_comparison(wide):
    rng = np.random.default_rng(wide)
    x, c = rng.integers(-wide, wide, (300, 5)), rng.integers(-wide, wide, (17, 5))
    c[9] = c[4]  # equal centroids: the smaller number wins
    far = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    number, best = K.nearest(x, c)
    assert number.tolist() == [min(range(17), key=lambda k: (f[k], k)) for f in far]
    assert best.tolist() == far.min(axis=1).tolist()


def test_walk_stops_early(monkeypatch):
    """With far centroids most exact distances are never taken."""
    rng = np.random.default_rng(5)
    c = np.arange(400)[:, None] * 1000 + rng.integers(0, 9, (400, 8))
    asked, take = [], np.nonzero
    monkeypatch.setattr(K.np, "nonzero", lambda a: (asked.append(int(a.sum())), take(a))[1])
    number, _ = K.nearest(c[::2] + 3, c)
    assert number.tolist() == list(range(0, 400, 2))
    assert sum(asked) < 0.05 * 200 * 400


def test_equals_brute_force(spark):
    rng = random.Random(8)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.4) for m in middles[i % 5 if i % 3 else 0]]) for i in range(200)]
    rows += [(1, rows[1][1]), (7, rows[30][1]), (None, rows[2][1])]  # repeated rows and ids, a null id
    assert found(K.cluster(frame(spark, rows).repartition(3))) == brute(rows, 8, 10)
    assert found(K.cluster(frame(spark, rows), k=3, rounds=1)) == brute(rows, 3, 1)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]  # eight centroids of two kinds: six stay empty
    assert found(K.cluster(frame(spark, rows))) == brute(rows, 8, 10)


def test_edge_rows(spark):
    good = [(i, [i / 7.0] * 64) for i in range(5)]
    bad = [(10, None), (11, []), (12, [1.0] * 63), (13, [1.0] * 65), (14, [1.0] * 63 + [None]), (15, [float("nan")] * 64), (16, [float("inf")] + [0.0] * 63),
           (17, [float("-inf")] + [0.0] * 63)]
    assert found(K.cluster(frame(spark, good + bad))) == brute(good, 8, 10)
    assert K.cluster(frame(spark, bad)).count() == 0 == K.cluster(frame(spark, [])).count()
    huge = K.cluster(frame(spark, [*good, (20, [1e300] * 64), (21, [-1e300] * 64)]), k=1).collect()
    assert len(huge) == 7 and all((r.distance is None) == (r.vec_id in (20, 21)) and r.inertia is None for r in huge)
    assert {r.cluster_inertia for r in huge} == {None}
    assert K.cluster(frame(spark, [(1, [1e300] * 64)])).first().distance == 0
