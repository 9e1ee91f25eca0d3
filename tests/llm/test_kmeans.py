"""Shallot k-means against plain k-means in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from reelrank.llm import kmeans

ROWS = "vec_id long, embedding array<double>, near int, _rr_x string"


def _plain(rows, k, rounds, dim):
    kept = [(i, [math.floor(e * 64) if abs(e) < 1e300 else math.floor(e) * 64 for e in v]) for i, v in rows
            if v is not None and len(v) == dim and all(e is not None and math.isfinite(e) for e in v)]
    key = lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [x for _, x in sorted(kept, key=key)[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        cents = [[sum(col) // len(mine) for col in zip(*mine)] if (mine := [x for (_, x), o in zip(kept, own) if o == n]) else c
                 for n, c in enumerate(cents)]
    got = [(i, *nearest(x)) for i, x in kept]
    fit = lambda s: s if s < 1 << 63 else None
    per = {n: sum(d for _, d, m in got if m == n) for n in range(k)}
    ok = {n: all(fit(d) is not None for _, d, m in got if m == n) for n in range(k)}
    total = fit(sum(per.values())) if all(ok.values()) else None
    return sorted(((i, n, fit(d), fit(per[n]) if ok[n] else None, total,
                    hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in got), key=repr)


def _run(spark, rows, k=4, rounds=3, dim=3):
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], ROWS).repartition(3)
    return sorted(map(tuple, kmeans.cluster(df, k=k, rounds=rounds, dim=dim).collect()), key=repr)


def test_against_plain(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(200)]  # many ties
    rows += [(int(i) + 500, rng.normal(size=3).tolist()) for i in range(100)]
    assert _run(spark, rows) == _plain(rows, 4, 3, 3)


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [1.0, 2.0]),
            (None, [1.0, 2.0, 3.0]), (7, [0.0, -0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0]), (8, [5.0, 5.0, 5.0])]
    got = _run(spark, rows)
    assert got == _plain(rows, 4, 3, 3) and len(got) == 5
    assert _run(spark, rows[:6]) == []
    assert _run(spark, [(1, [1.0, 1.0, 1.0])] * 3) == _plain([(1, [1.0, 1.0, 1.0])] * 3, 4, 3, 3)  # one place, three centroids


@pytest.mark.parametrize("big", [3e5, 1e6, 2.0 ** 40, 1e300, 1.7e308])
def test_wide_components(spark, big):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.integers(-4, 5, 3) / 4 * big).tolist()) for i in range(40)]
    assert _run(spark, rows) == _plain(rows, 4, 3, 3)


def test_more_clusters_than_vectors_and_one(spark):
    rows = [(i, [float(i), 0.0, 1.0]) for i in range(6)]
    assert _run(spark, rows, k=9) == _plain(rows, 9, 3, 3)
    assert _run(spark, rows, k=1) == _plain(rows, 1, 3, 3)


def test_bounds_and_ball_save_distances():
    rng = np.random.default_rng(3)
    k, n = 16, 4000
    x = (rng.normal(size=(k, 8)) * 400)[rng.integers(0, k, n)] + rng.normal(size=(n, 8)) * 40
    x = np.floor(x).astype(np.int64)
    at = x[rng.choice(n, k, replace=False)]
    near, second = np.zeros(n, np.int64), np.ones(n, np.int64)
    upper, lower = np.full(n, np.inf), np.zeros(n)
    moved, taken = np.zeros(k), []
    for _ in range(5):
        taken.append(kmeans.shallot(x, near, second, upper, lower, kmeans.Centroids(at, moved)))
        d = ((x[:, None] - at[None]) ** 2).sum(2)
        assert (near == d.argmin(1)).all()
        s = np.sort(np.sqrt(d), 1)
        assert (upper >= s[:, 0] * (1 - 1e-9)).all() and (lower <= s[:, 1] * (1 + 1e-9)).all()
        new = np.stack([x[near == c].sum(0) // max(1, (near == c).sum()) if (near == c).any() else at[c] for c in range(k)])
        moved, at = kmeans.moves(at, new), new
    # the first round knows no bounds, only the ball saves
    assert taken[0] < n * k and sum(taken[1:]) < 0.25 * 4 * n * k
