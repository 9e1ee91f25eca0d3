"""Whitening against numpy on the exact integer vectors."""

import math

import numpy as np
import pytest

from reelrank.llm import whitening

ROWS = "vec_id long, embedding array<double>, n int, _rr_x string"


def _run(spark, rows, monkeypatch=None, **kw):
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], ROWS).repartition(4)
    return whitening.whiten(df, **kw).collect()


def _compare(got, rows, components=8):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    off = np.array([[n * a - b for a, b in zip(v, s)] for v in x], dtype=object)
    centred = (off / n).astype(float)
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    keep = sum(v > e[0] * 1e-10 for v in e[:components])
    assert len(got) == n * keep
    want = centred @ (u[:, :keep] / np.sqrt(e[:keep]))
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and abs(r.explained / (e[r.component - 1] / np.trace(cov)) - 1) < 1e-6 and r.identity_error < 1e-6
    dev = [sum(int(t) ** 2 for t in o) for o in off]
    for k in range(1, keep + 1):
        mine = sorted((r.vec_id, r.deviation, r.whitened) for r in by[k])
        sign = 1 if np.dot([w for _, _, w in mine], [want[i][k - 1] for i in sorted(range(n), key=lambda i: (rows[i][0], dev[i]))]) > 0 else -1
        plain = sorted((rows[i][0], dev[i] if dev[i] < 1 << 63 else None, sign * want[i][k - 1]) for i in range(n))
        assert [m[:2] for m in mine] == [p[:2] for p in plain]
        assert np.allclose([m[2] for m in mine], [p[2] for p in plain], atol=1e-6)


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.normal(size=12) * np.arange(1, 13) / 12).tolist()) for i in range(700)]
    _compare(_run(spark, rows), rows)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 12 * 40)
    monkeypatch.setattr(whitening, "COLUMNS_PER_BLOCK", 5)
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.normal(size=12) * np.arange(1, 13)).tolist()) for i in range(530)]
    _compare(_run(spark, rows), rows)


def test_fewer_directions_than_components(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), v := rng.normal(size=3).tolist()) for i in range(50)]
    _compare(_run(spark, rows), rows)
    flat = [(i, [float(i % 5), 0.0, float(-(i % 5))]) for i in range(20)]  # one direction
    _compare(_run(spark, flat), flat)


def test_odd_rows(spark):
    good = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [-0.4, 0.5]), (3, [0.9, -0.7]), (4, [0.0, 0.3])]
    odd = [(5, None), (6, []), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [1.0, float("-inf")]), (10, [1.0, 2.0, 3.0])]
    _compare(_run(spark, good + odd), good)
    assert _run(spark, odd[:5]) == [] and _run(spark, []) == []
    assert _run(spark, good[:1]) == [] and _run(spark, good[:2]) == []  # no variance
    assert {r.vec_id for r in _run(spark, [(None, [1.0, 0.0]), (3, [0.0, 1.0])])} == {None, 3}


@pytest.mark.parametrize("big", [2.0 ** 22, 2.0 ** 36, 2.0 ** 45])
def test_deviations_no_long_holds_are_null(spark, big):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-4, 5, 2) / 4 * big).tolist()) for i in range(12)]
    _compare(_run(spark, rows), rows)
