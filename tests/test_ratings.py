"""Neighbourhood recommenders: brute force, regression anchors, error path."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reelrank.operators import evaluate as ev
from reelrank.operators import ratings as rt
from reelrank.operators import recommend as rc
from reelrank.plans import fixtures as fx

from .conftest import SF001, SF01


def _f_test(r):
    # the survey's modulo fixture, used only as a regression anchor here
    return r.where(F.col("movie_id") % 50 == 7).select("movie_id", "user_id")


def _brute(ratings_rows, test_rows):
    """Direct evaluation of the two formulas on Python dicts."""
    by_user = defaultdict(dict)
    by_movie = defaultdict(dict)
    for u, m, r in ratings_rows:
        by_user[u][m] = r
        by_movie[m][u] = r

    def mean(u):
        rs = by_user[u]
        return sum(rs.values()) / len(rs) if rs else 0

    def cos(u, v, skip):
        a = {m: r for m, r in by_user[u].items() if m != skip}
        b = {m: r for m, r in by_user[v].items() if m != skip}
        common = [m for m in a if m in b]
        num = sum(a[m] * b[m] for m in common)
        n1 = sum(a[m] ** 2 for m in common)
        n2 = sum(b[m] ** 2 for m in common)
        return num / (math.sqrt(n1) * math.sqrt(n2)) if n1 + n2 > 0 else 0

    def rel(u, v):
        common = [m for m in by_user[u] if m in by_user[v]]
        return sum(by_user[u][m] for m in common) / len(common) if common else 0

    gl, sh = {}, {}
    for m, u in test_rows:
        co = {v: r for v, r in by_movie[m].items() if v != u}
        s1 = s2 = n = 0.0
        t1 = t2 = 0.0
        for v, vote in co.items():
            w = cos(u, v, m)
            s1 += (vote - mean(v)) * w
            n += abs(w)
            t1 += abs(w) * rel(u, v)
            t2 += w * (vote - rel(v, u))
        if n:
            gl[(m, u)] = mean(u) + s1 / n
            sh[(m, u)] = t1 / n + t2 / n
    return gl, sh


def test_brute_force_sf0001(spark):
    r = fx.ratings(spark, SF001).cache()
    t = _f_test(r)
    rows = [(x.user_id, x.movie_id, x.rating) for x in r.collect()]
    trows = [(x.movie_id, x.user_id) for x in t.collect()]
    assert len(trows) == 106
    gl_b, sh_b = _brute(rows, trows)
    gl = {(x.movie_id, x.user_id): x.raw for x in rc.group_lens(r, t).collect()}
    sh = {(x.movie_id, x.user_id): x.raw for x in rc.shw(r, t).collect()}
    assert gl.keys() == gl_b.keys() and sh.keys() == sh_b.keys()
    for k in gl:
        assert gl[k] == pytest.approx(gl_b[k], abs=1e-9)
        assert sh[k] == pytest.approx(sh_b[k], abs=1e-9)


def test_rmse_anchors_sf001(spark):
    r = fx.ratings(spark, SF01).cache()
    t = _f_test(r).cache()
    out = {}
    for name, fn, excl in [("gl", rc.group_lens, False), ("shw", rc.shw, False),
                           ("gl_x", rc.group_lens, True), ("shw_x", rc.shw, True)]:
        m = ev.rmse(fn(r, t, exclude_target=excl), r, t).collect()[0]
        out[name] = (m.n_pred, round(m.rmse, 4))
    assert out["gl"] == (1228, 1.4159)
    assert out["shw"] == (1228, 0.8961)
    assert out["gl_x"][1] == 1.4348
    assert out["shw_x"][1] == 1.5333


def test_error_path_sparse(spark):
    r = fx.ratings(spark, SF01).where((F.col("user_id") + F.col("movie_id")) % 8 == 0).cache()
    t = _f_test(r)
    p = rc.group_lens(r, t)
    e = rc.prediction_errors(t, p)
    assert (t.count(), p.count(), e.count()) == (168, 69, 99)
    # predictions + errors = test set
    both = p.select("movie_id", "user_id").unionByName(e)
    assert both.exceptAll(t).count() == 0 and t.exceptAll(both).count() == 0


def test_pair_stats_symmetric(spark):
    r = fx.ratings(spark, SF001).cache()
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "user_id long, corater_id long")
    rows = {(x.user_id, x.corater_id): x for x in rt.pair_stats(r, pairs).collect()}
    if rows:
        a, b = rows[(1, 2)], rows[(2, 1)]
        assert (a.n, a.s_u, a.s_v, a.s_uv, a.s_uu) == (b.n, b.s_v, b.s_u, b.s_uv, b.s_vv)


def test_pair_stats_without_broadcast_matches(spark):
    r = fx.ratings(spark, SF001).cache()
    t = _f_test(r)
    cand = rt.corater_candidates(r, t)
    a = rt.pair_stats(r, cand)
    spark.conf.set("reelrank.broadcast.maxBytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = rt.pair_stats(r, cand)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        spark.conf.unset("reelrank.broadcast.maxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (2.4999999999,), (-0.5,)], "x double")
    got = [r.p for r in df.select(rc.round_prediction(F.col("x")).alias("p")).collect()]
    assert got == [2, 4, 2, 0]


def test_hot_movie_is_not_capped(spark):
    # a third of all ratings on one movie: every co-rater still contributes
    r0 = fx.ratings(spark, SF001)
    users = r0.select("user_id").distinct()
    hot = users.select("user_id", F.lit(999999).cast("long").alias("movie_id"),
                       ((F.col("user_id") % 5) + 1).cast("int").alias("rating"))
    r = r0.unionByName(hot).cache()
    t = hot.where(F.col("user_id") % 7 == 0).select("movie_id", "user_id")
    rows = [(x.user_id, x.movie_id, x.rating) for x in r.collect()]
    trows = [(x.movie_id, x.user_id) for x in t.collect()]
    gl_b, _ = _brute(rows, trows)
    gl = {(x.movie_id, x.user_id): x.raw for x in rc.group_lens(r, t).collect()}
    assert gl.keys() == gl_b.keys() and len(gl) == len(trows)
    for k in gl:
        assert gl[k] == pytest.approx(gl_b[k], abs=1e-9)


@pytest.mark.parametrize("split", [3, 20, 512])
def test_packed_vectors_equal_brute_force(spark, monkeypatch, split):
    """Packed rows, cut by movie beyond ``split`` ratings, with targets that the user has not rated,
    repeated test rows and a movie nobody else rated."""
    monkeypatch.setattr(rt, "SPLIT", split)
    r = fx.ratings(spark, SF001).unionByName(spark.createDataFrame([(1, 777777, 3)], "user_id long, movie_id long, rating int")).cache()
    t0 = _f_test(r)
    unrated = (t0.select("movie_id").distinct().crossJoin(spark.createDataFrame([(1,), (2,), (99999,)], "user_id long"))
               .select("movie_id", "user_id"))
    t = t0.unionByName(unrated).unionByName(t0).unionByName(spark.createDataFrame([(777777, 1), (None, 1)], "movie_id long, user_id long"))
    spark.conf.set("reelrank.broadcast.maxBytes", "0")
    try:
        assert (rt._degree_bits(r) is None) == (split == 512)
        got = rt.pair_features(r, t).collect()
    finally:
        spark.conf.unset("reelrank.broadcast.maxBytes")
    by = defaultdict(dict)
    for x in r.collect():
        by[x.user_id][x.movie_id] = x.rating
    want = {}
    for m, u in {tuple(x) for x in t.collect() if x.movie_id is not None}:
        for v in by:
            if v != u and m in by[v]:
                c = [i for i in by.get(u, {}) if i in by[v]]
                a, b = [by[u][i] for i in c], [by[v][i] for i in c]
                want[m, u, v] = (by[v][m], by.get(u, {}).get(m), len(c), sum(a), sum(b), sum(x * y for x, y in zip(a, b)),
                                 sum(x * x for x in a), sum(y * y for y in b))
    assert {(x.movie_id, x.user_id, x.corater_id): (x.vote, x.r_target, x.n, x.s_u, x.s_v, x.s_uv, x.s_uu, x.s_vv) for x in got} == want
    assert len(got) == len(want) and any(x.r_target is None for x in got)
    small = rt.pair_features(r, t)
    assert sorted(map(tuple, small.collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_pairs_meet_without_exchanging_vectors(spark, monkeypatch):
    """Over the broadcast bound no row goes to its co-rater, lists of many raters are cut, a null rating counts
    as under the bound, and a requested user without ratings is no pair."""
    monkeypatch.setattr(rt, "SPLIT", 3)
    rows = [(u, m, None if (u, m) in ((1, 2), (4, 2)) else (u * m) % 5 + 1) for u in range(1, 12) for m in range(1, 6) if (u + m) % 3]
    r = spark.createDataFrame(rows + [(None, 1, 2), (3, None, 1)], "user_id long, movie_id long, rating int")
    t = spark.createDataFrame([(m, u) for u in range(1, 6) for m in (1, 2)] + [(2, 77)], "movie_id long, user_id long")
    pairs = spark.createDataFrame([(u, v) for u in range(1, 12) for v in range(1, 12)] + [(1, 1 << 40), (1 << 40, 1), (None, 1)],
                                  "user_id long, corater_id long")
    small = [sorted(map(tuple, df.collect()), key=repr) for df in (rt.pair_stats(r, pairs), rt.pair_features(r, t))]
    spark.conf.set("reelrank.broadcast.maxBytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = [rt.pair_stats(r, pairs), rt.pair_features(r, t)]
        assert [sorted(map(tuple, df.collect()), key=repr) for df in large] == small and all(small)
        for df in large:
            assert "hashpartitioning(v" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("reelrank.broadcast.maxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_two_raters_meet_once(spark, monkeypatch):
    """For requested pairs a movie's list goes to its earlier raters alone, for features with the votes in the user ids;
    nothing is exchanged again to be summed, and large ids are not packed."""
    import re

    monkeypatch.setattr(rt, "SPLIT", 4)
    rows = [(u, m, None if (u * m) % 11 == 5 else (u * m) % 5 - 1) for u in range(-3, 12) for m in range(1, 6) if (u + 2 * m) % 4]
    pairs = spark.createDataFrame([(u, v) for u in range(-3, 9) for v in range(0, 12) if (u + v) % 3], "user_id long, corater_id long")
    for shift in (0, 1 << 61):
        r = spark.createDataFrame([(u + shift, m, x) for u, m, x in rows], "user_id long, movie_id long, rating int")
        p = pairs.select(*((F.col(c) + shift).alias(c) for c in pairs.columns))
        t = r.where("movie_id < 3").select("movie_id", "user_id")
        small = [sorted(map(tuple, df.collect()), key=repr) for df in (rt.pair_stats(r, p), rt.pair_features(r, t))]
        spark.conf.set("reelrank.broadcast.maxBytes", "0")
        try:
            large = [rt.pair_stats(r, p), rt.pair_features(r, t)]
            assert [sorted(map(tuple, df.collect()), key=repr) for df in large] == small and all(small)
            for df in large:
                assert not re.search(r"hashpartitioning\(u#\d+L?, v#", df._jdf.queryExecution().executedPlan().toString())
            cells = r.withColumn("requested", F.lit(True))
            both = r.alias("a").join(r.alias("b"), "movie_id").where("a.user_id <> b.user_id").count()
            assert 2 * rt.meet_raters(cells, ("rating",)).count() == both
            packed, apart = rt._with_votes(r)
            assert (apart is None) == (shift > 0) and ("rating" in packed.columns) == (shift > 0)
        finally:
            spark.conf.unset("reelrank.broadcast.maxBytes")
