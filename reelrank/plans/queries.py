"""Registered queries: (spark, sf_dir) -> DataFrame over the whole tables.

Each query wires driver tables -> fixtures -> one operator.  Doubles are
rounded to 6 places at the very end (presentation only; ranking and
prediction use full precision).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import ratings as rt
from ..operators import recommend as rc
from ..operators import similarity as sim
from . import fixtures as fx

RECENT = (2000, 2008)   # the model's "recent" window, 2000 <= year < 2008
K_MOST_SIMILAR = 25     # neighbours considered by most_similar
K_DEFAULT = 5           # default top-k


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """The ratings fixture, computed once per query (read by several joins)."""
    from ..operators.joins import materialize
    return materialize(fx.ratings(spark, d))


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def test_set(spark: SparkSession, d: str, r: DataFrame | None = None) -> DataFrame:
    """The evaluation test set: the recent test set (J9) over the fixtures."""
    return ev.recent_test_set(fx.id_map(spark, d), fx.available(spark, d),
                              fx.ratings(spark, d) if r is None else r, *RECENT)


# --- ratings statistics -------------------------------------------------------
def q_user_avg(spark, d):
    r = rt.user_avg(fx.ratings(spark, d))
    return r.select("user_id", "n_ratings", "sum_ratings", _r6("avg_rating"))


def q_user_ratings_loo(spark, d):
    r = ratings(spark, d)
    return rt.user_ratings_loo(r, test_set(spark, d, r))


def q_corater_candidates(spark, d):
    r = ratings(spark, d)
    return rt.corater_candidates(r, test_set(spark, d, r)).select(
        "movie_id", "user_id", "corater_id", "vote")


def q_pair_stats(spark, d):
    r = ratings(spark, d)
    cand = rt.corater_candidates(r, test_set(spark, d, r))
    return rt.pair_stats(r, cand)


def q_user_cosine(spark, d):
    r = ratings(spark, d)
    return rt.user_cosine(r, test_set(spark, d, r)).select(
        "movie_id", "user_id", "corater_id", _r6("w"))


def q_relative_avg(spark, d):
    r = ratings(spark, d)
    return rt.relative_avg(r, test_set(spark, d, r)).select(
        "movie_id", "user_id", "corater_id", _r6("user_rel_avg"), _r6("corater_rel_avg"))


# --- recommenders ------------------------------------------------------------------
def _preds(df):
    return df.select("movie_id", "user_id", _r6("raw"), "prediction")


def q_group_lens(spark, d):
    r = ratings(spark, d)
    return _preds(rc.group_lens(r, test_set(spark, d, r)))


def q_shw(spark, d):
    r = ratings(spark, d)
    return _preds(rc.shw(r, test_set(spark, d, r)))


def q_group_lens_loo(spark, d):
    """Q3 option: the test user's mean leaves the target rating out."""
    r = ratings(spark, d)
    return _preds(rc.group_lens(r, test_set(spark, d, r), exclude_target=True))


def q_shw_loo(spark, d):
    """Q3 option: both co-rating means leave the target rating out."""
    r = ratings(spark, d)
    return _preds(rc.shw(r, test_set(spark, d, r), exclude_target=True))


def neighbours_for_test(spark, d, k=K_MOST_SIMILAR, t=None):
    """Top-k corpus neighbours of the test set's distinct mapped movies."""
    test = test_set(spark, d) if t is None else t
    idm = fx.id_map(spark, d)
    from ..functions.text import strip_leading_zeros
    targets = (idm.join(test.select(F.col("movie_id").alias("netflix_id")).distinct(),
                        "netflix_id", "left_semi")
               .select(strip_leading_zeros(F.col("imdb_id")).alias("movie_id")))
    return sim.neighbours(fx.corpus(spark, d), targets, k=k)


def q_most_similar(spark, d):
    r = ratings(spark, d)
    t = test_set(spark, d, r)
    p = rc.most_similar(r, t, fx.id_map(spark, d), neighbours_for_test(spark, d, t=t))
    return p.select("movie_id", "user_id", "prediction")


def all_predictions(spark, d, r=None, t=None):
    """The three algorithms' predictions through the registry (U1);
    GroupLens and SHW share one checkpointed pair-features table."""
    from ..operators.joins import materialize
    r = ratings(spark, d) if r is None else r
    t = test_set(spark, d, r) if t is None else t
    f = materialize(rt.pair_features(r, t))
    return rc.run_algorithms(r, t, {
        "group_lens": {"features": f}, "shw": {"features": f},
        "most_similar": {"id_map": fx.id_map(spark, d), "neighbours": neighbours_for_test(spark, d, t=t)}})


def q_predictions_all(spark, d):
    return all_predictions(spark, d).select("algorithm", "movie_id", "user_id", _r6("raw"),
                                            "prediction")


def q_prediction_errors(spark, d):
    r = ratings(spark, d)
    t = test_set(spark, d, r)
    p = all_predictions(spark, d, r, t)
    out = None
    for name in ("group_lens", "shw", "most_similar"):
        e = rc.prediction_errors(t, p.where(F.col("algorithm") == name)).select(
            F.lit(name).alias("algorithm"), "movie_id", "user_id")
        out = e if out is None else out.unionByName(e)
    return out


def q_rmse(spark, d):
    r = ratings(spark, d)
    t = test_set(spark, d, r)
    out = ev.rmse(all_predictions(spark, d, r, t), r, t, ["group_lens", "shw", "most_similar"])
    return out.select("algorithm", "n_pred", "n_test", _r6("rmse"), _r6("coverage"))


# --- test sets ---------------------------------------------------------------------
def q_recent_test_set(spark, d):
    return test_set(spark, d)


def q_full_test_set(spark, d):
    return ev.full_test_set(fx.id_map(spark, d), fx.available(spark, d), fx.ratings(spark, d))


def q_test_set_limit(spark, d):
    return ev.test_set_limit(test_set(spark, d), 1000)


def q_test_set_summary(spark, d):
    return ev.test_set_summary(test_set(spark, d))


def q_movies_per_year(spark, d):
    return ev.movies_per_year(fx.id_map(spark, d), *RECENT)


def q_ratings_last_wins(spark, d):
    from ..operators.dedupe import last_wins
    e = fx.rating_events(spark, d)
    return last_wins(e, ["user_id", "movie_id"], fx.EVENT_ORDER).select(
        "user_id", "movie_id", "rating")


# --- similarity --------------------------------------------------------------------
def q_tfidf_weights(spark, d):
    w = sim.tfidf_weights(fx.corpus(spark, d))
    return w.select("movie_id", "term", "tf", "df", _r6("idf"), _r6("weight"))


def q_movie_similarity(spark, d):
    test = test_set(spark, d)
    idm = fx.id_map(spark, d)
    from ..functions.text import strip_leading_zeros
    targets = (idm.join(test.select(F.col("movie_id").alias("netflix_id")).distinct(),
                        "netflix_id", "left_semi")
               .select(strip_leading_zeros(F.col("imdb_id")).alias("movie_id")))
    s = sim.movie_similarity(sim.document_weights(fx.corpus(spark, d)), targets)
    return s.select("movie_id", "neighbour_id", _r6("similarity"))


def q_top_k_similar(spark, d):
    n = neighbours_for_test(spark, d, K_MOST_SIMILAR)
    return n.select("movie_id", "neighbour_id", _r6("similarity"), "rank")


# --- sources with files ---------------------------------------------------------
def _scratch(spark, name):
    import uuid

    from ..session import scratch_table_dir
    return scratch_table_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def q_ratings_csv_scan(spark, d):
    """K2 layout written in the model's per-key form, then S2 read back."""
    from ..sources.lines import read_keyed_ratings
    path = _scratch(spark, "ratings_by_user")
    r = fx.ratings(spark, d)
    (r.select("user_id", F.col("movie_id").cast("string"), "rating")
     .repartition("user_id").write.partitionBy("user_id").csv(path))
    back = read_keyed_ratings(spark, path, key_from="dir")
    return back.select(F.col("user_id").cast("bigint").alias("user_id"),
                       F.col("movie_id").cast("bigint").alias("movie_id"), "rating")


def _two_drops(spark, d, after_drop=None):
    """Rating events land in two drops (shipped up to 1995, then later), each ingested;
    ``after_drop(state_dir)`` runs after each.  Returns the table of a third run that finds nothing new."""
    from ..streaming.incremental import ingest
    base = _scratch(spark, "incremental")
    land, state, ckpt = f"{base}/landing", f"{base}/state", f"{base}/checkpoint"
    ev = fx.rating_events(spark, d).select("user_id", "movie_id", "rating", *fx.EVENT_ORDER)
    early = F.year("l_shipdate") <= 1995
    for i, part in enumerate((ev.where(early), ev.where(~early))):
        part.write.parquet(f"{land}/drop={i + 1}")
        ingest(spark, land, state, ckpt, ev.schema, ["user_id", "movie_id"], fx.EVENT_ORDER)
        if after_drop:
            after_drop(state)
    return ingest(spark, land, state, ckpt, ev.schema, ["user_id", "movie_id"], fx.EVENT_ORDER)


def q_incremental_ratings(spark, d):
    """Three availableNow runs (drop 1, drop 2, nothing new) give last-wins state."""
    return _two_drops(spark, d).select("user_id", "movie_id", "rating")


def q_incremental_user_avg(spark, d):
    """R1 x A1: user means from the signed changes of two drops."""
    from ..streaming import statistics as st
    stats = _scratch(spark, "stats")
    _two_drops(spark, d, lambda state: st.update_statistics(spark, state, stats))
    return st.read_user_avg(spark, stats).select("user_id", "n_ratings", "sum_ratings", _r6("avg_rating"))


def q_incremental_pair_stats(spark, d):
    """R1 x J1: co-rating sums of the test set's pairs from the changes of two drops."""
    from ..operators.dedupe import last_wins
    from ..operators.joins import materialize
    from ..streaming import statistics as st
    stats = _scratch(spark, "stats")
    r = last_wins(fx.rating_events(spark, d), ["user_id", "movie_id"], fx.EVENT_ORDER).select("user_id", "movie_id", "rating")
    pairs = materialize(rt.corater_candidates(r, test_set(spark, d, r)).select("user_id", "corater_id").distinct())
    _two_drops(spark, d, lambda state: st.update_statistics(spark, state, stats, pairs))
    return st.read_pair_stats(spark, stats)
