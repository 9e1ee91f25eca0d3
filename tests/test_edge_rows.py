"""Single odd rows whose result was once wrong."""

import pytest
from pyspark.sql import functions as F

from reelrank import session
from reelrank.functions import text as tx
from reelrank.operators import catalog, evaluate, recommend


def test_a_set_with_two_cd_counts_is_no_complete_set(spark):
    subs = spark.createDataFrame([("m", "s", "f1", "l1", "srt", 1), ("m", "s", "f2", "l2", "srt", 2),
                                  ("n", "t", "f3", "l3", "srt", 1)],
                                 "movie_id string, sub_id string, file_id string, link string, sub_format string, sum_cd int")
    assert [(r.movie_id, r.n_files) for r in catalog.best_subtitles(subs).collect()] == [("n", 1)]


def test_a_vote_of_zero_ends_the_search(spark):
    ratings = spark.createDataFrame([(1, 11, 0), (1, 12, 4), (2, 12, 3)], "user_id long, movie_id long, rating int")
    test = spark.createDataFrame([(10, 1), (10, 2)], "movie_id long, user_id long")
    id_map = spark.createDataFrame([("0000010", 10), ("0000011", 11), ("0000012", 12)], "imdb_id string, netflix_id long")
    near = spark.createDataFrame([("10", "11", 1), ("10", "12", 2)], "movie_id string, neighbour_id string, rank int")
    got = recommend.most_similar(ratings, test, id_map, near).collect()
    assert [(r.user_id, r.prediction) for r in got] == [(2, 3)]


@pytest.mark.parametrize("href, want", [("http://b.org/x", "http://b.org/x"), ("/x", "http://a.org/x"), ("x", "http://a.org/x")])
def test_links_are_resolved(spark, href, want):
    df = spark.createDataFrame([(f'<a class="c" href="{href}">go</a>', "http://a.org/p")], "html string, url string")
    assert df.select(tx.link_by_text(F.col("html"), F.col("url"), "go")).first()[0] == want


def test_a_prediction_without_a_rating_raises(spark):
    p = spark.createDataFrame([(1, 1, 3), (2, 1, 3)], "movie_id long, user_id long, prediction int")
    r = spark.createDataFrame([(1, 1, 4)], "movie_id long, user_id long, rating int")
    with pytest.raises(Exception, match="without an actual rating"):
        evaluate.rmse(p, r).collect()
    assert evaluate.rmse(p.limit(0), r).first().rmse == 0.0


def test_checkpoint_folder_must_be_named_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
