"""Test-set builders (J8, J9, L4, P6, A13, A14) and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_leading_zeros


def _ext_map(id_map: DataFrame) -> DataFrame:
    return id_map.select(strip_leading_zeros(F.col("imdb_id")).alias("ext_id"),
                         "netflix_id", "year")


def recent_movies(id_map: DataFrame, from_year: int = 2000, to_year: int = 2008) -> DataFrame:
    """Catalogued movies with ``from_year <= year < to_year``."""
    return id_map.where((F.col("year") >= from_year) & (F.col("year") < to_year))


def movies_per_year(id_map: DataFrame, from_year: int = 2000, to_year: int = 2008) -> DataFrame:
    """Number of recent movies per year."""
    return (recent_movies(id_map, from_year, to_year)
            .groupBy("year").agg(F.count(F.lit(1)).alias("movies")))


def recent_test_set(id_map: DataFrame, available: DataFrame, ratings: DataFrame,
                    from_year: int = 2000, to_year: int = 2008) -> DataFrame:
    """Every rater of each recent movie whose external id has a document.

    ``available(movie_id)`` holds external ids.  Returns (movie_id, user_id).
    """
    rec = _ext_map(recent_movies(id_map, from_year, to_year))
    avail = available.select(F.col("movie_id").alias("ext_id"))
    movies = rec.join(avail, "ext_id", "left_semi").select(F.col("netflix_id").alias("movie_id"))
    return ratings.select("movie_id", "user_id").join(movies, "movie_id", "left_semi")


def full_test_set(id_map: DataFrame, available: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every rater of every movie that has a document (any year)."""
    m = _ext_map(id_map)
    avail = available.select(F.col("movie_id").alias("ext_id"))
    movies = m.join(avail, "ext_id").select(F.col("netflix_id").alias("movie_id"))
    return ratings.select("movie_id", "user_id").join(movies, "movie_id")


def test_set_limit(test: DataFrame, limit: int) -> DataFrame:
    """L4: the first ``limit`` pairs in (movie_id, user_id) order (a top-n
    report: Spark plans it as TakeOrderedAndProject, partial top-n per task)."""
    return test.orderBy("movie_id", "user_id").limit(limit)


def test_set_summary(test: DataFrame) -> DataFrame:
    """Predictions required and movies involved."""
    return test.agg(F.count(F.lit(1)).alias("predictions"),
                    F.countDistinct("movie_id").alias("movies"))


def rmse(predictions: DataFrame, ratings: DataFrame, test: DataFrame | None = None,
         algorithms: list[str] | None = None) -> DataFrame:
    """RMSE of the integer predictions, with coverage.

    Grouped by ``algorithm`` when that column is present.  Without predictions the score is 0: for
    an empty set without that column, and for every one of ``algorithms`` that has none.  A
    prediction without an actual rating raises, as it has no error to count.
    ``coverage`` = n_pred / n_test.
    """
    keys = ["algorithm"] if "algorithm" in predictions.columns else []
    p = predictions.select(*keys, "movie_id", "user_id", "prediction")
    j = p.join(ratings.select("movie_id", "user_id", F.col("rating").alias("actual")),
               ["movie_id", "user_id"], "left")
    actual = F.coalesce(F.col("actual"), F.raise_error(F.lit("prediction without an actual rating")).cast("int"))
    d = (actual - F.col("prediction")).cast("double")
    agg = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"),
                               F.coalesce(F.sqrt(F.avg(d * d)), F.lit(0.0)).alias("rmse"))
    if keys and algorithms:
        names = predictions.sparkSession.createDataFrame([(a,) for a in algorithms], "algorithm string")
        agg = names.join(agg, "algorithm", "full_outer").na.fill(0, ["n_pred"]).na.fill(0.0, ["rmse"])
    if test is not None:
        n_test = test.select(F.count(F.lit(1))).scalar()
        agg = agg.withColumn("n_test", n_test).withColumn(
            "coverage", F.when(F.col("n_test") > 0, F.col("n_pred") / F.col("n_test")))
    return agg
