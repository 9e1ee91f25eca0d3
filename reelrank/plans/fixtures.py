"""Model inputs derived from the driver tables by Spark.

The toolkit's inputs (ratings, id map, corpus, ...) are re-expressed over the
TPC-H-like tables so that every query's work grows with the data:

* ratings: a customer (user) "rates" a part (movie) by order quantity,
  ``rating = floor((l_quantity - 1) / 10) + 1`` (1..5), max per pair;
* id map: every part is a catalogued movie, external id = zero-padded key,
  ``year = 1970 + p_size``, title = ``p_name``;
* corpus: English documents, one per external movie id (``doc_id``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def _rating_expr(q):
    return (F.floor((q - F.lit(1)) / F.lit(10)) + F.lit(1)).cast("int")


def rating_events(spark: SparkSession, d: str) -> DataFrame:
    """One rating event per line item, with the columns that order them."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("user_id"),
                    F.col("l_partkey").alias("movie_id"),
                    _rating_expr(F.col("l_quantity")).alias("rating"),
                    F.to_date("l_shipdate").alias("rated_on"),
                    "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey",
                    "l_quantity", "l_extendedprice"))


# Columns that order rating events: "last" wins on duplicates.
EVENT_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey",
               "l_quantity", "l_extendedprice"]


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """ratings(user_id BIGINT, movie_id BIGINT, rating INT), one row per pair."""
    ev = rating_events(spark, d)
    return ev.groupBy("user_id", "movie_id").agg(F.max("rating").alias("rating"))


def id_map(spark: SparkSession, d: str) -> DataFrame:
    """id_map(imdb_id STRING, netflix_id BIGINT, year INT, title STRING)."""
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    padded = F.when(F.length(key) >= 7, key).otherwise(F.lpad(key, 7, "0"))
    return p.select(padded.alias("imdb_id"),
                    F.col("p_partkey").alias("netflix_id"),
                    (F.lit(1970) + F.col("p_size")).cast("int").alias("year"),
                    F.col("p_name").alias("title"))


def corpus(spark: SparkSession, d: str, lang: str | None = None) -> DataFrame:
    """corpus(movie_id STRING, text STRING): documents by external id, all of
    them or those of one language."""
    docs = table(spark, d, "documents")
    docs = docs if lang is None else docs.where(F.col("lang") == lang)
    return docs.select(F.col("doc_id").cast("string").alias("movie_id"), "text")


def available(spark: SparkSession, d: str) -> DataFrame:
    """Movie ids that have a document (the reference's ids list)."""
    return corpus(spark, d).select("movie_id")


# --- text files re-expressed as line tables (source, line_no, value) ----------
def rating_block_lines(spark: SparkSession, d: str, dirty: bool = False) -> DataFrame:
    """One rating-block "file" per movie: ``<movie>:`` then ``user,rating,date``
    lines in event order.  ``dirty``: the four largest quantities make lines
    without a date, with a field too many, with a rating in words, and blank ones."""
    from ..sources.lines import number_lines

    # a line is made of what orders it, so it is put together after the numbering; a block's name is its movie's
    ev = rating_events(spark, d).select("movie_id", *EVENT_ORDER, "user_id")
    at = number_lines(ev, [*EVENT_ORDER, "user_id"], source="movie_id", keep=["l_shipdate", "l_quantity", "user_id"])
    movie, user, q = F.col("movie_id").cast("string"), F.col("user_id").cast("string"), F.col("l_quantity")
    rating = _rating_expr(q).cast("string")
    value = F.concat_ws(",", user, rating, F.date_format(F.to_date("l_shipdate"), "yyyy-MM-dd"))
    if dirty:
        value = (F.when(q == 50, F.concat_ws(",", user, rating)).when(q == 49, F.concat(value, F.lit(",x")))
                 .when(q == 48, F.concat_ws(",", user, F.lit("five"), F.lit("-"))).when(q == 47, "").otherwise(value))
    src = F.concat(F.lit("mv_"), movie, F.lit(".txt")).alias("source")
    heads = at.where("line_no = 1").select(src, "line_no", F.concat(movie, F.lit(":")).alias("value"))
    return heads.unionByName(at.select(src, (F.col("line_no") + 1).alias("line_no"), value.alias("value")))


def match_lines(spark: SparkSession, d: str) -> DataFrame:
    """The id-match file: ``imdb_id,netflix_id,year,title`` by netflix id."""
    from ..sources.lines import number_lines

    m = id_map(spark, d).select(
        F.lit("match.txt").alias("source"), "netflix_id",
        F.concat_ws(",", "imdb_id", F.col("netflix_id").cast("string"),
                    F.col("year").cast("string"), "title").alias("value"))
    return number_lines(m, ["netflix_id"]).select("source", "line_no", "value")


def title_lines(spark: SparkSession, d: str, dirty: bool = False) -> DataFrame:
    """The title list: ``netflix_id,year,title`` for every part.  ``dirty``: the
    largest sizes make lines without a comma, with a year in words and with a title no catalogue has."""
    from ..sources.lines import number_lines

    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    value = F.concat_ws(",", key, (F.lit(1970) + size).cast("string"), "p_name")
    if dirty:
        value = (F.when(size == 50, key).when(size == 49, F.concat_ws(",", key, F.lit("unknown"), "p_name"))
                 .when(size == 48, F.concat(value, F.lit(", the series"))).otherwise(value))
    p = table(spark, d, "part").select(F.lit("movie_titles.txt").alias("source"), "p_partkey", value.alias("value"))
    return number_lines(p, ["p_partkey"]).select("source", "line_no", "value")


def dirty_subs_lines(best: DataFrame) -> DataFrame:
    """A subtitle list of ``best`` whose sets of two files declare three, those
    of four declare three, and whose fifth files have lost their separator."""
    from ..sinks.formats import subs_list_lines
    from ..sources.parsers import subs_lines

    lines = subs_lines(subs_list_lines(best))
    value = (F.when(F.col("pos") == 5, F.replace(F.col("value"), F.lit("#"), F.lit(" ")))
             .when((F.col("status") == "header") & F.col("n_files").isin(2, 4), F.regexp_replace("value", "[24]$", "3"))
             .otherwise(F.col("value")))
    return lines.select("source", "line_no", value.alias("value"))


def subtitle_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Subtitle search results: each order is a subtitle set of its customer's
    "movie"; each line item one file of the set.  Declared CD count
    ``1 + o_orderkey % 6``; pending orders are in a non-srt format."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    fid = F.concat_ws("-", F.col("o_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").cast("string").alias("movie_id"),
                    F.col("o_orderkey").alias("sub_id"),
                    fid.alias("file_id"),
                    F.concat(F.lit("http://dl.example.org/sub/"), fid, F.lit(".gz")).alias("link"),
                    F.when(F.col("o_orderstatus") == "P", F.lit("sub")).otherwise(F.lit("srt"))
                    .alias("sub_format"),
                    (F.lit(1) + F.col("o_orderkey") % 6).cast("int").alias("sum_cd")))


def id_list(spark: SparkSession, d: str) -> DataFrame:
    """An id list with repeats: the order key of every line item."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("imdb_id"))
