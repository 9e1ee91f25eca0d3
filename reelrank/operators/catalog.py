"""Catalogue jobs: title matching, id dedupe, subtitle selection.

All are equi-joins and aggregates.  Candidate lists are aggregated per key
*before* joining (one row per catalogue key), so a title never multiplies
against every candidate row of a popular title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import last_path_segment, strip_leading_zeros
from ..sources.lines import number_lines
from .dedupe import occurring_once
from .joins import materialize


def normalise_title(c):
    """Case-folded title with runs of white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def title_match(titles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Look each title up by (normalised title, year).

    ``titles(netflix_id, year, title, malformed)``; ``catalogue(imdb_id, year,
    title)``.  Returns one row per title line with ``status`` in
    matched / no_match / conflict / malformed and ``imdb_ids`` (the id, or
    the conflicting ids joined by '/').
    """
    cands = (catalogue.select(normalise_title(F.col("title")).alias("key"), "year", "imdb_id")
             .groupBy("key", "year")
             .agg(F.count(F.lit(1)).alias("n_candidates"),
                  F.array_join(F.array_sort(F.collect_list("imdb_id")), "/").alias("ids")))
    # titles of one key side by side, also across tasks: their list of ids is long, and then written once a file and not once a row
    t = titles.withColumn("key", normalise_title(F.col("title")))
    order = ["key", "year", "netflix_id"]
    t = materialize(t.repartitionByRange(*order).sortWithinPartitions(*order))
    j = t.join(cands, ["key", "year"], "left")
    n = F.coalesce(F.col("n_candidates"), F.lit(0))
    status = (F.when(F.col("malformed"), F.lit("malformed"))
              .when(n == 0, F.lit("no_match"))
              .when(n == 1, F.lit("matched"))
              .otherwise(F.lit("conflict")))
    return j.select("netflix_id", "year", "title", status.alias("status"),
                    F.when(n > 0, F.col("ids")).alias("imdb_ids"))


def title_match_summary(matches: DataFrame) -> DataFrame:
    """Lines processed and counts per status."""
    per = matches.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = matches.agg(F.lit("lines").alias("status"), F.count(F.lit(1)).alias("n"))
    return per.unionByName(total)


def unique_ids(ids: DataFrame, col: str = "imdb_id") -> DataFrame:
    """Ids seen exactly once, ranked by (length, id)."""
    u = occurring_once(ids, col).withColumn("_len", F.length(col)).withColumn("source", F.lit("ids"))
    return number_lines(u, ["_len", col], out="rank").select("rank", col)


def id_batches(ranked: DataFrame, per_request: int = 10) -> DataFrame:
    """Request batch of each id, ``per_request`` ids per batch (Q6 fixed)."""
    return ranked.withColumn("batch", ((F.col("rank") - 1) / per_request).cast("bigint"))


def subs_requested(subs: DataFrame, requested: DataFrame, col: str = "imdb_id") -> DataFrame:
    """Keep subtitles whose movie id (zeros stripped) was requested."""
    req = requested.select(strip_leading_zeros(F.col(col)).alias("_rid")).distinct()
    return (subs.withColumn("_rid", strip_leading_zeros(F.col("movie_id")))
            .join(req, "_rid", "left_semi").drop("_rid"))


def subs_per_movie(subs: DataFrame) -> DataFrame:
    """Subtitle files found per movie."""
    return subs.groupBy("movie_id").agg(F.count(F.lit(1)).alias("n_subs"))


def best_subtitles(subs: DataFrame) -> DataFrame:
    """Per movie, the srt set with the fewest CDs (ties
    by subtitle id) and all its files - only if the set is complete.

    ``subs(movie_id, sub_id, file_id, link, sub_format, sum_cd INT)``.
    Returns (movie_id, sub_id, n_files, pos, file_id, link).  An incomplete
    best set drops the movie (no fallback to the next set), as does one whose
    files declare different CD counts.
    """
    srt = subs.where(F.col("sub_format") == "srt")
    sets = srt.groupBy("movie_id", "sub_id").agg(F.min("sum_cd").alias("sum_cd"), F.max("sum_cd").alias("max_cd"),
                                                 F.count(F.lit(1)).alias("n_files"))
    best = (sets.groupBy("movie_id")
            .agg(F.min_by(F.struct("sub_id", "sum_cd", "max_cd", "n_files"),
                          F.struct("sum_cd", "sub_id")).alias("b"))
            .select("movie_id", "b.*")
            .where((F.col("n_files") == F.col("sum_cd")) & (F.col("sum_cd") == F.col("max_cd"))))
    files = srt.join(best.select("movie_id", "sub_id", "n_files"), ["movie_id", "sub_id"])
    from pyspark.sql.window import Window
    w = Window.partitionBy("movie_id", "sub_id").orderBy("file_id", "link")
    return files.select("movie_id", "sub_id", F.col("n_files").cast("int").alias("n_files"),
                        F.row_number().over(w).cast("int").alias("pos"), "file_id", "link")


def subtitle_summary(requested: DataFrame) -> DataFrame:
    """Q7: ``found``, the movies that any requested subtitle belongs to, and
    ``kept``, those whose best set is complete."""
    both = (requested.select("movie_id", F.lit(True).alias("any"))
            .unionByName(best_subtitles(requested).select("movie_id", F.lit(False).alias("any"))))
    mine = lambda c: F.countDistinct(F.when(c, F.col("movie_id")))
    return both.agg(mine(F.col("any")).alias("found"), mine(~F.col("any")).alias("kept"))


def file_names(links: DataFrame, col: str = "link") -> DataFrame:
    """local file name of a download link (``.gz`` -> ``.srt``)."""
    return links.withColumn("file_name", F.replace(last_path_segment(F.col(col)),
                                                    F.lit(".gz"), F.lit(".srt")))


def deletion_variants(c, k: int):
    """Every string obtained from ``c`` by deleting at most ``k`` characters.

    Two strings within Levenshtein distance k share at least one such variant,
    so an equi-join on variants finds every candidate pair exactly.  Their number
    grows with the length to the power k; :func:`probe_segments` makes a fixed number of keys.
    """
    out = F.array(c)
    cur = F.array(c)
    for _ in range(k):
        cur = F.array_distinct(F.flatten(F.transform(cur, lambda v: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))),
            lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v)))))))
        out = F.array_distinct(F.concat(out, cur))
    return out


def _segment(length, i, k: int):
    """Start (from 0) and length of segment ``i`` of a string of ``length`` cut into k + 1 even parts."""
    start = F.floor(i * length / (k + 1)).cast("int")
    return start, F.floor((i + 1) * length / (k + 1)).cast("int") - start


def own_segments(c, k: int):
    """The k + 1 segments of a string: array of (length, i, segment)."""
    n = F.char_length(c)

    def one(i):
        start, size = _segment(n, i, k)
        return F.struct(n.alias("length"), i.alias("i"), F.substring(c, start + 1, size).alias("segment"))

    return F.transform(F.sequence(F.lit(0), F.lit(k)), one)


def probe_segments(c, k: int):
    """Every (length, i, segment) that a string within ``k`` edits of ``c`` may have.

    Of k + 1 segments of a string, k edits leave one whole; it occurs in the other string
    at most k places off.  So the other lengths, segments and offsets are enumerated: a number that depends on k
    alone, each with one substring.
    """
    n, steps = F.char_length(c), F.sequence(F.lit(-k), F.lit(k))

    def one(length, i, off):
        start, size = _segment(length, i, k)
        at = start + off
        return F.when((at >= 0) & (at + size <= n), F.struct(length.alias("length"), i.alias("i"), F.substring(c, at + 1, size).alias("segment")))

    lengths = F.filter(F.transform(steps, lambda d: n + d), lambda length: length >= 0)
    found = F.flatten(F.flatten(F.transform(lengths, lambda length: F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.transform(
        steps, lambda off: one(length, i, off))))))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def title_match_fuzzy(titles: DataFrame, catalogue: DataFrame, max_distance: int = 2) -> DataFrame:
    """J10 fuzzy mode: catalogue titles of the same year within
    ``max_distance`` edits of the (normalised) title.

    Candidates come from an equi-join of segments of the *distinct*
    (title, year) keys of both sides (:func:`own_segments`, :func:`probe_segments`) - never all
    titles of a year against each other - and every candidate is verified with ``levenshtein``.
    Returns the same columns as :func:`title_match`.
    """
    cat = (catalogue.select(normalise_title(F.col("title")).alias("ckey"), "year", "imdb_id")
           .groupBy("ckey", "year")
           .agg(F.count(F.lit(1)).alias("n"), F.collect_list("imdb_id").alias("ids")))
    t = titles.withColumn("key", normalise_title(F.col("title")))
    keys = t.where(~F.col("malformed")).select("key", "year").distinct()
    kv = keys.select("key", "year", F.inline(probe_segments(F.col("key"), max_distance)))
    cv = cat.select("ckey", "year", F.inline(own_segments(F.col("ckey"), max_distance)))
    pairs = (kv.join(cv, ["year", "length", "i", "segment"]).select("key", "year", "ckey").distinct()
             .where(F.levenshtein("key", "ckey", max_distance) >= 0))
    hits = (pairs.join(cat, ["ckey", "year"])
            .groupBy("key", "year")
            .agg(F.sum("n").alias("n_candidates"),
                 F.array_join(F.array_sort(F.flatten(F.collect_list("ids"))), "/").alias("ids")))
    j = t.join(hits, ["key", "year"], "left")
    n = F.coalesce(F.col("n_candidates"), F.lit(0))
    status = (F.when(F.col("malformed"), F.lit("malformed"))
              .when(n == 0, F.lit("no_match"))
              .when(n == 1, F.lit("matched"))
              .otherwise(F.lit("conflict")))
    return j.select("netflix_id", "year", "title", status.alias("status"),
                    F.when(n > 0, F.col("ids")).alias("imdb_ids"))
