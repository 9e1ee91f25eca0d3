"""Parsers for the model's text formats.

All take a lines table ``(source, line_no, value)`` (see :mod:`lines`).
Ids stay strings, as in the files; callers cast where they need numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_eol, strip_leading_zeros
from ..operators.dedupe import last_wins
from ..operators.joins import fits_broadcast, hint, materialize
from .lines import carry_forward


def _clean(lines: DataFrame) -> DataFrame:
    """F3 + P2: strip CR/LF, keep non-blank lines."""
    return (lines.withColumn("value", strip_eol(F.col("value")))
            .where(F.col("value") != ""))


def rating_lines(lines: DataFrame) -> DataFrame:
    """Every line of per-movie rating blocks with a status.

    The first line of each source is ``<movie>:``; every other non-blank line
    is ``user,rating,date``.  Returns (source, line_no, value, movie_id, user_id,
    rating, rated_on, status): ``short`` / ``extra`` for fewer or more than three fields,
    ``malformed`` for an empty user, a rating that is no integer or a blank
    header, ``orphan`` for lines under no header.  A date that doesn't parse is
    NULL (the model discards dates).
    """
    head = materialize(lines.where(F.col("line_no") == 1)
                       .select("source", F.regexp_replace(F.col("value"), r"[:\r\n]+$", "").alias("movie_id")))
    value = strip_eol(F.col("value"))
    parts = F.split(value, ",")
    user, rating = F.get(parts, 0), F.get(parts, 1).try_cast("int")
    orphan = F.coalesce(F.trim("movie_id") == "", F.lit(True))
    status = (F.when(F.col("line_no") == 1, F.when(orphan, "malformed").otherwise("header"))
              .when(value == "", "blank").when(orphan, "orphan")
              .when(F.size(parts) < 3, "short").when(F.size(parts) > 3, "extra")
              .when((F.trim(user) == "") | rating.isNull(), "malformed").otherwise("ok"))
    # one header per file: broadcast it (checked) instead of shuffling the lines
    return (lines.join(hint(head, fits_broadcast(head)), "source", "left")
            .select("source", "line_no", value.alias("value"), "movie_id", user.alias("user_id"), rating.alias("rating"),
                    F.get(parts, 2).try_cast("date").alias("rated_on"), status.alias("status")))


def ratings_from_blocks(lines: DataFrame) -> DataFrame:
    """The three-field lines of rating blocks as (movie_id, user_id, rating,
    rated_on), with a NULL rating where it doesn't parse; :func:`rating_lines`
    has every line, for :func:`routing.route`.  Duplicates are kept (dedupe is W7's job)."""
    return (rating_lines(lines).where("status = 'ok' or (status = 'malformed' and line_no > 1)")
            .select("movie_id", "user_id", "rating", "rated_on"))


def rating_block_check(classified: DataFrame) -> DataFrame:
    """S1 per block: (source, movie_id, n_lines, n_ok, n_short, n_extra,
    n_malformed, status); blank lines and the header are not counted, the status
    is the worst of the lines'."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    per = classified.groupBy("source", "movie_id").agg(
        n("ok", "short", "extra", "malformed", "orphan").alias("n_lines"), n("ok").alias("n_ok"), n("short").alias("n_short"),
        n("extra").alias("n_extra"), n("malformed", "orphan").alias("n_malformed"))
    return per.withColumn("status", F.when(F.col("n_malformed") > 0, "malformed").when(F.col("n_short") > 0, "short")
                          .when(F.col("n_extra") > 0, "extra").otherwise("ok"))


def test_set_parse(lines: DataFrame) -> DataFrame:
    """``movie:`` header lines set the movie for the users below.

    Returns (movie_id, user_id); users before any header get a NULL movie.
    """
    df = _clean(lines)
    is_head = F.col("value").endswith(":")
    df = carry_forward(df, F.when(is_head, F.regexp_replace(F.col("value"), ":+$", "")))
    return df.where(~is_head).select(F.col("header").alias("movie_id"),
                                     F.col("value").alias("user_id"))


def id_map_rows(lines: DataFrame) -> DataFrame:
    """S4 base: (imdb_id with zeros stripped, netflix_id, source, line_no)."""
    df = _clean(lines)
    parts = F.split(F.col("value"), ",")
    return df.select(strip_leading_zeros(F.get(parts, 0)).alias("imdb_id"),
                     F.get(parts, 1).alias("netflix_id"), "source", "line_no")


def id_maps(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two lookups of an id-match file, last line wins in each.

    Returns (imdb -> netflix, netflix -> imdb) as (imdb_id, netflix_id) tables.
    """
    rows = id_map_rows(lines)
    by_imdb = last_wins(rows, ["imdb_id"], ["source", "line_no"]).select("imdb_id", "netflix_id")
    by_netflix = last_wins(rows, ["netflix_id"], ["source", "line_no"]).select("imdb_id", "netflix_id")
    return by_imdb, by_netflix


def id_map_year_parse(lines: DataFrame) -> DataFrame:
    """``imdb,netflix,year,title`` with at most 3 splits (title keeps commas)."""
    df = _clean(lines)
    parts = F.split(F.col("value"), ",", 4)
    return df.select(F.get(parts, 0).alias("imdb_id"), F.get(parts, 1).alias("netflix_id"),
                     F.get(parts, 2).try_cast("int").alias("year"), F.get(parts, 3).alias("title"))


def title_lines(lines: DataFrame) -> DataFrame:
    """Every line of a title list ``id,year,title...`` with a status.

    Returns (source, line_no, value, netflix_id, year, title, status): ``short`` for a line
    without a year field, ``malformed`` for a year that is no integer; the title may hold commas.
    """
    value = strip_eol(F.col("value"))
    parts = F.split(value, ",")
    year = F.trim(F.get(parts, 1)).try_cast("int")
    title = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), ",")
    status = (F.when(value == "", "blank").when(F.size(parts) < 2, "short")
              .when(year.isNull(), "malformed").otherwise("ok"))
    return lines.select("source", "line_no", value.alias("value"), F.get(parts, 0).alias("netflix_id"), year.alias("year"),
                        title.alias("title"), status.alias("status"))


def titles_parse(lines: DataFrame) -> DataFrame:
    """(netflix_id, year, title, malformed, line_no) of the non-blank
    lines; a missing or non-integer year marks a line malformed."""
    return title_lines(lines).where("status <> 'blank'").select(
        "netflix_id", "year", "title", (F.col("status") != "ok").alias("malformed"), "line_no")


def subs_lines(lines: DataFrame) -> DataFrame:
    """Every line of a subtitle list (``movie:n``, then n lines
    ``file_id#link``) with a status.

    Returns (source, line_no, value, block, movie_id, n_files, pos, file_id, link,
    status); ``block`` is the header's line.  ``extra`` lines come after the
    declared n, ``malformed`` ones hold no ``#`` (or are a header whose count is no integer), ``orphan`` ones precede
    any header.  A blank line within the n is malformed.
    """
    df = lines.withColumn("value", strip_eol(F.col("value")))
    at = r"^([^#]*):([0-9]+)$"
    n = F.regexp_extract(F.col("value"), at, 2).try_cast("int")
    is_head = F.col("value").rlike(at)
    head = F.when(is_head, F.struct(F.regexp_extract(F.col("value"), at, 1).alias("movie_id"), n.alias("n_files"),
                                    F.col("line_no").alias("at")))
    df = carry_forward(df, head)
    parts = F.split(F.col("value"), "#")
    pos = (F.col("line_no") - F.col("header.at")).cast("int")
    within = F.coalesce(pos <= F.col("header.n_files"), F.lit(False))
    status = (F.when(is_head, F.when(F.col("header.n_files").isNull(), "malformed").otherwise("header"))
              .when((F.col("value") == "") & ~within, "blank").when(F.col("header").isNull(), "orphan")
              .when(F.size(parts) < 2, "malformed").when(~within, "extra").otherwise("ok"))
    item = F.when(~is_head & (F.size(parts) > 1), parts)
    return df.select("source", "line_no", "value", F.col("header.at").alias("block"), F.col("header.movie_id").alias("movie_id"),
                     F.col("header.n_files").alias("n_files"), F.when(~is_head, pos).alias("pos"),
                     F.get(item, 0).alias("file_id"), F.get(item, 1).alias("link"), status.alias("status"))


def subs_list_parse(lines: DataFrame) -> DataFrame:
    """The good lines of a subtitle list as (movie_id, n_files, pos,
    file_id, link), pos 1..n within a movie; :func:`subs_lines` has the others."""
    return subs_lines(lines).where("status = 'ok'").select("movie_id", "n_files", "pos", "file_id", "link")


def subs_list_check(classified: DataFrame) -> DataFrame:
    """S10 per block: (source, block, movie_id, n_files declared, n_lines found,
    n_ok, status).  ``malformed`` if a line or the count is, else ``short`` or
    ``extra`` against the declared count, else ``ok``."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    per = (classified.where(F.col("block").isNotNull()).groupBy("source", "block", "movie_id", "n_files")
           .agg(n("ok", "extra", "orphan").alias("_good"), n("malformed").alias("_bad"), n("ok").alias("n_ok")))
    # a header that is itself malformed is no item line
    bad = F.col("_bad") - F.col("n_files").isNull().cast("int")
    return per.select("source", "block", "movie_id", "n_files", (F.col("_good") + bad).alias("n_lines"), "n_ok",
                      F.when(F.col("_bad") > 0, "malformed").when(F.col("_good") < F.col("n_files"), "short")
                      .when(F.col("_good") > F.col("n_files"), "extra").otherwise("ok").alias("status"))
