"""Registered catalogue queries (title match, ids, subtitles) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ct
from ..sinks import formats as fm
from ..sources import parsers as ps
from . import fixtures as fx
from . import oracle as o

PER_REQUEST = 10   # ids per subtitle search request


def _titles(spark, d):
    return ps.titles_parse(fx.title_lines(spark, d))


def _matches(spark, d):
    return ct.title_match(_titles(spark, d), fx.id_map(spark, d))


def q_title_match(spark, d):
    return _matches(spark, d)


FUZZY_DISTANCE = 2   # edits allowed by the fuzzy title mode


def q_title_match_fuzzy(spark, d):
    return ct.title_match_fuzzy(_titles(spark, d), fx.id_map(spark, d), FUZZY_DISTANCE)


def q_title_match_summary(spark, d):
    return ct.title_match_summary(_matches(spark, d))


def q_unique_ids(spark, d):
    return ct.unique_ids(fx.id_list(spark, d))


def q_id_batches(spark, d):
    return ct.id_batches(ct.unique_ids(fx.id_list(spark, d)), PER_REQUEST)


def _requested(spark, d):
    return ct.subs_requested(fx.subtitle_candidates(spark, d), fx.id_map(spark, d))


def q_subs_requested(spark, d):
    return _requested(spark, d)


def q_subs_per_movie(spark, d):
    return ct.subs_per_movie(_requested(spark, d))


def _best(spark, d):
    return ct.best_subtitles(_requested(spark, d))


def q_best_subtitles(spark, d):
    return _best(spark, d)


def q_subs_list_format(spark, d):
    return fm.subs_list_lines(_best(spark, d))


def q_subs_list_parse(spark, d):
    return ps.subs_list_parse(fm.subs_list_lines(_best(spark, d)))


def q_file_names(spark, d):
    return ct.file_names(_best(spark, d).select("file_id", "link")).select("file_id", "file_name")


# --- oracle ----------------------------------------------------------------------
NORM = "lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"

TITLES = """titles AS (
  SELECT CAST(p_partkey AS VARCHAR) AS netflix_id, CAST(1970 + p_size AS INTEGER) AS year,
         p_name AS title, false AS malformed FROM part)"""

MATCHES = f"""cands AS (
  SELECT {NORM.format(c='title')} AS key, year, count(*) AS n_candidates,
         string_agg(imdb_id, '/' ORDER BY imdb_id) AS ids
  FROM id_map GROUP BY 1, 2),
matches AS (
  SELECT t.netflix_id, t.year, t.title,
         CASE WHEN t.malformed THEN 'malformed' WHEN coalesce(c.n_candidates, 0) = 0 THEN 'no_match'
              WHEN c.n_candidates = 1 THEN 'matched' ELSE 'conflict' END AS status,
         CASE WHEN coalesce(c.n_candidates, 0) > 0 THEN c.ids END AS imdb_ids
  FROM titles t LEFT JOIN cands c ON c.key = {NORM.format(c='t.title')} AND c.year = t.year)"""

SUBS = """subs AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS movie_id, o.o_orderkey AS sub_id,
         CAST(o.o_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS file_id,
         'http://dl.example.org/sub/' || CAST(o.o_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '.gz' AS link,
         CASE WHEN o.o_orderstatus = 'P' THEN 'sub' ELSE 'srt' END AS sub_format,
         CAST(1 + o.o_orderkey % 6 AS INTEGER) AS sum_cd
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
req AS (
  SELECT * FROM subs WHERE regexp_replace(movie_id, '^0+', '') IN
    (SELECT regexp_replace(imdb_id, '^0+', '') FROM id_map))"""

BEST = """sets AS (
  SELECT movie_id, sub_id, min(sum_cd) AS sum_cd, max(sum_cd) AS max_cd, count(*) AS n_files
  FROM req WHERE sub_format = 'srt' GROUP BY movie_id, sub_id),
bestset AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY sum_cd, sub_id) AS rn FROM sets) x
  WHERE rn = 1 AND n_files = sum_cd AND sum_cd = max_cd),
best AS (
  SELECT r.movie_id, r.sub_id, CAST(b.n_files AS INTEGER) AS n_files,
         CAST(row_number() OVER (PARTITION BY r.movie_id, r.sub_id ORDER BY r.file_id, r.link) AS INTEGER) AS pos,
         r.file_id, r.link
  FROM req r JOIN bestset b ON b.movie_id = r.movie_id AND b.sub_id = r.sub_id
  WHERE r.sub_format = 'srt')"""

UNIQUE = """uids AS (
  SELECT imdb_id FROM (SELECT CAST(l_orderkey AS VARCHAR) AS imdb_id FROM lineitem) x
  GROUP BY imdb_id HAVING count(*) = 1),
ranked AS (
  SELECT CAST(row_number() OVER (ORDER BY length(imdb_id), imdb_id) AS BIGINT) AS rank, imdb_id FROM uids)"""


def oracle_queries() -> dict[str, str]:
    q = {}
    q["title_match"] = o.with_(o.ID_MAP, TITLES, MATCHES) + \
        "SELECT netflix_id, year, title, status, imdb_ids FROM matches"
    q["title_match_fuzzy"] = o.with_(o.ID_MAP, TITLES) + f"""SELECT t.netflix_id, t.year, t.title,
  CASE WHEN t.malformed THEN 'malformed' WHEN count(c.imdb_id) = 0 THEN 'no_match'
       WHEN count(c.imdb_id) = 1 THEN 'matched' ELSE 'conflict' END AS status,
  CASE WHEN count(c.imdb_id) > 0 THEN string_agg(c.imdb_id, '/' ORDER BY c.imdb_id) END AS imdb_ids
FROM titles t LEFT JOIN id_map c ON c.year = t.year
  AND levenshtein({NORM.format(c='t.title')}, {NORM.format(c='c.title')}) <= {FUZZY_DISTANCE}
GROUP BY t.netflix_id, t.year, t.title, t.malformed"""
    q["title_match_summary"] = o.with_(o.ID_MAP, TITLES, MATCHES) + """SELECT status, CAST(count(*) AS BIGINT) AS n
FROM matches GROUP BY status UNION ALL SELECT 'lines', CAST(count(*) AS BIGINT) FROM matches"""
    q["unique_ids"] = o.with_(UNIQUE) + "SELECT rank, imdb_id FROM ranked"
    q["id_batches"] = o.with_(UNIQUE) + \
        f"SELECT rank, imdb_id, CAST((rank - 1) // {PER_REQUEST} AS BIGINT) AS batch FROM ranked"
    q["subs_requested"] = o.with_(o.ID_MAP, SUBS) + \
        "SELECT movie_id, sub_id, file_id, link, sub_format, sum_cd FROM req"
    q["subs_per_movie"] = o.with_(o.ID_MAP, SUBS) + \
        "SELECT movie_id, CAST(count(*) AS BIGINT) AS n_subs FROM req GROUP BY movie_id"
    q["best_subtitles"] = o.with_(o.ID_MAP, SUBS, BEST) + \
        "SELECT movie_id, sub_id, n_files, pos, file_id, link FROM best"
    q["subs_list_format"] = o.with_(o.ID_MAP, SUBS, BEST) + """SELECT 'subs_list' AS source,
  CAST(row_number() OVER (ORDER BY m, pos) AS BIGINT) AS line_no, value FROM (
  SELECT DISTINCT movie_id AS m, 0 AS pos, movie_id || ':' || CAST(n_files AS VARCHAR) AS value FROM best
  UNION ALL SELECT movie_id, pos, file_id || '#' || link FROM best) x"""
    q["subs_list_parse"] = o.with_(o.ID_MAP, SUBS, BEST) + \
        "SELECT movie_id, n_files, pos, file_id, link FROM best"
    q["file_names"] = o.with_(o.ID_MAP, SUBS, BEST) + \
        "SELECT file_id, replace(split_part(link, '/', -1), '.gz', '.srt') AS file_name FROM best"
    return q
