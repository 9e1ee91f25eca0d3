"""Registered queries on lines that don't parse and on whole outputs, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as ct
from ..sinks import atomic
from ..sinks import formats as fm
from ..session import scratch_table_dir
from ..sources import parsers as ps
from ..sources import routing
from ..sources.lines import read_lines
from ..sources.tables import table
from . import catalogue_queries as cq
from . import fixtures as fx
from . import oracle as o


def q_rejected_rating_lines(spark, d):
    """The rejects of rating blocks, from the output they were routed to."""
    return routing.route(ps.rating_lines(fx.rating_block_lines(spark, d, dirty=True))).rejected


def q_rating_block_check(spark, d):
    return ps.rating_block_check(ps.rating_lines(fx.rating_block_lines(spark, d, dirty=True)))


def q_subs_list_check(spark, d):
    """Every block against its declared count."""
    lines = fx.dirty_subs_lines(cq._best(spark, d))
    return ps.subs_list_check(ps.subs_lines(lines)).drop("source", "block")


def q_rejected_subs_lines(spark, d):
    return routing.route(ps.subs_lines(fx.dirty_subs_lines(cq._best(spark, d)))).rejected


def q_rejected_titles(spark, d):
    return routing.route(ps.title_lines(fx.title_lines(spark, d, dirty=True))).rejected


def q_title_match_split(spark, d):
    """K9: titles of all four outcomes, split by status and read back."""
    m = ct.title_match(ps.titles_parse(fx.title_lines(spark, d, dirty=True)), fx.id_map(spark, d))
    path = scratch_table_dir(spark, f"matches-{uuid.uuid4().hex}")
    fm.write_matches(m, path)
    return atomic.read(spark, path, "status", m.schema)


def q_latin1_lines(spark, d):
    """documents' lines (blank ones between them) written as Latin-1 bytes
    and read back with their numbers."""
    docs = table(spark, d, "conversations").select(
        F.explode(F.split(F.concat("text", F.lit("\n")), "\n")).alias("value"), "conv_id", "turn")
    path = scratch_table_dir(spark, f"latin1-{uuid.uuid4().hex}")
    # one file per conversation range: line numbers run per file
    (docs.repartitionByRange(4, "conv_id").sortWithinPartitions("conv_id", "turn")
     .select(F.encode("value", "ISO-8859-1").cast("string").alias("value")).write.text(path))
    lines = read_lines(spark, path, encoding="ISO-8859-1")
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("value is not null")


# --- oracle ----------------------------------------------------------------------
RATING_LINES = """rl AS (
  SELECT 'mv_' || movie_id || '.txt' AS source, movie_id, l_quantity AS q,
    CAST(1 + row_number() OVER (PARTITION BY movie_id ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey,
      l_quantity, l_extendedprice, user_id) AS BIGINT) AS line_no,
    CASE l_quantity WHEN 50 THEN user_id || ',' || rating WHEN 49 THEN user_id || ',' || rating || ',' || rated_on || ',x'
      WHEN 48 THEN user_id || ',five,-' END AS value,
    CASE l_quantity WHEN 50 THEN 'short' WHEN 49 THEN 'extra' WHEN 48 THEN 'malformed' END AS status
  FROM events_r)"""

SUB_BLOCKS = """blocks AS (
  SELECT movie_id, CASE WHEN n_files IN (2, 4) THEN 3 ELSE n_files END AS declared, n_files FROM best GROUP BY movie_id, n_files)"""


def oracle_queries() -> dict[str, str]:
    q = {}
    q["rejected_rating_lines"] = o.with_(o.EVENTS, RATING_LINES) + \
        "SELECT source, line_no, value, status FROM rl WHERE status IS NOT NULL"
    q["rating_block_check"] = o.with_(o.EVENTS, RATING_LINES) + """SELECT source, CAST(movie_id AS VARCHAR) AS movie_id,
  count(*) FILTER (q <> 47) AS n_lines, count(*) FILTER (q <> 47 AND status IS NULL) AS n_ok,
  count(*) FILTER (status = 'short') AS n_short, count(*) FILTER (status = 'extra') AS n_extra,
  count(*) FILTER (status = 'malformed') AS n_malformed,
  CASE WHEN bool_or(coalesce(status, '') = 'malformed') THEN 'malformed' WHEN bool_or(coalesce(status, '') = 'short') THEN 'short'
       WHEN bool_or(coalesce(status, '') = 'extra') THEN 'extra' ELSE 'ok' END AS status
FROM rl GROUP BY source, movie_id"""
    subs = o.with_(o.ID_MAP, cq.SUBS, cq.BEST, SUB_BLOCKS)
    q["subs_list_check"] = subs + """SELECT movie_id, declared AS n_files, CAST(n_files AS BIGINT) AS n_lines,
  CAST(CASE n_files WHEN 4 THEN 3 WHEN 2 THEN 2 ELSE n_files - CASE WHEN n_files >= 5 THEN 1 ELSE 0 END END AS BIGINT) AS n_ok,
  CASE WHEN n_files >= 5 THEN 'malformed' WHEN n_files < declared THEN 'short' WHEN n_files > declared THEN 'extra' ELSE 'ok' END AS status
FROM blocks"""
    q["rejected_subs_lines"] = subs + """, l AS (
  SELECT 'subs_list' AS source, CAST(row_number() OVER (ORDER BY m, pos) AS BIGINT) AS line_no, pos, n_files, file_id, link FROM (
    SELECT DISTINCT movie_id AS m, 0 AS pos, n_files, NULL AS file_id, NULL AS link FROM best
    UNION ALL SELECT movie_id, pos, n_files, file_id, link FROM best) x)
SELECT source, line_no, file_id || CASE pos WHEN 5 THEN ' ' ELSE '#' END || link AS value,
  CASE pos WHEN 5 THEN 'malformed' ELSE 'extra' END AS status
FROM l WHERE pos = 5 OR (pos = 4 AND n_files = 4)"""
    q["rejected_titles"] = """SELECT * FROM (SELECT 'movie_titles.txt' AS source, CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS line_no,
  CASE p_size WHEN 50 THEN CAST(p_partkey AS VARCHAR) ELSE p_partkey || ',unknown,' || p_name END AS value,
  CASE p_size WHEN 50 THEN 'short' WHEN 49 THEN 'malformed' END AS status FROM part) x WHERE status IS NOT NULL"""
    dirty = """titles AS (
  SELECT CAST(p_partkey AS VARCHAR) AS netflix_id, CASE WHEN p_size < 49 THEN CAST(1970 + p_size AS INTEGER) END AS year,
         CASE p_size WHEN 50 THEN '' WHEN 48 THEN p_name || ', the series' ELSE p_name END AS title, p_size >= 49 AS malformed FROM part)"""
    q["title_match_split"] = o.with_(o.ID_MAP, dirty, cq.MATCHES) + "SELECT netflix_id, year, title, status, imdb_ids FROM matches"
    q["latin1_lines"] = """SELECT value, count(*) AS n FROM (
  SELECT unnest(string_split(text || chr(10), chr(10))) AS value FROM conversations WHERE text IS NOT NULL) x GROUP BY value"""
    return q
