"""Registered parser, subtitle-text and page queries, with their SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import scripts as sc
from ..sinks import formats as fm
from ..sources import parsers as ps
from ..sources.lines import skip_lines
from ..sources.tables import table
from . import fixtures as fx
from . import oracle as o
from .queries import test_set

SKIP = 100            # lines dropped by the resume example
LINK_LABEL = "The"    # visible text of the link looked up on each page


# --- parsers ---------------------------------------------------------------------
def q_ratings_from_blocks(spark: SparkSession, d: str) -> DataFrame:
    return ps.ratings_from_blocks(fx.rating_block_lines(spark, d))


def q_test_set_format(spark, d):
    return fm.test_set_lines(test_set(spark, d))


def q_test_set_parse(spark, d):
    return ps.test_set_parse(fm.test_set_lines(test_set(spark, d)))


def q_id_map_parse(spark, d):
    by_imdb, by_netflix = ps.id_maps(fx.match_lines(spark, d))
    return (by_imdb.select(F.lit("imdb_to_netflix").alias("direction"), "imdb_id", "netflix_id")
            .unionByName(by_netflix.select(F.lit("netflix_to_imdb").alias("direction"),
                                           "imdb_id", "netflix_id")))


def q_id_map_year_parse(spark, d):
    return ps.id_map_year_parse(fx.match_lines(spark, d))


def q_titles_parse(spark, d):
    return ps.titles_parse(fx.title_lines(spark, d))


def q_skip_lines(spark, d):
    return skip_lines(fx.match_lines(spark, d), SKIP)


# --- subtitles and scripts --------------------------------------------------------
def q_strip_tags(spark, d):
    return sc.srt_cue_texts(table(spark, d, "conversations")).select(
        "movie_id", "turn", tx.strip_tags(F.col("cue_text")).alias("line"))


def q_srt_merge(spark, d):
    files = sc.srt_files(table(spark, d, "conversations"))
    return sc.srt_merge(files)


def q_plots_concat(spark, d):
    return sc.plots(table(spark, d, "pages")).select("movie_id", "text")


def q_movie_docs(spark, d):
    script = sc.srt_merge(sc.srt_files(table(spark, d, "conversations")))
    plots = sc.plots(table(spark, d, "pages")).select("movie_id", "text")
    return sc.movie_docs(script, plots)


def q_page_paragraphs(spark, d):
    p = table(spark, d, "pages").select("page_id", tx.paragraphs(F.col("html")).alias("ps"))
    return p.select("page_id", F.posexplode("ps").alias("pos", "paragraph")).select(
        "page_id", (F.col("pos") + 1).cast("int").alias("pos"), "paragraph")


def q_page_link_by_text(spark, d):
    p = table(spark, d, "pages").select(
        "page_id", tx.link_by_text(F.col("html"), F.col("url"), LINK_LABEL).alias("link"))
    return p.where(F.col("link").isNotNull())


def q_page_section_text(spark, d):
    return table(spark, d, "pages").select(
        "page_id", tx.section_text(F.col("html"), sc.SECTION_OPEN, sc.SECTION_CLOSE).alias("text"))


#: A frame of nested containers around every page.
FRAME = ('<div class="page main"><div id="top">', '</div><DIV class=x>end<div>s</div></DIV> foot</div><div class="page">other</div>')
DIV = "(?i)</?div(?:[\\s/][^>]*)?>"


def q_page_container_text(spark, d):
    """F14 on nested containers: the page's outer frame, to its balancing close."""
    framed = F.concat(F.lit(FRAME[0]), F.col("html"), F.lit(FRAME[1]))
    return table(spark, d, "pages").where("html is not null").select(
        "page_id", tx.container_text(framed, "div", css_class="main").alias("text"))


# --- oracle ----------------------------------------------------------------------
#: Names the SQL knows: a sample of the list behind ``unescape_entities``.
SQL_NAMES = ("amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "trade", "middot", "hellip", "mdash", "ndash", "eacute", "euro")


def _sql_unescape(x: str) -> str:
    names = tx.entity_names()
    quoted = lambda c: "'" + c.replace("'", "''") + "'"
    cases = " ".join(f"WHEN '{n};' THEN {quoted(names[n + ';'])} || substr(p, {len(n) + 2})" for n in SQL_NAMES)
    one = ("CASE WHEN regexp_matches(p, '^#[0-9]+;') THEN chr(CAST(regexp_extract(p, '^#([0-9]+);', 1) AS INTEGER)) "
           "|| regexp_replace(p, '^#[0-9]+;', '') "
           f"ELSE CASE regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;', 0) {cases} ELSE '&' || p END END")
    return (f"((string_split({x}, '&'))[1] || array_to_string(list_transform((string_split({x}, '&'))[2:], "
            f"lambda p: {one}), ''))")


def _sql_strip_tags(x: str) -> str:
    e = _sql_unescape(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
    return f"CASE WHEN regexp_matches({x}, '<.*?>') THEN {e} ELSE {x} END"


CUES = """cues AS (
  SELECT conv_id AS movie_id, turn,
         CASE WHEN turn % 2 = 0 THEN '<i>' || replace(text, chr(10), ' ') || '</i>'
              ELSE replace(text, chr(10), ' ') || ' a &amp; b' END AS cue_text,
         CAST(turn // 4 + 1 AS INTEGER) AS cd
  FROM conversations)"""

SRT_FILES = CUES + """,
srt AS (
  SELECT movie_id, 'cd' || CAST(cd AS VARCHAR) || '.srt' AS file_name,
         string_agg(CAST(turn + 1 AS VARCHAR) || chr(10)
                    || '00:00:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ',000 --> 00:00:'
                    || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ',500' || chr(10)
                    || cue_text || chr(10) || chr(10), '' ORDER BY turn) AS text
  FROM cues GROUP BY movie_id, cd)"""


def _sql_srt_clean(t: str) -> str:
    t1 = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    t2 = f"CASE WHEN suffix({t1}, chr(10)) THEN {t1} ELSE {t1} || chr(10) END"
    t3 = f"regexp_replace({t2}, '\\A(?:[^\\n]*\\n){{0,3}}', '')"
    t4 = f"regexp_replace({t3}, '(?m)^\\n(?:[^\\n]*\\n){{0,2}}', '', 'g')"
    lines = f"string_split({t4}, chr(10))"
    kept = f"list_slice({lines}, 1, len({lines}) - 1)"
    return f"array_to_string(list_transform({kept}, lambda x: ({_sql_strip_tags('x')}) || ' '), '')"


MERGED = SRT_FILES + f""",
cleaned AS (SELECT movie_id, file_name, {_sql_srt_clean('text')} AS clean FROM srt),
merged AS (
  SELECT CAST(movie_id AS VARCHAR) AS movie_id,
         string_agg(clean, '' ORDER BY file_name) AS text,
         CAST(count(*) AS INTEGER) AS n_files
  FROM cleaned GROUP BY movie_id)"""


def _sql_drop_scripts(h: str) -> str:
    return f"regexp_replace({h}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"


def _sql_paragraphs(h: str) -> str:
    ps_ = f"regexp_extract_all({_sql_drop_scripts(h)}, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1)"
    inner = _sql_unescape("regexp_replace(x, '<[^>]*>', '', 'g')")
    return f"list_transform({ps_}, lambda x: regexp_replace({inner}, '^\\s+|\\s+$', '', 'g'))"


def _sql_section(h: str) -> str:
    block = f"regexp_extract({_sql_drop_scripts(h)}, '(?is){sc.SECTION_OPEN}(.*?){sc.SECTION_CLOSE}', 1)"
    return f"array_to_string(list_filter(string_split_regex({block}, '<[^>]*>'), lambda x: x <> ''), chr(10))"


PLOTS = f"""plots AS (
  SELECT CAST(page_id AS VARCHAR) AS movie_id,
         array_to_string(list_concat({_sql_paragraphs('html')}, [{_sql_section('html')}]), chr(10)) AS text
  FROM pages)"""


def oracle_queries() -> dict[str, str]:
    q = {}
    base = [o.RATINGS, o.ID_MAP, o.AVAILABLE, o.TEST]
    q["ratings_from_blocks"] = o.with_(o.EVENTS) + """SELECT CAST(movie_id AS VARCHAR) AS movie_id,
  CAST(user_id AS VARCHAR) AS user_id, rating, rated_on FROM events_r"""
    q["test_set_format"] = o.with_(*base) + """SELECT 'test_set' AS source,
  CAST(row_number() OVER (ORDER BY m, k, u) AS BIGINT) AS line_no, value FROM (
  SELECT DISTINCT movie_id AS m, 0 AS k, CAST(NULL AS BIGINT) AS u, CAST(movie_id AS VARCHAR) || ':' AS value FROM test
  UNION ALL
  SELECT movie_id, 1, user_id, CAST(user_id AS VARCHAR) FROM test) x"""
    q["test_set_parse"] = o.with_(*base) + """SELECT CAST(movie_id AS VARCHAR) AS movie_id,
  CAST(user_id AS VARCHAR) AS user_id FROM test"""
    q["id_map_parse"] = o.with_(o.ID_MAP) + """SELECT d.direction, regexp_replace(imdb_id, '^0+', '') AS imdb_id,
  CAST(netflix_id AS VARCHAR) AS netflix_id
FROM id_map CROSS JOIN (VALUES ('imdb_to_netflix'), ('netflix_to_imdb')) d(direction)"""
    q["id_map_year_parse"] = o.with_(o.ID_MAP) + """SELECT imdb_id, CAST(netflix_id AS VARCHAR) AS netflix_id,
  year, title FROM id_map"""
    q["titles_parse"] = """SELECT CAST(p_partkey AS VARCHAR) AS netflix_id, CAST(1970 + p_size AS INTEGER) AS year,
  p_name AS title, false AS malformed,
  CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS line_no FROM part"""
    q["skip_lines"] = o.with_(o.ID_MAP) + """SELECT * FROM (
  SELECT 'match.txt' AS source, CAST(row_number() OVER (ORDER BY netflix_id) AS BIGINT) AS line_no,
         concat_ws(',', imdb_id, CAST(netflix_id AS VARCHAR), CAST(year AS VARCHAR), title) AS value
  FROM id_map) x WHERE line_no > """ + str(SKIP)
    q["strip_tags"] = o.with_(CUES) + \
        f"SELECT CAST(movie_id AS VARCHAR) AS movie_id, turn, {_sql_strip_tags('cue_text')} AS line FROM cues"
    q["srt_merge"] = o.with_(MERGED) + "SELECT movie_id, text, n_files FROM merged"
    q["plots_concat"] = o.with_(PLOTS) + "SELECT movie_id, text FROM plots"
    q["movie_docs"] = o.with_(MERGED, PLOTS) + """SELECT m.movie_id, m.text || coalesce(p.text, '') AS text
FROM merged m LEFT JOIN plots p ON p.movie_id = m.movie_id"""
    q["page_paragraphs"] = f"""SELECT page_id, CAST(generate_subscripts(ps, 1) AS INTEGER) AS pos,
  unnest(ps) AS paragraph FROM (SELECT page_id, {_sql_paragraphs('html')} AS ps FROM pages) x"""
    h = _sql_drop_scripts("html")
    anchor = tx.ANCHOR.replace("'", "''")
    groups = ", ".join(f"regexp_extract_all({h}, '{anchor}', {i})" for i in (1, 2, 3, 4))
    q["page_link_by_text"] = f"""SELECT page_id, link FROM (
  SELECT page_id,
    CASE WHEN len(hits) > 0 THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || hits[1] END AS link
  FROM (SELECT page_id, url,
          list_filter(list_zip({groups}), lambda z: regexp_replace(z[4], '<[^>]*>', '', 'g') = '{LINK_LABEL}') AS hits0
        FROM pages) a,
  LATERAL (SELECT list_transform(hits0, lambda z: coalesce(z[1], '') || coalesce(z[2], '') || coalesce(z[3], '')) AS hits) b
) x WHERE link IS NOT NULL"""
    q["page_container_text"] = f"""WITH w AS (
  SELECT page_id, regexp_extract(t, '(?s)<div class="page main">(.*)\\z', 1) AS after
  FROM (SELECT page_id, '{FRAME[0]}' || {h} || '{FRAME[1]}' AS t FROM pages WHERE html IS NOT NULL) x),
c AS (SELECT page_id, string_split_regex(after, '{DIV}') AS parts, regexp_extract_all(after, '{DIV}') AS marks FROM w),
m AS (SELECT page_id, generate_subscripts(marks, 1) AS i, unnest(marks) AS mark FROM c),
d AS (SELECT page_id, i, 1 + sum(CASE WHEN mark LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM m),
e AS (SELECT page_id, min(i) AS i FROM d WHERE depth = 0 GROUP BY page_id)
SELECT page_id, array_to_string(list_filter(flatten(list_transform(
    CASE WHEN e.i IS NULL THEN parts ELSE parts[1:e.i] END, lambda p: string_split_regex(p, '<[^>]*>'))), lambda x: x <> ''), chr(10)) AS text
FROM c LEFT JOIN e USING (page_id)"""
    q["page_section_text"] = f"SELECT page_id, {_sql_section('html')} AS text FROM pages"
    return q
