"""Reference SQL (DuckDB dialect) for the registered queries.

Each query is the same model expressed as plain ANSI-style SQL over the
driver's views; shared inputs are CTE fragments mirroring
:mod:`reelrank.plans.fixtures`.  Doubles are rounded to 6 places and counts
cast to BIGINT on both sides.
"""

from __future__ import annotations

from ..functions.stopwords import sql_list

RATINGS = """ratings AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS movie_id,
         CAST(max(floor((l.l_quantity - 1) / 10) + 1) AS INTEGER) AS rating
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey, l.l_partkey)"""

EVENTS = """events_r AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS movie_id,
         CAST(floor((l.l_quantity - 1) / 10) + 1 AS INTEGER) AS rating,
         CAST(l.l_shipdate AS DATE) AS rated_on,
         l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_quantity, l.l_extendedprice
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

NEWEST = """ratings AS (
  SELECT user_id, movie_id, rating FROM (
    SELECT user_id, movie_id, rating, row_number() OVER (PARTITION BY user_id, movie_id
      ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC,
               l_quantity DESC, l_extendedprice DESC) AS rn
    FROM events_r) x WHERE rn = 1)"""

ID_MAP = """id_map AS (
  SELECT CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 7 THEN CAST(p_partkey AS VARCHAR)
              ELSE lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS imdb_id,
         p_partkey AS netflix_id, CAST(1970 + p_size AS INTEGER) AS year, p_name AS title
  FROM part)"""

AVAILABLE = """available AS (
  SELECT CAST(doc_id AS VARCHAR) AS movie_id FROM documents)"""

CORPUS = """corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS movie_id, text FROM documents)"""

TEST = """test AS (
  SELECT r.movie_id, r.user_id FROM ratings r
  WHERE r.movie_id IN (
    SELECT netflix_id FROM id_map
    WHERE year >= 2000 AND year < 2008
      AND regexp_replace(imdb_id, '^0+', '') IN (SELECT movie_id FROM available)))"""

FEATURES = """cand AS (
  SELECT t.movie_id, t.user_id, tr.rating AS r_target, r.user_id AS corater_id, r.rating AS vote
  FROM test t
  LEFT JOIN ratings tr ON tr.movie_id = t.movie_id AND tr.user_id = t.user_id
  JOIN ratings r ON r.movie_id = t.movie_id AND r.user_id <> t.user_id),
pairs AS (SELECT DISTINCT user_id, corater_id FROM cand),
stats AS (
  SELECT p.user_id, p.corater_id, CAST(count(*) AS BIGINT) AS n,
         CAST(sum(a.rating) AS BIGINT) AS s_u, CAST(sum(b.rating) AS BIGINT) AS s_v,
         CAST(sum(a.rating * b.rating) AS BIGINT) AS s_uv,
         CAST(sum(a.rating * a.rating) AS BIGINT) AS s_uu,
         CAST(sum(b.rating * b.rating) AS BIGINT) AS s_vv
  FROM pairs p
  JOIN ratings a ON a.user_id = p.user_id
  JOIN ratings b ON b.user_id = p.corater_id AND b.movie_id = a.movie_id
  GROUP BY p.user_id, p.corater_id),
feat0 AS (
  SELECT c.movie_id, c.user_id, c.corater_id, c.vote, c.r_target,
         coalesce(s.n, 0) AS n, coalesce(s.s_u, 0) AS s_u, coalesce(s.s_v, 0) AS s_v,
         coalesce(s.s_uv, 0) - coalesce(c.r_target, 0) * CASE WHEN c.r_target IS NULL THEN 0 ELSE c.vote END AS num,
         coalesce(s.s_uu, 0) - coalesce(c.r_target, 0) * coalesce(c.r_target, 0) AS nu,
         coalesce(s.s_vv, 0) - CASE WHEN c.r_target IS NULL THEN 0 ELSE c.vote * c.vote END AS nv
  FROM cand c LEFT JOIN stats s ON s.user_id = c.user_id AND s.corater_id = c.corater_id),
feat AS (
  SELECT *, CASE WHEN nu + nv > 0 AND sqrt(CAST(nu AS DOUBLE)) * sqrt(CAST(nv AS DOUBLE)) > 0
                 THEN CAST(num AS DOUBLE) / (sqrt(CAST(nu AS DOUBLE)) * sqrt(CAST(nv AS DOUBLE)))
                 ELSE 0.0 END AS w
  FROM feat0)"""

USER_AVG = """uavg AS (
  SELECT user_id, CAST(count(*) AS BIGINT) AS n_ratings, CAST(sum(rating) AS BIGINT) AS sum_ratings,
         avg(CAST(rating AS DOUBLE)) AS avg_rating
  FROM ratings GROUP BY user_id)"""

GROUP_LENS = """gl AS (
  SELECT f.movie_id, f.user_id,
         sum(f.w * (f.vote - mv.avg_rating)) AS num, sum(abs(f.w)) AS den
  FROM feat f JOIN uavg mv ON mv.user_id = f.corater_id
  GROUP BY f.movie_id, f.user_id),
gl_pred AS (
  SELECT g.movie_id, g.user_id, mu.avg_rating + g.num / g.den AS raw
  FROM gl g JOIN uavg mu ON mu.user_id = g.user_id WHERE g.den <> 0)"""

SHW = """sh AS (
  SELECT movie_id, user_id,
         sum(abs(w) * CASE WHEN n > 0 THEN s_u / n ELSE 0.0 END) AS num1,
         sum(w * (vote - CASE WHEN n > 0 THEN s_v / n ELSE 0.0 END)) AS num2,
         sum(abs(w)) AS den
  FROM feat GROUP BY movie_id, user_id),
shw_pred AS (
  SELECT movie_id, user_id, num1 / den + num2 / den AS raw FROM sh WHERE den <> 0)"""


def pred(expr: str) -> str:
    """Half-even integer rounding after a 9-place round (see round_prediction)."""
    return f"CAST(round_even(round({expr}, 9), 0) AS INTEGER)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def stop_list() -> str:
    return sql_list()


def tfidf_ctes() -> list[str]:
    return [CORPUS,
            """toks AS (
  SELECT movie_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM corpus)""",
            f"""tf AS (
  SELECT movie_id, term, CAST(count(*) AS BIGINT) AS tf FROM toks
  WHERE term NOT IN {stop_list()} GROUP BY movie_id, term)""",
            """dfreq AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term)""",
            """w1 AS (
  SELECT tf.movie_id, tf.term, tf.tf, d.df,
         ln((1.0 + (SELECT count(*) FROM corpus)) / (1.0 + d.df)) + 1.0 AS idf
  FROM tf JOIN dfreq d ON d.term = tf.term)""",
            """norms AS (
  SELECT movie_id, sqrt(sum((tf * idf) * (tf * idf))) AS norm FROM w1 GROUP BY movie_id)""",
            """weights AS (
  SELECT w1.movie_id, w1.term, w1.tf, w1.df, w1.idf, (w1.tf * w1.idf) / n.norm AS weight
  FROM w1 JOIN norms n ON n.movie_id = w1.movie_id)"""]


def similarity_ctes(k: int = 25) -> list[str]:
    return tfidf_ctes() + [
        """targets AS (
  SELECT DISTINCT regexp_replace(imdb_id, '^0+', '') AS movie_id FROM id_map
  WHERE netflix_id IN (SELECT movie_id FROM test))""",
        """simi AS (
  SELECT a.movie_id, b.movie_id AS neighbour_id, sum(a.weight * b.weight) AS similarity
  FROM weights a JOIN weights b ON a.term = b.term AND a.movie_id <> b.movie_id
  WHERE a.movie_id IN (SELECT movie_id FROM targets)
  GROUP BY a.movie_id, b.movie_id)""",
        f"""topk AS (
  SELECT * FROM (
    SELECT movie_id, neighbour_id, similarity,
           CAST(row_number() OVER (PARTITION BY movie_id
                ORDER BY floor(similarity * 1e9 + 0.5) DESC, neighbour_id) AS INTEGER) AS rank
    FROM simi) x WHERE rank <= {k})"""]


MOST_SIMILAR = """emap AS (SELECT regexp_replace(imdb_id, '^0+', '') AS ext_id, netflix_id FROM id_map),
ms_hits AS (
  SELECT t.movie_id, t.user_id, k.rank, r.rating
  FROM test t
  JOIN emap f ON f.netflix_id = t.movie_id
  JOIN topk k ON k.movie_id = f.ext_id
  JOIN emap b ON b.ext_id = k.neighbour_id
  JOIN ratings r ON r.user_id = t.user_id AND r.movie_id = b.netflix_id
  WHERE b.netflix_id <> t.movie_id AND r.rating IS NOT NULL AND r.rating <> 0),
ms_pred AS (
  SELECT movie_id, user_id, CAST(arg_min(rating, rank) AS DOUBLE) AS raw,
         CAST(arg_min(rating, rank) AS INTEGER) AS prediction
  FROM ms_hits GROUP BY movie_id, user_id)"""


def _base():
    return [RATINGS, ID_MAP, AVAILABLE, TEST]


def _all_preds():
    return with_(*_base(), FEATURES, USER_AVG, GROUP_LENS, SHW, *similarity_ctes(25), MOST_SIMILAR,
                 f"""allp AS (
  SELECT 'group_lens' AS algorithm, movie_id, user_id, raw, {pred('raw')} AS prediction FROM gl_pred
  UNION ALL
  SELECT 'shw' AS algorithm, movie_id, user_id, raw, {pred('raw')} AS prediction FROM shw_pred
  UNION ALL
  SELECT 'most_similar' AS algorithm, movie_id, user_id, raw, prediction FROM ms_pred)""")


def core_queries() -> dict[str, str]:
    q = {}
    q["user_avg"] = with_(RATINGS, USER_AVG) + \
        "SELECT user_id, n_ratings, sum_ratings, round(avg_rating, 6) AS avg_rating FROM uavg"
    q["user_ratings_loo"] = with_(*_base()) + """SELECT t.movie_id, t.user_id, r.movie_id AS rated_movie_id, r.rating
FROM test t JOIN ratings r ON r.user_id = t.user_id WHERE r.movie_id <> t.movie_id"""
    q["corater_candidates"] = with_(*_base()) + """SELECT t.movie_id, t.user_id, r.user_id AS corater_id, r.rating AS vote
FROM test t JOIN ratings r ON r.movie_id = t.movie_id AND r.user_id <> t.user_id"""
    q["pair_stats"] = with_(*_base(), FEATURES) + \
        "SELECT user_id, corater_id, n, s_u, s_v, s_uv, s_uu, s_vv FROM stats"
    q["user_cosine"] = with_(*_base(), FEATURES) + \
        "SELECT movie_id, user_id, corater_id, round(w, 6) AS w FROM feat"
    q["relative_avg"] = with_(*_base(), FEATURES) + """SELECT movie_id, user_id, corater_id,
  round(CASE WHEN n > 0 THEN s_u / n ELSE 0.0 END, 6) AS user_rel_avg,
  round(CASE WHEN n > 0 THEN s_v / n ELSE 0.0 END, 6) AS corater_rel_avg FROM feat"""
    q["group_lens"] = with_(*_base(), FEATURES, USER_AVG, GROUP_LENS) + \
        f"SELECT movie_id, user_id, round(raw, 6) AS raw, {pred('raw')} AS prediction FROM gl_pred"
    q["group_lens_loo"] = with_(*_base(), FEATURES, USER_AVG) + f"""SELECT g.movie_id, g.user_id,
  round(r.mu + g.num / g.den, 6) AS raw, {pred('r.mu + g.num / g.den')} AS prediction
FROM (SELECT f.movie_id, f.user_id, max(f.r_target) AS r_target,
             sum(f.w * (f.vote - mv.avg_rating)) AS num, sum(abs(f.w)) AS den
      FROM feat f JOIN uavg mv ON mv.user_id = f.corater_id GROUP BY f.movie_id, f.user_id) g
JOIN (SELECT user_id, n_ratings, sum_ratings FROM uavg) u ON u.user_id = g.user_id,
LATERAL (SELECT CASE WHEN u.n_ratings - CASE WHEN g.r_target IS NULL THEN 0 ELSE 1 END > 0
         THEN (u.sum_ratings - coalesce(g.r_target, 0)) / (u.n_ratings - CASE WHEN g.r_target IS NULL THEN 0 ELSE 1 END)
         ELSE 0.0 END AS mu) r
WHERE g.den <> 0"""
    q["shw_loo"] = with_(*_base(), FEATURES) + f"""SELECT movie_id, user_id, round(num1 / den + num2 / den, 6) AS raw,
  {pred('num1 / den + num2 / den')} AS prediction FROM (
  SELECT movie_id, user_id,
    sum(abs(w) * CASE WHEN nn > 0 THEN (s_u - coalesce(r_target, 0)) / nn ELSE 0.0 END) AS num1,
    sum(w * (vote - CASE WHEN nn > 0 THEN (s_v - CASE WHEN r_target IS NULL THEN 0 ELSE vote END) / nn ELSE 0.0 END)) AS num2,
    sum(abs(w)) AS den
  FROM (SELECT *, n - CASE WHEN r_target IS NULL THEN 0 ELSE 1 END AS nn FROM feat) x
  GROUP BY movie_id, user_id) y WHERE den <> 0"""
    q["shw"] = with_(*_base(), FEATURES, SHW) + \
        f"SELECT movie_id, user_id, round(raw, 6) AS raw, {pred('raw')} AS prediction FROM shw_pred"
    q["most_similar"] = with_(*_base(), *similarity_ctes(25), MOST_SIMILAR) + \
        "SELECT movie_id, user_id, prediction FROM ms_pred"
    q["predictions_all"] = _all_preds() + \
        "SELECT algorithm, movie_id, user_id, round(raw, 6) AS raw, prediction FROM allp"
    q["prediction_errors"] = _all_preds() + """SELECT a.algorithm, t.movie_id, t.user_id
FROM test t CROSS JOIN (VALUES ('group_lens'), ('shw'), ('most_similar')) a(algorithm)
WHERE NOT EXISTS (SELECT 1 FROM allp p WHERE p.algorithm = a.algorithm
                  AND p.movie_id = t.movie_id AND p.user_id = t.user_id)"""
    q["rmse"] = _all_preds() + """, names AS (
  SELECT * FROM (VALUES ('group_lens'), ('shw'), ('most_similar')) v(algorithm))
SELECT a.algorithm, CAST(count(p.movie_id) AS BIGINT) AS n_pred,
  (SELECT CAST(count(*) AS BIGINT) FROM test) AS n_test,
  round(coalesce(sqrt(avg(CAST((r.rating - p.prediction) * (r.rating - p.prediction) AS DOUBLE))), 0.0), 6) AS rmse,
  round(count(p.movie_id) / (SELECT count(*) FROM test), 6) AS coverage
FROM names a LEFT JOIN allp p ON p.algorithm = a.algorithm
LEFT JOIN ratings r ON r.movie_id = p.movie_id AND r.user_id = p.user_id
GROUP BY a.algorithm"""
    q["recent_test_set"] = with_(*_base()) + "SELECT movie_id, user_id FROM test"
    q["full_test_set"] = with_(RATINGS, ID_MAP, AVAILABLE) + """SELECT r.movie_id, r.user_id
FROM ratings r JOIN id_map m ON m.netflix_id = r.movie_id
JOIN available a ON a.movie_id = regexp_replace(m.imdb_id, '^0+', '')"""
    q["test_set_limit"] = with_(*_base()) + \
        "SELECT movie_id, user_id FROM test ORDER BY movie_id, user_id LIMIT 1000"
    q["test_set_summary"] = with_(*_base()) + \
        "SELECT CAST(count(*) AS BIGINT) AS predictions, CAST(count(DISTINCT movie_id) AS BIGINT) AS movies FROM test"
    q["movies_per_year"] = with_(ID_MAP) + \
        "SELECT year, CAST(count(*) AS BIGINT) AS movies FROM id_map WHERE year >= 2000 AND year < 2008 GROUP BY year"
    q["ratings_last_wins"] = with_(EVENTS) + """SELECT user_id, movie_id, rating FROM (
  SELECT user_id, movie_id, rating, row_number() OVER (PARTITION BY user_id, movie_id
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC,
             l_quantity DESC, l_extendedprice DESC) AS rn
  FROM events_r) x WHERE rn = 1"""
    q["ratings_csv_scan"] = with_(RATINGS) + "SELECT user_id, movie_id, rating FROM ratings"
    q["incremental_ratings"] = q["ratings_last_wins"]
    q["incremental_user_avg"] = with_(EVENTS, NEWEST, USER_AVG) + \
        "SELECT user_id, n_ratings, sum_ratings, round(avg_rating, 6) AS avg_rating FROM uavg"
    q["incremental_pair_stats"] = with_(EVENTS, NEWEST, ID_MAP, AVAILABLE, TEST, FEATURES) + \
        "SELECT user_id, corater_id, n, s_u, s_v, s_uv, s_uu, s_vv FROM stats"
    q["tfidf_weights"] = with_(*tfidf_ctes()) + """SELECT movie_id, term, tf, df, round(idf, 6) AS idf,
  round(weight, 6) AS weight FROM weights"""
    q["movie_similarity"] = with_(*_base(), *similarity_ctes(25)) + \
        "SELECT movie_id, neighbour_id, round(similarity, 6) AS similarity FROM simi"
    q["top_k_similar"] = with_(*_base(), *similarity_ctes(25)) + \
        "SELECT movie_id, neighbour_id, round(similarity, 6) AS similarity, rank FROM topk"
    return q
