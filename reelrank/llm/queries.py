"""Registered queries: each operator over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, common, kmeans, langid, linededup, mixing, neardup_embeddings, packing, sharding, simhash, topk, toxicity, warc,
               whitening)

SHARDS = 8


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(common.read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "source")


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_embeddings.near_duplicates(common.read_table(spark, sf_dir, "embeddings"))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_warc(common.read_table(spark, sf_dir, "pages"), folder)
    found = warc.read_warc(spark, folder, with_payload=False)
    return found.where("kind = 'record'").select(
        warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_number("refers_to").alias("refers_to"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(common.read_table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shard_records(rows, "doc_id", [1.0] * SHARDS, order=[F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.plan_mix(docs, source="source", size=F.col("size"), key="doc_id")
    return out.select("doc_id", "size", "source_size", "target", (F.col("reps") * F.col("size")).alias("taken"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return linededup.line_decisions(docs, "doc_id", "text").select("doc_id", "n_lines", "n_kept", "removed")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = common.read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vecs, F.col("vec_id") % 50 == 0)


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(common.read_table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"),
                             "doc_id", "text", "toxic")


def op11_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(common.read_table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.read_table(spark, sf_dir, "embeddings"))


#: Conversation -7: its texts hold every kind of control string of its template and a backslash.
PLANTED = "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit(PLANTED).alias("text"))
    got = chat.read_back(chat.format_conversations(talks.unionByName(planted)))
    return got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def _u(i: str, key: str) -> str:
    """The hash unit of common.hash_unit over md5('shard|i|key')."""
    return (f"((('0x' || substr(md5('shard|{i}|' || coalesce(cast({key} AS VARCHAR), '\\N')), 1, 12))::BIGINT)::DOUBLE + 0.5)"
            " / 281474976710656.0")


def _shard(n: int) -> str:
    scores = ", ".join(f"-1.0 / ln({_u(str(i), 'doc_id')})" for i in range(n))
    return f"list_position([{scores}], list_max([{scores}])) - 1"


def _oracle_op5() -> str:
    return f"""
WITH d AS (
  SELECT doc_id, cast(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, coalesce(text, '') AS t FROM documents),
-- CRC-32 has no SQL function here: a table by rule, then one step per byte
tab AS (SELECT list(c ORDER BY b) AS steps FROM (
  SELECT b, list_reduce(list_prepend(cast(b AS BIGINT), [cast(i AS BIGINT) FOR i IN range(8)]),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM range(256) r(b))),
crc AS (
  SELECT doc_id, t, xor(list_reduce(list_prepend(4294967295::BIGINT,
      [cast('0x' || substr(hex(encode(t)), cast(2 * i + 1 AS BIGINT), 2) AS BIGINT) FOR i IN range(strlen(t))]),
    lambda x, y: xor(x // 256, tab.steps[xor(x % 256, y) + 1])), 4294967295) AS text_crc32
  FROM d, tab),
s AS (
  SELECT d.doc_id, d.size, crc.text_crc32, {_shard(SHARDS)} AS shard, {_shard(SHARDS + 1)} AS grown_shard
  FROM d JOIN crc USING (doc_id))
SELECT doc_id, size, text_crc32, 'key' AS law, cast(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY
         md5('shard|slot|' || coalesce(cast(doc_id AS VARCHAR), '\\N') || '|' || text_crc32)) - 1 AS slot,
       cast(grown_shard AS INTEGER) AS grown_shard
FROM s"""


def _oracle_op11() -> str:
    """The rounds written out, every vector against every centroid."""
    def assigned(r: int) -> str:
        return f"""
a{r} AS (SELECT vec_id, x, c, d FROM (
  SELECT v.vec_id, v.x, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i]))) AS d,
    row_number() OVER (PARTITION BY v.vec_id ORDER BY d, k.c) AS rn
  FROM kept v, c{r} k) WHERE rn = 1)"""

    rounds = "".join(f"""{assigned(r)},
m{r} AS (SELECT c, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, 65) t(i) GROUP BY c, i),
c{r + 1} AS (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{r} k LEFT JOIN (
  -- floor(s / n) in integers
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM m{r} GROUP BY c) m USING (c)),"""
                     for r in range(kmeans.ROUNDS))
    end = kmeans.ROUNDS
    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: floor(e * 64)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {kmeans.DIM}
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (
  SELECT sha256('1:' || coalesce(vec_id::VARCHAR, 'null')) AS h, x FROM kept ORDER BY h, x LIMIT {kmeans.K})),{rounds}{assigned(end)}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{end} JOIN c{end} k USING (c)"""


def _oracle_op13() -> str:
    """The digests straight from the rows; only the formatted length needs the template."""
    def escaped(col: str, codes: dict[str, str]) -> str:
        out = f"replace({col}, chr(92), chr(92) || 'b')"
        for mark, code in codes.items():
            out = f"replace({out}, '{mark}', chr(92) || '{code[1]}')"
        return out

    text, role = escaped("text", chat.CODES), escaped("role", chat.ROLE_CODES)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
-- equal neighbours of one role share a block: a part mark instead of an end and a head
l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN len(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(len({text}) + CASE WHEN before = role THEN {len(chat.PART)}
      ELSE {len(chat.HEAD) + len(chat.SEP) + len(chat.END) + 1} + len({role}) END)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    word = r"[^\x20\x09-\x0D]+"
    return {
        "op2_embedding_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
        "op3_warc_salvage": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT page_id, h, s, min(page_id) OVER (PARTITION BY s) AS least FROM p)
SELECT page_id, cast(strlen(h) AS BIGINT) AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)],
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM f""",
        "op5_rendezvous_sharding": _oracle_op5(),
        "op6_source_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{word}')), 0)::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS s,
    [3, 1, 2][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3) + 1] AS w
  FROM d GROUP BY source),
-- the capped sources are those of the smallest cap per weight
ranked AS (
  SELECT *, 1.5 * sum(s) OVER () - coalesce(sum(2 * s) OVER before, 0) AS rest,
    sum(w) OVER (ORDER BY s / w DESC, source NULLS FIRST ROWS UNBOUNDED PRECEDING) AS open_w
  FROM src
  WINDOW before AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT *, rest * w / open_w > 2 * s AS capped FROM ranked),
open AS (SELECT 1.5 * (SELECT sum(s) FROM src) - coalesce(sum(CASE WHEN capped THEN 2 * s END), 0) AS rest,
         sum(CASE WHEN NOT capped THEN w END) AS w FROM lev),
goal AS (SELECT lev.source, s AS source_size,
  CASE WHEN capped THEN 2.0 * s ELSE lev.w * open.rest::DOUBLE / open.w::DOUBLE END::DOUBLE AS target FROM lev, open),
t AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source
      ORDER BY md5('mix|' || coalesce(cast(d.doc_id AS VARCHAR), '\N') || '|' || d.size)
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  cast(size * (whole + CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END)
    AS BIGINT) AS taken
FROM t""",
        "op11_shallot_clusters": _oracle_op11(),
        "op13_chat_format": _oracle_op13(),
        "op8_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: floor(e * 256)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.x, c.x) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x))
WHERE rank <= 5""",
    }
