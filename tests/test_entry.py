"""Driver contract: entry(), registry and oracle on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as E
from reelrank.sources.tables import TABLES

from .conftest import SF001

FAST = ["user_avg", "group_lens", "shw", "top_k_similar", "most_similar", "best_subtitles",
        "title_match", "test_set_parse", "srt_merge", "page_paragraphs", "unique_ids"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["movie_id", "user_id", "raw", "prediction"]
    assert df.count() > 0


def test_every_query_has_oracle():
    """The training-data queries say for themselves which have SQL (tests/llm)."""
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    optional = {k for k in q if k == "pipeline" or k.startswith("op")}
    assert set(q) - set(s) <= optional and len(set(q) - optional) >= 50


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("key", FAST)
def test_oracle_sf0001(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = E.queries()[key](spark, SF001)
    res = con.execute(E.oracle_sql()[key])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    a = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=repr)
    idx = [cols.index(c) for c in order]
    b = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("key", ["group_lens", "most_similar"])
def test_shuffle_path_equals_broadcast_path(spark, key):
    q = E.queries()[key]
    a = sorted(map(tuple, q(spark, SF001).collect()))
    spark.conf.set("reelrank.broadcast.maxBytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = sorted(map(tuple, q(spark, SF001).collect()))
    finally:
        spark.conf.unset("reelrank.broadcast.maxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert a == b and len(a) > 0


def test_outputs_round_trip_writes_only_what_the_algorithms_read(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from reelrank.plans import file_queries as fq

    n, day = 12, datetime(1995, 1, 1)
    tables = {
        "orders": ([(u, u) for u in range(n)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(u, 1 + (u + k) % 3, 1, k, float(1 + 7 * (u + k) % 50), 1.0, day) for u in range(n) for k in range(2)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"),
        "part": ([(k, 30 + k, f"p{k}") for k in (1, 2, 3)], "p_partkey long, p_size int, p_name string"),
        "documents": ([(k, "x", "en", "s") for k in (1, 2, 3)], "doc_id long, text string, lang string, source string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    wrote, materialize = [], fq.materialize
    monkeypatch.setattr(fq, "materialize", lambda df: wrote.append(df.columns) or materialize(df))
    got = {r.algorithm: (r.n_pred, r.n_test) for r in fq.q_outputs_round_trip(spark, str(tmp_path)).collect()}
    assert set(got) == {"group_lens", "shw"} and all(n_test == 2 * n for _, n_test in got.values())
    features = next(c for c in wrote if "corater_id" in c)
    assert not {"s_uv", "s_uu", "s_vv"} & set(features)
