"""Each query with a SQL twin against DuckDB, on the smallest dataset."""

import duckdb
import pytest

from reelrank.llm import queries as Q

SF = "/root/testdata/sf0.001"


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = Q.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted([tuple(_norm(r[c]) for c in cols) for r in got.collect()], key=repr)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({Q.oracle_sql()[name]})").fetchall()
    assert rows == sorted([tuple(map(_norm, r)) for r in want], key=repr)
    assert rows


def test_registered_numbers():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.queries()) == list(range(1, 14))
