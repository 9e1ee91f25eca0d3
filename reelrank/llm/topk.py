"""Exact top-k by inner product: a dual-tree search over cover trees.

Candidates and queries are dealt into blocks; each pair of blocks is one unit
of work.  In a unit both sides get a cover tree (a node's children are centres
that cover its points at half its radius, no two of them closer than that).  The search takes
node pairs, most promising first, and drops a pair when the largest inner
product its covering radii allow, ``<q,c> + |c| r_q + |q| r_c + r_q r_c``, is below
the worst k-th best score in the query node.  The units' answers are merged by
a window that keeps k rows per query.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

K = 5
LEAF = 128
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192


@dataclass
class Node:
    """Points of a cover-tree node: ``rows``, the ``center`` and the covering ``radius``."""

    rows: np.ndarray
    center: np.ndarray
    radius: float
    children: list["Node"] = field(default_factory=list)


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, at: int | None = None) -> Node:
    """Cover tree over the rows of ``x``.

    Every level picks centres greedily: a point not within half the node's
    radius of an earlier centre becomes one.  Where that would split a node
    into more parts than it is worth (distances alike, as in many dimensions), the
    cover stops at ``LEAF`` points.
    """
    rows = np.arange(len(x)) if rows is None else rows
    at = rows[0] if at is None else at
    dist = np.sqrt(((x[rows] - x[at]) ** 2).sum(1))
    node = Node(rows, x[at], float(dist.max(initial=0)) * (1 + 1e-12))
    if len(rows) <= LEAF or node.radius == 0:
        return node
    limit = node.radius / 2
    near, own = dist.copy(), np.zeros(len(rows), np.int64)
    centers = [at]
    most = max(2, len(rows) // LEAF)
    while near.max() > limit and len(centers) < most:
        far = int(np.argmax(near))
        d = np.sqrt(((x[rows] - x[rows[far]]) ** 2).sum(1))
        closer = d < near
        near[closer], own[closer] = d[closer], len(centers)
        centers.append(rows[far])
    for i, c in enumerate(centers):
        part = rows[own == i]
        if len(part) == len(rows):
            return node
        if len(part):
            node.children.append(cover_tree(x, part, c))
    return node


def dual_search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, qids: np.ndarray, k: int):
    """Best ``k`` (score, id) of every query: scores (queries, k) with -inf for
    none, and ids; a query's own id is no candidate; ties to the smaller id."""
    best = np.full((len(q), k), -np.inf)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    norm = lambda n: float(np.sqrt((n.center ** 2).sum()))

    def bound(a: Node, b: Node) -> float:
        top = float(a.center @ b.center) + a.radius * norm(b) + b.radius * norm(a) + a.radius * b.radius
        return top + 1e-9 * (abs(top) + 1)

    def base(a: Node, b: Node) -> None:
        s = q[a.rows] @ x[b.rows].T
        s[qids[a.rows][:, None] == ids[b.rows]] = -np.inf
        s = np.concatenate((best[a.rows], s), 1)
        i = np.concatenate((best_id[a.rows], np.broadcast_to(ids[b.rows], (len(a.rows), len(b.rows)))), 1)
        if s.shape[1] > 4 * k:  # what is below the k-th score can go before the sort
            top = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            wide = int((s >= top[:, None]).sum(1).max())
            pick = np.argpartition(-s, min(wide, s.shape[1] - 1), axis=1)[:, :wide]
            s, i = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
        i = np.where(np.isinf(s), np.iinfo(np.int64).max, i)
        o = np.lexsort((i, -s), axis=1)[:, :k]
        best[a.rows], best_id[a.rows] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)

    def visit(a: Node, b: Node) -> None:
        if bound(a, b) < best[a.rows, -1].min():
            return
        if not a.children and not b.children:
            base(a, b)
            return
        pairs = [(c, d) for c in (a.children or [a]) for d in (b.children or [b])]
        for c, d in sorted(pairs, key=lambda p: -bound(*p)):
            visit(c, d)

    if len(q) and len(x):
        visit(cover_tree(q), cover_tree(x))
    return best, best_id


def integer_search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, qids: np.ndarray, k: int) -> pd.DataFrame:
    """Best ``k`` rows of every query in Python integers, for blocks whose
    scores doubles can't hold.  A score that no long holds takes the nearest long."""
    whole = np.frompyfunc(int, 1, 1)
    cand, low, high = whole(x), -(1 << 63), (1 << 63) - 1
    rows = []
    for one, own in zip(q, qids.tolist()):
        score = cand @ whole(one)
        best = heapq.nsmallest(k, ((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != own))
        rows += [(own, i, min(max(-s, low), high)) for s, i in best]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(np.int64)


def quantized(vector: Column) -> Column:
    """Integer components ``floor(256 x)``; null if the vector is null or holds
    a null or non-finite component."""
    v = vector.cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    # doubles from 2**53 on are whole; floor() of them as long would end at 2**63
    whole = lambda e: F.when(F.abs(e) < 2.0 ** 53, F.floor(e * 256).cast("double")).otherwise(
        F.greatest(F.least(e, F.lit(2.0 ** 1000)), F.lit(-(2.0 ** 1000))) * 256)
    return F.when(v.isNotNull() & ~F.exists(v, bad), F.transform(v, whole))


def _unit(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, g in pdf.groupby(pdf["_rr_v"].map(len)):
            v = np.stack(g["_rr_v"].to_numpy()) if dim else np.empty((len(g), 0))
            ids, ask = g["_rr_id"].to_numpy(), g["_rr_q"].to_numpy()
            if not ask.any() or ask.all():
                continue
            # inner products of at most 2**53 are exact in doubles
            top = np.abs(v).max(initial=0)
            if top * top * dim >= 2.0 ** 53 and np.sqrt((v[ask] ** 2).sum(1).max()) * np.sqrt((v[~ask] ** 2).sum(1).max()) >= 2.0 ** 53:
                out.append(integer_search(v[ask], v[~ask], ids[~ask], ids[ask], k))
                continue
            s, i = dual_search(v[ask], v[~ask], ids[~ask], ids[ask], k)
            row, col = np.nonzero(~np.isinf(s))
            out.append(pd.DataFrame({"query_id": ids[ask][row], "vec_id": i[row, col], "score": s[row, col].astype(np.int64)}))
        cols = ("query_id", "vec_id", "score")
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in cols})

    return run


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """The ``k`` candidates of highest inner product of every query row:
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (of the integer vectors).

    All rows but the query's own id are candidates; ties go to the smaller
    id; fewer candidates give fewer rows.  Vectors that are null or hold a null
    or non-finite component and rows with a null id take no part; vectors of
    another length are no candidates; rows repeated with the same id and vector are
    one candidate.  Scores too large for doubles are computed in integers, plainly; one that no
    long holds is given as the nearest long.  Other columns are ignored; an empty table gives no row.
    """
    rows = C.materialize(df.select(F.col(id_col).cast("long").alias("_rr_id"), quantized(F.col(vector)).alias("_rr_v"),
                                   F.coalesce(is_query, F.lit(False)).alias("_rr_q"))
                         .where("_rr_id is not null and _rr_v is not null").distinct())
    n, asked = rows.agg(F.count(F.lit(1)), F.sum(F.col("_rr_q").cast("long"))).first()
    cand_blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-(asked or 0) // QUERY_BLOCK))
    h = F.xxhash64("_rr_id", F.lit(3))
    cand = (rows.select("_rr_id", "_rr_v", F.lit(False).alias("_rr_q"), F.pmod(h, F.lit(cand_blocks)).alias("_rr_c"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("_rr_a")))
    ask = (rows.where("_rr_q").select("_rr_id", "_rr_v", "_rr_q",
                                      F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cand_blocks - 1).cast("long"))).alias("_rr_c"),
                                      F.pmod(h, F.lit(query_blocks)).alias("_rr_a")))
    found = (cand.unionByName(ask).groupBy("_rr_a", "_rr_c")
             .applyInPandas(_unit(k), "query_id long, vec_id long, score long"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
