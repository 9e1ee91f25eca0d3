"""Exact k-means on integer vectors by Shallot search.

Every vector carries its centroid, its second-nearest one, an upper bound on
the distance to the first and a lower bound on that to any other.  Centroid moves
widen the bounds; only where they meet is a vector searched again: its exact distances to both
remembered centroids come first, the closer one starts the scan, and the start's
neighbours are read in order of distance until they leave the ball of radius
``d(x, start) + d(x, second best)``, which shrinks with every better hit.  All comparisons of
candidates are between integer squares, so ties are exact.

The vectors stay in Spark tables; a round broadcasts the ``k`` centroids inside
its task closure and gathers one exact sum per cluster and dimension.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

K = 16
ROUNDS = 3
DIM = 64
#: Integer components up to this bound leave squared distances within 64 bits.
SMALL = 1 << 26
#: Relative slack of every bound computed in doubles.
SLACK = 1e-12


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows (64-bit or Python integers)."""
    return ((x - y) ** 2).sum(1)


def root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


@dataclass
class Centroids:
    """Centroids of a round: integer ``at``, their distances ``gap``, each one's
    neighbours by distance ``order``, and how far each moved."""

    at: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.at)
        # components too large for doubles: no gap is known, every centroid is in reach
        self.wide = self.at.dtype == object
        self.gap = np.zeros((k, k)) if self.wide else np.stack([root(squares(self.at, c)) for c in self.at])
        ranked = self.gap.copy()
        np.fill_diagonal(ranked, -1)
        self.order = np.argsort(ranked, axis=1, kind="stable")


def moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.full(len(old), np.inf) if new.dtype == object else root(squares(old, new))


def shallot(x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray,
            cents: Centroids) -> int:
    """Nearest centroid (ties: smaller number) of every row of ``x``; updates
    the four state arrays in place and returns the number of distances taken."""
    k, taken = len(cents.at), 0
    if k == 1:
        near[:], second[:], upper[:], lower[:] = 0, 0, np.inf, np.inf
        return taken
    if cents.wide:
        upper[:], lower[:] = np.inf, 0
    else:
        rank = np.argsort(-cents.moved, kind="stable")
        others = np.where(near == rank[0], cents.moved[rank[1]], cents.moved[rank[0]])
        upper += cents.moved[near] * (1 + SLACK)
        lower -= others * (1 + SLACK)
    rows = np.nonzero(~(upper * (1 + SLACK) < lower * (1 - SLACK)))[0]
    if not len(rows):
        return taken
    best = squares(x[rows], cents.at[near[rows]])
    taken += len(rows)
    if not cents.wide:
        upper[rows] = root(best)
        still = ~(upper[rows] * (1 + SLACK) < lower[rows] * (1 - SLACK))
        rows, best = rows[still], best[still]
    n1, n2 = near[rows], second[rows]
    d1, d2 = best, squares(x[rows], cents.at[n2])
    taken += len(rows)
    closer = (d2 < d1) | ((d2 == d1) & (n2 < n1))
    n1, n2 = np.where(closer, n2, n1), np.where(closer, n1, n2)
    d1, d2 = np.where(closer, d2, d1), np.where(closer, d1, d2)
    start, known = n1.copy(), n2.copy()
    reach = np.zeros(len(rows)) if cents.wide else root(d1)
    live = np.arange(len(rows))
    for j in range(1, k):
        c = cents.order[start[live], j]
        if not cents.wide:
            # the ball only shrinks and neighbours only get farther: who is out stays out
            inside = cents.gap[start[live], c] <= (reach[live] + root(d2[live])) * (1 + SLACK)
            live, c = live[inside], c[inside]
        if not len(live):
            break
        new = c != known[live]
        at, c = live[new], c[new]
        d = squares(x[rows[at]], cents.at[c])
        taken += len(at)
        first = (d < d1[at]) | ((d == d1[at]) & (c < n1[at]))
        next_ = ~first & ((d < d2[at]) | ((d == d2[at]) & (c < n2[at])))
        down = at[first]
        d2[down], n2[down] = d1[down], n1[down]
        d1[down], n1[down] = d[first], c[first]
        d2[at[next_]], n2[at[next_]] = d[next_], c[next_]
    near[rows], second[rows] = n1, n2
    if not cents.wide:
        upper[rows], lower[rows] = root(d1), root(d2)
    return taken


def _vectors(batch: pa.RecordBatch, wide: bool) -> np.ndarray:
    """The batch's integer vectors; wide ones travel as doubles."""
    flat = batch.column("_rr_x").flatten().to_numpy(zero_copy_only=False)
    if not wide:
        return flat.astype(np.int64).reshape(batch.num_rows, -1)
    ints = np.empty(len(flat), dtype=object)
    ints[:] = [math.floor(v * 64) if abs(v) < 1e300 else math.floor(v) * 64 for v in flat.tolist()]
    return ints.reshape(batch.num_rows, -1)


def _assign(cents: Centroids, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, cents.wide)
            near, second, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy()
                                          for c in ("near", "second", "upper", "lower"))
            shallot(x, near, second, upper, lower, cents)
            out = [batch.column("vec_id"), batch.column("_rr_x"), pa.array(near), pa.array(second), pa.array(upper), pa.array(lower)]
            names = ["vec_id", "_rr_x", "near", "second", "upper", "lower"]
            if last:
                d = squares(x, cents.at[near])
                out.append(pa.array([v if v < 1 << 63 else None for v in d.tolist()], pa.int64()))
                names.append("distance")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _partial_sums(k: int, wide: bool):
    """One partition's exact sums, as 32-bit limbs (the last one signed) of wide ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, near = _vectors(batch, wide), batch.column("near").to_numpy()
            if total is None:
                total, count = np.zeros((k, x.shape[1]), dtype=object), [0] * k
            for c in np.unique(near):
                mine = x[near == c]
                total[c] += mine.sum(0).astype(object)
                count[c] += len(mine)
        rows = []
        for c in range(k if total is not None else 0):
            rows.append((c, -1, 0, count[c]))
            for i, v in enumerate(total[c]):
                limbs = 0
                while wide and abs(v) >= 1 << 31:
                    rows.append((c, i, limbs, int(v & 0xFFFFFFFF)))
                    v, limbs = v >> 32, limbs + 1
                rows.append((c, i, limbs, int(v)))
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cluster", "dim", "limb", "total"])

    return run


def _new_centroids(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """Componentwise ``floor(sum / count)`` of every non-empty cluster: at most
    one row per cluster, dimension and limb comes to the driver."""
    wide = old.dtype == object
    parts = (state.select("near", "_rr_x").mapInArrow(_partial_sums(len(old), wide), "cluster long, dim long, limb long, total long")
             .groupBy("cluster", "dim", "limb").agg(F.sum("total").alias("total")).collect())
    sums: dict[tuple[int, int], int] = {}
    for r in parts:
        sums[r.cluster, r.dim] = sums.get((r.cluster, r.dim), 0) + (r.total << (32 * r.limb))
    new = old.copy()
    for c in range(len(old)):
        n = sums.get((c, -1), 0)
        if n:
            new[c] = [sums[c, i] // n for i in range(old.shape[1])]
    return new


def usable(vector: Column, dim: int) -> Column:
    v = vector.cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, bad)


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
            dim: int = DIM) -> DataFrame:
    """k-means of the integer vectors ``floor(64 x)``: ``vec_id``, ``cluster``,
    ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256`` of the final centroid, one row per kept vector.

    Start: the ``k`` kept vectors of smallest sha256 of ``1:<id>`` (a null id
    reads ``null``; equal ids go by components; fewer vectors, fewer clusters).  Kept are vectors of ``dim``
    components, none null or non-finite; others, null vectors included, give no row.  Ties go to
    the smaller number, an empty cluster keeps its centroid, repeated rows count
    each.  Components beyond 2**26 are compared in Python integers
    without bounds; a distance or sum that no long holds is null.  Other columns are
    ignored; an empty table gives no row.
    """
    spark = df.sparkSession
    v = F.col(vector).cast("array<double>")
    kept = df.where(usable(F.col(vector), dim)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("_rr_x"))
    top = kept.agg(F.max(F.array_max(F.transform("_rr_x", F.abs)))).first()[0]
    wide = top is not None and top * 64 > SMALL
    if not wide:
        kept = kept.withColumn("_rr_x", F.transform("_rr_x", lambda e: F.floor(e * 64).cast("int")))
    seed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    first = [r._rr_x for r in kept.orderBy(seed, "_rr_x").limit(k).collect()]
    if not first:
        return kept.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    if wide:
        at = np.empty((len(first), dim), dtype=object)
        at[:] = [[math.floor(e * 64) if abs(e) < 1e300 else math.floor(e) * 64 for e in x] for x in first]
    else:
        at = np.array(first, dtype=np.int64).reshape(len(first), dim)
    kind = "array<double>" if wide else "array<int>"
    schema = f"vec_id long, _rr_x {kind}, near long, second long, upper double, lower double"
    long = lambda n: F.lit(n).cast("long")
    state = kept.select("vec_id", "_rr_x", long(0).alias("near"), long(min(1, len(first) - 1)).alias("second"),
                        F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    moved = np.zeros(len(first))
    for r in range(rounds + 1):
        last = r == rounds
        state = C.materialize(state.mapInArrow(_assign(Centroids(at, moved), last), schema + (", distance long" if last else "")))
        if not last:
            new = _new_centroids(state, at)
            at, moved = new, moves(at, new)
    per = state.groupBy("near").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count("distance").alias("n"),
                                    F.count(F.lit(1)).alias("all")).collect()
    fits = lambda s, ok: int(s) if ok and s < 1 << 63 else None
    whole = all(r.n == r["all"] for r in per)
    inertia = fits(sum(int(r.d or 0) for r in per), whole)
    names = {c: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for c, row in enumerate(at)}
    table = spark.createDataFrame([(r.near, fits(r.d or 0, r.n == r["all"]), inertia, names[r.near]) for r in per],
                                  "near long, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return state.join(F.broadcast(table), "near").select(
        "vec_id", F.col("near").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
