"""Embedding near-duplicates by cross-polytope hashing.

A vector is padded to a power of two, rotated by three rounds of random signs
and a fast Hadamard transform, and hashed to the coordinate of largest
magnitude with its sign.  ``HASHES`` such values make the bucket of a table;
besides it, a table probes the buckets next in likelihood, those that swap one
value for its runner-up.  Rows of one bucket of which at least one has it as its main bucket are
candidates; every candidate pair is verified by its cosine.

Equal vectors are one class first.  Buckets are dealt out in bounded blocks
(``common.blocked_groups``); a unit multiplies its blocks and emits, per
vector, the number of links and one link of a spanning forest, never the
pairs.  A pair that meets in several buckets counts in the first of them, which
both vectors' bucket lists name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .simhash import forest

THRESHOLD = 0.95
TABLES = 8
HASHES = 3
PROBES = 8
BLOCK = 512
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row (a power of two long)."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Bucket codes (rows, tables, probes); the first probe is the main bucket."""
    dim = 1 << max(0, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng(SEED + dim)
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, dim - x.shape[1])))
    out = np.empty((len(x), tables, probes), np.int64)
    for t in range(tables):
        tops, vals = [], []
        for _ in range(hashes):
            y = x
            for signs in rng.choice([-1.0, 1.0], (3, dim)):
                y = hadamard(y * signs)
            mag = np.abs(y)
            top = np.argsort(-mag, axis=1, kind="stable")[:, :min(4, dim)]
            m = np.take_along_axis(mag, top, 1)
            tops.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
            vals.append((m[:, :1] - m) / m[:, :1])
        # alternatives: one or two hashes moved to a lesser coordinate, cheapest first
        picks = [(0,) * hashes]
        width = tops[0].shape[1]
        for k in (1, 2):
            for which in combinations(range(hashes), min(k, hashes)):
                for alt in np.ndindex(*[width - 1] * len(which)):
                    picks.append(tuple(alt[which.index(i)] + 1 if i in which else 0 for i in range(hashes)))
        picks = list(dict.fromkeys(picks))
        loss = np.stack([sum(vals[i][:, p[i]] ** 2 for i in range(hashes)) for p in picks], 1)
        code = np.stack([sum(tops[i][:, p[i]] * (2 * dim) ** i for i in range(hashes)) for p in picks], 1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        got = np.take_along_axis(code, best, 1)
        out[:, t] = np.pad(got, ((0, 0), (0, probes - got.shape[1])), mode="edge")
    return out


def classes(df: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Usable classes of equal vectors (``_rr_v``, ``_rr_c`` the smallest id,
    ``_rr_n`` copies), written; and all rows as ``_rr_id``, ``_rr_v`` (null if unusable)."""
    v = F.col(vector).cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    usable = v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda e: e != 0)
    # 0.0 + e turns -0.0 into 0.0, so that equal vectors are one class
    rows = df.select(F.col(id_col).alias("_rr_id"),
                     F.when(usable & F.col(id_col).isNotNull(), F.transform(v, lambda e: e + F.lit(0.0))).alias("_rr_v"))
    found = (rows.where(F.col("_rr_v").isNotNull()).groupBy("_rr_v")
             .agg(F.min("_rr_id").alias("_rr_c"), F.count(F.lit(1)).alias("_rr_n")))
    return C.materialize(found), rows


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no product of theirs overflows or vanishes; cosines stay the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _hashed(cls: DataFrame) -> DataFrame:
    """Written table of classes: id, copies, vector and all its bucket codes, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                vecs = b.column(0).to_pylist()
                for dim in sorted({len(v) for v in vecs}):
                    rows = [i for i, v in enumerate(vecs) if len(v) == dim]
                    x = np.array([vecs[i] for i in rows])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(1).take(pa.array(rows)), b.column(2).take(pa.array(rows)),
                         pa.array(np.full(len(rows), dim, np.int32)), pa.array([r.tobytes() for r in x], pa.binary()),
                         pa.array(buckets(scaled(x)).reshape(len(rows), -1).tolist(), pa.list_(pa.int64()))],
                        names=["_rr_c", "_rr_n", "_rr_dim", "_rr_x", "_rr_codes"])

    return C.materialize(cls.select("_rr_v", "_rr_c", "_rr_n").mapInArrow(
        run, "_rr_c long, _rr_n long, _rr_dim int, _rr_x binary, _rr_codes array<long>"))


def _routes(hashed: DataFrame) -> DataFrame:
    """Light rows: class, table, bucket, and whether it is the class's main bucket there."""
    pos = hashed.select("_rr_c", "_rr_dim", F.posexplode("_rr_codes").alias("_rr_p", "_rr_code"))
    return (pos.groupBy("_rr_c", "_rr_dim", F.floor(F.col("_rr_p") / PROBES).cast("int").alias("_rr_t"), "_rr_code")
            .agg(F.max(F.col("_rr_p") % PROBES == 0).alias("_rr_main")))


def _unit_links(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (t, dim, code, lo, hi), g in pdf.groupby(["_rr_t", "_rr_dim", "_rr_code", "_rr_lo", "_rr_hi"], sort=False):
            x = scaled(np.stack([np.frombuffer(b, np.float64) for b in g["_rr_x"]]))
            codes = np.stack(g["_rr_codes"].to_numpy()).reshape(len(g), TABLES, PROBES)
            ids, n = g["_rr_c"].to_numpy(), g["_rr_n"].to_numpy()
            main, side = g["_rr_main"].to_numpy(), g["_rr_b"].to_numpy()
            a, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
            norm = np.sqrt((x * x).sum(1))
            ok = (x[a] @ x[b].T >= threshold * norm[a][:, None] * norm[b]) & (main[a][:, None] | main[b])
            i, j = np.nonzero(ok)
            i, j = a[i], b[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            # the first bucket in which the two meet, by table and code
            big = np.iinfo(np.int64).max
            first = np.zeros(len(i), bool)
            for at in range(0, len(i), 4096):
                p, q = i[at:at + 4096], j[at:at + 4096]
                met_p = (codes[q] == codes[p][:, :, :1]).any(2)
                met_q = (codes[p] == codes[q][:, :, :1]).any(2)
                place = np.argmax(met_p | met_q, axis=1)
                r = np.arange(len(p))
                where = np.minimum(np.where(met_p[r, place], codes[p][r, place, 0], big),
                                   np.where(met_q[r, place], codes[q][r, place, 0], big))
                first[at:at + 4096] = (place == t) & (where == code)
            links = np.bincount(i[first], weights=n[j[first]], minlength=len(g))
            links += np.bincount(j[first], weights=n[i[first]], minlength=len(g))
            root = forest(len(g), i, j)
            seen = (links > 0) | (root != np.arange(len(g)))
            out.append(pd.DataFrame({"_rr_c": ids[seen], "links": links[seen].astype(np.int64), "root": ids[root[seen]]}))
        return pd.concat(out) if out else pd.DataFrame({k: np.empty(0, np.int64) for k in ("_rr_c", "links", "root")})

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: ``<id_col>``, ``n_links`` (other vectors at a
    cosine of ``threshold`` or more), ``component_id`` (smallest id reachable,
    the row's own included) and ``kept`` (id equals component).

    Vectors that are null, zero, or hold a null or non-finite component link
    with nothing, nor do vectors of different lengths or rows with a null id
    (their component is null and they are kept).  Ids are long; rows that share
    an id but not the vector share its component.  Repeated rows are vectors
    that link.  Other columns are ignored; an empty table gives an empty table.
    """
    cls, rows = classes(df, id_col, vector)
    hashed = _hashed(cls)
    routes = C.materialize(_routes(hashed))
    units = (C.blocked_groups(routes, ["_rr_t", "_rr_dim", "_rr_code"], "_rr_c", BLOCK, 4000, need="_rr_main")
             .join(hashed.drop("_rr_dim"), "_rr_c"))
    found = C.materialize(units.groupBy("_rr_unit").applyInPandas(
        _unit_links(threshold), "_rr_c long, links long, root long"))
    links = found.groupBy("_rr_c").agg(F.sum("links").alias("links"))
    roots = C.connected_components(found.select(F.col("_rr_c").alias("src"), F.col("root").alias("dst")))
    per_class = (cls.join(links, "_rr_c", "left").join(roots, F.col("_rr_c") == F.col("node"), "left")
                 .select("_rr_v", (F.coalesce("links", F.lit(0)) + F.col("_rr_n") - 1).alias("n_links"),
                         F.coalesce("root", "_rr_c").alias("component_id")))
    out = rows.join(per_class, "_rr_v", "left")
    comp = F.coalesce("component_id", "_rr_id")
    return out.select(F.col("_rr_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      comp.alias("component_id"), comp.eqNullSafe(F.col("_rr_id")).alias("kept"))
