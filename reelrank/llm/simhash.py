"""SimHash near-duplicates with a Gray-order hierarchical index.

1. Fingerprints: every word shingle's XXH64 votes on 64 bits.
2. Equal fingerprints become one class, so copies cost one row.
3. Classes are routed by masked bit patterns: the 64 bits are cut into
   ``max_bits + 2`` blocks, and two fingerprints that differ in at most
   ``max_bits`` bits agree on at least two blocks.  Only classes that share a
   pattern of two blocks meet; groups beyond a block size are cut into pairs
   of blocks (see ``common.blocked_groups``).
4. In a group the fingerprints are sorted by Gray rank and indexed by a tree:
   a node holds the bits all its leaves share that no ancestor holds.  A query
   walks down adding up the bits in which it differs and drops a node as
   soon as the sum exceeds ``max_bits``; leaves give exact distances.
5. Each unit emits a spanning forest of its links, never all pairs;
   distributed union-find joins them.
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

HASH_SEED = 42
FANOUT = 8
BLOCK = 2048
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of a whole text (0 without a word)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(words) - k + 1
    lo, hi = starts[:n].tolist(), ends[k - 1:].tolist()
    for at in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(lo[at:at + (1 << 15)], hi[at:at + (1 << 15)])],
                     dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def add_fingerprints(df: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """``_rr_id``, ``_rr_k`` (digest of id and text) and ``_rr_fp`` (the
    fingerprint's 64 bits as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             names=["_rr_id", "_rr_k", "_rr_fp"])

    cols = df.select(F.col(id_col).alias("_rr_id"), row_key(id_col, text).alias("_rr_k"),
                     F.col(text).cast("string").alias("_rr_text"))
    kind = dict(cols.dtypes)["_rr_id"]
    return cols.mapInArrow(run, f"_rr_id {kind}, _rr_k string, _rr_fp long")


def row_key(id_col: str, text: str):
    return C.md5_hex(F.col(id_col), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def block_masks(max_bits: int) -> list[int]:
    """Masks of every two of the ``max_bits + 2`` bit blocks."""
    n = max_bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the binary reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Tree over fingerprints in Gray order; level 0 holds the leaves."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        pat, mask = fps[self.order], np.full(len(fps), ~np.uint64(0))
        levels = [(pat, mask)]
        while len(pat) > FANOUT:
            at = np.arange(0, len(pat), FANOUT)
            ones = np.bitwise_and.reduceat(pat & mask, at)
            zeros = np.bitwise_and.reduceat(~pat & mask, at)
            pat, mask = ones, ones | zeros
            levels.append((pat, mask))
        # bits that a child shares beyond its parent's
        self.levels = [(p, m if i + 1 == len(levels) else m & ~np.repeat(levels[i + 1][1], FANOUT)[: len(m)])
                       for i, (p, m) in enumerate(levels)]

    def near(self, queries: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query index, fingerprint index) at ``max_bits`` or fewer."""
        pat, mask = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(pat))
        node = np.tile(np.arange(len(pat)), len(queries))
        acc = np.zeros(len(q), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            pat, mask = self.levels[level]
            if level < len(self.levels) - 1:
                kids = node[:, None] * FANOUT + np.arange(FANOUT)
                ok = kids < len(pat)
                q, acc, node = np.repeat(q, FANOUT)[ok.ravel()], np.repeat(acc, FANOUT)[ok.ravel()], kids[ok]
            acc = acc + np.bitwise_count((queries[q] ^ pat[node]) & mask[node])
            keep = acc <= max_bits
            q, node, acc = q[keep], node[keep], acc[keep]
        return q, self.order[node]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each point's component under the links (a, b)."""
    lab = np.arange(n)
    while len(a):
        new = lab.copy()
        np.minimum.at(new, a, lab[b])
        np.minimum.at(new, b, lab[a])
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def _unit_links(max_bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = [], []
        for (t, key, lo, hi), g in pdf.groupby(["_rr_t", "_rr_key", "_rr_lo", "_rr_hi"], sort=False):
            fps = g["_rr_fp"].to_numpy(np.int64).view(np.uint64)
            side = g["_rr_b"].to_numpy()
            rows = np.flatnonzero(side == lo)
            index = GrayIndex(fps[rows])
            ask = rows if lo == hi else np.flatnonzero(side == hi)
            pa_, pb_ = [], []
            for at in range(0, len(ask), 512):
                q, x = index.near(fps[ask[at:at + 512]], max_bits)
                pa_.append(ask[at:at + 512][q])
                pb_.append(rows[x])
            lab = forest(len(fps), np.concatenate(pa_), np.concatenate(pb_)) if pa_ else np.arange(len(fps))
            far = lab != np.arange(len(fps))
            src.append(fps[far].view(np.int64))
            dst.append(fps[lab[far]].view(np.int64))
        e = np.empty(0, np.int64)
        return pd.DataFrame({"src": np.concatenate([e, *src]), "dst": np.concatenate([e, *dst])})

    return run


def simhash_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (``src``, ``dst``) that span the components of distinct ``_rr_fp``."""
    routes = F.array(*[F.struct(F.lit(i).alias("t"), F.col("_rr_fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key"))
                       for i, m in enumerate(block_masks(max_bits))])
    routed = (fps.select("_rr_fp", F.explode(routes).alias("_rr_r"))
              .select("_rr_fp", F.col("_rr_r.t").alias("_rr_t"), F.col("_rr_r.key").alias("_rr_key")))
    units = C.blocked_groups(routed, ["_rr_t", "_rr_key"], "_rr_fp", BLOCK)
    return units.groupBy("_rr_unit").applyInPandas(_unit_links(max_bits), "src long, dst long")


def _components(df: DataFrame, id_col: str, text: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (``_rr_id``, ``_rr_k``, ``_rr_fp``) and the root of every ``_rr_fp``."""
    rows = C.materialize(add_fingerprints(df, id_col, text, shingle))
    classes = C.materialize(rows.select("_rr_fp").distinct())
    roots = C.connected_components(simhash_links(classes, max_bits))
    labelled = classes.join(roots, F.col("_rr_fp") == F.col("node"), "left")
    return rows, C.materialize(labelled.select("_rr_fp", F.coalesce("root", "_rr_fp").alias("_rr_root")))


def simhash_components(df: DataFrame, id_col: str, text: str, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``df``: ``<id_col>``, ``fingerprint`` (16 hex digits)
    and ``component_id`` (smallest id reachable over links of at most
    ``max_bits`` differing bits, the row's own included).

    Null and wordless texts have fingerprint zero and are linked like any
    other.  Rows with a null id take part; the smallest non-null id of the
    component stands for them (null if there is none).  Repeated rows give
    repeated rows; other columns are ignored; an empty table gives an empty
    table.
    """
    rows, labelled = _components(df, id_col, text, shingle, max_bits)
    first = rows.groupBy("_rr_fp").agg(F.min("_rr_id").alias("_rr_first")).join(labelled, "_rr_fp")
    smallest = first.groupBy("_rr_root").agg(F.min("_rr_first").alias("component_id"))
    of_fp = labelled.join(smallest, "_rr_root").select("_rr_fp", "component_id")
    return rows.join(of_fp, "_rr_fp").select(
        F.col("_rr_id").alias(id_col), F.lpad(F.lower(F.hex("_rr_fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str, text: str, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of ``df`` per component (all columns kept): the one with the
    smallest id, null ids last, ties by text digest; a row repeated with the
    same id and text counts once."""
    rows, labelled = _components(df, id_col, text, shingle, max_bits)
    least = F.min(F.struct(F.col("_rr_id").isNull().alias("none"), F.col("_rr_id").alias("id"), F.col("_rr_k").alias("k")))
    first = rows.groupBy("_rr_fp").agg(least.alias("f")).join(labelled, "_rr_fp")
    keep = first.groupBy("_rr_root").agg(F.min("f").alias("f")).select(F.col("f.k").alias("_rr_k"))
    return (df.withColumn("_rr_k", row_key(id_col, text)).join(keep, "_rr_k", "left_semi")
            .dropDuplicates(["_rr_k"]).drop("_rr_k"))
