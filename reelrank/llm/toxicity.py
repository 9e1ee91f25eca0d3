"""Toxicity severity by cumulative-link ordinal regression.

The grades are ordered; one weight vector is shared by all thresholds:
``P(grade > k) = sigmoid(w . x - theta_k)`` with increasing ``theta``.  The
output is the expected severity, the sum of these probabilities.  Features
are hashed words of the whole text, sparse, valued ``1 + ln(count)``.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, picked
by a hash of the id), by proximal gradient steps with an L1 penalty that
leaves weights only on words that carry severity; every row is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 6000
FEATURES = 1 << 18
_WORD = re.compile(r"[^\W\d_]+")
_seen: dict[str, int] = {}


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (increasing) and word counts of a whole text."""
    out = []
    for w in _WORD.findall((text or "").lower()):
        ix = _seen.get(w)
        if ix is None:
            ix = zlib.crc32(w.encode("utf-8", "replace")) % FEATURES
            if len(_seen) < 300_000 and len(w) < 64:
                _seen[w] = ix
        out.append(ix)
    ix, n = np.unique(np.array(out, dtype=np.int64), return_counts=True)
    return ix, n


def _value(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


@dataclass
class OrdinalModel:
    """``weights`` over the features, increasing ``thetas`` (one per grade above the lowest)."""

    weights: np.ndarray
    thetas: np.ndarray

    def exceed(self, text: str | None) -> np.ndarray:
        """P(grade > k) for every k."""
        ix, n = features(text)
        return _sigmoid(self.weights[ix] @ _value(n) - self.thetas)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int,
        l1: float = 1e-3, steps: int = 300, min_rows: int = 5) -> OrdinalModel:
    """Fit by accelerated proximal gradient on the mean of the thresholds'
    log losses; classes weigh alike, so that rare grades count.  Features of
    fewer than ``min_rows`` rows say nothing about other rows and get no weight.
    Weights are not negative: no word takes back what another one shows, so a
    long text can't hide it."""
    every, found = np.unique(np.concatenate([ix for ix, _ in rows] or [np.empty(0, np.int64)]), return_counts=True)
    used = every[found >= min_rows]
    rows = [(ix[k], n[k]) for ix, n in rows for k in [np.isin(ix, used, assume_unique=True)]]
    weights, thetas = np.zeros(FEATURES), np.linspace(0, 1, max(1, n_grades - 1))
    if not len(rows):
        return OrdinalModel(weights, thetas + 35)
    col = np.concatenate([np.searchsorted(used, ix) for ix, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(ix) for ix, _ in rows])
    val = np.concatenate([_value(n) for _, n in rows])
    above = grades[:, None] > np.arange(n_grades - 1)
    share = np.maximum(above.mean(0), 1 / (2 * len(rows)))
    pos, neg = 0.5 / share, 0.5 / np.maximum(1 - share, 1 / (2 * len(rows)))
    cost = np.where(above, pos, neg) / (len(rows) * (n_grades - 1))
    # steps scaled by each feature's curvature, as rare words have little
    size = np.maximum(np.bincount(col, weights=val * val * cost.sum(1)[row], minlength=len(used)), 1e-9)
    norm = np.bincount(row, weights=val * val / size[col], minlength=len(rows))
    step = 1 / max(0.25 * np.max(cost.sum(1) * norm) , 0.25)
    w = v = np.zeros(len(used))
    th = tv = np.linspace(0, 0.5, n_grades - 1)
    t = 1.0
    for _ in range(steps):
        z = np.bincount(row, weights=val * v[col], minlength=len(rows))
        err = (_sigmoid(z[:, None] - tv) - above) * cost
        g = np.bincount(col, weights=val * err.sum(1)[row], minlength=len(used))
        new = v - step * g / size
        new = np.maximum(new - step * l1 / size, 0)
        th_new = np.maximum.accumulate(tv + step * err.sum(0))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, tv = new + (t - 1) / t_new * (new - w), th_new + (t - 1) / t_new * (th_new - th)
        w, th, t = new, th_new, t_new
    weights[used] = w
    return OrdinalModel(weights, th)


def grade_by_evidence(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Severity grades 0, 1, 2 from a 0/1 label: toxic rows whose count of
    telling words (those much more frequent in toxic rows) is above the toxic
    rows' median are graded 2."""
    df_pos, df_neg = np.zeros(FEATURES), np.zeros(FEATURES)
    for (ix, _), y in zip(rows, toxic):
        (df_pos if y else df_neg)[ix] += 1
    n_pos, n_neg = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    odds = np.log((df_pos + 0.5) / (n_pos + 1)) - np.log((df_neg + 0.5) / (n_neg + 1))
    telling = (odds > np.log(8)) & (df_pos >= 5)
    hits = np.array([n[telling[ix]].sum() for ix, n in rows], dtype=float)
    if not toxic.any():
        return np.zeros(len(rows), np.int64)
    return np.where(toxic == 1, 1 + (hits > np.median(hits[toxic == 1])), 0)


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, text: str, grade: str,
                    sample: int = SAMPLE) -> tuple[list, np.ndarray]:
    """Features and grades of at most ``sample`` labelled rows, those with the
    smallest hash of the id; the features are made on the executors."""
    known = (labels.where(F.col(grade).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(id_col).agg(F.max(grade).alias("_rr_grade"))
             .withColumn("_rr_h", C.md5_hex("sample", F.col(id_col)))
             .orderBy("_rr_h").limit(sample).select(F.col(id_col).alias("_rr_id"), "_rr_grade", "_rr_h"))
    rows = (df.select(F.col(id_col).alias("_rr_id"), F.col(text).cast("string").alias("_rr_text"))
            .join(F.broadcast(known), "_rr_id").select("_rr_h", F.col("_rr_grade").cast("int"), "_rr_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()),
                 pa.array([f[1].astype("<i4").tobytes() for f in found], pa.binary())], names=["h", "grade", "ix", "n"])

    got = rows.mapInArrow(run, "h string, grade int, ix binary, n binary")
    got = got.orderBy("h", "grade", "ix", "n").limit(sample).collect()
    return ([(np.frombuffer(r.ix, "<i4").astype(np.int64), np.frombuffer(r.n, "<i4")) for r in got],
            np.array([r.grade for r in got], dtype=np.int64))


def score(df: DataFrame, id_col: str, text: str, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """``<id_col>``, ``severity`` (expected grade), ``p_toxic`` (grade above the
    lowest), ``grade`` (most grades that are likelier exceeded than not) and ``toxic``.

    A null text, or one without a word, scores by the thresholds alone;
    repeated rows and null ids are scored one by one; other columns are ignored.
    """
    rows = df.select(F.col(id_col), F.col(text).cast("string").alias("_rr_text"))
    kind = rows.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [model.exceed(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([float(x.sum()) for x in p], pa.float64()),
                 pa.array([float(x[0]) for x in p], pa.float64()),
                 pa.array([int((x >= 0.5).sum()) for x in p], pa.int32()),
                 pa.array([bool(x[0] >= threshold) for x in p], pa.bool_())],
                names=[id_col, "severity", "p_toxic", "grade", "toxic"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, severity double, p_toxic double, grade int, toxic boolean")


def severity(df: DataFrame, labels: DataFrame, id_col: str, text: str, label: str,
             graded: bool = False, sample: int = SAMPLE) -> DataFrame:
    """Fit on labelled rows and score all.  With ``graded`` the label column
    holds grades from 0; else it is 0/1 and grades come from ``grade_by_evidence``."""
    rows, y = labelled_sample(df, labels, id_col, text, label, sample)
    grades = y if graded else grade_by_evidence(rows, y)
    return score(df, id_col, text, fit(rows, grades, max(2, int(grades.max(initial=0)) + 1)))
