"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one
to three letters, words padded by a space), most frequent first.  A document is
ranked the same way over its whole text, and compared to every profile by
out-of-place distance: the sum of the rank differences of its n-grams, with
the profile length for those that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

PROFILE = 300
UNKNOWN = "und"
_SPACE = 32
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a whole text, in code order.

    A code holds up to three code points of 21 bits.  No letter, no n-gram.
    """
    a = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _is_letter()[a]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.concatenate(([_SPACE], np.where(letter, a, _SPACE), [_SPACE])).astype(np.int64)
    gap = a == _SPACE
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    keep[0] = True
    a = a[keep]
    gap = a == _SPACE
    two = (a[:-1] << 21) | a[1:]
    three = (two[:-1] << 21) | a[2:]
    return np.unique(np.concatenate((a[~gap], two, three[~gap[1:-1]])), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, ties by code."""
    if len(codes) > 4 * size:
        low = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= low], counts[counts >= low]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(df: DataFrame, text: str, lang: str, size: int = PROFILE) -> DataFrame:
    """Profiles (``lang``, ``gram``, ``rank`` from 0) from all rows with a language.

    N-grams are counted per Arrow batch, then summed; the result has at most
    ``size`` rows per language.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {}
            for i, name in enumerate(b.column(0).to_pylist()):
                found.setdefault(name, []).append(ngram_counts(b.column(1)[i].as_py()))
            for name, parts in found.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([k for _, k in parts]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])

    labelled = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("_rr_lang"),
                                                        F.col(text).cast("string").alias("_rr_text"))
    counts = labelled.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    # a limit on the bare row number is one the optimizer sees, so tasks keep ``size`` rows before the exchange
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
            .select("lang", "gram", (F.col("rank") - 1).alias("rank")))


class Profiles:
    """Profiles as one table: n-gram by language, ranks."""

    def __init__(self, rows, size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows}, key=lambda s: s.encode("utf-8"))
        self.grams = np.array(sorted({r[1] for r in rows}), dtype=np.int64)
        self.ranks = np.full((len(self.grams) + 1, max(1, len(self.langs))), size, dtype=np.int64)
        if rows:
            at = np.searchsorted(self.grams, [r[1] for r in rows])
            self.ranks[at, [self.langs.index(r[0]) for r in rows]] = [r[2] for r in rows]
        self.missing = np.full(self.ranks.shape[1], size)

    def predict(self, text: str | None) -> tuple[str, float]:
        top = ranked(*ngram_counts(text), self.size)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, top)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        ranks = self.ranks[at]
        out = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)
        best = int(np.argmin(out))
        return self.langs[best], float(1 - out[best] / (self.size * len(top)))


def identify(df: DataFrame, text: str, profiles: DataFrame, size: int = PROFILE,
             names: tuple[str, str] = ("lang_pred", "score"), keep_text: bool = True) -> DataFrame:
    """Add the predicted language and its score (1 - distance / greatest distance).

    ``und`` with score 0 for a null text, one without a letter, or no profile;
    ties go to the smaller language name.  The profiles (``size`` rows a
    language) are the only thing sent to the executors.  Columns of ``df`` of
    the new names are replaced; repeated rows are judged one by one.
    """
    model = Profiles([tuple(r) for r in profiles.select("lang", "gram", "rank").collect()], size)
    rows = df.drop(*names)
    at = rows.columns.index(text)
    kept = [i for i in range(len(rows.columns)) if keep_text or i != at]
    out = [rows.columns[i] for i in kept]
    kinds = ", ".join(f"`{rows.dtypes[i][0]}` {rows.dtypes[i][1]}" for i in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in kept), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=[*out, *names])

    return rows.mapInArrow(run, f"{kinds}, `{names[0]}` string, `{names[1]}` double")


def is_held_out(id_col: str):
    """Whether crc32 of the id as text leaves 1 modulo 3 (a null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict_languages(df: DataFrame, id_col: str, text: str, lang: str, size: int = PROFILE) -> DataFrame:
    """``<id_col>``, ``held_out``, ``lang_pred``, ``score`` of every row, learned
    from the rows that are not held out; language and id are no inputs of a prediction."""
    rows = df.select(F.col(id_col), F.col(text), F.col(lang), is_held_out(id_col).alias("held_out"))
    profiles = C.materialize(learn_profiles(rows.where(~F.col("held_out")), text, lang, size))
    return identify(rows.select(id_col, "held_out", text), text, profiles, size, keep_text=False)


def keep_identified(df: DataFrame, text: str, lang: str, min_score: float, size: int = PROFILE) -> DataFrame:
    """The rows of ``df``, unchanged, whose language is recognised: a letter,
    and a score of ``min_score`` at least against profiles of all its rows with a language."""
    profiles = C.materialize(learn_profiles(df, text, lang, size))
    found = identify(df, text, profiles, size, names=("_rr_pred", "_rr_score"))
    return (found.where((F.col("_rr_pred") != UNKNOWN) & (F.col("_rr_score") >= min_score))
            .drop("_rr_pred", "_rr_score"))
