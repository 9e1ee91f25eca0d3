"""Mixing sources to target weights by capped water-filling.

Sources share a budget in proportion to their weights; a source whose share
exceeds its cap (maximum epochs times its size) is clamped there and the
excess is dealt again over the others, until no share is above its cap.  The
rows of a source are then repeated: each as often as the whole epochs say,
and a seeded selection once more for the fractional epoch.  DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def word_count(text) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add ``target`` (double) to a table of sources (``size`` long, ``weight``).

    Clamps and deals again until feasible.  If all sources are capped the
    budget stays unspent.  Every round is one aggregate over the source table;
    the driver sees three numbers per round.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    cur = C.materialize(sources.withColumn("_rr_capped", F.lit(False)))
    while True:
        spent, open_w, n_capped = cur.agg(
            F.coalesce(F.sum(F.when(F.col("_rr_capped"), cap)), F.lit(0.0)),
            F.sum(F.when(~F.col("_rr_capped"), F.col("weight"))),
            F.sum(F.col("_rr_capped").cast("long"))).first()
        share = (F.col("weight") * F.lit(float(budget) - spent) / F.lit(float(open_w))
                 if open_w else F.lit(0.0))
        nxt = cur.withColumn("_rr_capped", F.col("_rr_capped") | (share > cap))
        if nxt.agg(F.sum(F.col("_rr_capped").cast("long"))).first()[0] == n_capped:
            return (cur.withColumn("target", F.when(F.col("_rr_capped"), cap).otherwise(share))
                    .drop("_rr_capped"))
        cur = C.materialize(nxt)


def _plan(df: DataFrame, source: str, size: Column, key: str, weights=(3, 1, 2), budget_ratio: float = 1.5,
          max_epochs: float = 2.0, seed: str = SEED) -> DataFrame:
    """``df`` with ``_rr_size``, ``_rr_source_size``, ``_rr_target``, ``_rr_reps``."""
    rows = (df.withColumn("_rr_size", size).withColumn("_rr_src", F.col(source))
            .withColumn("_rr_h", C.md5_hex(seed, F.col(key), F.col("_rr_size")))
            .withColumn("_rr_bucket", F.substring("_rr_h", 1, C.BUCKET_DIGITS)))
    starts = C.materialize(C.prefix_offsets(rows, ["_rr_src"], "_rr_bucket", F.col("_rr_size")))
    src = (starts.groupBy("_rr_src").agg(F.max("_rr_total").alias("size"))
           .withColumn("_rr_ix", F.row_number().over(Window.orderBy(F.col("_rr_src").asc_nulls_last())) - 1))
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                                F.col("_rr_ix") % len(weights) + 1)).drop("_rr_ix")
    src = C.materialize(src)
    total = src.agg(F.sum("size")).first()[0] or 0
    goals = water_fill(src, budget_ratio * total, max_epochs)
    goals = goals.select(F.col("_rr_src").alias("_rr_s2"), F.col("size").alias("_rr_source_size"),
                         F.col("target").alias("_rr_target"))
    plan = (starts.join(goals, F.col("_rr_src").eqNullSafe(F.col("_rr_s2")))
            .select("_rr_s2", F.col("_rr_bucket").alias("_rr_b2"), "_rr_start", "_rr_source_size", "_rr_target"))
    joined = rows.join(plan, F.col("_rr_src").eqNullSafe(F.col("_rr_s2")) & (F.col("_rr_bucket") == F.col("_rr_b2")))
    w = Window.partitionBy("_rr_src", "_rr_bucket").orderBy("_rr_h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_rr_start") + F.coalesce(F.sum("_rr_size").over(w), F.lit(0))
    whole = (F.when(F.col("_rr_source_size") > 0, F.floor(F.col("_rr_target") / F.col("_rr_source_size")))
             .otherwise(F.lit(0)))
    goal = F.col("_rr_target") - F.col("_rr_whole") * F.col("_rr_source_size")
    extra = (F.col("_rr_size") > 0) & (2 * F.col("_rr_before") + F.col("_rr_size") <= 2 * goal)
    return (joined.withColumn("_rr_before", before).withColumn("_rr_whole", whole)
            .withColumn("_rr_reps", (F.col("_rr_whole") + extra.cast("int")).cast("int"))
            .drop("_rr_src", "_rr_s2", "_rr_h", "_rr_bucket", "_rr_b2", "_rr_start", "_rr_before", "_rr_whole"))


def plan_mix(df: DataFrame, **kw) -> DataFrame:
    """Plan the mix: add ``size``, ``source_size``, ``target`` (of the row's
    source) and ``reps`` (how often the mix takes the row).

    ``source`` and ``key`` name columns, ``size`` is a column; weights go to the
    sources in code point order, null last, repeating.  The fractional epoch
    takes rows in the order of a seeded hash of (``key``, size) while the
    middle of the row lies below the goal, so a source ends within half a row
    of its target.  Null keys hash as one key; repeated rows count
    separately; rows of size 0 follow the whole epochs alone; columns of the
    new names are replaced; an empty table gives an empty table.

    Running totals come from (source, hash bucket) sums, so a source with a
    third of all rows is split over its buckets.
    """
    out = _plan(df, **kw)
    names = ["size", "source_size", "target", "reps"]
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in names],
                      *[F.col(f"_rr_{n}").alias(n) for n in names])


def mix(df: DataFrame, **kw) -> DataFrame:
    """The mixed rows themselves: every row ``reps`` times, columns of ``df``."""
    return (_plan(df, **kw).withColumn("_rr_rep", F.explode(F.array_repeat(F.lit(1), F.col("_rr_reps"))))
            .select(*[F.col(f"`{c}`") for c in df.columns]))
