"""Sharding by rendezvous hashing (highest random weight).

Every record key draws one score per shard; the record goes to the shard with
the highest score ``-weight / ln(u)``, where ``u`` is a hash of key and shard
in (0, 1).  A shard's score does not depend on the other shards, so adding
one moves records only into it, and the share of a shard is proportional to
its weight.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SEED = "shard"


def rendezvous(key, weights: Sequence[float], seed: str = SEED):
    """Column: the shard (int, from 0) of ``key`` among ``len(weights)`` shards.

    A null key hashes like the text ``\\N``.  Ties go to the smaller shard.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [F.struct((-F.lit(float(w)) / F.log(C.hash_unit(C.md5_hex(seed, str(i), key)))).alias("score"),
                       F.lit(-i).alias("neg"))
              for i, w in enumerate(weights)]
    return (-F.array_max(F.array(*scores))["neg"]).cast("int")


def shard_records(df: DataFrame, key: str, weights: Sequence[float], order: Sequence = (),
                  seed: str = SEED) -> DataFrame:
    """Add ``shard`` (int), ``slot`` (long: gapless from 0 within the shard) and
    ``grown_shard`` (the shard once one more shard of the last weight is added).

    The shard depends on the key, the weights and the seed alone: rows with
    the same key share a shard, null keys are one key.  Slots follow a hash of
    key and ``order`` columns; rows equal in all of them are
    interchangeable.  Columns of these names in ``df`` are replaced; an empty
    table gives an empty table.

    Slots come from per-(shard, hash bucket) counts: the only groups a task
    sees are buckets of a 16**4-way hash, whatever the size of a shard.
    """
    h = C.md5_hex(seed, "slot", F.col(key), *order)
    rows = (df.drop("shard", "slot", "grown_shard")
            .withColumn("shard", rendezvous(F.col(key), weights, seed))
            .withColumn("grown_shard", rendezvous(F.col(key), [*weights, weights[-1]], seed))
            .withColumn("_rr_h", h)
            .withColumn("_rr_bucket", F.substring("_rr_h", 1, C.BUCKET_DIGITS)))
    starts = C.prefix_offsets(rows, ["shard"], "_rr_bucket", F.lit(1))
    rank = F.row_number().over(Window.partitionBy("shard", "_rr_bucket").orderBy("_rr_h"))
    return (rows.join(starts, ["shard", "_rr_bucket"])
            .withColumn("slot", F.col("_rr_start") + rank - F.lit(1))
            .drop("_rr_h", "_rr_bucket", "_rr_start", "_rr_total"))
