"""Helpers shared by the pipeline operators.

Internal columns carry the prefix ``_rr_`` so that callers' extra columns
cannot clash with them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table_dir

__all__ = ["materialize", "md5_hex", "hash_unit", "prefix_offsets", "blocked_groups",
           "connected_components", "read_table"]

#: Hex digits of an order hash that name its bucket: 16**4 buckets per key.
BUCKET_DIGITS = 4


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a table under the shared checkpoint folder
    and read it back.  Compressed well, as these tables live as long as the run."""
    path = scratch_table_dir(df.sparkSession, f"m-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5_hex(*parts):
    """Hex md5 of the parts joined by ``|`` (a null part reads ``\\N``)."""
    cols = [F.coalesce(p.cast("string"), F.lit("\\N")) if not isinstance(p, str) else F.lit(p)
            for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def hash_unit(hex_col):
    """A double strictly between 0 and 1 from the first 48 bits of a hex digest."""
    return (F.conv(F.substring(hex_col, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def prefix_offsets(df: DataFrame, keys: Sequence[str], bucket: str, value) -> DataFrame:
    """Start of every bucket within its key: one row per (keys, bucket) with
    ``_rr_start`` (sum of ``value`` over the key's smaller buckets) and
    ``_rr_total`` (sum over the key).

    ``df`` is aggregated map-side first, so a hot key costs no more than its
    bucket count (a constant); the window runs over that small table.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_rr_sum"))
    w = Window.partitionBy(*keys)
    before = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *keys, bucket,
        F.coalesce(F.sum("_rr_sum").over(before), F.lit(0)).cast("long").alias("_rr_start"),
        F.sum("_rr_sum").over(w).alias("_rr_total"))


def blocked_groups(rows: DataFrame, keys: Sequence[str], id_col: str, block: int,
                   rows_per_unit: int = 20_000, need: str | None = None) -> DataFrame:
    """Deal the groups of ``keys`` out as bounded units of pairwise work.

    Groups of one row are dropped (they hold no pair), and those without a row
    whose boolean ``need`` is true.  A group larger than
    ``block`` is cut into blocks by a hash of ``id_col`` and every row goes to
    the units of its block with each other block, so that any two rows of the
    group meet in exactly one unit and no unit holds more than about two
    blocks of a group.  Small groups share a unit, of about ``rows_per_unit``
    dealt rows however large a group is.  Adds ``_rr_b`` (the row's
    block), ``_rr_lo``, ``_rr_hi`` (the unit's blocks) and ``_rr_unit``.
    """
    sizes = (rows.groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("_rr_size"), F.max(need if need else F.lit(True)).alias("_rr_need"))
             .where("_rr_size > 1 and _rr_need").drop("_rr_need"))
    sizes = materialize(sizes)
    # a row goes to as many units as its group has blocks
    total = sizes.agg(F.sum(F.col("_rr_size") * F.ceil(F.col("_rr_size") / F.lit(block)))).first()[0] or 0
    units = max(1, -(-int(total) // rows_per_unit))
    dealt = (rows.join(sizes, list(keys))
             .withColumn("_rr_nb", F.ceil(F.col("_rr_size") / F.lit(block)).cast("int"))
             .withColumn("_rr_b", F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.col("_rr_nb")).cast("int"))
             .withColumn("_rr_o", F.explode(F.sequence(F.lit(0), F.col("_rr_nb") - 1)))
             .withColumn("_rr_lo", F.least("_rr_b", "_rr_o"))
             .withColumn("_rr_hi", F.greatest("_rr_b", "_rr_o"))
             .drop("_rr_o", "_rr_size", "_rr_nb"))
    return dealt.withColumn("_rr_unit", F.pmod(F.xxhash64(*keys, "_rr_lo", "_rr_hi"), F.lit(units)))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and
    small-star rounds (distributed union-find).

    Returns one row per node that is not its component's smallest:
    ``node``, ``root`` (the smallest node of the component).  Each round is
    written to the shared checkpoint folder, so neither the lineage nor the
    driver grows.  Node columns must be orderable and not null.
    """
    cur = materialize(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
                      .where("u <> v").distinct())

    def signature(df):
        # sums of 31-bit hashes stay far from the 64-bit range
        h = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))
        return df.agg(F.count(F.lit(1)), F.sum(h)).first()

    sig = signature(cur)
    if not sig[0]:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        cur = materialize(small)
        new = signature(cur)
        if new == sig:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sig = new
    raise RuntimeError("connected components did not settle")
