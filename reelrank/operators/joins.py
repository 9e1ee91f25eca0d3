"""Join helpers: size-checked broadcast and lineage cuts.

``fits_broadcast`` counts a join side and multiplies by its estimated row
width; only a side under ``reelrank.broadcast.maxBytes`` (session conf, default
64 MB) is hinted.  Otherwise the DataFrame is left untouched and Spark plans
by its own statistics, with AQE's skew split.  The count moves one number per task, never
rows.  Materialise (``materialize``) an input first when it is expensive to recompute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_BYTES = 64 << 20
#: Bytes of a fixed-size value in a broadcast row.
_WIDTH = 8
_FIXED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType)


def max_broadcast_bytes(df: DataFrame) -> int:
    v = df.sparkSession.conf.get("reelrank.broadcast.maxBytes", None)
    return int(v) if v else DEFAULT_MAX_BYTES


def row_bytes(df: DataFrame) -> int:
    """Estimated bytes of a row in a hash relation, with 64 for what has no fixed size."""
    return 24 + sum(_WIDTH if isinstance(f.dataType, _FIXED) else 64 for f in df.schema.fields)


def relation_bytes(df: DataFrame) -> int:
    """Bytes of all rows in a hash relation: one aggregate over rows and the
    measured length of whatever has no fixed size."""
    fixed = 24 + _WIDTH * len(df.columns)
    size = F.lit(fixed).cast("long")
    for f in df.schema.fields:
        if not isinstance(f.dataType, _FIXED):
            c = F.col(f"`{f.name}`")
            text = c if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(c))
            size = size + F.coalesce(F.octet_length(text), F.lit(0))
    return int(df.select(F.sum(size)).first()[0] or 0)


def fits_broadcast(df: DataFrame, max_rows: int | None = None) -> bool:
    """True if all rows of ``df`` take at most the bound (or are at most ``max_rows``).

    Rows are counted first; lengths are measured only where the count alone doesn't rule a broadcast out.
    """
    if max_rows is not None:
        return max_rows > 0 and df.count() <= max_rows
    limit = max_broadcast_bytes(df)
    if limit <= 0 or df.count() * (24 + _WIDTH * len(df.columns)) > limit:
        return False
    return all(isinstance(f.dataType, _FIXED) for f in df.schema.fields) or relation_bytes(df) <= limit


def hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a parquet table under the shared
    ``spark.checkpoint.dir`` and read it back.

    Used for inputs read several times by one plan (ratings, candidates,
    weights, numbered lines) so they are computed once and survive executor
    loss.  A columnar table (rather than ``checkpoint()``'s serialized rows)
    keeps later scans pruned to the columns they need.
    """
    import uuid

    from ..session import scratch_table_dir

    spark = df.sparkSession
    path = scratch_table_dir(spark, f"m-{uuid.uuid4().hex}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
