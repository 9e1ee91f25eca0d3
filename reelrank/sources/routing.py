"""Routing of parsed lines: what parses goes on, the rest is kept as rejects.

A classified table (see the ``*_lines`` parsers) holds every input line once, with a
``status``: ``ok``, a reason to reject it, or ``header`` / ``blank``.
:func:`route` writes it once, partitioned by status, and counts the statuses
in that same job.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import few_folders, scratch_table_dir

#: short: too few fields; extra: too many fields or lines; malformed: a field
#: that doesn't parse; orphan: a line that no header claims.
REJECTS = ("short", "extra", "malformed", "orphan")
STATUSES = ("ok", *REJECTS, "header", "blank")


class Routed(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def rejects(classified: DataFrame) -> DataFrame:
    """The rejected lines as they came, with the reason."""
    return classified.where(F.col("status").isin(*REJECTS)).select("source", "line_no", "value", "status")


def route(classified: DataFrame, path: str | None = None) -> Routed:
    """Write a classified table to ``path`` (default: the checkpoint folder) by
    status and return its accepted lines, its rejects and the count per status.

    One job reads, parses, counts (``observe``) and writes; both outputs are
    read back from their own partitions.  The sum of the counts is the number of lines.
    """
    spark = classified.sparkSession
    path = path or scratch_table_dir(spark, f"routed-{uuid.uuid4().hex}")
    seen = Observation()
    counted = classified.observe(seen, *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    with few_folders(spark):
        counted.write.mode("overwrite").option("compression", "zstd").partitionBy("status").parquet(path)
    back = spark.read.schema(classified.schema).parquet(path)
    return Routed(back.where("status = 'ok'").drop("status", "value"), rejects(back), dict(seen.get))
