"""Line tables: ``lines(source STRING, line_no BIGINT, value STRING)``.

Parsers take a lines DataFrame rather than a path, so a file scan and a
table-derived fixture run the same plan.  Two building blocks keep text
formats distributed:

* :func:`number_lines` - dense 1-based line numbers per source without a
  global sort into one task: range-partition on (source, order), number rows
  inside each partition, then add the offset of the partition's first source
  from a small table (one row per partition).
* :func:`carry_forward` - "last header seen" (the format's ``movie:`` lines)
  without one window over a whole file: a window inside fixed-size blocks of
  line numbers, plus each block's trailing header carried across blocks
  through a block-level table (lines / block_size rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

DEFAULT_BLOCK = 1 << 20   # lines per carry-forward block


def _numbered(key: str):
    """Rows of a sorted partition with the number ``_n`` of each within its run of equal ``key``, from 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.schema.get_field_index(key))
            new = np.ones(b.num_rows, dtype=bool)
            new[1:] = pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            n = np.arange(1, b.num_rows + 1) - np.repeat(starts, np.diff(np.append(starts, b.num_rows)))
            if last is not None and k[0].equals(last):
                n[:starts[1] if len(starts) > 1 else None] += seen
            last, seen = k[-1], int(n[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "_n"])
    return run


def number_lines(df: DataFrame, order: list[str], source: str = "source",
                 out: str = "line_no", partitions: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add a dense 1-based ``out`` per ``source`` following ``order``; rows without a
    source go.  Of the other columns those of ``keep`` stay (default: all).

    Partition ids and in-partition positions depend on the range bounds,
    which are sampled from the input; the tagged rows are therefore
    checkpointed (reliably, to ``spark.checkpoint.dir``) so that the offsets
    and the rows agree and survive executor loss.  Only the first source of a partition can
    have rows in earlier ones, so there is one offset per partition, however many
    sources there are.
    """
    from ..operators.joins import materialize

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [source, *order]
    cols = [c for c in df.columns if c == source or keep is None or c in keep]
    tagged = (df.where(F.col(source).isNotNull()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .select(*cols, F.spark_partition_id().alias("_pid")))
    tagged = materialize(tagged.mapInArrow(_numbered(source), StructType([*tagged.schema.fields, StructField("_n", LongType())])))
    ends = tagged.groupBy("_pid").agg(F.min(source).alias("_first"), F.max(F.struct(F.col(source).alias("s"), F.col("_n").alias("n"))).alias("_last"))
    upto = Window.partitionBy("_last.s").orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    by_pid = Window.orderBy("_pid")
    # one row per partition
    offs = (ends.withColumn("_sum", F.sum("_last.n").over(upto))
            .withColumn("_off", F.when(F.lag("_last.s").over(by_pid) == F.col("_first"), F.lag("_sum").over(by_pid)))
            .where("_off is not null").select("_pid", "_first", "_off"))
    off = F.when(F.col(source) == F.col("_first"), F.col("_off"))
    return (tagged.join(F.broadcast(offs), "_pid", "left")
            .withColumn(out, (F.col("_n") + F.coalesce(off, F.lit(0))).cast("bigint"))
            .drop("_pid", "_n", "_first", "_off"))


def carry_forward(lines: DataFrame, header: Column, out: str = "header",
                  source: str = "source", line_no: str = "line_no",
                  block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``out`` = the value of ``header`` on the closest line at or before
    each line (``header`` is NULL on non-header lines)."""
    from ..operators.joins import fits_broadcast, hint

    b = F.floor((F.col(line_no) - 1) / F.lit(block))
    df = lines.withColumn("_h", header).withColumn("_blk", b)
    within = Window.partitionBy(source, "_blk").orderBy(line_no).rowsBetween(
        Window.unboundedPreceding, 0)
    df = df.withColumn("_local", F.last("_h", ignorenulls=True).over(within))
    tails = (df.where(F.col("_h").isNotNull())
             .groupBy(source, "_blk").agg(F.max_by("_h", F.col(line_no)).alias("_tail")))
    prev = Window.partitionBy(source).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (df.select(source, "_blk").distinct()
              .join(tails, [source, "_blk"], "left")
              .withColumn("_carry", F.last("_tail", ignorenulls=True).over(prev))
              .select(source, "_blk", "_carry"))
    return (df.join(hint(blocks, fits_broadcast(blocks)), [source, "_blk"], "left")
            .withColumn(out, F.coalesce(F.col("_local"), F.col("_carry")))
            .drop("_h", "_blk", "_local", "_carry"))


#: Charsets whose line ends are the ASCII bytes the text reader splits at, by the names in use.
_BYTE_LINES = {"iso-8859-1": "ISO-8859-1", "iso8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1",
               "us-ascii": "US-ASCII", "ascii": "US-ASCII"}


def read_lines(spark: SparkSession, path: str, encoding: str | None = None,
               glob: str | None = None) -> DataFrame:
    """S6/S13 base: every line of the files under ``path`` as a lines table,
    blank ones included.

    The text reader splits bytes at ``\\n``, ``\\r\\n`` or ``\\r`` and ignores
    ``encoding``; each line's bytes are decoded in a column, so files stay
    splittable.  UTF-8, ISO-8859-1 and US-ASCII can be read so; others
    are refused.  ``.gz`` files are decoded by the reader.
    """
    value = F.col("value")
    name = (encoding or "utf-8").lower().replace("_", "-")
    if name not in ("utf-8", "utf8"):
        if name not in _BYTE_LINES:
            raise ValueError(f"no lines of {encoding}: read ISO-8859-1, US-ASCII or UTF-8")
        value = F.decode(value.cast("binary"), _BYTE_LINES[name]).alias("value")
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    raw = r.text(path).select(F.col("_metadata.file_path").alias("source"),
                              F.col("_metadata.file_block_start").alias("_block"),
                              F.monotonically_increasing_id().alias("_pos"), value)
    return number_lines(raw, ["_block", "_pos"]).select("source", "line_no", "value")


def read_documents(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
                   glob: str | None = None) -> DataFrame:
    """One row per file, ``(path, file_name, stem, parent, text)``, decoded
    from bytes so any charset works; ``stem`` is the name up to its last dot.  One file bounds one row."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    parts = F.split(F.col("path"), "/")
    return df.select(
        "path",
        F.element_at(parts, -1).alias("file_name"),
        F.regexp_extract(F.element_at(parts, -1), r"^(.+?)(?:\.[^.]*)?$", 1).alias("stem"),
        F.element_at(parts, -2).alias("parent"),
        F.decode(F.col("content"), encoding).alias("text"))


def skip_lines(lines: DataFrame, n: int, line_no: str = "line_no") -> DataFrame:
    """Drop the first ``n`` lines of every source (resume / header drop)."""
    return lines.where(F.col(line_no) > n)


def read_keyed_ratings(spark: SparkSession, path: str, key: str = "user_id",
                       other: str = "movie_id", encoding: str = "ISO-8859-1",
                       key_from: str = "file") -> DataFrame:
    """Two-column rating files ``other,rating`` whose key is in the path.

    ``key_from='file'`` reads the model's layout (``<key>.txt`` per key);
    ``'dir'`` reads Hive-style ``<name>=<key>/`` folders.  Blank lines are
    dropped by the CSV reader; ratings are cast to INT.
    """
    df = (spark.read.option("encoding", encoding).option("header", "false")
          .option("recursiveFileLookup", "true")
          .schema(f"{other} string, rating int").csv(path))
    if key_from == "file":
        k = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    else:
        k = F.regexp_extract(F.col("_metadata.file_path"), r"/[^/=]+=([^/]+)/[^/]*$", 1)
    return df.select(k.alias(key), other, "rating").where(F.col(other).isNotNull())


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A ``movie,user,prediction`` file (blank lines dropped)."""
    return (spark.read.option("header", "false")
            .schema("movie_id string, user_id string, prediction int").csv(path)
            .where(F.col("movie_id").isNotNull()))
