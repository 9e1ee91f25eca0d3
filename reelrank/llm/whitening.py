"""Whitening of embeddings with MLlib's distributed ``BlockMatrix``.

Centred rows are indexed and laid out in blocks of bounded size; the transpose
times the matrix gives the scatter, whose eigenvectors (a matrix of dimension
squared, on the driver) make the whitening matrix; one more block product
projects every row.  A product over all rows is cut into splits of a few blocks, so
no task holds more than those.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

COMPONENTS = 8
#: Entries of a block (2 MB of doubles) and blocks of a split or product task.
BLOCK_ENTRIES, BLOCKS_PER_TASK, COLUMNS_PER_BLOCK = 1 << 18, 4, 1024
#: A direction with less variance than this share of the largest one has no sound scale.
LEAST_SHARE = 1e-10
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def scaled(vector: Column) -> Column:
    """``floor(1024 c) + 100000`` of every component as long (clamped at 2**61);
    null for vectors that are null, empty or hold null or non-finite entries."""
    v = vector.cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    top = float(1 << 61)
    whole = lambda e: F.floor(F.greatest(F.least(e * 1024, F.lit(top)), F.lit(-top))) + 100_000
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad), F.transform(v, whole))


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` as a written table with a gapless ``index`` from 0: places inside a
    task are frozen by the write, tasks are put end to end by a sum over one row each."""
    place = F.monotonically_increasing_id()
    t = C.materialize(rows.withColumn("_rr_part", F.shiftright(place, 33))
                      .withColumn("_rr_place", place.bitwiseAND(F.lit((1 << 33) - 1))))
    ends = t.groupBy("_rr_part").agg((F.max("_rr_place") + 1).alias("_rr_n"))
    before = Window.orderBy("_rr_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_rr_part", F.coalesce(F.sum("_rr_n").over(before), F.lit(0)).alias("_rr_start"))
    # one row per writing task
    return (t.join(F.broadcast(starts), "_rr_part")
            .withColumn("index", F.col("_rr_start") + F.col("_rr_place")).drop("_rr_part", "_rr_place", "_rr_start"))


def _scatter(m: BlockMatrix, row_blocks: int) -> np.ndarray:
    """Transpose times matrix, summed over splits of a few row blocks."""
    splits = max(1, -(-row_blocks // BLOCKS_PER_TASK))
    product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def _times(m: BlockMatrix, right: np.ndarray, row_blocks: int) -> BlockMatrix:
    """``m`` times a small matrix; its partitions set how many tasks share the rows."""
    sc, per = m._java_matrix_wrapper._sc, m.colsPerBlock
    tasks = max(1, -(-row_blocks // BLOCKS_PER_TASK))
    blocks = [((i, 0), Matrices.dense(len(p), p.shape[1], p.flatten("F").tolist()))
              for i, p in enumerate(right[j:j + per] for j in range(0, len(right), per))]
    return m.multiply(BlockMatrix(sc.parallelize(blocks, max(tasks, len(blocks))), per, right.shape[1], len(right), right.shape[1]))


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened leading components, one row per vector and component: ``vec_id``,
    ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    The vectors are ``scaled``; all of them are fitted, with divisor ``n``.
    Vectors that are null, empty or hold null or non-finite entries give no row, nor do
    those of another length than the commonest (ties: the longer).  Repeated rows and
    ids and null ids count each.  Directions with under ``LEAST_SHARE`` of the largest
    variance have no component, so one vector, equal vectors or an empty table give
    no row.  ``deviation`` is null where a long can't hold it.  Other columns
    are ignored.
    """
    spark = df.sparkSession
    found = df.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector)).alias("_rr_x")).where("_rr_x is not null")
    common = found.groupBy(F.size("_rr_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    d = common.d
    rows = indexed(found.where(F.size("_rr_x") == d))
    least, most, n = rows.agg(F.min(F.array_min("_rr_x")), F.max(F.array_max("_rr_x")), F.count(F.lit(1))).first()
    wide = max(abs(least), abs(most)) * n >= 1 << 62 or d * (n * (most - least)) ** 2 >= 1 << 63
    exact = (lambda c: c.cast("decimal(38,0)")) if wide else (lambda c: c)
    sums = [int(s) for s in rows.agg(*(F.sum(exact(F.get("_rr_x", F.lit(i)))).alias(f"s{i}") for i in range(d))).first()]
    total = F.array(*(exact(F.lit(s if not wide else str(s))) for s in sums))
    size = exact(F.lit(n).cast("long"))
    off = F.zip_with("_rr_x", total, lambda x, s: exact(exact(x) * size) - s)
    if wide:
        # a squared term beyond 2**63 alone is more than a long holds
        sum2 = F.aggregate(F.transform("_rr_off", lambda t: F.when(F.abs(t) < 1 << 32, exact(t * t))),
                           F.lit("0").cast("decimal(38,0)"), lambda a, t: exact(a + t))
    else:
        sum2 = F.aggregate(F.transform("_rr_off", lambda t: t * t), F.lit(0).cast("long"), lambda a, t: a + t)
    off_rows = rows.select("vec_id", "index", off.alias("_rr_off"))
    centred = off_rows.select("index", array_to_vector(F.transform("_rr_off", lambda t: t.cast("double") / n)).alias("vector"))

    per_row, per_col = max(1, BLOCK_ENTRIES // d), min(d, COLUMNS_PER_BLOCK)
    row_blocks = -(-n // per_row)
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), n, d).toBlockMatrix(per_row, per_col)
    cov = _scatter(matrix, row_blocks) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = int((values[:components] > max(values[0], 0) * LEAST_SHARE).sum())
    if not keep:
        return spark.createDataFrame([], SCHEMA)
    projected = _times(matrix, vectors[:, :keep] / np.sqrt(values[:keep]), row_blocks)
    error = float(np.abs(_scatter(projected, row_blocks) / n - np.eye(keep)).max())
    explained = F.array(*(F.lit(float(v / np.trace(cov))) for v in values[:keep]))

    white = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    white = white.select("index", vector_to_array("vector").alias("_rr_w"))
    return (off_rows.select("vec_id", "index", sum2.try_cast("long").alias("deviation")).join(white, "index")
            .select("vec_id", "deviation", F.posexplode("_rr_w").alias("_rr_i", "whitened"))
            .select("vec_id", (F.col("_rr_i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(explained, F.col("_rr_i")).alias("explained"), F.lit(error).alias("identity_error")))
