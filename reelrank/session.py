"""SparkSession helpers.

Cluster deployments hand us a configured session; we only fill in settings
that are unset, so a cluster's shared ``spark.checkpoint.dir`` always wins.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults tuned for correctness at any scale; AQE re-plans joins at run time
# (broadcast conversion with a measured size, skew split, partition coalescing).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(master: str | None = None, app: str = "reelrank",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with our defaults.

    ``master`` is only set when given, so spark-submit's choice is kept.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir, setting a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only when nothing is configured (local tests) do we create one.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a driver-side context
        sc = None
    cur = sc.getCheckpointDir() if sc is not None else None
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="reelrank-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc is not None:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster (falls back to the shuffle partition count)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_table_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


@contextmanager
def few_folders(spark: SparkSession, n: int = 16) -> Iterator[None]:
    """While open, a write by partition columns keeps a file open per value and sorts nothing, if
    a task has at most ``n`` values."""
    conf = "spark.sql.maxConcurrentOutputFileWriters"
    old = spark.conf.get(conf)
    spark.conf.set(conf, str(n))
    try:
        yield
    finally:
        spark.conf.set(conf, old)


def clear_scratch_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables written under the checkpoint folder.

    Call after the results of a run have been written; tables still referenced
    by live DataFrames must not be cleared while those are in use.
    """
    base = scratch_table_dir(spark, "").rstrip("/")
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)
