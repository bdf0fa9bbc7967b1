"""Session construction and the shared working folder.

On a cluster the working folder is the one the cluster names in
``spark.checkpoint.dir`` (a shared file system).  Only when that setting is
absent — local runs and tests — do we create one of our own.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, partitions: int | None = None,
                  app_name: str = "feedlens", driver_memory: str = "8g") -> SparkSession:
    """A session with the settings the library assumes (AQE on, UI off, UTC).

    Local sessions (tests, bench) also get a shuffle-partition count equal to
    the cores and a driver heap; on a cluster those stay whatever the cluster
    sets, and AQE sizes shuffle partitions from the data."""
    local = (master or "").startswith("local")
    b = SparkSession.builder.appName(app_name)
    if master is not None:
        b = b.master(master)
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if local or partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions or os.cpu_count()))
    if local:
        b = b.config("spark.driver.memory", driver_memory)
        # Small local inputs: AQE's 1 MB coalesce floor would leave cores idle
        # on CPU-bound text stages.  Cluster sessions keep the defaults.
        b = b.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        b = b.config("spark.sql.files.maxPartitionBytes", "4m")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: read from the session, set only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get(_CKPT_KEY, None)
    if not conf:
        try:
            conf = spark.conf.get(_CKPT_KEY)
        except Exception:  # noqa: BLE001 - unset key raises in some versions
            conf = None
    if not conf:
        # Only a local master shares the driver's own folders with its tasks.
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set {_CKPT_KEY} to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="feedlens-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for a written table."""
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/feedlens-{name}-{uuid.uuid4().hex[:12]}"
    if _open_blocks():
        _open_blocks()[-1].append(path)
    return path


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads the table instead of
    recomputing the whole plan) and computes ``df`` once — unlike an
    uncached reliable checkpoint, which runs the plan twice.  Inside
    ``scratch_tables`` the table is deleted when the block ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_JOBS: dict[int, list[list[str]]] = {}      # paths written by the jobs that each thread runs


def _open_blocks() -> list[list[str]]:
    return _JOBS.setdefault(threading.get_ident(), [])


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies (any file system that Spark knows)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch_tables(spark: SparkSession):
    """A job's block: the tables it writes to scratch go when it ends, so only
    what it returns by value, or wrote to its output, may be used afterwards."""
    _open_blocks().append([])
    try:
        yield
    finally:
        for path in _open_blocks().pop():
            delete_path(spark, path)
