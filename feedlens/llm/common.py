"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hash_order(column: str = "doc_id"):
    """The id's hash as a number from 0 to 2**53."""
    return F.shiftrightunsigned(F.xxhash64(column), 11)


def share_below(size, n: int, column: str = "doc_id"):
    """Whether a row's id hashes into the lowest share of ``size`` ids that holds
    at least ``n`` of them, all but surely.  Thins out a large group by rows
    alone, before any shuffle, to a number that does not grow with it."""
    return hash_order(column) / float(1 << 53) * size < n + 6 * n ** 0.5 + 20


BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, which a task holds twice (JVM and Python)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def fold(column: str, mod: int):
    """crc32 of a column's text form, modulo ``mod`` (null: remainder of '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % mod
