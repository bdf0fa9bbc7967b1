"""Published models: versions beside each other, a manifest that names one.

A model is written to a folder of its own under its path; only when that is
whole does the manifest, a one-line file, change to name it, by an atomic
rename.  So a reader finds the old version or the new one, whole, whatever
fails and whenever it looks.  The version before stays for readers that have
begun; older ones go.  Any file system that Spark knows will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from feedlens.session import delete_path

MANIFEST = "_manifest.json"


def _place(spark: SparkSession, path: str):
    """``(jvm Path class, file system, file context)`` of a path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return jvm.org.apache.hadoop.fs.Path, fs, jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), conf)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    path_of, fs, _ = _place(spark, path)
    if not fs.exists(path_of(path)):
        return None
    stream = fs.open(path_of(path))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: beside first, then renamed over ``path``."""
    path_of, fs, context = _place(spark, path)
    beside = path_of(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    gateway = spark.sparkContext._gateway
    rename = gateway.jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(path_of(path)), options)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the manifest says: ``version`` and ``before``."""
    text = read_text(spark, f"{path.rstrip('/')}/{MANIFEST}")
    return json.loads(text) if text else None


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Calls ``write`` with a new folder, then makes that the model at ``path``.

    If ``write`` fails, what ``path`` names stays as it was."""
    path = path.rstrip("/")
    old = manifest(spark, path)
    version = f"v-{uuid.uuid4().hex[:16]}"
    try:
        write(f"{path}/{version}")
    except BaseException:
        delete_path(spark, f"{path}/{version}")
        raise
    before = old and old["version"]
    write_text(spark, f"{path}/{MANIFEST}", json.dumps({"version": version, "before": before}))
    if old and old.get("before"):
        delete_path(spark, f"{path}/{old['before']}")
    return f"{path}/{version}"


def published(spark: SparkSession, path: str) -> str:
    """The folder of the model at ``path``; ``path`` itself if nothing was published there."""
    found = manifest(spark, path)
    return f"{path.rstrip('/')}/{found['version']}" if found else path
