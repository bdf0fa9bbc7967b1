"""Structured Streaming: continuous scoring (ST1) and a running class
summary (ST2).

Each micro-batch is scored by the batch scorer inside ``foreachBatch``.  ST1
writes the scores under the batch id with overwrite, so a replayed batch
rewrites the same files (idempotent sink).  ST2 is stateful: the counts of each
scored batch appear beside the checkpoint as a folder that is renamed into
place whole and once, and a second query sums them in the state store
(complete mode) and publishes every new total under a manifest.  A look at the
running summary reads one small file, however many batches have gone by, and a
reader always finds a whole summary.  Checkpoints live in the shared folder, so
a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators.scoring import class_counts, class_dim, drop_failed, score_keys
from feedlens.session import scratch_tables
from feedlens.sources.models import publish, published


def text_stream(spark: SparkSession, directory: str, glob: str, schema,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in ``directory`` (matching ``glob``) as a stream.

    Where ``glob`` matches folders, as a table that Spark wrote is one, the
    files in them are read, whatever their names."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    named = f"{directory.rstrip('/')}/{glob}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    if any(f.isDirectory() for f in found):
        return r.parquet(named)
    return r.option("pathGlobFilter", glob).parquet(directory)


def _start(stream: DataFrame, write_batch, checkpoint: str, available_now: bool):
    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def stream_score(stream: DataFrame, weights: DataFrame, sink: str, checkpoint: str,
                 key="doc_id", text: str = "text", available_now: bool = True):
    """ST1: score every arriving text; append the scores under ``sink``."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_tables(batch.sparkSession):        # what a batch writes on the way goes with it
            scored = drop_failed(score_keys(weights, batch, key, text))
            scored.drop("z").write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return _start(stream, write_batch, checkpoint, available_now)


COUNTS = "sentiment string, n long"


def appear(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes ``df`` so that ``path`` appears whole, at once; if it is there already
    (the batch is replayed), it stays as it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parent, name = path.rsplit("/", 1)
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{parent}/_beside/{name}")
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        df.write.mode("overwrite").parquet(beside.toString())
        if not fs.rename(beside, target):
            raise OSError(f"{beside} could not be renamed to {target}")


class SummaryQuery:
    """The two queries of ST2: the first scores, the second adds up.

    With ``available_now`` the second starts when the first has ended;
    otherwise both run until ``stop``."""

    def __init__(self, first, second, available_now: bool):
        self._running, self._second, self._wait = [first], second, available_now
        if not available_now:
            self._running.append(second())

    def awaitTermination(self) -> None:
        for q in self._running:
            q.awaitTermination()
        if self._wait and len(self._running) == 1 and self._running[0].exception() is None:
            self._running.append(self._second())
            self._running[-1].awaitTermination()

    def exception(self):
        return next((e for q in self._running if (e := q.exception()) is not None), None)

    def stop(self) -> None:
        for q in self._running:
            q.stop()


def stream_summary(stream: DataFrame, weights: DataFrame, sink: str, checkpoint: str,
                   key="doc_id", text: str = "text", available_now: bool = True) -> SummaryQuery:
    """ST2: the count per predicted class of everything that has arrived, published
    under ``sink``; ``read_summary`` reads it."""
    spark, counts = stream.sparkSession, f"{checkpoint}/counts"

    def write_counts(batch: DataFrame, batch_id: int) -> None:
        with scratch_tables(spark):
            scored = drop_failed(score_keys(weights, batch, key, text))
            appear(spark, class_counts(scored, "predicted_class").coalesce(1), f"{counts}/batch_id={batch_id}")

    def write_totals(totals: DataFrame, batch_id: int) -> None:
        publish(spark, sink, lambda folder: totals.coalesce(1).write.parquet(folder))

    def second():
        made = spark.createDataFrame([], COUNTS)      # so that there is a folder to watch
        appear(spark, made, f"{counts}/batch_id=-1")
        totals = spark.readStream.schema(COUNTS).parquet(counts).groupBy("sentiment").agg(F.sum("n").alias("n"))
        w = totals.writeStream.outputMode("complete").foreachBatch(write_totals).option("checkpointLocation", f"{checkpoint}/totals")
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()

    return SummaryQuery(_start(stream, write_counts, f"{checkpoint}/scores", available_now), second, available_now)


def read_summary(spark: SparkSession, sink: str) -> DataFrame:
    """``(cls, sentiment, n)`` over all batches so far, all three classes."""
    folder = published(spark, sink)
    counts = spark.createDataFrame([], COUNTS) if folder == sink else spark.read.schema(COUNTS).parquet(folder)
    return (F.broadcast(class_dim(spark)).join(counts, "sentiment", "left")
             .select("cls", "sentiment", F.coalesce("n", F.lit(0).cast("long")).alias("n")))


def run_to_end(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
