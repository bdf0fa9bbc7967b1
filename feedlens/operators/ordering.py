"""Ordering operators: seeded shuffle with an exact global rank, the 80/10/10
split, fixed-size mini-batches, best candidate, and the patience rule.

No operator here sorts the whole input in one partition.  Global positions
come from a two-phase rank: count rows per hash bucket (a small table),
turn the counts into offsets, then rank inside each bucket.  Per-run
positions in an ordered history come from range-partitioned chunks, so a run
holding a large share of the rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions import fixed


# --------------------------------------------------------------------------
# O1 — seeded shuffle with an exact global rank
# --------------------------------------------------------------------------

def shuffle_key(key: str, seed: int = fixed.SEED):
    """The order key of the seeded shuffle: ``md5('<seed>:' || key)``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))


def seeded_rank(df: DataFrame, key: str = "text", seed: int = fixed.SEED,
                bucket_chars: int = 4, out: str = "rnk") -> DataFrame:
    """Add ``out`` = 0-based position in the order of ``(md5(seed:key), key)``
    and ``n_rows`` = the total row count.

    The hash is uniform, so its first ``bucket_chars`` hex digits cut the
    order into 16**bucket_chars equal ranges.  Per-bucket counts (at most
    65,536 rows at the default) become running offsets and are broadcast —
    their size is bounded by the bucket count, not by the data.  The rank
    inside a bucket is a window partitioned by bucket, so each task holds
    about n / 16**bucket_chars rows.  ``key`` must be unique (it is, after
    the keep-first dedupe).  The input is read twice (counts, then rank), so
    pass a written table rather than a long lineage."""
    d = (df.withColumn("_h", shuffle_key(key, seed))
           .withColumn("_b", F.substring("_h", 1, bucket_chars)))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("n_rows"))
    inner = Window.partitionBy("_b").orderBy("_h", key)
    return (d.join(F.broadcast(offsets), "_b")
             .withColumn(out, F.col("_off") + F.row_number().over(inner) - 1)
             .drop("_h", "_b", "_off"))


# --------------------------------------------------------------------------
# O2 / O3 — positional split and mini-batches
# --------------------------------------------------------------------------

def split_bounds(n, train_ratio: float = fixed.TRAIN_RATIO,
                 val_ratio: float = fixed.VAL_RATIO):
    """``int(n*train_ratio)`` and ``int(n*(train_ratio+val_ratio))`` in double
    arithmetic, truncated — the ratios are added in Python first, as the
    original does."""
    return ((n * F.lit(float(train_ratio))).cast("long"),
            (n * F.lit(float(train_ratio + val_ratio))).cast("long"))


def split_positional(ranked: DataFrame, rnk: str = "rnk", n: str = "n_rows",
                     train_ratio: float = fixed.TRAIN_RATIO,
                     val_ratio: float = fixed.VAL_RATIO) -> DataFrame:
    """``split`` in {train, validation, test} by rank; ``pos`` = position
    inside the split.  Test takes the remainder.  Not stratified."""
    train_end, val_end = split_bounds(F.col(n), train_ratio, val_ratio)
    r = F.col(rnk)
    split = (F.when(r < train_end, F.lit("train"))
              .when(r < val_end, F.lit("validation"))
              .otherwise(F.lit("test")))
    start = (F.when(r < train_end, F.lit(0).cast("long"))
              .when(r < val_end, train_end)
              .otherwise(val_end))
    return ranked.withColumn("split", split).withColumn("pos", r - start)


def mini_batches(split_df: DataFrame, batch_size: int = fixed.BATCH_SIZE,
                 pos: str = "pos") -> DataFrame:
    """Consecutive batches of ``batch_size`` rows inside each split."""
    return split_df.withColumn("batch_id", F.floor(F.col(pos) / F.lit(batch_size)).cast("long"))


def seeded_split(df: DataFrame, key: str = "text", seed: int = fixed.SEED,
                 train_ratio: float = fixed.TRAIN_RATIO,
                 val_ratio: float = fixed.VAL_RATIO,
                 batch_size: int = fixed.BATCH_SIZE) -> DataFrame:
    """O1 -> O2 -> O3: ``rnk, n_rows, split, pos, batch_id`` added."""
    ranked = seeded_rank(df, key, seed)
    return mini_batches(split_positional(ranked, train_ratio=train_ratio,
                                         val_ratio=val_ratio), batch_size)


# --------------------------------------------------------------------------
# O4 — best candidate (top-1, greater is better)
# --------------------------------------------------------------------------

def best_by(df: DataFrame, metric: str, tie: str, group: list[str] | None = None) -> DataFrame:
    """Row with the largest ``metric`` per group; ties go to the smallest
    ``tie``.  An aggregate (``max_by``), so it combines map-side."""
    others = [c for c in df.columns if c not in (group or [])]
    key = F.struct(F.col(metric), (-F.col(tie)).alias("_t"))
    best = F.max_by(F.struct(*[F.col(c) for c in others]), key).alias("_best")
    g = df.groupBy(*(group or [])).agg(best)
    return g.select(*(group or []), *[F.col(f"_best.{c}").alias(c) for c in others])


# --------------------------------------------------------------------------
# O5 — patience rule over an ordered evaluation history
# --------------------------------------------------------------------------

def _chunked(df: DataFrame, run: str, order: list[str], chunks: int) -> DataFrame:
    """Range-partition on ``(run, *order)`` and tag rows with their partition:
    each ``(run, _c)`` pair is a contiguous slice of the run's order, and the
    range bounds are sampled so even a single huge run is cut into many
    slices."""
    return (df.repartitionByRange(chunks, F.col(run), *[F.col(c) for c in order])
              .withColumn("_c", F.spark_partition_id()))


def early_stop_point(df: DataFrame, run: str = "run", order=("ts", "event_id"),
                     metric: str = "metric",
                     patience: int = fixed.EARLY_STOPPING_PATIENCE,
                     chunks: int | None = None) -> DataFrame:
    """Per run: ``n_steps``, ``best_step`` (first step reaching the maximum),
    ``best_metric`` and ``stop_step`` — the first step after which ``patience``
    evaluations in a row brought no strict improvement (null: never).

    The rows are range-partitioned into slices (so a run holding most rows
    is spread over many tasks) and written once.  Each slice is scanned once
    and summarised; a small per-run pass over the slice summaries resolves
    what depends on earlier slices.  Inside a slice, a row after the slice's
    first improvement has its own last improvement; a row before it has the
    last improvement ``L`` of the earlier slices, so its first stop is simply
    ``max(slice_start, L + patience)`` if that comes before the improvement."""
    from feedlens.session import materialize
    order = list(order)
    spark = df.sparkSession
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = materialize(_chunked(df.select(run, *order, metric), run, order, chunks), "history-slices")

    prev = Window.partitionBy(run).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    cs = r.groupBy(run, "_c").agg(F.count(F.lit(1)).alias("_n"), F.max(metric).alias("_mx"))
    cs = cs.select(run, "_c", F.coalesce(F.sum("_n").over(prev), F.lit(0)).alias("_off"),
                   F.max("_mx").over(prev).alias("_pmax"))

    w = Window.partitionBy(run, "_c").orderBy(*order)
    step = F.col("_off") + F.row_number().over(w)
    x = (r.join(cs, [run, "_c"])
          .withColumn("step", step)
          .withColumn("_pb", F.greatest(F.col("_pmax"),
                                        F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))))
          .withColumn("_imp", F.col("_pb").isNull() | (F.col(metric) > F.col("_pb")))
          .withColumn("_li", F.max(F.when(F.col("_imp"), F.col("step")))
                               .over(w.rowsBetween(Window.unboundedPreceding, 0))))
    imp_step = F.when(F.col("_imp"), F.col("step"))
    sl = x.groupBy(run, "_c").agg(
        F.min("step").alias("_start"), F.max("step").alias("_end"),
        F.min(imp_step).alias("_first_imp"), F.max(imp_step).alias("_last_imp"),
        F.min(F.when(F.col("_li").isNotNull() & (F.col("step") - F.col("_li") >= patience),
                     F.col("step"))).alias("_a_stop"),
        F.max(metric).alias("_mx"))
    last_before = F.max("_last_imp").over(prev)
    cand = F.greatest(F.col("_start"), last_before + patience)
    before_end = F.coalesce(F.col("_first_imp") - 1, F.col("_end"))
    b_stop = F.when(last_before.isNotNull() & (cand <= before_end), cand)
    sl = sl.withColumn("_stop", F.coalesce(b_stop, F.col("_a_stop")))
    return sl.groupBy(run).agg(
        F.max("_end").alias("n_steps"), F.max("_last_imp").alias("best_step"),
        F.max("_mx").alias("best_metric"), F.min("_stop").alias("stop_step"))
