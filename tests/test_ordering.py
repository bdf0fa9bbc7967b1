"""Seeded shuffle, split, batches, best candidate and the patience rule."""

import hashlib
import random

from pyspark.sql import functions as F

from feedlens.operators.ordering import (best_by, early_stop_point, mini_batches,
                                         seeded_rank, split_positional)


def _texts(spark, n):
    return spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("t"), F.col("id")).alias("text"))


def test_split_sizes_85(spark):
    sp = split_positional(seeded_rank(_texts(spark, 85)))
    counts = {r.split: r["count"] for r in sp.groupBy("split").count().collect()}
    assert counts == {"train": 68, "validation": 8, "test": 9}


def test_split_bounds_match_python(spark):
    for n in (1, 2, 9, 10, 11, 99, 101, 373):
        sp = split_positional(seeded_rank(_texts(spark, n)))
        got = {r.split: r["count"] for r in sp.groupBy("split").count().collect()}
        e1, e2 = int(n * 0.8), int(n * (0.8 + 0.1))
        want = {k: v for k, v in {"train": e1, "validation": e2 - e1, "test": n - e2}.items() if v}
        assert got == want, n


def test_rank_is_md5_order_and_partition_free(spark):
    n = 500
    want = sorted(range(n), key=lambda i: (hashlib.md5(f"42:t{i}".encode()).hexdigest(), f"t{i}"))
    want_rank = {o: r for r, o in enumerate(want)}
    for parts in (1, 7, 64):
        df = _texts(spark, n).repartition(parts)
        got = {r.ord: r.rnk for r in seeded_rank(df, bucket_chars=2).collect()}
        assert got == want_rank


def test_batches_are_consecutive_blocks(spark):
    sp = mini_batches(split_positional(seeded_rank(_texts(spark, 85))))
    sizes = sorted((r.split, r.batch_id, r["count"])
                   for r in sp.groupBy("split", "batch_id").count().collect())
    assert [s for s in sizes if s[0] == "train"] == [("train", i, 16) for i in range(4)] + [("train", 4, 4)]
    assert [s for s in sizes if s[0] == "test"] == [("test", 0, 9)]


def _patience_py(metrics, patience=2):
    best, li, stop = None, None, None
    for step, m in enumerate(metrics, 1):
        if best is None or m > best:
            best, li = m, step
        if stop is None and step - li >= patience:
            stop = step
    return li, stop


def test_patience_rule_with_a_hot_run(spark):
    rnd = random.Random(7)
    rows, eid = [], 0
    for run, n in ((1, 3000), (2, 5), (3, 1), (4, 40)):     # run 1 holds most rows
        for i in range(n):
            rows.append((run, i * 10 + rnd.randint(0, 5), eid, float(rnd.randint(0, 50))))
            eid += 1
    df = spark.createDataFrame(rows, "run long, ts long, event_id long, metric double")
    got = {r.run: (r.n_steps, r.best_step, r.stop_step)
           for r in early_stop_point(df, chunks=16).collect()}
    for run in (1, 2, 3, 4):
        mine = sorted((x for x in rows if x[0] == run), key=lambda x: (x[1], x[2]))
        li, stop = _patience_py([x[3] for x in mine])
        assert got[run] == (len(mine), li, stop), run


def test_patience_rule_any_slicing(spark):
    """Stops that fall on slice boundaries: many short runs, tied metrics."""
    rnd = random.Random(11)
    rows, eid = [], 0
    for run in range(40):
        for i in range(rnd.randint(1, 60)):
            rows.append((run, i, eid, float(rnd.randint(0, 4))))
            eid += 1
    df = spark.createDataFrame(rows, "run long, ts long, event_id long, metric double")
    want = {}
    for run in range(40):
        mine = [x[3] for x in rows if x[0] == run]
        want[run] = (len(mine), *_patience_py(mine)) if mine else None
    for chunks in (1, 3, 16, 64):
        got = {r.run: (r.n_steps, r.best_step, r.stop_step)
               for r in early_stop_point(df, chunks=chunks).collect()}
        assert got == {k: v for k, v in want.items() if v}, chunks


def test_best_by_ties_to_first(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "cand int, f1_macro double")
    assert best_by(df, "f1_macro", "cand").first().cand == 1
