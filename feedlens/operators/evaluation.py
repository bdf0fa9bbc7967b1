"""Evaluation: accuracy, macro precision/recall/F1, weighted F1, per-class
report and confusion matrix.

Everything derives from one aggregate, ``groupBy(y, pred).count()`` — at most
nine rows per group key — so the predictions are scanned once and the class
with most rows costs one row per partition.  Macro averages run over the
classes present in truth or prediction; empty ratios count as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions import fixed

_K = len(fixed.CLASS_NAMES)


def confusion_counts(preds: DataFrame, y: str = "label", p: str = "pred",
                     group: tuple[str, ...] = ()) -> DataFrame:
    """``(*group, y, p, n)`` — the one pass over the predictions.

    Written to the shared folder (at most nine rows per group): every metric,
    report row and matrix cell reads this small table, so the predictions —
    and the scoring behind them — are computed once, not once per branch of
    the report."""
    from feedlens.session import materialize
    cm = (preds.groupBy(*group, F.col(y).alias("y"), F.col(p).alias("p"))
               .agg(F.count(F.lit(1)).alias("n")))
    return materialize(cm, "confusion")


def _share(a, b):
    """a / b, 0 where there is nothing to share (no predictions at all)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_class(cm: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """``(*group, cls, sentiment, tp, n_true, n_pred, precision, recall, f1, present)``
    for all three classes."""
    g = [F.col(c) for c in group]
    as_truth = cm.select(*g, F.col("y").alias("cls"), F.col("n").alias("n_true"),
                         F.lit(0).cast("long").alias("n_pred"),
                         F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"))
    as_pred = cm.select(*g, F.col("p").alias("cls"), F.lit(0).cast("long").alias("n_true"),
                        F.col("n").alias("n_pred"), F.lit(0).cast("long").alias("tp"))
    sums = (as_truth.unionByName(as_pred).groupBy(*group, "cls")
                    .agg(F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true"),
                         F.sum("n_pred").alias("n_pred")))
    # all classes for every group: the class list is fixed, so build it by
    # exploding a literal array rather than joining to a product
    keys = cm.select(*g).distinct() if group else cm.sparkSession.range(1).select()
    full = keys.select(*g, F.explode(F.sequence(F.lit(0), F.lit(_K - 1))).alias("cls"))
    s = full.join(sums, [*group, "cls"], "left").na.fill(0, ["tp", "n_true", "n_pred"])
    tp, nt, npred = F.col("tp"), F.col("n_true"), F.col("n_pred")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    names = F.array(*[F.lit(n) for n in fixed.CLASS_NAMES])
    return s.select(
        *g, F.col("cls").cast("int").alias("cls"),
        F.element_at(names, F.col("cls") + 1).alias("sentiment"),
        tp, nt, npred,
        ratio(tp, npred).alias("precision"),
        ratio(tp, nt).alias("recall"),
        ratio(2 * tp, nt + npred).alias("f1"),
        ((nt > 0) | (npred > 0)).alias("present"))


def metrics_from_classes(pc: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: n, accuracy, precision, recall, f1_macro, f1_weighted."""
    pr = F.col("present")
    n = F.sum("n_true")
    macro = lambda c: F.coalesce(F.avg(F.when(pr, F.col(c))), F.lit(0.0))
    return pc.groupBy(*group).agg(
        n.alias("n"),
        _share(F.sum("tp"), n).alias("accuracy"),
        macro("precision").alias("precision"),
        macro("recall").alias("recall"),
        macro("f1").alias("f1_macro"),
        _share(F.sum(F.col("f1") * F.col("n_true")), n).alias("f1_weighted"))


def metrics(counts: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """E1-E5 from confusion counts (and E9 with ``group=('cand',)``)."""
    return metrics_from_classes(per_class(counts, group), group)


def eval_metrics(preds: DataFrame, y: str = "label", p: str = "pred",
                 group: tuple[str, ...] = ()) -> DataFrame:
    """E1-E5 of predictions; scans them.  For several reports over the same
    predictions, pass one ``confusion_counts`` to ``metrics``, ``report`` and
    ``matrix``.  No predictions: n is null or 0 and every ratio 0."""
    return metrics(confusion_counts(preds, y, p, group), group)


def classification_report(preds: DataFrame, y: str = "label", p: str = "pred") -> DataFrame:
    """E6 of predictions; scans them."""
    return report(confusion_counts(preds, y, p))


def report(counts: DataFrame) -> DataFrame:
    """E6 from confusion counts: per-class rows, then accuracy, macro avg and
    weighted avg rows: ``(row, precision, recall, f1, support)``."""
    pc = per_class(counts)
    classes = pc.select(F.col("cls").alias("ord"), F.col("sentiment").alias("row"),
                        "precision", "recall", "f1", F.col("n_true").alias("support"))
    m = metrics_from_classes(pc)
    pr = F.col("present")
    wavg = lambda c: _share(F.sum(F.col(c) * F.col("n_true")), F.sum("n_true"))
    avg = lambda c: F.coalesce(F.avg(F.when(pr, F.col(c))), F.lit(0.0))
    avgs = pc.agg(
        avg("precision").alias("mp"), avg("recall").alias("mr"), avg("f1").alias("mf"), wavg("precision").alias("wp"),
        wavg("recall").alias("wr"), wavg("f1").alias("wf"), F.sum("n_true").alias("s"))
    acc = m.select(F.lit(3).alias("ord"), F.lit("accuracy").alias("row"),
                   F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"),
                   F.col("accuracy").alias("f1"), F.col("n").alias("support"))
    macro = avgs.select(F.lit(4).alias("ord"), F.lit("macro avg").alias("row"),
                        F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                        F.col("mf").alias("f1"), F.col("s").alias("support"))
    weighted = avgs.select(F.lit(5).alias("ord"), F.lit("weighted avg").alias("row"),
                           F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                           F.col("wf").alias("f1"), F.col("s").alias("support"))
    return classes.unionByName(acc).unionByName(macro).unionByName(weighted)


def confusion_matrix(preds: DataFrame, y: str = "label", p: str = "pred") -> DataFrame:
    """E7 of predictions; scans them."""
    return matrix(confusion_counts(preds, y, p))


def matrix(cm: DataFrame) -> DataFrame:
    """E7 from confusion counts: ``(truth, pred, n)`` over the classes present
    in truth or prediction, zero cells kept; rows = truth, columns = prediction."""
    present = (cm.select(F.col("y").alias("c")).union(cm.select(F.col("p").alias("c")))
                 .distinct())
    # at most 3 x 3 cells: pair the present classes by exploding the list
    cells = (present.agg(F.sort_array(F.collect_set("c")).alias("cs"))
                    .select(F.explode("cs").alias("truth"), "cs")
                    .select("truth", F.explode("cs").alias("pred")))
    return (cells.join(cm.withColumnRenamed("y", "truth").withColumnRenamed("p", "pred"),
                       ["truth", "pred"], "left")
                 .select(F.col("truth").cast("int"), F.col("pred").cast("int"),
                         F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n")))


def metrics_long(metrics: DataFrame, cols=("accuracy", "precision", "recall",
                                           "f1_macro", "f1_weighted")) -> DataFrame:
    """``(metric, value)`` in the printed order."""
    return metrics.unpivot([], list(cols), "metric", "value")
