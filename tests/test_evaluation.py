"""Metrics against the published scores (their unique confusion matrix)."""

import pytest

from feedlens.operators.evaluation import (classification_report, confusion_matrix,
                                           eval_metrics, metrics_long)

# rows = truth, columns = prediction (Negative, Neutral, Positive)
GOLDEN = [[3, 0, 0], [1, 0, 0], [0, 0, 5]]


def _preds(spark, matrix):
    rows = [(t, p) for t, row in enumerate(matrix) for p, n in enumerate(row) for _ in range(n)]
    return spark.createDataFrame(rows, "label int, pred int")


def test_published_metrics(spark):
    m = eval_metrics(_preds(spark, GOLDEN)).first()
    assert m.n == 9
    assert m.accuracy == pytest.approx(0.888889, abs=1e-6)
    assert m.precision == pytest.approx(0.583333, abs=1e-6)
    assert m.recall == pytest.approx(0.666667, abs=1e-6)
    assert m.f1_macro == pytest.approx(0.619048, abs=1e-6)
    assert m.f1_weighted == pytest.approx(0.841270, abs=1e-6)


def test_per_class_report(spark):
    rep = {r.row: r for r in classification_report(_preds(spark, GOLDEN)).collect()}
    assert (rep["Negative"].precision, rep["Negative"].recall) == pytest.approx((0.75, 1.0))
    assert rep["Negative"].f1 == pytest.approx(0.857143, abs=1e-6)
    assert (rep["Neutral"].precision, rep["Neutral"].recall, rep["Neutral"].f1) == (0.0, 0.0, 0.0)
    assert (rep["Positive"].precision, rep["Positive"].recall, rep["Positive"].f1) == (1.0, 1.0, 1.0)
    assert rep["accuracy"].f1 == pytest.approx(8 / 9)
    assert rep["macro avg"].f1 == pytest.approx(0.619048, abs=1e-6)
    assert rep["weighted avg"].f1 == pytest.approx(0.841270, abs=1e-6)
    assert [rep[k].support for k in ("Negative", "Neutral", "Positive")] == [3, 1, 5]


def test_confusion_matrix_keeps_zero_cells(spark):
    cm = {(r.truth, r.pred): r.n for r in confusion_matrix(_preds(spark, GOLDEN)).collect()}
    assert cm == {(t, p): GOLDEN[t][p] for t in range(3) for p in range(3)}


def test_macro_over_present_classes_only(spark):
    m = eval_metrics(_preds(spark, [[2, 1, 0], [0, 0, 0], [0, 0, 0]])).first()
    # classes present: 0 (truth) and 1 (prediction) -> macro over two classes
    assert m.precision == pytest.approx((1.0 + 0.0) / 2)
    assert m.recall == pytest.approx((2 / 3 + 0.0) / 2)
    cm = confusion_matrix(_preds(spark, [[2, 1, 0], [0, 0, 0], [0, 0, 0]])).collect()
    assert len(cm) == 4


def test_metrics_long_order(spark):
    rows = metrics_long(eval_metrics(_preds(spark, GOLDEN))).collect()
    assert [r.metric for r in rows] == ["accuracy", "precision", "recall", "f1_macro", "f1_weighted"]


def test_no_predictions_at_all(spark):
    """Every ratio is 0; nothing divides by zero."""
    empty = spark.createDataFrame([], "label int, pred int")
    m = eval_metrics(empty).first()
    assert (m.accuracy, m.precision, m.recall, m.f1_macro, m.f1_weighted) == (0, 0, 0, 0, 0)
    assert all((r.f1 or 0) == 0 for r in classification_report(empty).collect())
    assert confusion_matrix(empty).count() == 0
