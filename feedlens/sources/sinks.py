"""Sinks: result CSV and metrics JSON (directories of part files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    """Header, RFC-4180 quotes, values written as they are (no trimming).

    ``order``: a column, not written, whose order the rows take over all parts:
    they are range-partitioned by it and sorted in each part, so the parts by
    name hold the rows in the order of the input, however many there are."""
    if order:
        df = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).drop(order)
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
       .option("quoteAll", True)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def write_results_typed(scored: DataFrame, path: str, key: tuple[str, ...] = (), text: str = "text") -> None:
    """The typed form of the result table: Parquet with the class, the
    confidence and the probabilities as numbers, and the text as carried."""
    from feedlens.functions.fixed import CLASS_NAMES
    (scored.select(*key, text, "predicted_class", "confidence",
                   *[F.element_at("p", k + 1).alias(n) for k, n in enumerate(CLASS_NAMES)])
           .write.mode("overwrite").parquet(path))


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", True).option("escape", '"')
                 .option("multiLine", True).csv(path))


METRIC_KEYS = ("accuracy", "precision", "recall", "f1_macro", "f1_weighted")


def write_metrics_json(metrics: DataFrame, path: str,
                       exclude=("classification_report", "confusion_matrix")) -> None:
    """The metrics record without the report and the matrix."""
    keep = [c for c in metrics.columns if c not in exclude]
    metrics.select(*keep).write.mode("overwrite").json(path)


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


__all__ = ["write_results_csv", "write_results_typed", "read_results_csv", "write_metrics_json",
           "read_metrics_json", "METRIC_KEYS"]
