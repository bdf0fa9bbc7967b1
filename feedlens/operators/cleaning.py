"""Preparing labelled feedback: clean, label-encode, filter, keep-first dedupe.

The order of the steps is part of the semantics: labels are mapped and bad
rows dropped *before* the dedupe, so a row with an unusable label never hides
a usable duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions import fixed
from feedlens.functions.probs import label_decode, label_encode
from feedlens.functions.text import clean_text, nonblank


def norm_columns(df: DataFrame) -> DataFrame:
    """Strip surrounding whitespace from every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def clean_columns(df: DataFrame, cols=("text", "sentiment"),
                  null_text: str | None = fixed.NULL_TEXT) -> DataFrame:
    """null -> 'nan', remove double quotes, Unicode strip, per column."""
    return df.withColumns({c: clean_text(F.col(c), null_text) for c in cols})


def with_label(df: DataFrame, sentiment: str = "sentiment", label: str = "label") -> DataFrame:
    """Class name -> 0/1/2 (null when unmapped), already an int."""
    return df.withColumn(label, label_encode(F.col(sentiment)))


def drop_unlabelled(df: DataFrame, cols=("text", "label")) -> DataFrame:
    return df.dropna(subset=list(cols))


def keep_nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(nonblank(F.col(text)))


def dedupe_first(df: DataFrame, key: str = "text", order: str = "ord") -> DataFrame:
    """Keep the first row (smallest ``order``) of each ``key``.

    Written as an aggregate, not a window: ``min`` / ``min_by`` are combined
    map-side before the shuffle, so a key that holds a large share of the rows
    costs one row per partition in the exchange, not all of its rows in one
    task.  With fixed-width columns this stays a HashAggregate."""
    rest = [c for c in df.columns if c not in (key, order)]
    aggs = [F.min(order).alias(order)] + [F.min_by(c, order).alias(c) for c in rest]
    return df.groupBy(key).agg(*aggs).select(key, order, *rest)


def prepare(df: DataFrame, order: str = "ord",
            null_text: str | None = fixed.NULL_TEXT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Prepared feedback ``(ord, text, sentiment, label)`` from raw
    ``(ord, text, sentiment)``.

    After the label filter, ``sentiment`` is exactly the class name of
    ``label``, so the dedupe carries only the int label and the name is
    decoded afterwards.  ``carry`` columns come from the kept row."""
    out = clean_columns(norm_columns(df).select(order, *carry, "text", "sentiment"),
                        null_text=null_text)
    out = with_label(out)
    out = drop_unlabelled(out)
    out = keep_nonblank(out)
    out = dedupe_first(out.select(order, *carry, "text", "label"), "text", order)
    return out.select(order, *carry, "text", label_decode(F.col("label")).alias("sentiment"),
                      "label")


def stage_counts(raw: DataFrame, split: DataFrame) -> DataFrame:
    """A5: ``(stage, n)``.  ``raw``: cleaned rows with their label, all of them
    (one conditional pass); ``split``: the prepared rows with their split."""
    lab = F.col("label").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    one = raw.agg(F.count(F.lit(1)).alias("loaded"), count(lab).alias("labelled"),
                  count(lab & nonblank(F.col("text"))).alias("nonblank"))
    parts = ("train", "validation", "test")
    two = split.agg(F.count(F.lit(1)).alias("unique"), *[count(F.col("split") == s).alias(s) for s in parts])
    return (one.unpivot([], ["loaded", "labelled", "nonblank"], "stage", "n")
               .unionByName(two.unpivot([], ["unique", *parts], "stage", "n")))
