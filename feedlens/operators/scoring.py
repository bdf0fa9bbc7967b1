"""Scores to records, tables and summaries.

Input everywhere is a scored DataFrame: one row per text with ``z`` (class
logits), ``p`` (probabilities), ``pred`` (class index) and ``confidence``.
Everything here is per-row expressions or an aggregate over at most three
class keys (combined map-side, so a class holding most rows is no hot spot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.functions import fixed
from feedlens.functions import probs as P
from feedlens.functions.text import display_text, format_pct
from feedlens.operators.naive_bayes import weight_names, weight_sums


def class_dim(spark: SparkSession) -> DataFrame:
    """The fixed three-row class dimension ``(cls, sentiment)``."""
    return spark.createDataFrame(list(enumerate(fixed.CLASS_NAMES)), "cls int, sentiment string")


def with_scores(df: DataFrame, z: str = "z") -> DataFrame:
    """Add ``p`` (softmax), ``pred`` (argmax, ties to the lowest index),
    ``predicted_class`` and ``confidence = p[pred]``."""
    return (df.withColumn("p", P.softmax(F.col(z)))
              .withColumn("pred", P.argmax(F.col(z)))
              .withColumn("predicted_class", P.label_decode(F.col("pred")))
              .withColumn("confidence", F.element_at(F.col("p"), F.col("pred") + 1)))


def _keys(key) -> tuple[str, ...]:
    return (key,) if isinstance(key, str) else tuple(key)


def score_keys(weights: DataFrame, docs: DataFrame, key="doc_id", text: str = "text",
               unique: bool = False) -> DataFrame:
    """M5 without the texts: ``(*key, z, p, pred, ...)``, one row per input
    row, from one scan of ``docs``; no text is shuffled."""
    ks, cols = _keys(key), weight_names()
    s = weight_sums(weights, docs, ks, text, cols, unique)
    z = F.array(*[F.col(c).cast("double") for c in cols])
    rows = s if unique else s.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return with_scores(rows.select(*ks, F.when(F.col(cols[0]).isNotNull(), z).alias("z")))


def score_docs(weights: DataFrame, docs: DataFrame, key="doc_id",
               text: str = "text", keep: tuple[str, ...] = (),
               text_as: F.Column | None = None, unique: bool = False) -> DataFrame:
    """M5 with the texts: every input row, scored; a row that cannot be scored
    keeps null scores (see ``drop_failed``).

    The sums are joined back to the rows, which moves the carried columns by
    key.  ``text_as`` carries an expression of the text (its display form)
    instead of the text; on a written table that already holds it as a column
    the second read touches only that.  Use ``score_keys`` where no text is
    wanted.  ``unique`` says that no two rows share a key."""
    ks = _keys(key)
    return with_scores(attach(docs, class_sums(weights, docs, ks, text, unique), ks, text, keep, text_as, unique))


def class_sums(weights: DataFrame, docs: DataFrame, ks: tuple[str, ...], text: str, unique: bool) -> DataFrame:
    """``(*ks, _id, _ok, z)``: the class sums of each key and text, without the texts."""
    cols = weight_names()
    s = weight_sums(weights, docs, ks, text, cols, unique)
    z = F.array(*[F.col(c).cast("double") for c in cols])
    return s.select(*ks, "_id", "_ok", F.when(F.col(cols[0]).isNotNull(), z).alias("z"))


def attach(docs: DataFrame, s: DataFrame, ks: tuple[str, ...], text: str, keep: tuple[str, ...] = (),
           text_as: F.Column | None = None, unique: bool = False) -> DataFrame:
    """The rows of ``docs`` with the columns that ``s`` has beside ``*ks, _id, _ok``."""
    carried = F.col(text) if text_as is None else text_as.alias(text)
    if unique:
        return docs.select(*ks, carried, *keep).join(s.drop("_id", "_ok"), list(ks), "left")
    found = [c for c in s.columns if c not in (*ks, "_id", "_ok")]
    rows = docs.select(*ks, carried, *keep, F.xxhash64(F.coalesce(text, F.lit(""))).alias("_id"),
                       F.col(text).isNotNull().alias("_ok"))
    same = (rows["_id"] == s["_id"]) & (rows["_ok"] == s["_ok"])
    for k in ks:
        same = same & rows[k].eqNullSafe(s[k])
    joined = rows.join(s, same, "left")
    return joined.select(*[rows[c] for c in rows.columns if c not in ("_id", "_ok")], *[s[c] for c in found])


def drop_failed(scored: DataFrame) -> DataFrame:
    """M6: keep rows that got a score."""
    return scored.filter(F.col("pred").isNotNull())


def score_records(scored: DataFrame, text: str = "text") -> DataFrame:
    """M4: the score record ``struct(text, predicted_class, confidence,
    class_probabilities map)``, one per row."""
    return scored.select("*", P.score_record(F.col(text), F.col("p")).alias("record"))


def result_table(scored: DataFrame, text: str = "text", precut: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """M8: display form — six string columns, text cut to 100 characters
    (``precut=True`` when ``text`` already holds the display form), after the
    columns ``keep``."""
    p = F.col("p")
    shown = F.col(text) if precut else display_text(F.col(text))
    return scored.select(
        *keep,
        shown.alias("Text"),
        F.col("predicted_class").alias("Sentiment"),
        format_pct(F.col("confidence")).alias("Confidence"),
        *[format_pct(F.element_at(p, k + 1)).alias(name)
          for k, name in enumerate(fixed.CLASS_NAMES)])


def class_counts(df: DataFrame, col: str = "Sentiment") -> DataFrame:
    """``(sentiment, n)`` for the classes present."""
    return df.groupBy(F.col(col).alias("sentiment")).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, col: str = "sentiment", order: str = "ord") -> DataFrame:
    """A2: ``(sentiment, n, rnk)``: rows per class, count descending, ties by
    first appearance; the rank runs over at most three rows."""
    g = df.groupBy(F.col(col).alias("sentiment")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    w = Window.orderBy(F.desc("n"), F.asc("_first"))
    return g.select("sentiment", "n", F.row_number().over(w).cast("int").alias("rnk"))


def sentiment_summary(df: DataFrame, col: str = "Sentiment") -> DataFrame:
    """A3: count per class, all three classes, 0 for an absent one."""
    dim = F.broadcast(class_dim(df.sparkSession))
    counts = class_counts(df, col)
    return (dim.join(counts, "sentiment", "left")
               .select("cls", "sentiment", F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n")))


def class_share(df: DataFrame, col: str = "Sentiment") -> DataFrame:
    """A4: share of each present class; the window runs over at most three rows."""
    counts = class_counts(df, col)
    total = F.sum("n").over(Window.partitionBy())
    share = F.col("n") / total
    return counts.select("sentiment", "n", share.alias("share"),
                         F.concat(F.format_number(share * 100, 1), F.lit("%")).alias("pct"))


def prob_distribution(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per class in class order, probability scaled to 0-100."""
    ex = scored.select(key, F.posexplode("p").alias("cls", "prob"))
    return ex.select(key, F.col("cls").cast("int").alias("cls"),
                     P.label_decode(F.col("cls")).alias("sentiment"),
                     (F.col("prob") * 100).alias("pct"),
                     F.concat(F.format_number(F.col("prob") * 100, 1), F.lit("%")).alias("bar_label"))


def confidence_band(conf) -> F.Column:
    """Gauge band of a confidence (bands closed on the left)."""
    pct = conf * 100
    expr = None
    for lo, hi in fixed.CONFIDENCE_BANDS:
        label = F.lit(f"{lo}-{hi}")
        cond = pct < hi if hi < 100 else F.lit(True)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def confidence_bands(scored: DataFrame) -> DataFrame:
    """Rows per confidence band and how many reach the gauge threshold."""
    c = F.col("confidence")
    return (scored.filter(c.isNotNull())
                  .groupBy(confidence_band(c).alias("band"))
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.when(c * 100 >= fixed.CONFIDENCE_THRESHOLD, 1).otherwise(0))
                        .cast("long").alias("n_above_threshold")))
