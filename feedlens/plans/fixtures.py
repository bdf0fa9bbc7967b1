"""Views over the driver tables that stand in for the application's inputs.

``fb_raw``   labelled feedback with injected dirt (null, blank, quoted,
             NBSP-padded text; unmapped, lower-case and quoted labels);
             every document row is kept — the dirt is a CASE, not a filter.
``fb_clean`` the prepare job applied to ``fb_raw``.
``batch``    unlabelled texts to score (``conversations``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators.cleaning import prepare
from feedlens.sources.tables import table

NBSP = " "


def fb_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ord, text, sentiment)``: documents left-joined to their labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic",
                                                 F.lit(True).alias("_labelled"))
    j = d.join(lab, "doc_id", "left")
    k = F.col("doc_id")
    text = (F.when(k % 97 == 0, F.lit(None).cast("string"))
             .when(k % 89 == 0, F.lit(' "" \t' + NBSP))
             .when(k % 7 == 0, F.concat(F.lit(NBSP + ' "'), F.col("text"), F.lit('" \n')))
             .otherwise(F.col("text")))
    sentiment = (F.when(F.col("_labelled").isNull(),
                        F.when(k % 5 == 0, F.lit("Mixed")))
                  .when(k % 83 == 0, F.lit("positive"))
                  .when(F.col("toxic") == 1, F.lit("Negative"))
                  .when(F.col("quality") == 0, F.lit(' "Neutral" '))
                  .otherwise(F.lit("Positive")))
    return j.select(k.alias("ord"), text.alias("text"), sentiment.alias("sentiment"))


def fb_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ord, text, sentiment, label)`` — prepared feedback."""
    return prepare(fb_raw(spark, sf_dir))


def batch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled batch input ``(doc_id, text)`` from ``conversations``.

    ``doc_id`` is a stable row key, ``conv_id:turn``."""
    return keyed_turns(table(spark, sf_dir, "conversations"))


def keyed_turns(turns: DataFrame) -> DataFrame:
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")


# --- the same views as DuckDB SQL, for the oracle ---------------------------

FB_RAW_SQL = """
select d.doc_id as ord,
  case when d.doc_id % 97 = 0 then null
       when d.doc_id % 89 = 0 then concat(' "" ', chr(9), chr(160))
       when d.doc_id % 7  = 0 then concat(chr(160), ' "', d.text, '" ', chr(10))
       else d.text end as text,
  case when l.doc_id is null then case when d.doc_id % 5 = 0 then 'Mixed' else null end
       when d.doc_id % 83 = 0 then 'positive'
       when l.toxic = 1 then 'Negative'
       when l.quality = 0 then ' "Neutral" '
       else 'Positive' end as sentiment
from documents d left join labels l on d.doc_id = l.doc_id
"""

BATCH_SQL = "select conv_id::varchar || ':' || turn::varchar as doc_id, text from conversations"
