"""Token features: tokenise, truncate, vocabulary, id encoding, padding.

Tokenising is a column expression (``regexp_extract_all`` on the normalised
text), so it runs on the JVM side on whole texts.  The vocabulary
is capped (the original's 30,522 ids), which is what lets the id table be
broadcast with a known size bound; tokens outside it map to [UNK].
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions import fixed
from feedlens.functions import text as T

# Ids 0..103 are [PAD], unused and the specials; learned tokens start here.
FIRST_TOKEN_ID = fixed.MASK_ID + 1
# Learned tokens that fit below the vocabulary size.
MAX_LEARNED = fixed.VOCAB_SIZE - FIRST_TOKEN_ID


def tokenize(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, T.tokens(F.col(text)))


def truncate_tokens(df: DataFrame, col: str = "tokens",
                    max_length: int = fixed.MAX_LENGTH) -> DataFrame:
    return df.withColumn(col, T.truncate(F.col(col), max_length))


def token_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(token, n)`` over all occurrences; combined map-side, so a very
    common token costs one row per partition in the shuffle."""
    return (df.select(F.explode(tokens).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def top_vocabulary(counts: DataFrame, min_count: int = 2,
                   size: int = MAX_LEARNED, first_id: int = FIRST_TOKEN_ID) -> DataFrame:
    """``(token, id, n)``: tokens with ``n >= min_count``, the ``size`` most
    frequent (ties by token), ids from ``first_id`` in that order.

    The cap is the feature (a fixed vocabulary size).  A histogram of the
    count values (one row per distinct count — a small table) gives the exact
    count at which the top ``size`` tokens end; only tokens at or above it
    reach the bounded top-k, so its final merge holds about ``size`` rows
    whatever the number of partitions.  The id window then runs over at most
    ``size`` rows.

    The histogram grows with the data (about the square root of the token
    count), but every row holds at least one token, so the cut lies within
    its ``size`` largest count values: a bounded top-k keeps exactly those
    before the running-sum window."""
    kept = counts.filter(F.col("n") >= min_count)
    hist = (kept.groupBy("n").agg(F.count(F.lit(1)).alias("_k"))
                .orderBy(F.desc("n")).limit(size))
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    cut = (hist.select("n", F.sum("_k").over(above).alias("_cum"))
               .filter(F.col("_cum") >= size)
               .agg(F.coalesce(F.max("n"), F.lit(min_count)).alias("_cut")))
    top = (kept.filter(F.col("n") >= cut.scalar())
               .orderBy(F.desc("n"), F.asc("token")).limit(size))
    w = Window.orderBy(F.desc("n"), F.asc("token"))
    return top.select("token", (F.row_number().over(w) - 1 + first_id).alias("id"), "n")


def build_vocab(df: DataFrame, tokens: str = "tokens", min_count: int = 2,
                size: int = MAX_LEARNED) -> DataFrame:
    """Vocabulary from one counting pass: the counts (one row per distinct
    token) are written once, and the threshold and the top-k both read them."""
    from feedlens.session import materialize
    return top_vocabulary(materialize(token_counts(df, tokens), "token-counts"), min_count, size)


def encode_padded(df: DataFrame, vocab: DataFrame, key: str = "ord",
                  tokens: str = "tokens", batch: tuple[str, ...] = ("split", "batch_id"),
                  keep: tuple[str, ...] = (), broadcast: bool = False) -> DataFrame:
    """Token ids, ``[CLS] ids [SEP]``, padded to the longest in each batch.

    One shuffle serves both steps: rows are hash-partitioned by the batch key
    first, which already satisfies the per-document regroup (document keys
    nest inside batches) and the per-batch width window.  The vocabulary is
    broadcast when it is the capped table (``broadcast=True``); otherwise it
    is joined by shuffle."""
    cols = [key, *batch, *keep]
    d = df.select(*cols, tokens).repartition(*[F.col(b) for b in batch])
    ex = d.select(*cols, F.posexplode_outer(tokens).alias("p", "token"))
    v = vocab.select("token", "id")
    ids = (ex.join(F.broadcast(v) if broadcast else v, "token", "left")
             .withColumn("id", F.when(F.col("p").isNotNull(),
                                      F.coalesce(F.col("id"), F.lit(fixed.UNK_ID)))))
    per_doc = (ids.groupBy(*cols)
                  .agg(F.sort_array(F.collect_list(
                      F.when(F.col("p").isNotNull(), F.struct("p", "id")))).alias("_pi")))
    body = F.transform(F.col("_pi"), lambda s: s["id"].cast("int"))
    seq = F.concat(F.array(F.lit(fixed.CLS_ID)), body, F.array(F.lit(fixed.SEP_ID)))
    w = Window.partitionBy(*batch)
    out = (per_doc.withColumn("_seq", seq)
                  .withColumn("n_real", F.size("_seq"))
                  .withColumn("width", F.max("n_real").over(w)))
    pad = F.col("width") - F.col("n_real")
    return (out.withColumn("input_ids", F.concat("_seq", F.array_repeat(F.lit(fixed.PAD_ID), pad)))
               .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("n_real")),
                                                      F.array_repeat(F.lit(0), pad)))
               .withColumn("n_unk", F.size(F.filter("_seq", lambda x: x == fixed.UNK_ID)))
               .drop("_pi", "_seq"))
