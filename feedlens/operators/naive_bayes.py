"""Relational multinomial naive Bayes: fit and score as joins and aggregates.

Fit: token x class counts over the train split (combined map-side) and
Laplace-smoothed log weights for every train token.  One weight row per token
holds the weights of all three classes (and of all smoothing candidates), so
scoring never multiplies rows.

Weights are DECIMAL(18,12): their sums are exact, so scores do not depend on
partitioning or on the order in which rows meet (the same holds in any SQL
engine).  The class priors are the weight row of an empty token, which the
tokenizer can never produce; it is added once per document after the sums.

Scoring joins tokens to weights in two parts with one meaning.  Tokens that
hold at least 1/``MAX_FREQUENT`` of all train tokens — at most MAX_FREQUENT of
them, whatever the corpus — are looked up by broadcast.  What is left is rare in
train; the MAX_HEAVY tokens of it that most scored texts hold, found by a
sketch over the scored side, are looked up by broadcast too, so no shuffled key
is hot on either side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import fixed
from feedlens.functions import text as T
from feedlens.session import materialize
from feedlens.sources.models import publish, published

PRIOR_TOKEN = ""          # never emitted by the tokenizer
WEIGHT_TYPE = "decimal(18,12)"
SUM_TYPE = "decimal(34,12)"   # leaves room to add without losing a digit
N_CLASSES = len(fixed.CLASS_NAMES)
MAX_FREQUENT = 20_000     # frequent tokens there can be
LOW_BITS = 20             # of a weight, summed by themselves
MAX_HEAVY = 1000          # tokens of the scored texts that are split off


def weight_names(candidate: int | None = None) -> list[str]:
    """The weight columns of one smoothing candidate (None: the only one)."""
    return [f"w{k}" if candidate is None else f"w{k}_{candidate}" for k in range(N_CLASSES)]


def _log_weight(num: Column, den: Column) -> Column:
    return F.round(F.ln(num / den), 12).cast(WEIGHT_TYPE)


def class_token_counts(train: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """``(token, n, c0, c1, c2)`` over every token occurrence of the train rows.

    Each document also contributes one occurrence of the empty token, so that
    row holds the number of train documents per class (the prior counts) —
    one pass over the training data yields everything the fit needs."""
    toks = F.concat(F.array(F.lit(PRIOR_TOKEN)), T.tokens(F.col(text)))
    # Outer: a filter on the arrays' size would tokenise every text twice.
    ex = (train.where(F.col(text).isNotNull()).select(F.col(label).alias("_y"), toks.alias("_toks"))
               .select("_y", F.explode_outer("_toks").alias("token")))
    return ex.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.when(F.col("_y") == k, 1).otherwise(0)).alias(f"c{k}") for k in range(N_CLASSES)])


def weight_table(counts: DataFrame, alphas: list[float | None]) -> DataFrame:
    """``(token, frequent, weights...)`` of every train token and the prior row.

    ``counts`` is a written table; its totals are one aggregated row, read as
    a scalar.  One candidate (``alphas`` of length 1) has the plain names."""
    names = [weight_names(None if len(alphas) == 1 else c) for c in range(len(alphas))]
    words = counts.filter(F.col("token") != PRIOR_TOKEN)
    total = (words.agg(F.struct(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"),
                                *[F.sum(f"c{k}").alias(f"t{k}") for k in range(N_CLASSES)]).alias("t"))
                  .scalar())
    rows = words.select("token", "n", *[f"c{k}" for k in range(N_CLASSES)], total.alias("t"))
    weights = [_log_weight(F.col(f"c{k}") + float(a), F.col(f"t.t{k}") + float(a) * F.col("t.v")).alias(names[c][k])
               for c, a in enumerate(alphas) for k in range(N_CLASSES)]
    prior = counts.filter(F.col("token") == PRIOR_TOKEN).select(
        "token", F.lit(False).alias("frequent"),
        *[_log_weight(F.col(f"c{k}") + 1.0, F.col("n") + float(N_CLASSES)).alias(names[c][k])
          for c in range(len(alphas)) for k in range(N_CLASSES)])
    return rows.select("token", (F.col("n") * MAX_FREQUENT >= F.col("t.n")).alias("frequent"), *weights).unionByName(prior)


@dataclass
class NBModel:
    """Weights ``(token, frequent, w0, w1, w2)``, the empty token holding the priors."""
    weights: DataFrame

    def save(self, path: str) -> None:
        """Published whole: the model that ``path`` named before serves until then."""
        publish(self.weights.sparkSession, path, lambda folder: self.weights.write.parquet(folder))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "NBModel":
        return NBModel(spark.read.parquet(published(spark, path)))


def nb_fit(train: DataFrame, text: str = "text", label: str = "label", alpha: float = 1.0) -> NBModel:
    """Fitting is an action (as in Spark ML): counts and weights — one row per
    train token — are written once, so scoring plans start from a table."""
    counts = materialize(class_token_counts(train, text, label), "nb-counts")
    return NBModel(materialize(weight_table(counts, [alpha]), "nb-weights"))


def nb_fit_grid(train: DataFrame, alphas: list[float], text: str = "text", label: str = "label") -> DataFrame:
    """Weights for several smoothing values at once, one row per token, with
    the columns ``weight_names(c)`` of each candidate."""
    counts = materialize(class_token_counts(train, text, label), "nb-counts")
    if len(alphas) == 1:
        t = weight_table(counts, alphas).withColumnsRenamed(dict(zip(weight_names(), weight_names(0), strict=True)))
        return materialize(t, "nb-grid")
    return materialize(weight_table(counts, alphas), "nb-grid")


def heavy_tokens(part: DataFrame) -> tuple[DataFrame, list[str]]:
    """The written rows of ``part`` and the tokens ``_k`` that stand in most of them.

    A token that is rare in train may stand in every text that is scored (another
    language, a new boilerplate word).  A mergeable frequency sketch counts the
    rows of each token while they are written; what it finds only says which
    rows meet their weights by broadcast, so results do not depend on it."""
    seen = Observation("tokens")
    top = F.expr(f"approx_top_k(_k, {MAX_HEAVY}, {50 * MAX_HEAVY})")
    rows = materialize(part.observe(seen, top.alias("top")), "token-rows")
    return rows, [t["item"] for t in seen.get["top"] or [] if t["item"] is not None]


def weight_sums(weights: DataFrame, docs: DataFrame, key: tuple[str, ...], text: str,
                cols: list[str], unique: bool = False) -> DataFrame:
    """``(*key, _id, _ok, _copies, *cols)``: exact sums of weights per document.

    One scan of ``docs``; only keys, tokens and sums are shuffled, never texts.
    The scan writes a row an occurrence: a frequent token by its weights, a rare
    one by name, and one row of the document's own.  Frequent ones are summed
    where they lie; rare ones meet their weights by token first.  Documents that
    share a key but not a text are told apart by ``_id``, a hash of the text
    (``unique``: the caller knows that keys are); ``_copies`` counts rows that
    share both, and the sums are those of one of them.  ``_ok`` is false for
    a null text, whose sums are null."""
    flag = F.col("frequent") if "frequent" in weights.columns else F.lit(False)
    words = weights.filter(F.col("token") != PRIOR_TOKEN).withColumn("_f", flag)
    # Whole numbers of 10^-12, summed in two parts: exact, and many times faster than wide decimals.
    words = words.withColumns({c: (F.col(c) * F.lit(10 ** 12)).cast("long") for c in cols})
    # At most MAX_FREQUENT rows: each holds 1/MAX_FREQUENT of the train tokens.
    frequent = F.broadcast(words.filter("_f").select("token", *cols))
    rare = words.filter(~F.col("_f")).select(F.col("token").alias("_t"), *[F.col(c).alias(f"_r_{c}") for c in cols])
    doc = [*key, "_id", "_ok"]
    mark = F.lit(None).cast("string")
    toks = F.coalesce(F.concat(F.array(mark), T.tokens(F.col(text))), F.array(mark))
    # The hash and the tokens first, once a text: beside ``explode`` they would be computed once
    # a token.  Outer, though no array is empty: a filter on its size would tokenise a text twice.
    e = docs.select(*key, (F.lit(0) if unique else F.xxhash64(F.coalesce(text, F.lit("")))).alias("_id"),
                    F.col(text).isNotNull().alias("_ok"), toks.alias("_toks")).select(*doc, F.explode_outer("_toks").alias("token"))
    j = e.join(frequent, "token", "left")
    rows, heavy = heavy_tokens(j.select(
        *doc, F.when(F.col("token").isNull(), 1).alias("_c"),
        F.when(F.col("token").isNotNull() & F.col(cols[0]).isNull(), F.col("token")).alias("_k"), *cols))
    part = rows.where(F.col("_k").isNotNull()).select(*doc, "_k")
    split = F.col("_k").isin(heavy) if heavy else F.lit(False)
    met = part.where(~split).join(rare, F.col("_k") == F.col("_t"))      # a token without weights adds nothing
    if heavy:                # at most MAX_HEAVY rows of weights
        met = met.unionByName(part.where(split).join(F.broadcast(rare.where(F.col("_t").isin(heavy))), F.col("_k") == F.col("_t")))
    met = met.select(*doc, F.lit(None).cast("int").alias("_c"), *[F.col(f"_r_{c}").alias(c) for c in cols])
    high, low = F.lit(1 << LOW_BITS).cast("decimal(7,0)"), F.lit((1 << LOW_BITS) - 1)
    unit = F.lit("0.000000000001").cast("decimal(12,12)")
    none = F.lit(0).cast("long")
    whole = lambda c: (F.coalesce(F.col(f"_h_{c}"), none).cast("decimal(19,0)") * high
                       + F.coalesce(F.col(f"_l_{c}"), none).cast("decimal(19,0)")).cast("decimal(25,0)")
    total = rows.where(F.col("_k").isNull()).select(*doc, "_c", *cols).unionByName(met).groupBy(*doc).agg(
        F.sum("_c").alias("_copies"),
        *[F.sum(F.shiftright(c, LOW_BITS)).alias(f"_h_{c}") for c in cols],
        *[F.sum(F.col(c).bitwiseAND(low)).alias(f"_l_{c}") for c in cols])
    total = total.select(*doc, "_copies", *[(whole(c) * unit).cast(SUM_TYPE).alias(c) for c in cols])
    prior = weights.filter(F.col("token") == PRIOR_TOKEN).select(F.struct(*cols)).scalar()
    one = [F.when(F.col("_copies") == 1, F.col(c)).otherwise((F.col(c) / F.col("_copies")).cast(SUM_TYPE)) for c in cols]
    return total.select(*doc, "_copies", *[
        F.when(F.col("_ok"), (v + prior[c]).cast(SUM_TYPE)).alias(c) for v, c in zip(one, cols, strict=True)])
