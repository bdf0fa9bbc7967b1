"""Spark ML flavour of the classifier: a persisted ``PipelineModel``.

Stages are all built in: the library's normalisation (``SQLTransformer``),
``RegexTokenizer`` with the library's token pattern, ``HashingTF`` (a fixed
feature space, so no vocabulary has to be gathered on the driver; tokens that
share a feature are not told apart), ``IDF``
and multinomial ``LogisticRegression``.  Scoring with the fitted model is a
map-only transform (no shuffle); the model is broadcast by Spark.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import fixed
from feedlens.functions import probs as P
from feedlens.functions import text as T
from feedlens.session import materialize
from feedlens.sources.models import publish, published

NUM_FEATURES = 1 << 18


def lr_pipeline(max_iter: int = 20, reg_param: float = fixed.WEIGHT_DECAY,
                num_features: int = NUM_FEATURES, text: str = "text",
                label: str = "label") -> Pipeline:
    """``maxIter`` stands in for the epoch budget and ``regParam`` for the
    weight decay of the original training options."""
    fold = SQLTransformer(statement=f"SELECT *, {T.normalise_sql(text)} AS _norm FROM __THIS__")
    tok = RegexTokenizer(inputCol="_norm", outputCol="_tokens", pattern=T.token_pattern(),
                         gaps=False, toLowercase=False, minTokenLength=1)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol=label, family="multinomial",
                            maxIter=max_iter, regParam=reg_param, elasticNetParam=0.0)
    return Pipeline(stages=[fold, tok, tf, idf, lr])


def lr_fits(train: DataFrame, reg_params: list[float], label: str = "label", **kw) -> list[PipelineModel]:
    """One model for each decay.  The texts are tokenised and counted once: the
    counts are written, and the weights of terms and every fit read them."""
    *_, tf, idf, _ = first = lr_pipeline(label=label, **kw).getStages()
    texts = PipelineModel(first[:-2])
    counts = materialize(texts.transform(train).select(label, tf.getOutputCol()), "lr-counts")
    terms = idf.fit(counts)
    found = terms.transform(counts)
    return [PipelineModel([*first[:-2], terms, lr_pipeline(label=label, reg_param=r, **kw).getStages()[-1].fit(found)]) for r in reg_params]


def lr_fit(train: DataFrame, reg_param: float = fixed.WEIGHT_DECAY, **kw) -> PipelineModel:
    return lr_fits(train, [reg_param], **kw)[0]


def lr_score(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """Input columns plus ``p`` (class probabilities), ``pred``,
    ``predicted_class`` and ``confidence``."""
    out = model.transform(docs)
    p = vector_to_array(F.col("probability"))
    keep = [c for c in docs.columns]
    return (out.select(*keep, p.alias("p"))
               .withColumn("pred", P.argmax(F.col("p")))
               .withColumn("predicted_class", P.label_decode(F.col("pred")))
               .withColumn("confidence", F.element_at(F.col("p"), F.col("pred") + 1)))


def save_model(model: PipelineModel, path: str) -> None:
    """Published whole: the model that ``path`` named before serves until then."""
    publish(SparkSession.active(), path, lambda folder: model.write().save(folder))


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(published(SparkSession.active(), path))


def train_summary(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The training-run record of the fitted classifier (one row), with the
    objective after every iteration (the first entry is from before them)."""
    lr = model.stages[-1]
    s = lr.summary
    hist = [float(x) for x in s.objectiveHistory]
    row = (int(s.totalIterations), hist[-1] if hist else None,
           float(s.accuracy), float(s.weightedFMeasure()), hist)
    return spark.createDataFrame(
        [row], "total_iterations int, final_objective double, train_accuracy double, "
               "train_f1_weighted double, objective_history array<double>")
