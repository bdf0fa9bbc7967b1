"""End-to-end jobs: prepare, make datasets, train + evaluate, batch analysis,
score one text.  Each job is a function over DataFrames; options of the
original command line are arguments of ``run_training`` and ``analyse``, which
go from input files to written outputs in one call.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import fixed
from feedlens.operators import evaluation as E
from feedlens.operators.cleaning import prepare
from feedlens.operators.naive_bayes import NBModel, nb_fit_grid, weight_names, weight_sums
from feedlens.operators.ordering import best_by, seeded_split
from feedlens.operators.scoring import (class_share, drop_failed, result_table,
                                        score_docs, score_keys, sentiment_summary, with_scores)
from feedlens.operators.tokens import MAX_LEARNED, build_vocab, encode_padded, truncate_tokens
from feedlens.functions.text import display_text, tokens as tokens_expr
from feedlens.session import materialize, scratch_tables
from feedlens.sources.files import read_batch_csv, read_feedback_csv, read_text_lines
from feedlens.sources.sinks import write_metrics_json, write_results_csv, write_results_typed


# --------------------------------------------------------------------------
# J1 / J2
# --------------------------------------------------------------------------

def prepare_job(raw: DataFrame, null_text: str | None = fixed.NULL_TEXT) -> DataFrame:
    """Raw ``(ord, text, sentiment)`` -> ``(ord, text, sentiment, label)``."""
    return prepare(raw, null_text=null_text)


def split_job(clean: DataFrame, seed: int = fixed.SEED,
              train_ratio: float = fixed.TRAIN_RATIO, val_ratio: float = fixed.VAL_RATIO,
              batch_size: int = fixed.BATCH_SIZE) -> DataFrame:
    """O1-O3 on prepared feedback: ``rnk, n_rows, split, pos, batch_id`` added."""
    return seeded_split(clean, "text", seed, train_ratio, val_ratio, batch_size)


def make_datasets(split: DataFrame, max_length: int = fixed.MAX_LENGTH,
                  vocab: DataFrame | None = None) -> DataFrame:
    """``(split, ord, batch_id, input_ids, attention_mask, labels)``.

    The vocabulary is learned on the train split unless one is given."""
    toks = truncate_tokens(split.withColumn("tokens", tokens_expr(F.col("text"))),
                           "tokens", max_length)
    if vocab is None:
        vocab = build_vocab(split.filter(F.col("split") == "train")
                                 .select(tokens_expr(F.col("text")).alias("tokens")))
        bounded = True                      # top-k of at most MAX_LEARNED rows
    else:
        bounded = vocab.count() <= MAX_LEARNED
    enc = encode_padded(toks, vocab, "ord", "tokens", ("split", "batch_id"), keep=("label",),
                        broadcast=bounded)
    return enc.select("split", "ord", "batch_id", "input_ids", "attention_mask",
                      F.col("label").alias("labels"), "width", "n_real", "n_unk")


# --------------------------------------------------------------------------
# J3 — train + evaluate (naive Bayes flavour; the ML flavour is ml_pipeline)
# --------------------------------------------------------------------------

ALPHAS = (0.25, 0.5, 1.0, 2.0)
SPLITS = ("train", "validation", "test")


@dataclass
class TrainResult:
    model: NBModel
    best: DataFrame           # O4: the chosen candidate row
    candidates: DataFrame     # E9: metrics per candidate on validation
    test_preds: DataFrame     # (ord, label, pred, ...)
    confusion: DataFrame      # E7 counts on test, written
    metrics: DataFrame        # E1-E5 on test


def candidate_metrics(split: DataFrame, grid: DataFrame, alphas=ALPHAS) -> DataFrame:
    """Every smoothing candidate scored on the validation split in one
    pass.  A token row meets one weight row, which holds all candidates; only
    the per-document sums are unfolded, one row per candidate."""
    val = split.filter(F.col("split") == "validation").select("ord", "text", "label")
    cols = [c for i in range(len(alphas)) for c in weight_names(i)]
    sums = weight_sums(grid, val, ("ord", "label"), "text", cols, unique=True)   # the label travels in the key
    z = F.array(*[F.struct(F.lit(i).alias("cand"), F.array(*[F.col(c).cast("double") for c in weight_names(i)]).alias("z"))
                  for i in range(len(alphas))])
    zs = sums.select("label", F.explode(z).alias("e")).select("label", "e.cand", "e.z")
    m = E.eval_metrics(with_scores(zs), group=("cand",))
    alpha = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("cand") + 1)
    return m.withColumn("alpha", alpha)


def train_eval(split: DataFrame, alphas=ALPHAS, output: str | None = None) -> TrainResult:
    """Fit every smoothing candidate on train, choose by validation
    macro-F1 (O4, ties to the earlier candidate), evaluate on test, and
    optionally persist weights and test metrics.

    Without validation rows the first candidate is taken; without train rows
    there is no model and this raises.  ``split`` should be a written table
    (it is read three times); see ``materialize``."""
    train = split.filter(F.col("split") == "train")
    if train.isEmpty():
        raise ValueError("no training rows: nothing to fit")
    grid = nb_fit_grid(train, list(alphas))
    cands = materialize(candidate_metrics(split, grid, alphas), "candidates")  # one row a candidate
    best = best_by(cands, "f1_macro", "cand")
    row = best.select("cand").first()
    chosen = int(row["cand"]) if row and row["cand"] is not None else 0
    weights = grid.select("token", "frequent", *[F.col(c).alias(w) for c, w in zip(weight_names(chosen), weight_names(), strict=True)])
    model = NBModel(materialize(weights, "weights"))
    test = split.filter(F.col("split") == "test")
    preds = score_keys(model.weights, test, ("ord", "label"), "text", unique=True)
    confusion = E.confusion_counts(preds)
    metrics = E.metrics(confusion)
    if output:
        model.save(f"{output}/weights")
        write_metrics_json(metrics, f"{output}/test_metrics")
    return TrainResult(model, best, cands, preds, confusion, metrics)


@dataclass
class TrainingReport:
    """What ``run_training`` wrote, by value."""
    counts: dict              # rows loaded, labelled and not blank, unique, per split
    metrics: dict             # E1-E5 on test
    paths: dict               # model, metrics, report, matrix, training (E9/E10 record), datasets


def run_training(spark: SparkSession, data, output: str, flavour: str = "nb", alphas=ALPHAS,
                 epochs: int = fixed.EPOCHS, batch_size: int = fixed.BATCH_SIZE, weight_decay: float = fixed.WEIGHT_DECAY,
                 max_length: int = fixed.MAX_LENGTH, seed: int = fixed.SEED, datasets: bool = False,
                 multi_line: bool = True, malformed: str = "fail", lr: float = 8.0, steps: int = 1,
                 patience: int = fixed.EARLY_STOPPING_PATIENCE) -> TrainingReport:
    """J3 from CSV files to a published model in one call.

    ``flavour``, the model: ``nb`` (naive Bayes, candidate chosen among
    ``alphas``), ``ml`` (the Spark ML pipeline; ``epochs`` passes of its
    optimiser and ``weight_decay``; two candidates, with and without the
    decay, chosen the same way) or ``linear`` (gradient steps at learning rate
    ``lr``, ``steps`` an epoch, evaluated after every epoch; ``patience`` ends
    it and the best epoch is kept).  ``batch_size`` and ``max_length`` shape
    the tokenised examples that ``datasets`` writes.  The counts are observed
    while the rows pass; the test split is scored once."""
    if flavour not in ("nb", "ml", "linear"):
        raise ValueError("flavour must be 'nb', 'ml' or 'linear'")
    with scratch_tables(spark):
        loaded = Observation("loaded")
        raw = read_feedback_csv(spark, data, multi_line, malformed=malformed).select("ord", "text", "sentiment")
        clean = materialize(prepare_job(raw.observe(loaded, F.count(F.lit(1)).alias("n"))), "prepared")
        split_seen = Observation("split")
        split = materialize(split_job(clean, seed, batch_size=batch_size).observe(
            split_seen, F.count(F.lit(1)).alias("unique"), *[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in SPLITS]), "split")
        counts = {"loaded": loaded.get["n"], **split_seen.get}
        paths = {"model": f"{output}/model", "metrics": f"{output}/test_metrics", "report": f"{output}/report", "matrix": f"{output}/matrix",
                 "training": f"{output}/training_metrics"}
        if flavour == "nb":
            res = train_eval(split, alphas)
            res.model.save(paths["model"])
            cm, record = res.confusion, res.candidates
        elif flavour == "ml":
            preds, record = _train_ml(split, epochs, weight_decay, paths["model"])
            cm = E.confusion_counts(preds)
        else:
            from feedlens.operators import linear as L
            fitted = L.fit(split, epochs, lr, weight_decay, steps, patience)
            fitted.save(paths["model"])
            cm = E.confusion_counts(L.score_linear(split.filter(F.col("split") == "test"), fitted.weights, ("label",)))
            record = fitted.history.withColumn("best", F.col("epoch") == fitted.stop.select("best_step").scalar())
        m = E.metrics(cm)
        record.write.mode("overwrite").json(paths["training"])
        write_metrics_json(m, paths["metrics"])
        E.report(cm).write.mode("overwrite").parquet(paths["report"])
        E.matrix(cm).write.mode("overwrite").parquet(paths["matrix"])
        if datasets:
            paths["datasets"] = f"{output}/datasets"
            make_datasets(split, max_length).write.mode("overwrite").partitionBy("split").parquet(paths["datasets"])
        return TrainingReport(counts, m.first().asDict(), paths)


def _train_ml(split: DataFrame, epochs: int, weight_decay: float, path: str) -> tuple[DataFrame, DataFrame]:
    """The ML flavour of ``train_eval``: fits, chooses on validation, saves;
    predictions on test and the training-run record (E10)."""
    from feedlens.operators import ml_pipeline as ML
    part = {s: split.filter(F.col("split") == s).select("ord", "text", "label") for s in SPLITS}
    if part["train"].isEmpty():
        raise ValueError("no training rows: nothing to fit")
    models = ML.lr_fits(part["train"], [weight_decay, 0.0], max_iter=epochs)
    scores = [E.eval_metrics(ML.lr_score(m, part["validation"])).first()["f1_macro"] or 0.0 for m in models]
    best = models[max(range(len(models)), key=lambda i: (scores[i], -i))]
    ML.save_model(best, path)
    return ML.lr_score(best, part["test"]), ML.train_summary(split.sparkSession, best)


# --------------------------------------------------------------------------
# J4 / J5 — batch analysis and one text
# --------------------------------------------------------------------------

@dataclass
class BatchResult:
    scored: DataFrame         # written once; the others read it
    table: DataFrame
    summary: DataFrame
    share: DataFrame
    n_analysed: int
    n_failed: int


def run_batch(texts: DataFrame, weights: DataFrame, key: str = "ord",
              output: str | None = None) -> BatchResult | None:
    """J4 over a table of ``(key, text)`` with unique keys: score every text,
    drop failures, build the result table, the zero-filled summary and the
    share of present classes; with ``output`` write the table as CSV and in
    typed form.

    No input rows: a warning, no output, and None.  The scores are written
    once and everything reads them; how many were analysed and how many
    failed is observed on that pass."""
    rows = materialize(texts.select(key, "text", display_text(F.col("text")).alias("shown")), "batch-rows")
    if rows.isEmpty():
        warnings.warn("nothing to analyse: the input has no texts", stacklevel=2)
        return None
    seen = Observation("scored")
    failed = F.col("pred").isNull()
    scored = score_docs(weights, rows, key, "text", text_as=F.col("shown"), unique=True).observe(
        seen, F.count(F.when(~failed, 1)).alias("ok"), F.count(F.when(failed, 1)).alias("failed"))
    scored = materialize(drop_failed(scored), "batch-scores")
    table = result_table(scored, precut=True)
    if output:
        write_results_csv(result_table(scored, precut=True, keep=(key,)), f"{output}/csv", order=key)
        write_results_typed(scored, f"{output}/typed", (key,))
    return BatchResult(scored, table, sentiment_summary(scored, "predicted_class"),
                       class_share(scored, "predicted_class"), seen.get["ok"], seen.get["failed"])


@dataclass
class AnalysisReport:
    """What ``analyse`` wrote, by value."""
    n_analysed: int
    n_failed: int
    summary: dict[str, int]   # all three classes
    share: dict[str, float]   # classes present
    paths: dict[str, str]


def analyse(spark: SparkSession, model: str, output: str, csv=None, typed: str | None = None, lines=None,
            multi_line: bool = True, malformed: str = "fail") -> AnalysisReport | None:
    """J4 from inputs to written outputs.  A CSV file goes before text files
    (``lines``), and those before typed text (one text a line)."""
    with scratch_tables(spark):
        if csv is not None:
            texts = read_batch_csv(spark, csv, multi_line, malformed=malformed)
        elif lines is not None:
            texts = read_text_lines(spark, lines)
        else:
            rows = [(i, t.strip()) for i, t in enumerate((typed or "").split("\n")) if t.strip()]
            texts = spark.createDataFrame(rows, "ord long, text string")
        res = run_batch(texts, NBModel.load(spark, model).weights, "ord", output)
        if res is None:
            return None
        return AnalysisReport(res.n_analysed, res.n_failed,
                              {r["sentiment"]: r["n"] for r in res.summary.collect()},
                              {r["sentiment"]: r["share"] for r in res.share.collect()},
                              {"csv": f"{output}/csv", "typed": f"{output}/typed"})


def score_one(spark: SparkSession, text: str, weights: DataFrame) -> DataFrame:
    """A blank text is rejected; any other text is scored as given."""
    if not text.strip():
        raise ValueError("the text is blank: there is nothing to score")
    one = spark.createDataFrame([(0, text)], "ord long, text string")
    return score_docs(weights, one, "ord", "text", unique=True)
