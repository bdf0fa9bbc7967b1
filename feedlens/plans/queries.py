"""Registered queries: one per operator of the inventory, each
``(spark, sf_dir) -> DataFrame`` over the whole driver tables.

Column names and types match the oracle SQL in ``oracle.py`` (doubles are
rounded on both sides: probabilities to 4 places, metrics to 6, weights
to 9).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import probs as P
from feedlens.functions import text as T
from feedlens.functions import fixed
from feedlens.operators import cleaning as C
from feedlens.operators import evaluation as E
from feedlens.operators import ordering as O
from feedlens.operators import scoring as S
from feedlens.operators import tokens as K
from feedlens.operators.naive_bayes import NBModel, nb_fit
from feedlens.plans import fixtures as X
from feedlens.plans import jobs as J
from feedlens.session import materialize, scratch_path
from feedlens.sources import files as FS
from feedlens.sources import sinks as SK
from feedlens.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def r4(c):
    return F.round(c, 4)


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------
# shared inputs
# --------------------------------------------------------------------------

def cleaned_raw(spark, sf):
    """fb_raw with cleaned text/sentiment and label, all rows."""
    return C.with_label(C.clean_columns(X.fb_raw(spark, sf)))


def split_df(spark, sf):
    """The seeded 80/10/10 split of the prepared feedback, written once to the
    shared folder: fit, validation and test all read it, so the dedupe and
    the rank run once per job, and a lost executor re-reads a table."""
    clean = materialize(X.fb_clean(spark, sf), "prepared")   # J1 output, read twice by the rank
    return materialize(J.split_job(clean), "split")


def nb_model(spark, sf) -> NBModel:
    """Naive Bayes fitted on the train split, alpha 1."""
    return nb_fit(split_df(spark, sf).filter(F.col("split") == "train"))


def scored_batch(spark, sf):
    """Conversations scored by the model (M5)."""
    return S.score_keys(nb_model(spark, sf).weights, X.batch_texts(spark, sf), "doc_id", "text")


def scored_texts(spark, sf):
    """The same with the texts."""
    return S.score_docs(nb_model(spark, sf).weights, X.batch_texts(spark, sf), "doc_id", "text")


def test_preds(spark, sf):
    sp = split_df(spark, sf)
    w = nb_fit(sp.filter(F.col("split") == "train")).weights
    return S.score_keys(w, sp.filter(F.col("split") == "test"), ("ord", "label"), "text", unique=True)


def metrics_cols(df):
    return df.select(F.col("n").cast("long").alias("n"),
                     *[r6(F.col(c)).alias(c) for c in SK.METRIC_KEYS])


def probs_cols(df, key="doc_id"):
    return df.select(key, F.col("pred"), r4(F.col("confidence")).alias("confidence"),
                     *[r4(F.element_at("p", k + 1)).alias(f"p{k}") for k in range(3)])


# --------------------------------------------------------------------------
# 2.1 sources and sinks
# --------------------------------------------------------------------------

def _raw_csv(spark, sf) -> str:
    """fb_raw written as CSV with padded header names, in document order."""
    path = scratch_path(spark, "fb-raw-csv")
    raw = X.fb_raw(spark, sf).select(F.col("ord").alias(" doc_id "), F.col("text").alias(" text "),
                                     F.col("sentiment").alias("sentiment "))
    SK.write_results_csv(raw.orderBy(" doc_id "), path)
    return path


@query("norm_columns")
def q_norm_columns(spark, sf):
    """P1 (+ S1 scan): padded header names come back stripped."""
    df = FS.read_feedback_csv(spark, _raw_csv(spark, sf))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "sentiment")


@query("src_feedback_csv")
def q_src_feedback_csv(spark, sf):
    """S1 -> J1: the CSV round trip prepares to the same rows as the table."""
    raw = FS.read_feedback_csv(spark, _raw_csv(spark, sf))
    raw = raw.select("ord", F.col("doc_id").cast("long").alias("doc_id"), "text", "sentiment")
    return C.prepare(raw, carry=("doc_id",)).drop("ord")


@query("src_batch_csv")
def q_src_batch_csv(spark, sf):
    """Conversations written as CSV and read back as a batch input."""
    path = scratch_path(spark, "batch-csv")
    SK.write_results_csv(X.batch_texts(spark, sf).orderBy("doc_id"), path)
    return FS.read_batch_csv(spark, path).select("text")


@query("src_text_lines")
def q_src_text_lines(spark, sf):
    """S3: every document split into stripped, non-blank lines."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return FS.split_lines(docs).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line")


@query("sink_results_csv")
def q_sink_results_csv(spark, sf):
    """The result table written as CSV in the order of the keys and read back,
    ``ord`` being the place in the file."""
    path = scratch_path(spark, "results-csv")
    SK.write_results_csv(S.result_table(S.drop_failed(scored_texts(spark, sf)), keep=("doc_id",)), path, order="doc_id")
    return FS.parse_csv(spark, path, ("Text",))


@query("sink_metrics_json")
def q_sink_metrics_json(spark, sf):
    """Test metrics written as JSON and read back."""
    path = scratch_path(spark, "metrics-json")
    SK.write_metrics_json(metrics_cols(E.eval_metrics(test_preds(spark, sf))), path)
    back = SK.read_metrics_json(spark, path)
    return back.select(F.col("n").cast("long").alias("n"),
                       *[F.col(c).cast("double").alias(c) for c in SK.METRIC_KEYS])


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """Weights saved as Parquet, loaded, and used to score the test split."""
    path = scratch_path(spark, "nb-model")
    sp = split_df(spark, sf)
    nb_fit(sp.filter(F.col("split") == "train")).save(path)
    w = NBModel.load(spark, path).weights
    return probs_cols(S.score_docs(w, sp.filter(F.col("split") == "test"), "ord", "text"), "ord")


# --------------------------------------------------------------------------
# 2.2 projections, filters, scalars
# --------------------------------------------------------------------------

@query("clean_text")
def q_clean_text(spark, sf):
    return C.clean_columns(X.fb_raw(spark, sf))


@query("label_encode")
def q_label_encode(spark, sf):
    return cleaned_raw(spark, sf).select("ord", "sentiment", "label")


@query("label_decode")
def q_label_decode(spark, sf):
    return scored_batch(spark, sf).select("doc_id", "pred",
                                          P.label_decode(F.col("pred")).alias("class_name"))


@query("drop_unlabelled")
def q_drop_unlabelled(spark, sf):
    return C.drop_unlabelled(cleaned_raw(spark, sf)).select("ord", "text", "label")


@query("nonblank")
def q_nonblank(spark, sf):
    return C.keep_nonblank(C.drop_unlabelled(cleaned_raw(spark, sf))).select("ord", "text", "label")


@query("prepare_feedback")
def q_prepare_feedback(spark, sf):
    return X.fb_clean(spark, sf)


@query("display_text")
def q_display_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.display_text(F.col("text")).alias("display"))


@query("format_pct")
def q_format_pct(spark, sf):
    s = S.drop_failed(scored_batch(spark, sf))
    return s.select("doc_id", T.format_pct(F.col("confidence")).alias("confidence_pct"),
                    *[T.format_pct(F.element_at("p", k + 1)).alias(n)
                      for k, n in enumerate(fixed.CLASS_NAMES)])


@query("confidence_bands")
def q_confidence_bands(spark, sf):
    return S.confidence_bands(scored_batch(spark, sf))


@query("prob_distribution")
def q_prob_distribution(spark, sf):
    d = S.prob_distribution(S.drop_failed(scored_batch(spark, sf)))
    return d.withColumn("pct", F.round("pct", 2))


@query("result_table")
def q_result_table(spark, sf):
    return S.result_table(S.drop_failed(scored_texts(spark, sf)))


# --------------------------------------------------------------------------
# 2.3 distinct and aggregations
# --------------------------------------------------------------------------

@query("dedupe_first")
def q_dedupe_first(spark, sf):
    rows = C.keep_nonblank(C.drop_unlabelled(cleaned_raw(spark, sf)))
    return C.dedupe_first(rows.select("ord", "text", "label"), "text", "ord")


@query("class_distribution")
def q_class_distribution(spark, sf):
    return S.class_distribution(X.fb_clean(spark, sf))


@query("sentiment_summary")
def q_sentiment_summary(spark, sf):
    return S.sentiment_summary(S.drop_failed(scored_batch(spark, sf)), "predicted_class")


@query("class_share")
def q_class_share(spark, sf):
    return S.class_share(X.fb_clean(spark, sf), "sentiment").withColumn("share", r6(F.col("share")))


@query("stage_counts")
def q_stage_counts(spark, sf):
    return C.stage_counts(cleaned_raw(spark, sf), split_df(spark, sf))


# --------------------------------------------------------------------------
# 2.4 ordering, split, batches, best, patience
# --------------------------------------------------------------------------

@query("seeded_shuffle")
def q_seeded_shuffle(spark, sf):
    clean = materialize(X.fb_clean(spark, sf), "prepared")   # the rank reads it twice
    return O.seeded_rank(clean).select("ord", "rnk")


@query("split_80_10_10")
def q_split(spark, sf):
    return split_df(spark, sf).select("ord", "label", "rnk", "split", "pos")


@query("mini_batches")
def q_mini_batches(spark, sf):
    return split_df(spark, sf).select("ord", "split", "batch_id", "pos")


def history(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("metric"))


@query("early_stop_point")
def q_early_stop_point(spark, sf):
    return O.early_stop_point(history(spark, sf))


@query("eval_by_candidate")
def q_eval_by_candidate(spark, sf):
    sp = split_df(spark, sf)
    from feedlens.operators.naive_bayes import nb_fit_grid
    grid = nb_fit_grid(sp.filter(F.col("split") == "train"), list(J.ALPHAS))
    m = J.candidate_metrics(sp, grid)
    return m.select(F.col("cand").cast("int").alias("cand"), "alpha",
                    F.col("n").cast("long").alias("n"),
                    *[r6(F.col(c)).alias(c) for c in SK.METRIC_KEYS])


@query("best_candidate")
def q_best_candidate(spark, sf):
    return O.best_by(q_eval_by_candidate(spark, sf), "f1_macro", "cand")


# --------------------------------------------------------------------------
# 2.5 text features
# --------------------------------------------------------------------------

SEP1 = "\u0001"


@query("tokenize")
def q_tokenize(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                    F.md5(F.array_join("t", SEP1)).alias("tokens_md5"))


@query("truncate_tokens")
def q_truncate_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.truncate(T.tokens(F.col("text"))).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_kept"),
                    F.md5(F.array_join("t", SEP1)).alias("kept_md5"))


def train_tokens(spark, sf):
    sp = split_df(spark, sf)
    return sp.filter(F.col("split") == "train").select(T.tokens(F.col("text")).alias("tokens"))


@query("build_vocab")
def q_build_vocab(spark, sf):
    v = K.build_vocab(train_tokens(spark, sf))
    return v.select("token", F.col("id").cast("int").alias("id"), F.col("n").cast("long").alias("n"))


def ids_str(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@query("encode_ids")
def q_encode_ids(spark, sf):
    """T4: the ids of every token of every text (no truncation)."""
    sp = split_df(spark, sf)
    vocab = K.build_vocab(train_tokens(spark, sf))
    d = K.encode_padded(sp.withColumn("tokens", T.tokens(F.col("text"))), vocab, broadcast=True)
    body = F.slice("input_ids", 2, F.col("n_real") - 2)
    return d.select("ord", "split", (F.col("n_real") - 2).cast("int").alias("n_ids"),
                    F.col("n_unk").cast("int").alias("n_unk"), ids_str(body).alias("ids"))


@query("pad_batches")
def q_pad_batches(spark, sf):
    d = J.make_datasets(split_df(spark, sf))
    return d.select("ord", "split", "batch_id", F.col("width").cast("int").alias("width"),
                    F.col("n_real").cast("int").alias("n_real"),
                    ids_str(F.col("input_ids")).alias("input_ids"),
                    ids_str(F.col("attention_mask")).alias("attention_mask"))


@query("make_datasets")
def q_make_datasets(spark, sf):
    d = J.make_datasets(split_df(spark, sf))
    return d.select("split", "ord", "batch_id", ids_str(F.col("input_ids")).alias("input_ids"),
                    ids_str(F.col("attention_mask")).alias("attention_mask"), "labels")


# --------------------------------------------------------------------------
# 2.6 model fit and scoring
# --------------------------------------------------------------------------

@query("nb_fit")
def q_nb_fit(spark, sf):
    w = nb_model(spark, sf).weights
    return w.select("token", *[F.round(F.col(f"w{k}").cast("double"), 9).alias(f"w{k}")
                               for k in range(3)])


@query("softmax")
def q_softmax(spark, sf):
    s = S.drop_failed(scored_batch(spark, sf))
    return s.select("doc_id", *[r4(F.element_at("p", k + 1)).alias(f"p{k}") for k in range(3)])


@query("argmax_class")
def q_argmax_class(spark, sf):
    s = S.drop_failed(scored_batch(spark, sf))
    return s.select("doc_id", "pred", *[F.round(F.element_at("z", k + 1), 6).alias(f"z{k}")
                                        for k in range(3)])


@query("score_batch")
def q_score_batch(spark, sf):
    return probs_cols(S.drop_failed(scored_batch(spark, sf)))


@query("score_record")
def q_score_record(spark, sf):
    r = S.score_records(S.drop_failed(scored_texts(spark, sf)))
    return r.select("doc_id", "record.text", "record.predicted_class",
                    r4(F.col("record.confidence")).alias("confidence"),
                    *[r4(F.col("record.class_probabilities")[n]).alias(n) for n in fixed.CLASS_NAMES])


@query("drop_failed")
def q_drop_failed(spark, sf):
    """M6: texts that cannot be scored (null; here from the raw feedback,
    with nulls kept as null) are dropped; the rest keep their class."""
    raw = X.fb_raw(spark, sf).select(F.col("ord").alias("doc_id"), "text")
    w = nb_model(spark, sf).weights
    return S.drop_failed(S.score_keys(w, raw, "doc_id", "text")).select("doc_id", "pred")


@query("score_examples")
def q_score_examples(spark, sf):
    ex = FS.examples(spark).withColumn("doc_id", F.concat_ws(":", "category", "idx"))
    s = S.score_docs(nb_model(spark, sf).weights, ex, "doc_id", "text", keep=("category", "idx"))
    return s.select("category", "idx", "predicted_class", r4(F.col("confidence")).alias("confidence"))


# --------------------------------------------------------------------------
# 2.7 evaluation
# --------------------------------------------------------------------------

@query("eval_metrics")
def q_eval_metrics(spark, sf):
    return metrics_cols(E.eval_metrics(test_preds(spark, sf)))


@query("classification_report")
def q_classification_report(spark, sf):
    r = E.classification_report(test_preds(spark, sf))
    return r.select("row", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long").alias("support"))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return E.confusion_matrix(test_preds(spark, sf))


@query("metrics_long")
def q_metrics_long(spark, sf):
    m = E.eval_metrics(test_preds(spark, sf))
    return E.metrics_long(m).withColumn("value", r6(F.col("value")))


@query("train_eval_nb")
def q_train_eval_nb(spark, sf):
    res = J.train_eval(split_df(spark, sf), output=scratch_path(spark, "train-nb"))
    return metrics_cols(res.metrics)


# --------------------------------------------------------------------------
# 2.9 jobs
# --------------------------------------------------------------------------

@query("batch_analysis")
def q_batch_analysis(spark, sf):
    """J4 (flagship): batch CSV in -> scores -> result table -> CSV out."""
    return SK.read_results_csv(spark, _analysis(spark, sf)[1] + "/csv")


def _analysis(spark, sf):
    src = scratch_path(spark, "batch-in")
    SK.write_results_csv(X.batch_texts(spark, sf).orderBy("doc_id"), src)
    out = scratch_path(spark, "batch-out")
    return J.run_batch(FS.read_batch_csv(spark, src), nb_model(spark, sf).weights, "ord", output=out), out


@query("batch_summary")
def q_batch_summary(spark, sf):
    """The zero-filled summary (A3) and the shares (A4) of the same run."""
    res, _ = _analysis(spark, sf)
    return (res.summary.join(res.share.select("sentiment", "pct"), "sentiment", "left")
               .select("sentiment", "n", F.coalesce("pct", F.lit("-")).alias("pct"),
                       F.lit(res.n_analysed).cast("long").alias("n_analysed"), F.lit(res.n_failed).cast("long").alias("n_failed")))


@query("typed_results")
def q_typed_results(spark, sf):
    """The typed sink (Q20): probabilities as numbers, read back."""
    _, out = _analysis(spark, sf)
    t = spark.read.parquet(out + "/typed")
    return t.select("predicted_class", *[r4(F.col(c)).alias(c) for c in ("confidence", *fixed.CLASS_NAMES)])


@query("score_one")
def q_score_one(spark, sf):
    """The first turn of the conversations, scored as one typed text."""
    first = table(spark, sf, "conversations").orderBy("conv_id", "turn").select("text").first()["text"]
    s = J.score_one(spark, first, nb_model(spark, sf).weights)
    return s.select("text", "predicted_class", r4(F.col("confidence")).alias("confidence"))


# --------------------------------------------------------------------------
# the same reports over predictions that hold every class and every cell
# --------------------------------------------------------------------------

def label_preds(spark, sf):
    """Labelled documents with a prediction that is off on every 5th and 7th row."""
    lab = table(spark, sf, "labels").where("quality is not null and toxic is not null")
    y = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    k = F.col("doc_id")
    p = F.when(k % 5 == 0, (F.col("label") + 1) % 3).when(k % 7 == 0, (F.col("label") + 2) % 3).otherwise(F.col("label"))
    d = lab.select(k, y.alias("label")).withColumn("pred", p.cast("int"))
    return d.withColumn("predicted_class", P.label_decode(F.col("pred")))


@query("eval_all_classes")
def q_eval_all(spark, sf):
    return metrics_cols(E.eval_metrics(label_preds(spark, sf)))


@query("report_all_classes")
def q_report_all(spark, sf):
    r = E.classification_report(label_preds(spark, sf))
    return r.select("row", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long").alias("support"))


@query("matrix_all_classes")
def q_matrix_all(spark, sf):
    return E.confusion_matrix(label_preds(spark, sf))


@query("summary_all_classes")
def q_summary_all(spark, sf):
    d = label_preds(spark, sf)
    return S.sentiment_summary(d, "predicted_class").join(
        S.class_share(d, "predicted_class").select("sentiment", "pct"), "sentiment")


# --------------------------------------------------------------------------
# Spark ML flavour, the Arrow scorer, streaming
# --------------------------------------------------------------------------

def _lr(spark, sf):
    from feedlens.operators import ml_pipeline as ML
    sp = split_df(spark, sf)
    model = ML.lr_fit(sp.filter(F.col("split") == "train").select("text", "label"))
    return ML, sp, model


@query("lr_fit")
def q_lr_fit(spark, sf):
    """Facts of the fitted ML pipeline on the test split that any right fit has."""
    ML, sp, model = _lr(spark, sf)
    s = ML.lr_score(model, sp.filter(F.col("split") == "test").select("ord", "text", "label"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    bad = (F.abs(total - 1) > 1e-9) | F.exists("p", lambda x: (x < 0) | (x > 1))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("bad_probabilities"),
                 F.count(F.when(~F.coalesce(F.col("pred").between(0, 2), F.lit(False)), 1)).alias("bad_classes"),
                 F.count(F.when(F.col("confidence") != F.array_max("p"), 1)).alias("bad_confidences"))


@query("lr_model_roundtrip")
def q_lr_model_roundtrip(spark, sf):
    """S7 for the ML flavour: save, load, score; rows that differ from the fitted model's."""
    ML, sp, model = _lr(spark, sf)
    path = scratch_path(spark, "lr-model")
    ML.save_model(model, path)
    test = sp.filter(F.col("split") == "test").select("ord", "text")
    a = ML.lr_score(model, test).select("ord", "pred", F.col("p").alias("pa"))
    b = ML.lr_score(ML.load_model(path), test).select("ord", F.col("pred").alias("pred_b"), F.col("p").alias("pb"))
    j = a.join(b, "ord", "full")
    same = F.coalesce((F.col("pred") == F.col("pred_b")) & (F.col("pa") == F.col("pb")), F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~same, 1)).alias("mismatches"))


@query("train_metrics")
def q_train_metrics(spark, sf):
    """The training-run record.  Accuracy and F1 must equal those of the confusion
    matrix of the model's predictions on train; the objective must have an entry for
    every iteration and never rise."""
    ML, sp, model = _lr(spark, sf)
    train = sp.filter(F.col("split") == "train").select("ord", "text", "label")
    r = ML.train_summary(spark, model)
    own = E.eval_metrics(ML.lr_score(model, train))      # one row, from the written confusion counts
    same = lambda a, b: F.abs(F.col(a) - own.select(b).scalar()) < 1e-9
    h = F.col("objective_history")
    falls = F.forall(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.get(h, i) <= F.get(h, i - 1) + 1e-9)
    return r.select(
        own.select("n").scalar().cast("long").alias("n_train"), F.col("total_iterations").between(1, 20).alias("iterations_ok"),
        ((F.col("final_objective") >= 0) & (F.size(h) == F.col("total_iterations") + 1) & falls).alias("objective_ok"),
        same("train_accuracy", "accuracy").alias("accuracy_ok"), same("train_f1_weighted", "f1_weighted").alias("f1_ok"))


@query("train_job")
def q_train_job(spark, sf):
    """J3, ML flavour, from CSV to a saved model: its counts, and how many of the
    library's metrics differ from Spark ML's own evaluator on the same rows."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from feedlens.operators import ml_pipeline as ML
    rep = J.run_training(spark, _raw_csv(spark, sf), scratch_path(spark, "train-ml"), flavour="ml", epochs=10)
    test = split_df(spark, sf).filter(F.col("split") == "test").select("text", F.col("label").cast("double").alias("label"))
    s = materialize(ML.lr_score(ML.load_model(rep.paths["model"]), test).withColumn("pred", F.col("pred").cast("double")), "ml-test")
    own = {k: MulticlassClassificationEvaluator(labelCol="label", predictionCol="pred", metricName=m).evaluate(s)
           for k, m in (("accuracy", "accuracy"), ("f1_weighted", "f1"))}
    differ = sum(abs(own[k] - rep.metrics[k]) > 1e-9 for k in own)
    row = [(rep.counts["loaded"], rep.counts["unique"], rep.counts["train"], rep.counts["validation"], rep.counts["test"], differ)]
    return spark.createDataFrame(row, "loaded long, unique_rows long, train long, validation long, test long, metrics_that_differ long")


@query("score_udf")
def q_score_udf(spark, sf):
    """M7: the Arrow-batched scorer gives the same scores as score_batch."""
    from feedlens.operators.udf_scoring import score_udf
    w = nb_model(spark, sf).weights
    return probs_cols(S.drop_failed(score_udf(X.batch_texts(spark, sf), w, "doc_id", "text")))


#: options of the fit with an evaluation history
LINEAR = dict(epochs=6, lr=8.0, weight_decay=0.001, patience=2)


def linear_model(spark, sf):
    """The hashed softmax regression, fitted by gradient steps on the train split."""
    from feedlens.operators import linear as L
    return L.fit(split_df(spark, sf), **LINEAR)


@query("train_history")
def q_train_history(spark, sf):
    """E9 during the fit: validation metrics of every epoch until the patience rule ends it."""
    m = linear_model(spark, sf)
    best = m.stop.select("best_step").scalar()
    return m.history.select("epoch", r6(F.col("loss")).alias("loss"), "n", *[r6(F.col(c)).alias(c) for c in SK.METRIC_KEYS],
                            (F.col("epoch") == best).alias("best"))


@query("fit_stop_point")
def q_fit_stop_point(spark, sf):
    """O5 on the history of a real fit."""
    return linear_model(spark, sf).stop.withColumn("best_metric", r6(F.col("best_metric")))


@query("linear_fit")
def q_linear_fit(spark, sf):
    """M1: the weights of the best epoch."""
    return linear_model(spark, sf).weights.select("bucket", *[r6(F.col(c)).alias(c) for c in ("w0", "w1", "w2")])


@query("score_external")
def q_score_external(spark, sf):
    """M7: the fitted model as an outside object, loaded from its file by each worker
    process, on the texts themselves."""
    from feedlens.operators import external as X7
    name = X7.ship_table(linear_model(spark, sf).weights, scratch_path(spark, "external-model"))
    return probs_cols(S.drop_failed(X7.score_external(X.batch_texts(spark, sf), X7.hashed_model(name), "doc_id", "text")))


def _conversation_stream_args(spark, sf):
    schema = table(spark, sf, "conversations").schema
    return sf.rstrip("/"), "conversations.parquet", schema


@query("stream_score")
def q_stream_score(spark, sf):
    """ST1: conversations arriving as a file stream, scored per micro-batch."""
    from feedlens.streaming import scoring as ST
    d, glob, schema = _conversation_stream_args(spark, sf)
    src = ST.text_stream(spark, d, glob, schema)
    src = X.keyed_turns(src)
    sink = scratch_path(spark, "stream-scores")
    q = ST.stream_score(src, nb_model(spark, sf).weights, sink,
                        scratch_path(spark, "stream-scores-ckpt"))
    ST.run_to_end(q)
    out = spark.read.parquet(sink).withColumnRenamed("p", "p_")
    return out.select("doc_id", "pred", r4(F.col("confidence")).alias("confidence"),
                      *[r4(F.element_at("p_", k + 1)).alias(f"p{k}") for k in range(3)])


@query("stream_summary")
def q_stream_summary(spark, sf):
    """ST2: running count per predicted class over the stream, all classes."""
    from feedlens.streaming import scoring as ST
    d, glob, schema = _conversation_stream_args(spark, sf)
    src = ST.text_stream(spark, d, glob, schema)
    src = X.keyed_turns(src)
    sink = scratch_path(spark, "stream-summary")
    q = ST.stream_summary(src, nb_model(spark, sf).weights, sink,
                          scratch_path(spark, "stream-summary-ckpt"))
    ST.run_to_end(q)
    return ST.read_summary(spark, sink)
