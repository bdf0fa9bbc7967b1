"""Jobs end to end: entry, sources/sinks, streaming = batch, ML round trip,
and the oracle check on a few keys at sf0.001."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ENTRY
from feedlens.operators import ml_pipeline as ML
from feedlens.plans import jobs as J
from feedlens.plans import oracle as ORACLE
from feedlens.plans import queries as Q
from feedlens.operators.naive_bayes import NBModel, nb_fit
from feedlens.sources.files import read_batch_csv, read_feedback_csv, read_text_lines
from oracle_compare import compare, duck


def test_entry_runs(spark):
    df = ENTRY.entry(spark)
    assert df.columns == ["Text", "Sentiment", "Confidence", "Negative", "Neutral", "Positive"]
    assert df.count() > 0


def test_every_oracle_key_is_a_query():
    assert set(ENTRY.oracle_sql()) <= set(ENTRY.queries())


@pytest.mark.parametrize("key", sorted(ORACLE.build()))
def test_oracle_small(spark, sf_small, key):
    info = compare(spark, key, sf_small, ENTRY.queries()[key], ENTRY.oracle_sql()[key],
                   duck(sf_small))
    assert info["ok"], info


@pytest.mark.parametrize("key", ["nb_fit", "score_batch"])
def test_weights_where_the_id_space_is_too_small(spark, key):
    """At sf0.1 there are more train tokens than ids; the classifier has them all."""
    sf = "/root/testdata/sf0.1"
    info = compare(spark, key, sf, ENTRY.queries()[key], ENTRY.oracle_sql()[key], duck(sf))
    assert info["ok"], info


def test_batch_csv_needs_text_column(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("body\nhello\n")
    with pytest.raises(ValueError):
        read_batch_csv(spark, str(p))


def test_text_lines_file(spark, tmp_path):
    p = tmp_path / "lines.txt"
    p.write_text("  first \n\n   \nsecond\n")
    assert [r.text for r in read_text_lines(spark, str(p)).orderBy('ord').collect()] == ["first", "second"]


def test_lr_pipeline_roundtrip(spark, sf_small, tmp_path):
    sp = Q.split_df(spark, sf_small)
    model = ML.lr_fit(sp.filter(F.col("split") == "train").select("text", "label"), max_iter=10)
    test = sp.filter(F.col("split") == "test").select("ord", "text")
    a = {r.ord: r.pred for r in ML.lr_score(model, test).collect()}
    ML.save_model(model, str(tmp_path / "m"))
    b = {r.ord: r.pred for r in ML.lr_score(ML.load_model(str(tmp_path / "m")), test).collect()}
    assert a == b and len(a) > 0
    assert ML.train_summary(spark, model).first().total_iterations > 0


def _csv_folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text('text,sentiment\n"good, ""really"" good",Positive\n"two\nlines",Neutral\n')
    (d / "b.csv").write_text(' sentiment , text ,extra\nNegative,bad thing,x\nPositive,good again,\n')
    return d


def test_csv_files_with_other_column_orders(spark, tmp_path):
    rows = read_feedback_csv(spark, str(_csv_folder(tmp_path))).orderBy("ord").collect()
    assert [(r.ord, r.text, r.sentiment) for r in rows] == [
        (0, 'good, "really" good', "Positive"), (1, "two\nlines", "Neutral"),
        (2, "bad thing", "Negative"), (3, "good again", "Positive")]


def test_malformed_csv_rows_are_counted(spark, tmp_path):
    d = _csv_folder(tmp_path)
    (d / "c.csv").write_text("text,sentiment\nfine,Neutral\na,b,c,d\n")
    with pytest.raises(ValueError, match="1 CSV rows"):
        read_feedback_csv(spark, str(d))
    df = read_feedback_csv(spark, str(d), malformed="drop")
    assert df.malformed == 1 and df.count() == 5


@pytest.mark.parametrize("n", [0, 4, 9])
def test_tiny_training_sets(spark, n):
    """No rows: an error and no model; a handful: a model even without validation rows."""
    rows = [(i, f"text number {i} {'good' if i % 3 else 'bad'}", ("Negative", "Neutral", "Positive")[i % 3], i % 3) for i in range(n)]
    clean = spark.createDataFrame(rows, "ord long, text string, sentiment string, label int")
    split = J.split_job(clean)
    if not n:
        with pytest.raises(ValueError):
            J.train_eval(split)
        return
    res = J.train_eval(split)
    assert res.model.weights.count() > 1
    m = res.metrics.first()
    assert 0 <= m.accuracy <= 1 and 0 <= m.f1_macro <= 1


def test_training_and_analysis_from_files(spark, tmp_path):
    d = tmp_path / "data"
    d.mkdir()
    lines = [f'"sample {i} {w}",{c}' for i in range(40) for w, c in (("awful", "Negative"), ("plain", "Neutral"), ("lovely", "Positive"))]
    (d / "all.csv").write_text("text,sentiment\n" + "\n".join(lines) + "\n")
    for flavour in ("nb", "ml"):
        rep = J.run_training(spark, str(d), str(tmp_path / flavour), flavour=flavour, epochs=5, datasets=flavour == "nb")
        assert rep.counts == {"loaded": 120, "unique": 120, "train": 96, "validation": 12, "test": 12}
        assert 0 <= rep.metrics["accuracy"] <= 1
    assert spark.read.parquet(str(tmp_path / "nb" / "datasets")).count() == 120
    assert spark.read.parquet(str(tmp_path / "nb" / "matrix")).agg(F.sum("n")).first()[0] == 12
    model = str(tmp_path / "nb" / "model")
    (tmp_path / "batch.csv").write_text("text\nlovely\nawful\n")
    out = J.analyse(spark, model, str(tmp_path / "out"), csv=str(tmp_path / "batch.csv"), typed="plain")   # the file goes first
    assert (out.n_analysed, out.n_failed) == (2, 0) and sum(out.summary.values()) == 2
    assert out.summary["Positive"] == 1 and out.summary["Negative"] == 1
    assert spark.read.parquet(out.paths["typed"]).count() == 2
    typed = J.analyse(spark, model, str(tmp_path / "out2"), typed="plain\n\n lovely ")
    assert typed.n_analysed == 2 and typed.share["Neutral"] == 0.5
    with pytest.warns(UserWarning):
        assert J.analyse(spark, model, str(tmp_path / "none"), typed=" \n ") is None
    assert not (tmp_path / "none").exists()


def test_candidates_of_the_ml_flavour_tokenise_once(spark):
    """Both fits read the written counts, and are what a pipeline's own fit gives."""
    import numpy as np
    from feedlens.operators import ml_pipeline as ML
    rows = [(f"sample {i} {w}", c) for i in range(20) for c, w in enumerate(("awful", "plain", "lovely"))]
    docs = spark.createDataFrame(rows, "text string, label int")
    reads = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda t: (reads.add(1), t)[1], "string").asNondeterministic()
    models = ML.lr_fits(docs.select(counted("text").alias("text"), "label"), [0.01, 0.0], max_iter=5, num_features=1 << 10)
    assert reads.value == len(rows)
    for m, r in zip(models, (0.01, 0.0), strict=True):
        own = ML.lr_pipeline(5, r, 1 << 10).fit(docs)
        assert [type(s) for s in m.stages] == [type(s) for s in own.stages]
        assert np.allclose(m.stages[-1].coefficientMatrix.toArray(), own.stages[-1].coefficientMatrix.toArray(), atol=1e-6)
        assert ML.train_summary(spark, m).first()[0] == own.stages[-1].summary.totalIterations


def test_streams_over_several_batches_and_replays(spark, sf_small, tmp_path):
    from feedlens.operators.scoring import drop_failed, score_keys, sentiment_summary
    from feedlens.streaming import scoring as ST
    w = nb_fit(spark.createDataFrame([("good fine", 2), ("bad poor", 0), ("so so", 1)], "text string, label int")).weights
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["good", "bad", None, "so", "good fine", "poor", ""])], "doc_id long, text string")
    src = str(tmp_path / "src")
    docs.repartition(3).write.parquet(src)
    stream = lambda: ST.text_stream(spark, src, "*.parquet", docs.schema, 1)
    sink, ckpt = str(tmp_path / "sum"), str(tmp_path / "c1")
    ST.run_to_end(ST.stream_summary(stream(), w, sink, ckpt))
    want = sorted(map(tuple, sentiment_summary(drop_failed(score_keys(w, docs)), "predicted_class").collect()))
    assert sorted(map(tuple, ST.read_summary(spark, sink).collect())) == want and len(want) == 3
    ST.run_to_end(ST.stream_summary(stream(), w, sink, str(tmp_path / "c2")))      # replayed from the start
    assert sorted(map(tuple, ST.read_summary(spark, sink).collect())) == want
    scores = str(tmp_path / "scores")
    ST.run_to_end(ST.stream_score(stream(), w, scores, str(tmp_path / "c3")))
    assert spark.read.parquet(scores).count() == 6


def test_streams_of_a_table_that_is_a_folder(spark, tmp_path):
    """A literal name or a pattern, beside files and folders of other tables."""
    from feedlens.streaming import scoring as ST
    w = nb_fit(spark.createDataFrame([("good fine", 2), ("bad poor", 0), ("so so", 1)], "text string, label int")).weights
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["good", "bad", None, "so", "good fine"])], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "talks.parquet"))
    docs.write.parquet(str(tmp_path / "others.data"))
    for i, name in enumerate(("talks.parquet", "*.parquet")):
        stream = ST.text_stream(spark, str(tmp_path), name, docs.schema)
        ST.run_to_end(ST.stream_score(stream, w, f"{tmp_path}/scores{i}", f"{tmp_path}/c{i}"))
        assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/scores{i}").collect()) == [0, 1, 3, 4]
    ST.run_to_end(ST.stream_summary(stream, w, f"{tmp_path}/sum", f"{tmp_path}/cs"))
    assert sorted(r["n"] for r in ST.read_summary(spark, f"{tmp_path}/sum").collect()) == [1, 1, 2]


def test_summary_state_over_restarts(spark, tmp_path):
    """Files that come between runs; a replayed batch; the cost of a look."""
    import os
    import shutil

    from feedlens.operators.scoring import drop_failed, score_keys, sentiment_summary
    from feedlens.streaming import scoring as ST
    w = nb_fit(spark.createDataFrame([("good fine", 2), ("bad poor", 0), ("so so", 1)], "text string, label int")).weights
    src, sink, ckpt = str(tmp_path / "src"), str(tmp_path / "sum"), str(tmp_path / "c")
    os.makedirs(src)
    assert sorted(r["n"] for r in ST.read_summary(spark, sink).collect()) == [0, 0, 0]
    rows = []
    for run in range(3):
        rows += [(run * 10 + i, t) for i, t in enumerate(["good", "bad", None, "so", "good fine"][run:])]
        spark.createDataFrame(rows[-(5 - run):], "doc_id long, text string").coalesce(2).write.parquet(f"{src}/run{run}")
        for f in os.listdir(f"{src}/run{run}"):
            if f.endswith(".parquet"):
                os.rename(f"{src}/run{run}/{f}", f"{src}/{run}-{f}")
        shutil.rmtree(f"{src}/run{run}")
        if run == 2:      # the last batch was scored, but the query ended before it was marked as done
            last = max(os.listdir(f"{ckpt}/scores/commits"), key=lambda f: int(f) if f.isdigit() else -1)
            for f in (last, f".{last}.crc"):
                if os.path.exists(f"{ckpt}/scores/commits/{f}"):
                    os.remove(f"{ckpt}/scores/commits/{f}")
        ST.run_to_end(ST.stream_summary(ST.text_stream(spark, src, "*.parquet", "doc_id long, text string", 1), w, sink, ckpt))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        want = sorted(map(tuple, sentiment_summary(drop_failed(score_keys(w, docs)), "predicted_class").collect()))
        assert sorted(map(tuple, ST.read_summary(spark, sink).collect())) == want
    assert len([f for f in os.listdir(sink) if f.startswith("v-")]) <= 2      # a look reads one of these
    assert os.path.exists(f"{ckpt}/totals/state")


def test_no_shared_folder_on_a_cluster_raises(spark, monkeypatch):
    import feedlens.session as SE

    class Context:
        master = "spark://elsewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k, d: None)}))

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k: None)})
    with pytest.raises(RuntimeError):
        SE.shared_dir(Session())


def test_scratch_tables_go_with_the_job(spark):
    import os

    from feedlens.session import materialize, scratch_tables
    with scratch_tables(spark):
        path = materialize(spark.range(3), "gone").inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))
