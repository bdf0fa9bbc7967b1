"""The fit with an evaluation history, published models, outside models."""

import collections
import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.functions import text as T
from feedlens.operators import external as X
from feedlens.operators import linear as L
from feedlens.operators.naive_bayes import NBModel, nb_fit
from feedlens.plans import jobs as J
from feedlens.plans import queries as Q
from feedlens.sources import models as M


@pytest.fixture(scope="module")
def split(spark):
    return Q.split_df(spark, "/root/testdata/sf0.01").cache()


def alone(rows, epochs, lr, decay, patience, steps=1):
    """The same fit in plain Python over ``(split, pos, label, tokens)``."""
    def vector(tokens):
        n = collections.Counter(int(hashlib.md5(t.encode()).hexdigest()[:4], 16) for t in tokens)
        norm = math.sqrt(sum(v * v for v in n.values()))
        return {**{b: v / norm for b, v in n.items()}, L.BIAS: 1.0}
    data = [(s, pos, y, vector(t)) for s, pos, y, t in rows]
    w = collections.defaultdict(lambda: [0.0] * 3)

    def probabilities(x):
        z = [sum(v * w[b][k] for b, v in x.items()) for k in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    history, best, kept, since = [], -1, None, 0
    for epoch in range(1, epochs + 1):
        loss = seen = 0
        for step in range(steps):
            part = [(y, x, probabilities(x)) for s, pos, y, x in data if s == "train" and (pos + step) % steps == 0]
            g = collections.defaultdict(lambda: [0.0] * 3)
            for y, x, p in part:
                loss, seen = loss - math.log(p[y]), seen + 1
                for b, v in x.items():
                    for k in range(3):
                        g[b][k] += v * (p[k] - (k == y))
            for b in list(w) + [b for b in g if b not in w]:
                for k in range(3):
                    w[b][k] = w[b][k] * (1 if b == L.BIAS else 1 - lr * decay) - lr * g[b][k] / len(part)
        pairs = []
        for s, _, y, x in data:
            if s == "validation":
                p = probabilities(x)
                pairs.append((y, p.index(max(p))))
        f1 = []
        for c in range(3):
            tp, true, pred = sum(a == b == c for a, b in pairs), sum(a == c for a, _ in pairs), sum(b == c for _, b in pairs)
            if true + pred:
                f1.append(2 * tp / (true + pred))
        f1 = sum(f1) / len(f1)
        history.append((epoch, loss / seen, f1))
        since = 0 if f1 > best else since + 1
        if f1 > best:
            best, kept = f1, {b: list(v) for b, v in w.items()}
        if since >= patience:
            break
    return history, kept


@pytest.mark.parametrize("steps", [1, 4])
def test_fit_equals_plain_python(spark, split, steps):
    rows = [tuple(r) for r in split.where("split <> 'test'").select("split", "pos", "label", T.tokens(F.col("text"))).collect()]
    want, weights = alone(rows, 5, 6.0, 0.002, 2, steps)
    m = L.fit(split, epochs=5, lr=6.0, weight_decay=0.002, patience=2, steps=steps)
    got = m.history.orderBy("epoch").collect()
    assert [(r["epoch"], pytest.approx(r["loss"]), pytest.approx(r["f1_macro"])) for r in got] == want
    stop = m.stop.first()
    assert stop["n_steps"] == len(want) and stop["best_step"] == max(want, key=lambda r: (r[2], -r[0]))[0]
    w = {r["bucket"]: (r["w0"], r["w1"], r["w2"]) for r in m.weights.collect()}
    assert set(w) <= set(weights) and len(w) <= L.BUCKETS + 1
    assert all(np.allclose(w.get(b, (0, 0, 0)), v, atol=1e-9) for b, v in weights.items())


def test_a_batch_is_worked_on_in_pieces(spark, split, monkeypatch):
    """A batch of many long texts does not become arrays as long as the batch."""
    def bounded(offsets, flat, made=L.vectors):
        assert len(flat) <= 1 << 16 or len(offsets) == 2
        return made(offsets, flat)

    def short(batch, made=L._unpacked):
        row, bucket, value = made(batch)
        assert len(row) <= 1 << 16 or batch.num_rows == 1
        return row, bucket, value

    monkeypatch.setattr(L, "vectors", bounded)
    monkeypatch.setattr(L, "_unpacked", short)
    word = "if(id % 2 = 0, '', concat_ws(' ', transform(sequence(1, if(id = 7, 70000, 3000)), i -> concat('t', i * (id + 1)))))"
    docs = spark.range(60).selectExpr("id", f"{word} as text").coalesce(1)
    got = {r["id"]: r for r in L.features(docs, ("id",)).collect()}
    assert len(got) == 60 and not got[0]["bucket"] and abs(sum(v * v for v in got[7]["value"]) - 1) < 1e-9
    rows = L.features(docs, ("id",)).selectExpr("int(id % 3) as label", "bucket", "value").coalesce(1)
    w = np.zeros((L.BUCKETS + 1, 3))
    loss = L.gradient(rows, w).where(F.col("bucket") == L.LOSS).first()
    assert loss["g1"] == 60 and loss["g0"] == pytest.approx(60 * np.log(3))
    assert L.score_features(rows, w, ("label",)).count() == 60


def test_patience_ends_the_fit_and_the_best_epoch_stays(split):
    m = L.fit(split, epochs=9, lr=20.0, weight_decay=0.0005)          # overshoots at once
    stop = m.stop.first()
    assert stop["stop_step"] == stop["n_steps"] == stop["best_step"] + 2 < 9
    again = L.fit(split, epochs=int(stop["best_step"]), lr=20.0, weight_decay=0.0005)
    assert np.allclose(L.to_array(m.weights), L.to_array(again.weights))


def test_odd_texts_and_no_train_rows(spark, split):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "é " * 5000), (4, "a"), (4, "a"), (5, "中文 ok")], "id int, text string")
    out = {r["id"]: r for r in L.score_linear(docs, L.fit(split, epochs=1).weights, ("id",)).collect()}
    assert set(out) == {1, 3, 4, 5} and all(abs(sum(r["p"]) - 1) < 1e-12 for r in out.values())
    with pytest.raises(ValueError):
        L.fit(split.where("split <> 'train'"))


def test_run_training_linear(spark, split, tmp_path):
    d = tmp_path / "data"
    split.select("text", "sentiment").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(str(d))
    rep = J.run_training(spark, str(d), str(tmp_path / "out"), flavour="linear", epochs=4, lr=6.0, weight_decay=0.002)
    history = spark.read.json(rep.paths["training"])
    assert history.count() == history.agg(F.max("epoch")).first()[0] and history.where("best").count() == 1
    w = L.LinearModel.load(spark, rep.paths["model"])
    assert w.count() <= L.BUCKETS + 1 and rep.metrics["n"] == rep.counts["test"]


# --- published models ---------------------------------------------------------

def test_a_failed_write_leaves_the_old_model(spark, split, tmp_path):
    path = str(tmp_path / "model")
    train = split.where("split = 'train'")
    nb_fit(train).save(path)
    before = NBModel.load(spark, path).weights.orderBy("token").collect()

    def half(folder):
        spark.range(10).write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        M.publish(spark, path, half)
    assert NBModel.load(spark, path).weights.orderBy("token").collect() == before
    assert len([f for f in os.listdir(path) if f.startswith("v-")]) == 1
    held = NBModel.load(spark, path).weights              # a reader that began before
    nb_fit(train, alpha=2.0).save(path)
    assert held.orderBy("token").collect() == before
    assert NBModel.load(spark, path).weights.orderBy("token").collect() != before
    for _ in range(3):
        nb_fit(train).save(path)
    assert len([f for f in os.listdir(path) if f.startswith("v-")]) == 2 and not [f for f in os.listdir(path) if f.endswith(".tmp")]


def test_unpublished_folder_still_loads(spark, split, tmp_path):
    nb_fit(split.where("split = 'train'")).weights.write.parquet(str(tmp_path / "old"))
    assert NBModel.load(spark, str(tmp_path / "old")).weights.count() > 0 and M.manifest(spark, str(tmp_path / "none")) is None


# --- outside models -----------------------------------------------------------

def test_equals_the_model_in_the_plan(spark, split, tmp_path):
    m = L.fit(split, epochs=2)
    name = X.ship_table(m.weights, str(tmp_path / "weights"))
    extra = spark.createDataFrame([(-1, "Ünï çödé 中文 £5, ́x"), (-2, ""), (-3, "İstanbul ß ŒUVRE")], "ord long, text string")
    docs = split.select("ord", "text").unionByName(extra)
    a = X.score_external(docs, X.hashed_model(name), "ord", max_texts=7)
    b = L.score_linear(docs, m.weights, ("ord",))
    got, want = ({r["ord"]: r for r in d.collect()} for d in (a, b))
    assert set(got) == set(want)
    assert all(np.allclose(got[k]["p"], want[k]["p"], atol=1e-12) and got[k]["pred"] == want[k]["pred"] for k in want)


def test_one_load_a_process_bounded_batches_and_failures(spark, tmp_path):
    class Counted:
        """Writes one line a load; fails on some texts."""

        def __init__(self, log):
            with open(log, "a") as f:
                f.write(f"{os.getpid()}\n")

        def __call__(self, texts):
            assert len(texts) <= 5 and sum(map(len, texts)) <= 120 or len(texts) == 1
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return np.array([[0.2, 0.3, 0.5] if "nan" not in t else [np.nan] * 3 for t in texts])

    log = str(tmp_path / "loads")
    rows = [(i, None if i % 50 == 0 else "bad" if i % 50 == 1 else "nan" if i % 50 == 2 else "x" * (i % 150)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, text string").withColumns({"p": F.lit("mine"), "pred": F.lit(9)}).repartition(40)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "17")
    try:
        out = X.score_external(docs.select("id", "text"), lambda: Counted(log), "id", max_texts=5, max_bytes=120)
        got = {r["id"]: r for r in out.collect()}
    finally:
        spark.conf.set(key, old)
    pids = open(log).read().split()
    assert len(pids) == len(set(pids)) <= spark.sparkContext.defaultParallelism + 2
    assert len(got) == 3000
    for i, t in rows:
        failed = t is None or t in ("bad", "nan")
        assert (got[i]["pred"], got[i]["predicted_class"], got[i]["confidence"]) == ((None, None, None) if failed else (2, "Positive", 0.5))


def test_no_text_is_shuffled(spark, split):
    plan = X.score_external(split, lambda: None, "ord")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_empty_table(spark):
    assert X.score_external(spark.createDataFrame([], "doc_id long, text string"), lambda: None).count() == 0
