"""Score records, display formatting, summaries, the one-text job, M7."""

import math
import re

import pytest
from pyspark.sql import functions as F

from feedlens.functions import probs as P
from feedlens.functions.text import display_text, format_pct
from feedlens.operators.naive_bayes import nb_fit
from feedlens.operators.scoring import (class_share, confidence_bands, result_table,
                                        score_docs, score_keys, score_records, sentiment_summary,
                                        with_scores)
from feedlens.operators.udf_scoring import score_udf
from feedlens.plans.jobs import score_one
from feedlens.sources.files import examples

README_EXAMPLES = [((0.0435, 0.1647, 0.7918), "Positive", "79.18%"),
                   ((0.7484, 0.1156, 0.1360), "Negative", "74.84%"),
                   ((0.0959, 0.5267, 0.3774), "Neutral", "52.67%")]


def test_probabilities_to_class_and_confidence(spark):
    rows = [([math.log(x) for x in p],) for p, _, _ in README_EXAMPLES]
    df = with_scores(spark.createDataFrame(rows, "z array<double>"))
    df = df.withColumn("text", F.lit("t"))
    got = [(r.Sentiment, r.Confidence) for r in result_table(df).collect()]
    assert got == [(c, pct) for _, c, pct in README_EXAMPLES]


def test_format_pct_matches_python(spark):
    xs = [0.7918, 0.10005, 0.00125, 0.12345, 0.999999, 1e-9, 0.333335]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.s for r in df.select(format_pct(F.col("x")).alias("s")).collect()]
    assert got == [f"{x:.2%}" for x in xs]


def test_display_text_cut(spark):
    df = spark.createDataFrame([("a" * 100,), ("é" * 101,)], "t string")
    got = [r.d for r in df.select(display_text(F.col("t")).alias("d")).collect()]
    assert got == ["a" * 100, "é" * 100 + "..."]


def test_softmax_stable_and_argmax_first(spark):
    df = spark.createDataFrame([([1000.0, 999.0, -5.0],), ([1.0, 1.0, 0.0],)], "z array<double>")
    r = with_scores(df).collect()
    assert sum(r[0].p) == pytest.approx(1.0) and r[0].pred == 0
    assert r[1].pred == 0 and r[1].p[0] == r[1].p[1]


def test_label_encode_case_sensitive(spark):
    df = spark.createDataFrame([("Positive",), ("positive",), (None,), ("Neutral",)], "s string")
    got = [r.l for r in df.select(P.label_encode(F.col("s")).alias("l")).collect()]
    assert got == [2, None, None, 1]


def _model(spark, sf):
    from feedlens.plans import queries as Q
    return nb_fit(Q.split_df(spark, sf).filter(F.col("split") == "train"))


def test_summary_zero_fill_and_share_present_only(spark):
    df = spark.createDataFrame([("Positive",), ("Positive",), ("Negative",)], "Sentiment string")
    summ = {r.sentiment: r.n for r in sentiment_summary(df).collect()}
    assert summ == {"Negative": 1, "Neutral": 0, "Positive": 2}
    share = {r.sentiment: r.share for r in class_share(df).collect()}
    assert share == pytest.approx({"Positive": 2 / 3, "Negative": 1 / 3})


def test_score_one_and_examples(spark, sf_small):
    w = _model(spark, sf_small).weights
    with pytest.raises(ValueError):
        score_one(spark, "   \n", w)
    r = score_one(spark, "  I love it  ", w).first()
    assert r.text == "  I love it  " and sum(r.p) == pytest.approx(1.0)
    ex = examples(spark).withColumn("doc_id", F.concat_ws(":", "category", "idx"))
    assert ex.count() == 9
    rec = score_records(score_docs(w, ex, "doc_id", "text", keep=("category",))).collect()
    assert all(set(x.record.class_probabilities) == {"Negative", "Neutral", "Positive"} for x in rec)


def test_arrow_scorer_equals_relational(spark, sf_small):
    from feedlens.plans.fixtures import batch_texts
    w = _model(spark, sf_small).weights
    docs = batch_texts(spark, sf_small)
    a = {r.doc_id: (r.pred, r.p) for r in score_docs(w, docs).collect()}
    b = {r.doc_id: (r.pred, r.p) for r in score_udf(docs, w).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0]
        assert a[k][1] == pytest.approx(b[k][1], abs=1e-12)


def test_confidence_bands(spark):
    df = spark.createDataFrame([(0.3,), (0.5,), (0.74,), (0.75,), (0.95,)], "confidence double")
    got = {r.band: (r.n, r.n_above_threshold) for r in confidence_bands(df).collect()}
    assert got == {"0-50": (1, 0), "50-75": (2, 0), "75-100": (2, 1)}


def _weights(spark, rows):
    w = spark.createDataFrame(rows, "token string, frequent boolean, w0 string, w1 string, w2 string")
    return w.select("token", "frequent", *[F.col(f"w{k}").cast("decimal(18,12)").alias(f"w{k}") for k in range(3)])


def test_frequent_and_rare_tokens_add_up(spark):
    """Both parts of the join, repeated tokens, unknown tokens, no tokens, null."""
    w = _weights(spark, [("", False, "-1", "-2", "-3"), ("often", True, "0.5", "0.25", "0.125"),
                         ("rare", False, "-1.5", "0.75", "0.000000000001"), ("big", False, "-999999.123456789012", "-1", "1")])
    docs = spark.createDataFrame([(1, "often rare often unknown rare rare"), (2, ""), (3, None), (4, "unknown"),
                                  (5, " ".join(["big"] * 40 + ["often"] * 3))], "doc_id long, text string")
    for got in (score_keys(w, docs), score_docs(w, docs), score_keys(w, docs, unique=True), score_udf(docs, w)):
        z = {r.doc_id: r.z for r in got.collect()}
        assert z[1] == pytest.approx([-1 + 1 - 4.5, -2 + 0.5 + 2.25, -3 + 0.25 + 3e-12], abs=1e-12)
        assert z[2] == z[4] == [-1, -2, -3] and z[3] is None
        assert z[5] == pytest.approx([-40000000 + 35.06154320 + 0.5 - 0.00002272, -41.25, 37.375], rel=1e-9)


def test_rows_that_share_a_key_are_not_merged(spark):
    w = _weights(spark, [("", False, "0", "0", "0"), ("a", True, "1", "2", "3"), ("b", False, "5", "4", "3")])
    docs = spark.createDataFrame([(1, "a"), (1, "b b"), (1, "b b"), (None, "a"), (1, None)], "doc_id long, text string")
    want = sorted([[1, 2, 3], [10, 8, 6], [10, 8, 6], [1, 2, 3], []])
    for got in (score_keys(w, docs), score_docs(w, docs), score_udf(docs, w)):
        assert sorted(r.z or [] for r in got.collect()) == want


def test_one_scan_and_no_text_in_exchanges(spark, sf_small):
    """With automatic broadcasts off: the input is read once (by the step that writes the
    token rows, or by the rest) and its texts stay out of every shuffle."""
    from feedlens.operators import naive_bayes as NB
    from feedlens.plans import fixtures as X
    w = _model(spark, sf_small).weights
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found, steps = NB.heavy_tokens, []
    NB.heavy_tokens = lambda part: (steps.append(part._jdf.queryExecution().executedPlan().toString()), found(part))[1]
    try:
        df = score_keys(w, X.batch_texts(spark, sf_small))
        plan = steps[0] + df._jdf.queryExecution().executedPlan().toString()
        df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        NB.heavy_tokens = found
    lines = plan.splitlines()
    assert sum("conversations.parquet" in x for x in lines) == 1
    for i, x in enumerate(lines):
        if "Exchange hashpartitioning" in x:
            below = next(y for y in lines[i + 1:] if "Aggregate" in y or "Project" in y or "Join" in y)
            assert not re.search(r"\btext#", below.split("Output", 1)[-1].split("functions", 1)[0]), below


def test_any_number_of_weights(spark):
    rows = [("", False, "0", "0", "0")] + [(f"t{i}", False, str(i % 7), "1", "0") for i in range(31_000)]
    docs = spark.createDataFrame([(1, "t5 t6 t30999")], "doc_id long, text string")
    z = score_udf(docs, _weights(spark, rows)).first().z
    assert z == [5 + 6 + 30999 % 7, 3, 0]


def test_vocabulary_is_not_capped(spark):
    """More train tokens than the id space holds, most of them once: all have weights."""
    rows = [(" ".join(f"w{i}x{j}" for j in range(400)), i % 3) for i in range(100)]
    train = spark.createDataFrame(rows, "text string, label int")
    m = nb_fit(train)
    assert m.weights.count() == 40_001
    assert m.weights.filter("frequent").count() <= 20_000


def test_tokens_of_every_scored_text_leave_the_shuffle(spark):
    """One token of every scored text is not in train, one is rare there: both are split
    off, the join by token keeps none of them, and the scores are the same."""
    from feedlens.operators import naive_bayes as NB
    train = spark.createDataFrame([(f"word{i} good", i % 3) for i in range(60)] + [("banner text", 1)], "text string, label int")
    w = nb_fit(train).weights.withColumn("frequent", F.col("token") == "good")
    docs = spark.createDataFrame([(i, f"unseen banner word{i % 60} other{i}") for i in range(3000)], "doc_id long, text string").repartition(9)
    seen = []
    found = NB.heavy_tokens

    def spy(part):
        rows, heavy = found(part)
        seen.append((rows, heavy))
        return rows, heavy

    NB.heavy_tokens = spy
    try:
        got = {r["doc_id"]: r["z"] for r in score_keys(w, docs).collect()}
    finally:
        NB.heavy_tokens = found
    rows, heavy = seen[0]
    assert {"unseen", "banner"} <= set(heavy) and len(heavy) <= NB.MAX_HEAVY and not any(t.startswith("\0") for t in heavy)
    assert rows.where(~F.col("_k").isin(heavy)).groupBy("_k").count().agg(F.max("count")).first()[0] <= 50
    small = NB.MAX_HEAVY
    NB.MAX_HEAVY = 1
    try:
        assert {r["doc_id"]: r["z"] for r in score_keys(w, docs).collect()} == got
    finally:
        NB.MAX_HEAVY = small


def test_result_parts_keep_the_input_order(spark, tmp_path):
    import csv
    import glob

    from feedlens.sources.sinks import write_results_csv
    df = spark.range(5000).select(F.col("id").alias("ord"), F.concat(F.lit('line "q"\n'), F.col("id")).alias("Text")).repartition(7)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        write_results_csv(df, str(tmp_path / "out"), order="ord")
    finally:
        spark.conf.set(key, "true")
    rows, parts = [], sorted(glob.glob(str(tmp_path / "out" / "part-*")))
    for p in parts:
        with open(p, newline="") as f:
            part = list(csv.reader(f, escapechar=None))
        assert part[0] == ["Text"]
        rows += part[1:]
    assert len(parts) > 1 and [r[0] for r in rows] == [f'line "q"\n{i}' for i in range(5000)]


def test_a_text_is_tokenised_and_hashed_once(spark):
    """What the scan writes is made before ``explode``, without a filter on the tokens and
    without a shuffle; the sums are exact to the last digit."""
    from decimal import Decimal

    from feedlens.operators import naive_bayes as NB
    w = _weights(spark, [("", False, "-1.000000000001", "0", "0"), ("a", True, "-9.123456789012", "0.000000000001", "3"), ("b", False, "-0.999999999999", "-12.5", "0")])
    docs = spark.createDataFrame([(1, "a b " * 1000 + "zz"), (2, ""), (3, None)], "doc_id long, text string")
    found, steps = NB.heavy_tokens, []
    NB.heavy_tokens = lambda part: (steps.append(part._jdf.queryExecution().executedPlan().toString()), found(part))[1]
    try:
        got = {r[0]: list(r)[4:] for r in NB.weight_sums(w, docs, ("doc_id",), "text", NB.weight_names()).collect()}
    finally:
        NB.heavy_tokens = found
    assert "Exchange hashpartitioning" not in steps[0]
    assert not any(x in line for line in steps[0].splitlines() if re.search(r"\b(Filter|Generate)\b", line) for x in ("regexp", "xxhash64"))
    assert got == {1: [Decimal("-10124.456789011001"), Decimal("-12499.999999999000"), Decimal(3000)],
                   2: [Decimal("-1.000000000001"), Decimal(0), Decimal(0)], 3: [None, None, None]}


def test_ascii_tokens_are_those_of_the_full_pattern(spark):
    from feedlens.functions import text as T
    chars = "".join(map(chr, range(128)))
    texts = [chars, "It's 4.5% <b>OK_then</b> a+b=c", "", None, "  café naïve", "abc中文x", "� !", *[f"A{c}{c}z9" for c in chars]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    full = F.regexp_extract_all(T.normalise(F.col("text")), F.lit(T.token_pattern()), F.lit(0))
    assert df.where(~T.tokens(F.col("text")).eqNullSafe(full)).count() == 0
