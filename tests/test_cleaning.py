"""Prepare job: golden CSVs for the quirks Q1-Q8 and the 85-row corpus shape."""

from pyspark.sql import functions as F

from feedlens.functions.text import whitespace_chars
from feedlens.operators.cleaning import dedupe_first, prepare
from feedlens.operators.scoring import class_share
from feedlens.sources.files import read_feedback_csv

NB = " "
DIRTY = (
    ' text ,sentiment\n'
    '"a ""q"" b",Positive\n'
    '"  lead",Positive\n'
    ',Positive\n'
    'NA,Negative\n'
    '"x",positive\n'
    '"x",Neutral\n'
    '"x",Positive\n'
    '"""""",Negative\n'
    '"multi\nline",Neutral\n'
    '\n'
    f'"{NB}nb{NB}",Negative\n'
    'last, Positive \n'
    'null,Neutral\n'
)


def _prepared(spark, path):
    raw = read_feedback_csv(spark, str(path))
    return prepare(raw.select("ord", "text", "sentiment"))


def test_dirty_csv_matches_pandas(spark, tmp_path):
    p = tmp_path / "dirty.csv"
    p.write_text(DIRTY, encoding="utf-8")
    got = sorted((r.text, r.label) for r in _prepared(spark, p).collect())
    want = sorted([("a q b", 2), ("lead", 2), ("nan", 2), ("x", 1), ("multi\nline", 1),
                   ("nb", 0), ("last", 2)])
    assert got == want


def test_csv_corpus_shape(spark, tmp_path):
    """Same schema as the original data file: 85 rows, 42 / 33 / 10."""
    lines = ["text,sentiment"]
    for i in range(85):
        s = "Positive" if i < 42 else ("Negative" if i < 75 else "Neutral")
        lines.append(f'"feedback number {i} is here",{s}')
    p = tmp_path / "corpus.csv"
    p.write_text("\n".join(lines) + "\n")
    df = _prepared(spark, p)
    assert df.count() == 85
    counts = {r.sentiment: r.n for r in class_share(df, "sentiment").collect()}
    assert counts == {"Positive": 42, "Negative": 33, "Neutral": 10}
    pct = {r.sentiment: r.pct for r in class_share(df, "sentiment").collect()}
    assert pct == {"Positive": "49.4%", "Negative": "38.8%", "Neutral": "11.8%"}


def test_numeric_looking_text_stays_text(spark, tmp_path):
    p = tmp_path / "num.csv"
    p.write_text("text,sentiment\n007,Positive\n1.50,Negative\n")
    assert sorted(r.text for r in _prepared(spark, p).collect()) == ["007", "1.50"]


def test_strip_set_is_python_whitespace(spark):
    ws = whitespace_chars()
    assert all(c.isspace() for c in ws) and "　" in ws and " " in ws
    df = spark.createDataFrame([(0, f"　 \t x y{NB} ", "Positive")],
                               "ord long, text string, sentiment string")
    assert prepare(df).first().text == "x y"


def test_dedupe_keeps_first_whatever_the_partitioning(spark):
    rows = [(i, f"t{i % 10}", i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "ord long, text string, label int")
    for n in (1, 7, 64):
        got = {r.text: (r.ord, r.label) for r in dedupe_first(df.repartition(n)).collect()}
        assert got == {f"t{k}": (k, k % 3) for k in range(10)}


def test_bad_label_never_hides_good_duplicate(spark):
    df = spark.createDataFrame([(0, "same", "Mixed"), (1, "same", "Neutral")],
                               "ord long, text string, sentiment string")
    r = prepare(df).collect()
    assert [(x.text, x.label, x.ord) for x in r] == [("same", 1, 1)]
