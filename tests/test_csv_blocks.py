"""CSV files cut at any byte give the rows of Spark's own whole-file read."""

import random

import pytest

from feedlens.sources import csv_blocks as B
from feedlens.sources.files import parse_csv, read_feedback_csv

FIELDS = ["plain", "", '""', '"quoted"', '"two\nlines"', '"a ""q"" b"', '"x,\n\n,y"', 'in 5" pipe', "it's", '"ends"junk', '"\n"', '"long ' + "w " * 200 + '\nend"',
          "é 東京", '"""\n"""', " spaced ", '","', 'a"b"c', '"\r\n"']


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "211b", "spark.sql.files.openCostInBytes": "1b"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, seed, n=60, end="\n", header='text,sentiment,"c, d"'):
    rng = random.Random(seed)
    lines = [header] + [",".join(rng.choice(FIELDS) for _ in range(3)) for _ in range(n)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(end.join(lines) + end * (seed % 2))


def whole_file(spark, path, names=("text", "sentiment", "c, d")):
    schema = ", ".join(f"`{c}` string" for c in [*names, "_bad"])
    df = (spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
          .option("columnNameOfCorruptRecord", "_bad").csv(str(path)))
    return [tuple(r)[:-1] for r in df.collect() if r["_bad"] is None]


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_whole_file_read(spark, small_blocks, tmp_path, seed):
    p = tmp_path / "one.csv"
    write(p, seed)
    df = parse_csv(spark, str(p), ("text",), malformed="drop")
    got = [tuple(r)[1:] for r in df.orderBy("ord").collect()]
    assert got == whole_file(spark, p)
    assert [r[0] for r in df.select("ord").orderBy("ord").collect()] == list(range(len(got)))
    n = B.lines_of(spark, str(p)).select("block").distinct().count()
    assert n > 10                                        # parsed by many tasks


def test_line_ends_header_and_mark(spark, tmp_path):
    p = tmp_path / "crlf.csv"
    body = '﻿"te\r\nxt", sentiment \r\n\r\n"a\r\nb",Positive\r\n\r\nlast,"x"'
    p.write_bytes(body.encode())
    rows = parse_csv(spark, str(p), (), malformed="drop")
    assert rows.columns == ["ord", "te\r\nxt", "sentiment"]
    assert [tuple(r) for r in rows.orderBy("ord").collect()] == [(0, "a\r\nb", "Positive"), (1, "last", "x")]
    q = tmp_path / "lf"
    q.mkdir()
    write(q / "b.csv", 7, end="\r\n")
    write(q / "a.csv", 8, header="sentiment,text,other")
    got = parse_csv(spark, str(q), ("text",), malformed="drop").orderBy("ord")
    want = [(s, t, o, None) for s, t, o in whole_file(spark, q / "a.csv")]
    want += [(s, t, None, c) for t, s, c in whole_file(spark, q / "b.csv")]
    # inside quotes a line end stays as it is (pandas keeps it too; Spark's whole-file read makes it \\n)
    flat = lambda rows: [tuple(v and v.replace("\r\n", "\n") for v in r) for r in rows]
    assert flat((r["sentiment"], r["text"], r["other"], r["c, d"]) for r in got.collect()) == flat(want)


def test_states(spark):
    """The line function against a character automaton, from both states."""
    def slow(line, inside):
        state, i = ("in" if inside else "start"), 0
        while i < len(line):
            c = line[i]
            if state == "in":
                if c == '"':
                    if line[i + 1:i + 2] == '"':
                        i += 1
                    else:
                        state = "field"
            elif c == ",":
                state = "start"
            elif state == "start":
                state = "in" if c == '"' else "field"
            i += 1
        return state == "in"
    rng = random.Random(3)
    for _ in range(20_000):
        line = "".join(rng.choices('"",ab ', k=rng.randrange(12)))
        for inside in (False, True):
            assert B.after(line, inside) == slow(line, inside), (line, inside)


def test_starts_compose(spark):
    rng = random.Random(5)
    rows = [(f, b, rng.random() < 0.5, rng.random() < 0.5, None) for f in "xyz" for b in range(0, 4000, 10)]
    rows = [(f, b, o, i if rng.random() < 0.1 else not o, h) for f, b, o, i, h in rows]
    df = spark.createDataFrame(rows, "file string, block long, outside boolean, inside boolean, header string").repartition(7)
    got = {(r["file"], r["block"]): r["started"] for r in B.starts(df).collect()}
    state = {}
    for f, b, o, i, _ in rows:
        now = state.get(f, False)
        assert got[f, b] == now
        state[f] = i if now else o


def test_one_newline_a_row(spark, small_blocks, tmp_path):
    p = tmp_path / "flat.csv"
    p.write_text('text,sentiment\n"a",Positive\nb "q" b,Neutral\n' + "".join(f"t{i},Negative\n" for i in range(60)))
    rows = read_feedback_csv(spark, str(p), multi_line=False).orderBy("ord").collect()
    assert [r["text"] for r in rows[:2]] == ["a", 'b "q" b'] and [r["ord"] for r in rows] == list(range(62))


def test_long_lines_take_linear_time():
    import time
    t = time.time()
    for line in ('"' * 400_001, '"a",' * 100_000, 'a"' * 200_000, '"a""' * 100_000, '"' + "x," * 200_000):
        B.after(line, False), B.after(line, True)
    assert time.time() - t < 5


def test_header_longer_than_the_file_raises(spark, tmp_path):
    p = tmp_path / "open.csv"
    p.write_text('"text\nsentiment')
    with pytest.raises(ValueError):
        parse_csv(spark, str(p), ())
