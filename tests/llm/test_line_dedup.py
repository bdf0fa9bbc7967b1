import hashlib
from collections import defaultdict

from feedlens.llm import line_dedup

LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def brute(rows, min_chars=20, min_docs=3):
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    held = defaultdict(set)
    key = lambda x: x.strip(line_dedup.STRIP).translate(LOWER)
    for d, ls in lines:
        for x in ls:
            if len(key(x)) >= min_chars:
                held[key(x)].add(d)
    gone = {k: max(v, key=lambda d: -1 if d is None else d) for k, v in held.items() if len(v) >= min_docs}
    return sorted((str(d), len(ls), "\n".join(x for x in ls if gone.get(key(x), d) == d)) for d, ls in lines)


def got(docs):
    out = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    return sorted((str(r["doc_id"]), len((r["text"] or "").split("\n")), r["__kept"]) for r in out.collect())


def test_matches_brute_force(spark):
    long_ = "This very line is held by many of the documents"
    rows = [(i, "\n".join([f"own line number {i} of this text", " " + long_.upper() if i % 2 else long_ + "\t",
                           "short", long_ if i % 5 == 0 else "", "Ünïcode lines are folded only in A-Z é" if i < 9 else "x"]))
            for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)


def test_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark, odd, none):
    assert got(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert got(none) == []


def test_bitmap_is_run_lengths_and_no_python_runs(spark):
    line = "a line that three documents do hold"
    docs = spark.createDataFrame([(i, f"k\n{line}\n{line}\nk\n{line}") for i in range(3)], "doc_id long, text string")
    maps = line_dedup.keep_bitmaps(docs)
    assert {r["doc"]: list(r["rle"]) for r in maps.collect()} == {0: [1, 2, 1, 1], 1: [1, 2, 1, 1]}
    plan = line_dedup.drop_lines(docs, maps)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_kept_digest(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    row = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs)).first()
    assert hashlib.sha256(row["__kept"].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
