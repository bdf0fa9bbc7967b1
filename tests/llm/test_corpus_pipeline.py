import corpus_pipeline
import __spark_entry__ as ENTRY
from feedlens.llm import queries
from feedlens.session import materialize
from test_decontam import brute as brute_contamination
from test_line_dedup import brute as brute_lines
from test_simhash import brute_components


def brute_line(rows):
    return {int(d): t for d, _, t in brute_lines(list(rows.items()))}


def brute_sim(rows):
    return {int(d): int(c) for d, _, c in brute_components(list(rows.items()))}


def brute_hit(text, bench):
    return brute_contamination([(0, text)], bench)[0][2] > 0


def test_registered():
    names = ENTRY.queries()
    assert "pipeline" in names and all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 14))
    assert set(queries.ORACLE) <= set(queries.REGISTRY)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    step = materialize(stages["language_id"](spark, docs, sf), "t1")
    assert step.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in step.collect()}
    letters = {d for d, t in rows.items() if any(map(str.isalpha, t or ""))}
    assert set(kept) <= letters and len(kept) >= 0.99 * len(letters) and all(kept[d] == rows[d] for d in kept)
    step = materialize(stages["line_dedup"](spark, step, sf), "t2")
    want = brute_line(kept)
    got = {r["doc_id"]: r["text"] for r in step.collect()}
    assert step.columns == docs.columns and got == want
    assert all(r["n_chars"] == len(r["text"]) for r in step.collect() if want[r["doc_id"]] != kept[r["doc_id"]])
    step = materialize(stages["simhash_dedup"](spark, step, sf), "t3")
    comp = brute_sim(want)
    assert step.columns == docs.columns and {r["doc_id"] for r in step.collect()} == {d for d, c in comp.items() if d == c}
    left = {r["doc_id"]: r["text"] for r in step.collect()}
    step = materialize(stages["decontamination"](spark, step, sf), "t4")
    clean = {d for d, t in left.items() if not brute_hit(t, bench)}
    assert step.columns == docs.columns and {r["doc_id"] for r in step.collect()} == clean
    last = stages["packing"](spark, step, sf).collect()
    assert {r["doc_id"] for r in last} == clean


def test_odd_rows_pass_through(spark, odd, none, sf):
    extra = odd.withColumnRenamed("h", "__kept").withColumn("source", odd.doc_id)
    for docs in (extra, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, docs, sf), name)
            assert out.columns == docs.columns
            docs = out
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()


def test_run_equals_its_stages(spark, sf):
    one = corpus_pipeline.run(spark, sf).drop("sequence_id", "offset")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
    assert sorted(one.collect()) == sorted(docs.drop("sequence_id", "offset").collect())
