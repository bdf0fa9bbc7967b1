from pyspark.sql import functions as F

from feedlens.llm import toxicity
from feedlens.llm.common import fold
from feedlens.llm.queries import REGISTRY


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    out = REGISTRY["op8_toxicity"](spark, sf).join(labels, "doc_id").where("held_out")
    r = out.agg(F.sum(((F.col("toxic") == 1) & (F.col("predicted") == 1)).cast("int")).alias("tp"),
                F.sum("toxic").alias("p"), F.sum("predicted").alias("said"), F.min("score"), F.max("score")).first()
    # The table has toxic labels on junk without any toxic word; nothing can tell those.
    assert r["tp"] / r["p"] > 0.85 and r["tp"] / r["said"] > 0.9 and r[3] >= 0 and r[4] <= 1


def _planted(spark):
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, f"some plain words about thing {i % 17} " + ("you are a zorgle, a ZORGLE!" if bad else "and more of it")))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_words_it_was_not_told(spark, odd, none):
    docs, labels = _planted(spark)
    m = toxicity.train(docs, labels, fold("doc_id", 3) != 1)
    assert any("zorgle" in u for u in m.lexicon)
    got = {r["doc_id"]: r["score"] for r in m.score(docs, ["doc_id"]).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in got)
    scores = m.score(odd, ["doc_id", "h"]).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert m.score(none, ["doc_id"]).count() == 0


def test_labels_that_teach_nothing(spark, odd):
    labels = spark.createDataFrame([(1, None), (2, 5), (None, 1)], "doc_id long, toxic int")
    m = toxicity.train(odd, labels, F.lit(True))
    assert {r["score"] for r in m.score(odd, ["doc_id"]).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.train(odd, one, F.lit(True)).score(odd, ["doc_id"]).collect()} == {1.0}


def test_disguises_are_undone():
    assert toxicity.open_up(b"you 1d1ot, you s.c.u.m") == " you idiot you scum ".replace("idiot ", "idiot  ")
    assert toxicity.units("élan vital".encode()) >= {" vital ", " vita"}


def test_lexicon_does_not_depend_on_chunks(spark):
    """A word that toxic and clean texts hold alike is none of the lexicon, also at one text a chunk."""
    rows = [(i, i % 2, f"neutral {'zorgle' if i % 2 else 'garden'} x{i}") for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, y int, text string")
    apart = spark.createDataFrame(spark.sparkContext.parallelize(rows, 24), df.schema)     # one text a task
    got = [toxicity.learn_lexicon(d, 50) for d in (df.coalesce(1), apart)]
    assert got[0] == got[1] and " zorgle " in got[0] and not any("neut" in u for u in got[0])


def test_features_see_every_disguise():
    find = toxicity.automaton({f" {w} ": 4.0 for w in ("shit", "ass", "idiot", "stupid", "scum", "nazi")})
    at = [toxicity.NAMES.index(n) for n in ("hits", "disguised", "disguised_words")]

    def seen(text):
        f = toxicity.features(text, text.lower(), find, toxicity.ODD)
        return f[at[0]], f[at[1]], f[at[2]] > 0

    for w in ("$hit", "@ss", "a$$", "1diot", "5tupid", "i.d.i.o.t", "s-t-u-p-i-d", "st~upid", "sc'um", "s`c^um", "1d1ot", "s_c_u_m", "$HIT", "naz!"):
        for text in (w, f"you {w}, really", f"({w})", f"what a {w}!!", f"'{w}'."):
            assert seen(text.encode()) == (0, 1, True), text
    assert seen(b"an idiot! a 5tupid *scum* here.") == (2, 1, True)      # plain hits beside it do not count against it
    for text in ("plain words, no more!", "'quoted' -- *bold* _it_ 1990 $5 ... !!", "", "élan? oui!"):
        assert seen(text.encode()) == (0, 0, False), text


def test_columns_of_every_feature_name_are_carried(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels, F.lit(True), trees=3)
    mine = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in toxicity.NAMES})
    out = {r["doc_id"]: r for r in model.score(mine, ["doc_id", *toxicity.NAMES]).collect()}
    plain = {r["doc_id"]: r["score"] for r in model.score(docs, ["doc_id"]).collect()}
    assert {d: r["score"] for d, r in out.items()} == plain
    assert all(r[n] == f"{n} of {d}" for d, r in out.items() for n in toxicity.NAMES)
