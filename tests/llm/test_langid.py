import random

from pyspark.sql import functions as F

from feedlens.llm import langid
from feedlens.llm.common import fold
from feedlens.llm.queries import REGISTRY


def test_held_out_accuracy_and_little_rejection(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = REGISTRY["op9_langid"](spark, sf).join(docs, "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int")),
                F.min("score"), F.max("score")).first()
    assert r[0] > 0.98 and r[1] < 0.01 and 0 <= r[2] <= r[3] <= 1


def test_score_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    m = langid.train(docs, fold("doc_id", 4) != 2, per_lang=30)
    one = langid.predict(docs.coalesce(1), m, ["doc_id"]).collect()
    many = langid.predict(docs.repartition(7), m, ["doc_id"]).collect()
    assert sorted(one) == sorted(many)


def test_odd_rows(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    m = langid.train(docs, per_lang=30)
    for r in langid.predict(odd, m, ["doc_id", "text"]).collect():
        letter = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == (not letter) and (letter or (r["score"] == 0 and r["rejected"]))
    kept = langid.filter_languages(odd, m)
    assert kept.columns == odd.columns and kept.where("text is null or text = ''").count() == 0
    assert langid.predict(none, m, ["doc_id"]).count() == 0
    assert langid.train(none) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None, ["doc_id"]).collect()} == {"und"}


UNLEARNED = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza"]


def test_unlearned_languages_and_noise_are_rejected_and_short_texts_stay(spark):
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    m = langid.train(docs, fold("doc_id", 4) != 2)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(200)) for _ in range(20)]
    noise += [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(20)) for _ in range(20)]
    clean = [r["text"] for r in docs.where((fold("doc_id", 4) == 2) & F.col("text").rlike("[a-zA-Z]{3}")).orderBy("doc_id").collect()]
    short = [" ".join(t.split()[:k]) for t in clean for k in (3, 8)]
    mixed = [" ".join(a.split()[:30] + b.split()[:30]) for a, b in zip(clean, clean[1:], strict=False)]

    def share(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return langid.predict(df, m, ["doc_id"]).agg(F.avg(F.col("rejected").cast("int"))).first()[0]

    assert [share(x) for x in (UNLEARNED, noise)] == [1.0, 1.0]
    assert all(share(x) < 0.01 for x in (clean, short, mixed))


def test_every_language_is_learned(spark):
    """300 languages, of 3 words of their own each, in unequal numbers: no cap drops one."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzàéîöüñçßøåłžčšđğıəþðŋ"
    words = [["".join(rng.choices(letters, k=7)) for _ in range(3)] for _ in range(300)]
    rows = [(k * 1000 + i, f"l{k:03d}", " ".join(rng.choices(words[k], k=12))) for k in range(300) for i in range(14 + k % 5)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    m = langid.train(docs, F.col("doc_id") % 1000 > 1, total=3000, epochs=40)
    assert m.langs == [f"l{k:03d}" for k in range(300)]
    out = langid.predict(docs.where("doc_id % 1000 <= 1"), m, ["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
