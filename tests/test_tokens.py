"""Tokens, vocabulary, ids and padding."""

from pyspark.sql import functions as F

from feedlens.functions.text import tokens, truncate
from feedlens.operators.tokens import FIRST_TOKEN_ID, build_vocab, encode_padded


def test_tokenize_mixed_sample(spark):
    df = spark.createDataFrame([("User-friendly CAFÉ, 東京は Ñandú!",)], "t string")
    got = df.select(tokens(F.col("t")).alias("k")).first().k
    assert got == ["user", "-", "friendly", "cafe", ",", "東", "京", "は", "nandu", "!"]


def test_truncate_keeps_room_for_specials(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(500)),)], "t string")
    got = df.select(truncate(tokens(F.col("t"))).alias("k")).first().k
    assert len(got) == 126 and got[0] == "w0"


def test_vocab_cap_and_ids(spark):
    rows = [(["a", "a", "a", "b", "b", "c", "c", "d"],), (["a", "b", "z"],)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    v = {r.token: r.id for r in build_vocab(df, size=2).collect()}
    assert v == {"a": FIRST_TOKEN_ID, "b": FIRST_TOKEN_ID + 1}


def test_padding_per_batch(spark):
    vocab = spark.createDataFrame([("a", 104), ("b", 105)], "token string, id int")
    rows = [(0, "s", 0, ["a", "b", "x"]), (1, "s", 0, ["a"]), (2, "s", 1, [])]
    df = spark.createDataFrame(rows, "ord long, split string, batch_id long, tokens array<string>")
    got = {r.ord: r for r in encode_padded(df, vocab, broadcast=True).collect()}
    assert got[0].input_ids == [101, 104, 105, 100, 102]
    assert got[1].input_ids == [101, 104, 102, 0, 0]
    assert got[1].attention_mask == [1, 1, 1, 0, 0]
    assert got[2].input_ids == [101, 102] and got[2].width == 2
    assert got[0].n_unk == 1


def test_vocab_cut_matches_full_sort(spark):
    """The histogram cut and bounded top-k equal a plain full sort, for caps
    that fall inside a tie group and for caps larger than the histogram."""
    from feedlens.operators.tokens import token_counts, top_vocabulary
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = token_counts(docs.select(tokens(F.col("text")).alias("tokens")))
    pdf = counts.toPandas()
    ranked = (pdf[pdf.n >= 2].sort_values(["n", "token"], ascending=[False, True])
                             .reset_index(drop=True))
    for size in (1, 37, 500, 3000, len(ranked) + 10):
        got = top_vocabulary(counts, 2, size).toPandas().sort_values("id")
        want = ranked.head(size)
        assert list(got.token) == list(want.token), size
        assert list(got.id) == list(range(FIRST_TOKEN_ID, FIRST_TOKEN_ID + len(want)))


def test_composed_and_decomposed_words_are_one_token(spark):
    """NFC and NFD forms, a dotted capital I and CJK, in both flavours of the model."""
    from feedlens.operators import ml_pipeline as ML
    texts = ["caf\u00e9 \u00c5ngstr\u00f6m", "cafe\u0301 A\u030angstro\u0308m", "\u0130stanbul", "abc\u6771\u4eacdef"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.k for r in df.select(tokens(F.col("text")).alias("k")).collect()]
    assert got[0] == got[1] == ["cafe", "angstrom"] and got[2] == ["istanbul"]
    assert got[3] == ["abc", "\u6771", "\u4eac", "def"]
    fold, tok = ML.lr_pipeline().getStages()[:2]
    assert [r._tokens for r in tok.transform(fold.transform(df)).collect()] == got
