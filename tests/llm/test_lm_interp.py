import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import lm_interp, shards
from feedlens.llm.common import fold


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def brute(rows, learn, weights):
    uni, bi, begins = Counter(), Counter(), 0
    for (_, t), on in zip(rows, learn, strict=True):
        if on:
            begins += 1
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    out = []
    for (d, t), on in zip(rows, learn, strict=True):
        w = tokens(t)
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, x in zip(["<s>", *w], w, strict=False):
            ctx = begins if a == "<s>" else uni[a]
            l2, l1, l0 = weights[min(ctx.bit_length(), lm_interp.BUCKETS - 1)]
            score += math.log10(l2 * bi[a, x] / max(ctx, 1) + l1 * uni[x] / n + l0 / (v + 1))
        out.append((str(d), not on, len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return sorted(out, key=str)


def run(docs, learn):
    counted, model = lm_interp.fit(docs, learn)
    out = [(str(r[0]), not r[1], *r[2:]) for r in lm_interp.score(counted, model).collect()]
    return sorted(out, key=str), model


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9)


def test_matches_brute_force(spark, sf, odd, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 100_000)
    monkeypatch.setattr(shards, "RANGE_KEYS", 4000)
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = docs.select("doc_id", "text", (fold("doc_id", 7) != 2).alias("on")).collect()
        got, model = run(docs, fold("doc_id", 7) != 2)
        same(got, brute([(r[0], r[1]) for r in rows], [r[2] for r in rows], model.weights))
        assert all(abs(sum(w) - 1) < 1e-9 and min(w) >= 0 for w in model.weights) and model.weights[0][0] == 0


def test_beats_the_unigram_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted, model = lm_interp.fit(docs, fold("doc_id", 7) != 2)
    r = lm_interp.score(counted, model).where(~F.col("learned")).agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def test_em_finds_the_mixture():
    """Tokens that only pairs explain pull the weight to pairs, and the other way."""
    w = lm_interp.em([(3, 1 + 40 * 8, 1, 90), (3, 0, 1 + 36 * 8, 10)])
    assert w[3][0] == pytest.approx(0.9, abs=0.02) and w[3][1] == pytest.approx(0.1, abs=0.02)
    assert w[4] == w[3] and w[0] == [0.0, 0.5, 0.5]


def test_probabilities_add_up_to_one():
    """Over all words and the one unknown word, whatever the context's count."""
    words = ["a", "b", "a", "c"]
    uni, bi = Counter(words), Counter([("a", "b"), ("a", "c")])
    l2, l1, l0 = 0.5, 0.3, 0.2
    p = [l2 * bi["a", w] / 2 + l1 * uni[w] / 4 + l0 / 4 for w in "abc"] + [l0 / 4]
    assert sum(p) == pytest.approx(1)


def test_no_learning_rows(spark, odd, none):
    got, model = run(odd, F.lit(False))
    assert all(r[3] == 0 and r[4] == 0 and r[5] == 0 and r[6] == 0 for r in got) and model.tokens == 0
    assert run(none, F.lit(True))[0] == []


def test_ratio_bins_hold_their_ratio():
    x = np.exp2(np.linspace(-30, 60, 500))
    back = lm_interp.bin_ratio(lm_interp.ratio_bin(x))
    assert np.abs(np.log2(back / x)).max() <= 0.5 / lm_interp.STEPS + 1e-9
