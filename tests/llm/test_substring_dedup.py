import hashlib
import random
import re

import numpy as np
import pytest

from feedlens.llm import shards, substring_dedup


def brute(rows, length=35):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    seen = {}
    for _, w in docs:
        for p in range(len(w) - length + 1):
            seen[tuple(w[p:p + length])] = seen.get(tuple(w[p:p + length]), 0) + 1
    out = []
    for d, w in docs:
        gone = {q for p in range(len(w) - length + 1) if seen[tuple(w[p:p + length])] > 1 for q in range(p, p + length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(docs, **kw):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"])
                  for r in substring_dedup.remove_repeats(docs, **kw).collect())


def planted(n=60, words=120, vocab=400):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(vocab)]
    passages = [rng.choices(pool, k=rng.choice([20, 34, 35, 36, 60, 110])) for _ in range(6)]
    rows = []
    for d in range(n):
        w = rng.choices(pool, k=rng.randint(0, words))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            p = rng.choice(passages)
            w[at:at] = p[rng.randint(0, 5):len(p) - rng.randint(0, 5)]
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(n, "a " * 100), (n + 1, rows[0][1]), (None, rows[1][1]), rows[2], (n + 2, "É" + " é" * 40)]
    return rows


@pytest.mark.parametrize("length,start", [(35, None), (35, 9), (10, 3), (4, 4)])
def test_matches_brute_force(spark, length, start):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(docs, length=length, start=start) == brute(rows, length)


def test_many_shards_and_ranges(spark, monkeypatch):
    """Counts cross shards and key ranges."""
    monkeypatch.setattr(shards, "SHARD_BYTES", 2000)
    monkeypatch.setattr(shards, "RANGE_KEYS", 50)
    rows = planted()
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_spans_and_text(spark):
    p = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"own words {p} end"), (2, p)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, with_text=True).collect()}
    assert out[1]["kept"] == "own words end" and [tuple(s) for s in out[1]["spans"]] == [(2, 40)] and out[2]["kept"] == ""


def test_odd_rows(spark, odd, none):
    assert got(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert got(none) == []


def test_keys_and_counts_survive_packing():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        k = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert np.array_equal(shards.unpack_keys(shards.pack_keys(k)), k)
        c = rng.integers(0, 1 << 33, len(k))
        assert np.array_equal(shards.unpack_counts(shards.pack_counts(c)), c)
