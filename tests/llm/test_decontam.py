import random
import re

import numpy as np

from feedlens.llm import decontam


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        if i is not None and k:
            for p in range(len(w) - k + 1):
                wins.setdefault(tuple(w[p:p + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if tuple(w[p:p + k]) in wins:
                    hit |= set(range(p, p + k))
                    ids |= wins[tuple(w[p:p + k])]
        out.append((str(d), len(w), len(hit), sorted(ids)))
    return sorted(out)


def got(docs, bench, **kw):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], sorted(m["item_id"] for m in r["matches"]))
                  for r in decontam.contamination(docs, bench, **kw).collect())


def planted(spark, n=60):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 4, 12, 30])))) for i in range(8)]
    items += [(None, "w1 w2 w3"), (99, ""), (100, None), (3, " ".join(rng.choices(vocab, k=15)))]
    docs = []
    for d in range(n):
        w = rng.choices(vocab, k=rng.randint(0, 80))
        if d % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = (items[d % 8][1] or "").upper().split()
        docs.append((d, ", ".join(w)))
    docs += [(None, docs[0][1]), docs[3], (7, None), (8, "!!!")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force(spark):
    docs, items, d, b = planted(spark)
    assert got(d, b) == brute(docs, items)
    assert got(d, b, window=5) == brute(docs, items, 5)


def test_blocks_of_the_benchmark_merge(spark):
    docs, items, d, b = planted(spark, 30)
    assert got(d, b, block_bytes=200) == brute(docs, items)
    left = decontam.decontaminate(d, b, block_bytes=200)
    clean = sorted((x, y) for x, y, n, _ in brute(docs, items) if n == 0)
    assert left.columns == d.columns and sorted((str(r["doc_id"]), len(words(r["text"]))) for r in left.collect()) == clean


def test_shards_of_a_long_text(spark, monkeypatch):
    docs, items, _, _ = planted(spark)
    it = decontam.tokenise([str(i) for i, t in items if i is not None], [(t or "").encode() for i, t in items if i is not None])
    texts = [(t or "").encode() for _, t in docs]
    whole = decontam.find(texts, it, 10)
    for size in (160, 40):           # the second is less than twice the longest item
        monkeypatch.setattr(decontam, "SHARD", size)
        parts = decontam.find(texts, it, 10)
        assert np.array_equal(whole[1], parts[1]) and {f[:1] + f[2:3] for f in whole[3]} == {f[:1] + f[2:3] for f in parts[3]}


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    sym = rng.integers(0, 3, 500)
    sa = decontam.suffix_array(sym, 40)
    text = [tuple(sym[i:i + 40]) for i in sa]
    assert sorted(sa) == list(range(500)) and all(a[:30] <= b[:30] for a, b in zip(text, text[1:], strict=False))


def test_empty_sides(spark, odd, none):
    b = spark.createDataFrame([(1, "no id here")], "item_id long, text string")
    e = b.limit(0)
    assert got(none, b) == []
    assert all(r[2] == 0 for r in got(odd, e))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd, b) == brute(rows, [(1, "no id here")])
    assert decontam.decontaminate(odd, b).columns == odd.columns


def test_a_repeated_word_costs_no_more_than_others():
    """1 MB of one word against items of that word."""
    import time
    it = decontam.tokenise(["a", "b"], [b"0 " * 5000, b"x " + b"0 " * 60 + b"y"])
    t = time.time()
    n, hit, _, found = decontam.find([b"0 " * 500_000, b"z " + b"0 " * 70 + b"y"], it, 10)
    assert time.time() - t < 20
    assert hit.sum() == 500_000 + 71
    assert {(d, i, k) for d, _, i, _, k in found} == {(0, 0, 5000), (0, 1, 60), (1, 0, 70), (1, 1, 61)}


def test_longest_matches(monkeypatch):
    """Against every pair of places, also where a match is longer than a shard."""
    rng = np.random.default_rng(4)
    for size in (1 << 20, 40):
        monkeypatch.setattr(decontam, "SHARD", size)
        for _ in range(30):
            items = [rng.integers(0, 3, rng.integers(3, 90)) for _ in range(3)]
            docs = [np.concatenate([rng.integers(0, 3, 20), items[rng.integers(3)], rng.integers(0, 3, 9)]) for _ in range(3)] + [rng.integers(0, 1, 60)]
            said = lambda x: " ".join(map(str, x)).encode()
            found = decontam.find([said(d) for d in docs], decontam.tokenise(["0", "1", "2"], [said(i) for i in items]), 5)[3]
            got = {}
            for d, at, i, item_at, n in found:
                got[d, i] = max(got.get((d, i), 0), n)
                assert np.array_equal(docs[d][at:at + n], items[i][item_at:item_at + n])
            for d, doc in enumerate(docs):
                for i, item in enumerate(items):
                    best, row = 0, np.zeros(len(item) + 1, int)
                    for w in doc:
                        row = np.concatenate([[0], np.where(item == w, row[:-1] + 1, 0)])
                        best = max(best, row.max())
                    assert got.get((d, i), 0) == (best if best >= min(5, len(item)) else 0)
