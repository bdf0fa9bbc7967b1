import random
import re

import numpy as np
import xxhash

from feedlens.llm import simhash


def brute_fp(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    if len(words) < shingle:
        grams = [" ".join(words)]
    else:
        grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, bits=3):
    fps = [(d, brute_fp(t)) for d, t in rows]
    comp = {d: d for d, _ in fps if d is not None}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if a is not None and b is not None and bin(x ^ y).count("1") <= bits:
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    return sorted((str(d), f, str(None if d is None else root(d))) for d, f in fps)


def got(docs, **kw):
    return sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in simhash.near_duplicates(docs, **kw).collect())


def test_documents_and_odd_rows(spark, sf, odd, none):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        assert got(docs) == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(none) == []


def test_blocks_of_a_hot_unit_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = set()
    for _ in range(400):
        x = base
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    reps = spark.createDataFrame(rows, "fp long, rep long")
    for block in (10, 50_000):
        comp = {r["node"]: r["component"] for r in simhash.components(simhash.star_edges(reps, 3, block)).collect()}
        parent = list(range(len(fps)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        assert [comp.get(i, i) for i in range(len(fps))] == [root(i) for i in range(len(fps))]


def test_long_chains_end_in_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    out = simhash.components(edges).collect()
    assert {r["node"] for r in out} == set(range(301)) and {r["component"] for r in out} == {0}


def test_trie_join_equals_pairs():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64) << np.uint64(30))
    forest = simhash.trie_join(np.zeros(len(keys), np.int64), keys, 0, 2)
    other = simhash.Forest(len(keys))
    i, j = np.triu_indices(len(keys), 1)
    ok = np.bitwise_count(keys[i] ^ keys[j]) <= 2
    other.add(i[ok], j[ok])
    assert np.array_equal(forest.root, other.root)


def test_keep_one(spark, odd):
    text = " ".join(f"word{i}" for i in range(200))
    docs = spark.createDataFrame([(5, text, 1), (3, text, 2), (9, "quite another text", 3), (3, text, 2), (None, text, 0)],
                                 "doc_id long, text string, fp int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["fp"]) for r in kept.collect()) == [("3", 2), ("9", 3), ("None", 0)]
