import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import ann_imi
from feedlens.llm.queries import REGISTRY


def brute(ids, x, top, step):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % step == 0:
            s = (x * q).sum(axis=1)
            o = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:top]
            out[int(i)] = [(int(ids[k]), float(s[k])) for k in o]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({a for a, _ in got[q]} & {a for a, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_registered_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want, got = brute(ids, x, 20, 20), found(REGISTRY["op1_inverted_multi_index"](spark, sf))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.95
    exact = {int(i): v for i, v in zip(ids, x, strict=True)}
    for q, near in got.items():
        assert near == sorted(near, key=lambda n: (-n[1], n[0]))
        assert all(abs(s - exact[q] @ exact[v]) < 1e-12 for v, s in near)


def test_clustered_vectors_visit_few_cells():
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(40, 16)) * 5
    x = np.repeat(centre, 100, axis=0) + rng.normal(size=(4000, 16)) * 0.05
    c1, c2 = ann_imi.kmeans(x[:, :8], 16), ann_imi.kmeans(x[:, 8:], 16)
    i, j = ann_imi.nearest(x[:, :8], c1), ann_imi.nearest(x[:, 8:], c2)
    count = np.zeros((16, 16))
    np.add.at(count, (i, j), 1)
    m = {"half": 8, "c1": c1, "c2": c2, "count": count,
         "v1": np.bincount(i, ((x[:, :8] - c1[i]) ** 2).sum(1), 16) / np.maximum(count.sum(1), 1) / 8,
         "v2": np.bincount(j, ((x[:, 8:] - c2[j]) ** 2).sum(1), 16) / np.maximum(count.sum(0), 1) / 8}
    visited = np.mean([sum(count[p] for p in ann_imi.probes(q, m, 20, 0.98)) for q in x[::100]])
    assert visited < 0.35 * len(x)


def test_walk_goes_by_falling_sums():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=9), rng.normal(size=7)
    pairs = ann_imi.walk(a, b, np.ones((9, 7)), 1e9)
    sums = [a[i] + b[j] for i, j in pairs]
    assert len(set(pairs)) == 63 and all(x >= y - 1e-12 for x, y in zip(sums, sums[1:], strict=False))


def test_blocks_and_ties(spark):
    """Small blocks on both sides, and many equal vectors: nothing is lost, ties go to small ids."""
    rng = np.random.default_rng(2)
    base = rng.integers(-2, 3, size=(30, 6)).astype(float)
    base = base[np.abs(base).sum(1) > 0]
    x = base[rng.integers(0, len(base), 400)]
    df = spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in enumerate(x)], "vec_id long, embedding array<double>, score string")
    want = brute(np.arange(400), x, 5, 20)
    got = found(ann_imi.search(df, F.col("vec_id") % 20 == 0, top=5, target=1.0, cell_rows=20, block=16))
    assert got == {q: [(a, pytest.approx(s)) for a, s in w] for q, w in want.items()}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [-1.0, 0.0]), (20, [2.0, 0.0]), (20, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann_imi.search(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(20, 2.0), (20, 2.0), (1, 0.5), (9, -1.0)], 20: [(0, 2.0), (1, 1.0), (9, -2.0)]}
    empty = ann_imi.search(df.limit(0), F.col("vec_id") % 20 == 0)
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert found(ann_imi.search(one, F.col("vec_id") % 20 == 0)) == {0: [(1, 2.0)]}


def test_share_of_the_pairs_that_are_multiplied(spark):
    """The walk, not the size of the table, says what is multiplied."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    stats = {}
    ann_imi.search(rows, F.col("vec_id") % 20 == 0, stats=stats)
    assert stats["share"] < 0.75                          # vectors without structure
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(60, 16)) * 5, 100, axis=0) + rng.normal(size=(6000, 16)) * 0.05
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = found(ann_imi.search(df, F.col("vec_id") % 40 == 0, stats=stats))
    assert recall(got, brute(ids, x, 20, 40)) >= 0.9 and stats["share"] < 0.15
