"""Approximate nearest neighbours by an inverted multi-index, largest inner product.

Index.  Each vector is cut into two halves, and each half is quantised to one
of ``k`` centroids, so a vector lies in one of k*k cells (first centroid,
second centroid).  Centroids are fitted by k-means on a bounded sample
(``sample`` vectors, those with the smallest hash of their id); every vector
is indexed.  ``k`` follows the number of vectors: cells of two of them up to
``fine`` centroids, beyond that as many as leave ``cell_rows`` in a cell, for a
walk of more cells than that costs more than the products it saves.

Search.  A query sorts the centroids of either half by inner product and walks
the pairs by their sum, largest first, with a heap (the multi-sequence walk).
It stops when the cells seen are expected to hold ``target`` of the neighbours
wanted: inside a cell the inner products are taken as normal around the pair's
sum, with the spread that the cell's quantisation error gives them, and every
cell's count is known.  Clustered data stop early, data without structure walk
on; nothing depends on a fixed number of cells.

Rerank.  Queries meet the vectors of their cells by first centroid, in blocks
of bounded size on either side; inner products are taken on the original
vectors in double precision, and the best of all blocks are kept.

Defined cases.  Vectors that are null, empty, zero, of another dimension than
most, or hold null or non-finite components take no part, neither do rows with
a null id.  Rows that repeat an id are candidates each; as queries they are one
(the smallest vector).  Candidates with the query's own id are left out.  With
fewer candidates than wanted, all found are returned.  Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.session import materialize

BLOCK = 8192           # vectors, or queries, that one block holds


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part, in double precision."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
                .where("vec_id is not null and v is not null and size(v) > 0").where(ok)
                .where(F.exists("v", lambda x: x != 0)))
    dim = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size("v") == (dim["d"] if dim else 0))


def matrix(column) -> np.ndarray:
    """The rows of a list column as one array."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from ``k`` evenly spaced sample rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            s = np.bincount(near, x[:, d], k)
            c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for lo in range(0, len(x), 4096):
        part = x[lo:lo + 4096]
        out[lo:lo + 4096] = np.argmin((c * c).sum(1) - 2 * part @ c.T, axis=1)
    return out


def tail(z: np.ndarray) -> np.ndarray:
    """Share of a standard normal above z (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    p = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, p, 1 - p)


def walk(a: np.ndarray, b: np.ndarray, found: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Centroid pairs by falling sum of scores until ``enough`` is expected to be found."""
    oa, ob = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, out, got = [(-(a[oa[0]] + b[ob[0]]), 0, 0)], [], 0.0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        pair = int(oa[i]), int(ob[j])
        out.append(pair)
        got += found[pair]
        if j + 1 < len(ob):
            heapq.heappush(heap, (-(a[oa[i]] + b[ob[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(oa):
            heapq.heappush(heap, (-(a[oa[i + 1]] + b[ob[0]]), i + 1, 0))
    return out


def probes(q: np.ndarray, model: dict, top: int, target: float) -> list[tuple[int, int]]:
    """The cells one query visits."""
    h = model["half"]
    a, b = model["c1"] @ q[:h], model["c2"] @ q[h:]
    mean = a[:, None] + b[None, :]
    spread = np.sqrt((q[:h] @ q[:h]) * model["v1"][:, None] + (q[h:] @ q[h:]) * model["v2"][None, :] + 1e-18)
    n = model["count"]
    want = min(top, n.sum())
    lo, hi = float((mean - 9 * spread).min()), float((mean + 9 * spread).max())
    for _ in range(14):                       # the score that `want` vectors are expected to reach
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (n * tail((mid - mean) / spread)).sum() > want else (lo, mid)
    found = n * tail((lo - mean) / spread)
    return walk(a, b, found, target * found.sum())


def search(rows: DataFrame, queries, top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           target: float = 0.965, cell_rows: int = 256, fine: int = 32, sample: int = 20_000, block: int = BLOCK,
           stats: dict | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest found of every row that ``queries`` selects.

    ``queries``: a boolean column over ``vec_id``.  ``stats`` is given the ``share`` of
    all pairs of a query and a vector that the rerank multiplies."""
    spark = rows.sparkSession
    base = materialize(usable(rows, id_col, vec_col), "vectors")
    total = base.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    few = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    x = matrix(few.column("v"))
    k = math.ceil(max(min(fine, math.sqrt(total / 2)), math.sqrt(total / cell_rows)))
    k = int(min(max(1, k), 512, max(1, len(x) // 8)))
    half = x.shape[1] // 2
    model = {"half": half, "c1": kmeans(x[:, :half], k if half else 1), "c2": kmeans(x[:, half:], k)}
    k1 = len(model["c1"])
    shared = spark.sparkContext.broadcast(model)              # 2 k centroids, k at most 512

    def assign(batches):
        m = shared.value
        for part in batches:
            v = matrix(part.column("v"))
            if not len(v):
                continue
            i, j = nearest(v[:, :half], m["c1"]), nearest(v[:, half:], m["c2"])
            e1 = ((v[:, :half] - m["c1"][i]) ** 2).sum(1)
            e2 = ((v[:, half:] - m["c2"][j]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("v"), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 pa.array(e1), pa.array(e2)], ["vec_id", "v", "c1", "c2", "e1", "e2"])

    index = materialize(base.mapInArrow(assign, "vec_id long, v array<double>, c1 int, c2 int, e1 double, e2 double"), "cells")
    cells = index.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.sum("e1").alias("e1"), F.sum("e2").alias("e2")).toPandas()
    count = np.zeros((k1, k))
    count[cells["c1"], cells["c2"]] = cells["n"]
    err1 = np.bincount(cells["c1"], cells["e1"], k1) / np.maximum(count.sum(1), 1) / max(1, half)
    err2 = np.bincount(cells["c2"], cells["e2"], k) / np.maximum(count.sum(0), 1) / (x.shape[1] - half)
    full = spark.sparkContext.broadcast(model | {"count": count, "v1": err1, "v2": err2})   # k*k counts

    def route(batches):
        m = full.value
        for part in batches:
            ids, v = part.column("vec_id").to_pylist(), matrix(part.column("v"))
            out = []
            for qid, q in zip(ids, v, strict=True):
                by: dict[int, list[int]] = {}
                for i, j in probes(q, m, top + 1, target):
                    by.setdefault(i, []).append(j)
                out += [(qid, i, sorted(js), q) for i, js in by.items()]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int32()),
                     pa.array([o[2] for o in out], pa.list_(pa.int32())), pa.array([o[3] for o in out], pa.list_(pa.float64()))],
                    ["query_id", "c1", "c2s", "q"])

    # a number of partitions of its own, so that the walks are not gathered in one task
    asked = base.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(total / 100_000)), "vec_id")
    probe = materialize(asked.mapInArrow(route, "query_id long, c1 int, c2s array<int>, q array<double>"), "probes")
    if stats is not None:
        seen = probe.select("c1", F.explode("c2s").alias("c2")).groupBy("c1", "c2").count().toPandas()     # k*k rows at most
        stats["share"] = float((count[seen["c1"], seen["c2"]] * seen["count"]).sum() / max(1, total * probe.select("query_id").distinct().count()))
    visits = probe.groupBy("c1").count().toPandas()           # k rows
    here = np.zeros(k1)
    here[visits["c1"]] = visits["count"]
    parts = [(int(c), max(1, math.ceil(count[c].sum() / block)), max(1, math.ceil(here[c] / block))) for c in range(k1)]
    deal = F.broadcast(spark.createDataFrame(parts, "c1 int, nv int, nq int"))
    left = (index.select("vec_id", "v", "c1", "c2").join(deal, "c1")
                 .withColumn("bv", F.pmod(F.xxhash64("vec_id", "v"), F.col("nv")).cast("int"))
                 .withColumn("bq", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nv", "nq"))
    right = (probe.join(deal, "c1").withColumn("bq", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int"))
                  .withColumn("bv", F.explode(F.sequence(F.lit(0), F.col("nv") - 1))).drop("nv", "nq"))

    def rerank(vt: pa.Table, qt: pa.Table) -> pa.Table:
        ids, c2 = vt.column("vec_id").to_numpy(), vt.column("c2").to_numpy()
        qids = qt.column("query_id").to_numpy()
        out: list[tuple] = []
        if len(ids) and len(qids):
            order = np.argsort(c2, kind="stable")             # a second centroid's vectors are a slice
            ids, c2 = ids[order], c2[order]
            v, q = matrix(vt.column("v"))[order], matrix(qt.column("q"))
            lists = qt.column("c2s").to_pylist()
            held, first = np.unique(c2, return_index=True)
            last = np.append(first[1:], len(c2))
            for lo in range(0, len(q), 256):
                asking = q[lo:lo + 256]
                visit = np.zeros((len(asking), k), bool)
                for r, js in enumerate(lists[lo:lo + 256]):
                    visit[r, js] = True
                s = np.full((len(asking), len(v)), -np.inf)
                for j, a, b in zip(held, first, last, strict=True):      # only visited cells are multiplied
                    r = np.flatnonzero(visit[:, j])
                    if len(r):
                        s[r, a:b] = asking[r] @ v[a:b].T
                s[ids[None, :] == qids[lo:lo + 256, None]] = -np.inf
                some = min(top + 4, s.shape[1])               # rounding may swap near ties
                near = np.argpartition(-s, some - 1, axis=1)[:, :some]
                for r in range(len(s)):
                    at = near[r][np.isfinite(s[r, near[r]])]
                    # Ties with the last kept score are all looked at.
                    if len(at) == some:
                        at = np.flatnonzero(s[r] >= s[r, at].min() - 1e-12)
                    exact = (v[at] * q[lo + r]).sum(axis=1)
                    o = np.lexsort((ids[at], -exact))[:top]
                    out.append((np.full(len(o), qids[lo + r]), ids[at][o], exact[o]))
        cols = [np.concatenate([o[c] for o in out]) if out else np.empty(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    keys = ["c1", "bv", "bq"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda a, b: rerank(a, b), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
                .select("query_id", "rank", "vec_id", "score"))
