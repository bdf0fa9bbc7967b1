import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ENTRY
from feedlens.llm import merkle as M
from feedlens.llm import queries

FIELDS = ["doc_id", "lang", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """All levels, in memory."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(levels, i):
    """(left, right) siblings of leaf ``i`` on each level."""
    out = []
    for nodes in levels[:-1]:
        lo = i // 8 * 8
        out.append(("".join(nodes[lo:i]), "".join(nodes[i + 1:lo + 8])))
        i //= 8
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    trees = {}
    for g, rs in groups.items():
        trees[g] = tree([x for _, _, x in sorted((r[0] is not None, r[0] or 0, leaf(r)) for r in rs)])
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for g, levels in trees.items():
        for i, x in enumerate(levels[0]):
            path = way(levels, i) + way(top, order.index(g))
            out.append((g, x, levels[-1][0], top[-1][0], h(*[a + b for a, b in path]), path))
    return out


def frame(spark, rows):
    return (spark.createDataFrame(rows, "doc_id long, lang string, text string")
            .withColumns({c: F.lit(7) for c in ("place", "total", "tree", "digest", "chunk", "key", "at")}))


def rows_of(seed, n):
    rng = random.Random(seed)
    langs = [None, "en", "de", "", "é", "🙂", *(f"l{i}" for i in range(20))]
    return [(rng.choice([None, rng.randrange(10 ** 6)]), "en" if rng.random() < 0.4 else rng.choice(langs),
             rng.choice([None, "", "x" * rng.randrange(2000), f"é {i}"])) for i in range(n)]


@pytest.mark.parametrize("tier, n", [(4, 700), (1, 700), (2, 150), (4, 1), (1, 8), (1, 9)])
def test_equals_trees_in_memory(spark, monkeypatch, tier, n):
    monkeypatch.setattr(M, "TIER", tier)
    monkeypatch.setattr(M, "CHUNK", 8 ** tier)
    rows = rows_of(n, n)
    manifest = M.build(frame(spark, rows), FIELDS, "doc_id", "lang")
    got = M.proofs(manifest, with_proof=True).collect()
    assert sorted(str((r["tree"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"])) for r in got) == sorted(str(x[:5]) for x in brute(rows))
    assert all(r["verified"] and r["folded_root"] == manifest.root for r in got)
    for r in got[:50]:           # the packed proof stands alone
        assert M.folded(r["leaf"], M.unpack(bytes(r["proof"]))) == (manifest.root, r["proof_sha256"])
    assert {r["tree"]: bytes(r["digest"]).hex() for r in manifest.subroots().collect()} == {x[0]: x[2] for x in brute(rows)}


def test_claims(spark):
    rows = rows_of(3, 90)
    df = frame(spark, rows)
    false = M.leaf_digest([F.col("doc_id"), F.col("lang"), F.lit("forged")])
    got = M.proofs(M.build(df, FIELDS, "doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, false))).collect()
    want = {x[1]: x[5] for x in brute(rows)}
    for r in got:
        forged = r["key"] is not None and r["key"] % 2 == 0
        x = leaf((r["key"], r["tree"], "forged")) if forged else r["leaf"]
        for a, b in want[r["leaf"]]:
            x = h(a, x, b)
        assert (r["folded_root"], r["verified"]) == (x, x == r["root"]) and r["verified"] != forged


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "en", "same")] * 20 + [(None, None, None)] * 3
    got = M.proofs(M.build(frame(spark, rows), FIELDS, "doc_id", "lang")).collect()
    assert sorted((str(r["tree"]), r["leaf"], r["proof_sha256"]) for r in got) == sorted((str(x[0]), x[1], x[4]) for x in brute(rows))
    manifest = M.build(frame(spark, []), FIELDS, "doc_id", "lang")
    assert manifest.root is None and M.proofs(manifest).count() == 0


def test_query_of_odd_rows_equals_sql(spark, tmp_path):
    rows = [(d, "web" if i % 3 else None, g, None if i % 5 == 0 else i, t if i % 2 else (t or "") + "ABC") for i, (d, g, t) in enumerate(rows_of(4, 300))]
    rows += [(-5, "web", "en", 1, "no")] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit("x"))
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    name = "op12_merkle_manifest"
    got = sorted(map(tuple, ENTRY.queries()[name](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(queries.ORACLE[name]).fetchall(), key=str)
    assert 0 < sum(r[6] for r in got) < len(got)
