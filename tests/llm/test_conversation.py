import hashlib
import itertools
import random
import re

import duckdb
import pytest

import __spark_entry__ as ENTRY
from feedlens.llm import conversation as C
from feedlens.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, name int, block int, again string, fault int"
FINE = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(C.SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows):
    """The best script of all scripts, by trying each: (cost, script, lines)."""
    ways = []
    fresh = [list(x) for k in range(3) for x in itertools.product(("user", "assistant"), repeat=k)]
    for (_, role, text), fault in zip(rows, faults_of(rows), strict=True):
        can = [(3, "D", [])]
        if fault in (None, "truncated"):
            more = fault == "truncated"
            for ins in fresh:
                said = [(r, "") for r in ins]
                can.append((2 * len(ins) + more, "I" * len(ins) + "K", [*said, (role, text)]))
                can += [(2 * len(ins) + 2 + more, "I" * len(ins) + "R", [*said, (r, text)]) for r in ("user", "assistant")]
        ways.append(can)
    best = None
    for way in itertools.product(*ways, [(2 * len(i), "I" * len(i), [(r, "") for r in i]) for i in fresh]):
        said = [t for w in way for t in w[2]]
        if FINE.fullmatch("".join(r[:1] or "?" for r, _ in said)):
            key = (sum(w[0] for w in way), "".join(w[1] for w in way), [f"{r}:{t}" for r, t in said])
            best = key if best is None or key < best else best
    return best


def conversations(seed, n, longest):
    rng, out = random.Random(seed), []
    for c in range(n):
        for i in range(rng.randint(1, longest)):
            role = rng.choices(["user", "assistant", "system", "tool", ""], [5, 5, 1, 1, 1])[0]
            out.append((c, i, role, rng.choice([" ", "", "Yes.", "No!", f"text {i}", f"text {i}.", f"is it {c}? \t"])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, 2, "3", 4) for c, t, r, x in rows], SCHEMA)


def by_conv(rows):
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    return {c: sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, g in groups.items()}


@pytest.mark.parametrize("block", [2, 4096])
def test_equals_trying_every_script(spark, block):
    rows = conversations(block, 150, 3)
    got = {r["conv_id"]: r for r in C.transcript_digests(C.repair(frame(spark, rows), block_rows=block)).collect()}
    groups = by_conv(rows)
    assert set(got) == set(groups)
    for c, group in groups.items():
        cost, script, lines = brute(group)
        r = got[c]
        assert (r["cost"], r["audit"]) == (cost, script), (c, group)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found = faults_of(group)
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [found.count(k) for k in ("blank", "duplicate", "truncated")]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(group)]
        assert r["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)


def test_blocks_and_batches_change_nothing(spark):
    """Long conversations, one with a third of all rows, in blocks of 1, 7 and 5000 rows and small Arrow batches."""
    rows = [(0, t, random.Random(t).choice(["user", "assistant"]), random.Random(-t).choice(["", "Yes.", f"t{t}.", f"t{t}"])) for t in range(3000)]
    rows += [(1 + c, t, r, x) for c, t, r, x in conversations(5, 60, 90)]
    df = frame(spark, rows)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    out = []
    for block, batch in ((5000, old), (7, "11"), (1, "64")):
        spark.conf.set(key, batch)
        try:
            blocks = C.repair(df, block_rows=block)
            out.append(sorted(map(tuple, C.transcript_digests(blocks).collect())))
            turns = C.repaired_turns(blocks).orderBy("conv_id", "block", "place").collect()
        finally:
            spark.conf.set(key, old)
        said, edits = {}, {}
        for r in turns:
            said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
            edits.setdefault(r["conv_id"], []).append(r["edit"])
        for r in C.transcript_digests(blocks).collect():
            assert hashlib.sha256("\n".join(said.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]
            assert "".join(edits.get(r["conv_id"], [])) == r["audit"].replace("D", "")
    assert out[0] == out[1] == out[2]


def test_bytes_close_a_block_too(spark):
    df = frame(spark, [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "x" * 50_000 + ".") for t in range(8)])
    blocks = C.repair(df, block_bytes=100_000)
    assert blocks.count() == 4
    assert C.transcript_digests(blocks).first()["audit"] == "K" * 8


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a."), (None, None, "system", "b."), (1, 5, None, None), (1, None, None, None), (2, 3, "user", "é ß 東京 🙂."),
            (2, 3, "user", "é ß 東京 🙂."), (2, 9, "assistant", "x" * 200_000 + "."), (3, 1, "s", "t."), (4, None, "user", "Hi.")]
    got = {r["conv_id"]: r for r in C.transcript_digests(C.repair(frame(spark, rows))).collect()}
    for c, group in by_conv(rows).items():
        cost, script, lines = brute(group)
        assert (got[c]["cost"], got[c]["audit"]) == (cost, script)
        assert got[c]["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got[1]["gaps"] == 0 and got[2]["gaps"] == 5 and got[4]["gaps"] == 0 and got[1]["audit"] == "DD"


def test_empty_table(spark):
    blocks = C.repair(frame(spark, []))
    assert blocks.count() == 0 and C.transcript_digests(blocks).count() == 0 and C.repaired_turns(blocks).count() == 0


def test_query_of_odd_rows_equals_sql(spark, tmp_path):
    rows = conversations(9, 80, 12) + [(None, None, "user", "A. b"), (None, 2, None, None), (7000, None, "user", "a"), (7001, 1, "assistant", None)]
    rows += [(8000 + i, 1, "user", "x.") for i in range(60)]       # some lose their only row
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    name = "op13_conversation_repair"
    got = sorted(map(tuple, ENTRY.queries()[name](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view conversations as from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == sorted(con.execute(queries.ORACLE[name]).fetchall(), key=str)
    assert sum(r[7] == "" for r in got) > 0
