"""SimHash near-duplicates: fingerprints, a binary trie self-join, components.

Fingerprints.  Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z
lower-cased; shingles are ``shingle`` consecutive words joined by a space,
repeats included (fewer words: one shingle of all of them; none, or a null
text: fingerprint zero).  Bit *b* is set if it is set in over half of the
shingles' XXH64 (seed 42).

Links.  Two fingerprints link at ``max_bits`` or fewer differing bits.  Only
distinct fingerprints are joined, so a group of exact copies is one entry of
any size.  The 64 bits are cut into ``max_bits + 1`` chunks; two linked
fingerprints agree on at least one chunk whole, so each chunk heads a trie of
its own whose subtrees under one chunk value are a unit of work.  Inside a
unit the trie is joined with itself: node pairs are walked down together, bit
by bit, the differing bits are added up and a pair beyond the budget is
pruned with everything below it.  A unit of more than ``block`` entries is
dealt out as pairs of blocks, so no task holds more than two blocks of one
unit; nothing is capped or left out.  A unit returns a spanning star of each
component it finds, never all pairs.

Components.  Large-star / small-star rounds over the star edges, each round
written to the shared folder.

Defined cases.  Null or empty text: fingerprint zero, linked like any other.
A null ``doc_id`` takes part in no link and has a null ``component_id``.
Rows that repeat a ``doc_id`` are each returned; the id is one node that
belongs to every fingerprint it has.  Other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm import textnum as tn
from feedlens.session import materialize

SEED = 42
BITS = 64
BLOCK = 50_000        # entries of one unit that one block holds
LEAF = 64             # node pairs of at most so many entry pairs are compared directly
FRONTIER = 1 << 18    # node pairs expanded at once
GATHER = 1 << 20      # entries a task gathers before it joins the units it has


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    words = text.lower().split()          # bytes: ASCII white space, ASCII case
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    flat = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    total, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    starts = [0, *ends[:-1]]
    for lo in range(0, n, 1 << 16):       # bounded memory for very long texts
        hi = min(n, lo + (1 << 16))
        raw = b"".join([digest(flat[s:e - 1], SEED)
                        for s, e in zip(starts[lo:hi], ends[lo + shingle - 1:hi + shingle - 1], strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long."""
    def run(batches):
        for part in tn.chunks(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in tn.text_bytes(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                .mapInArrow(run, "doc_id long, fp long"))


def expand(zeros_at, a, b, diff, bit, max_bits):
    """The children of node pairs: pairs of ranges of a sorted array."""
    zeros = zeros_at(bit)
    am = a[:, 0] + zeros[a[:, 1]] - zeros[a[:, 0]]
    bm = b[:, 0] + zeros[b[:, 1]] - zeros[b[:, 0]]
    a0, a1 = np.stack([a[:, 0], am], 1), np.stack([am, a[:, 1]], 1)
    b0, b1 = np.stack([b[:, 0], bm], 1), np.stack([bm, b[:, 1]], 1)
    same = a[:, 0] == b[:, 0]
    other = ~same
    xa = np.concatenate([a0, a1, a0, a1[other]])
    xb = np.concatenate([b0, b1, b1, b0[other]])
    d = np.concatenate([diff, diff, diff + 1, diff[other] + 1])
    na, nb = xa[:, 1] - xa[:, 0], xb[:, 1] - xb[:, 0]
    own = xa[:, 0] == xb[:, 0]
    keep = (d <= max_bits) & (na > 0) & (nb > 0) & ~(own & (na == 1))
    return xa[keep], xb[keep], d[keep]


def leaf_pairs(keys, a, b, max_bits):
    """Linked entry pairs of small node pairs."""
    na, nb = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
    size = na * nb
    at = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    i, j = a[at, 0] + k // nb[at], b[at, 0] + k % nb[at]
    ok = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= max_bits)
    return i[ok], j[ok]


class Forest:
    """Components of a task's entries: every entry points at its root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = self.root[i], self.root[j]
            open_ = ri != rj
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            if not len(i):
                return
            np.minimum.at(self.root, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:                      # shorten the paths
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def trie_join(unit: np.ndarray, keys: np.ndarray, depth: int, max_bits: int) -> Forest:
    """Components of the entries of each unit; entries sorted by (unit, key).

    ``depth`` top bits are equal inside a unit.  Walks node pairs depth first
    in blocks of at most FRONTIER, so memory stays bounded."""
    cache: dict[int, np.ndarray] = {}

    def zeros_at(bit: int) -> np.ndarray:
        if bit not in cache:
            if len(cache) > 8:
                cache.clear()
            z = np.zeros(len(keys) + 1, np.int64)
            np.cumsum(((keys >> np.uint64(bit)) & np.uint64(1)) == 0, out=z[1:])
            cache[bit] = z
        return cache[bit]

    forest = Forest(len(keys))
    cut = np.flatnonzero(np.diff(unit)) + 1
    top = np.stack([np.concatenate([[0], cut]), np.concatenate([cut, [len(unit)]])], 1)
    top = top[top[:, 1] - top[:, 0] > 1]
    stack = [(BITS - 1 - depth, top, top, np.zeros(len(top), np.int64))]
    while stack:
        bit, a, b, diff = stack.pop()
        if not len(a):
            continue
        if len(a) > FRONTIER:
            h = len(a) // 2
            stack += [(bit, a[:h], b[:h], diff[:h]), (bit, a[h:], b[h:], diff[h:])]
            continue
        small = (a[:, 1] - a[:, 0]) * (b[:, 1] - b[:, 0]) <= LEAF
        if bit < 0:
            small[:] = True
        if small.any():
            sa, sb = a[small], b[small]
            size = np.cumsum((sa[:, 1] - sa[:, 0]) * (sb[:, 1] - sb[:, 0]))
            lo = 0
            while lo < len(sa):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + (1 << 21), side="right")))
                forest.add(*leaf_pairs(keys, sa[lo:hi], sb[lo:hi], max_bits))
                lo = hi
        big = ~small
        if big.any():
            stack.append((bit - 1, *expand(zeros_at, a[big], b[big], diff[big], bit, max_bits)))
    return forest


def star_edges(reps: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges ``(u, v)``, v < u, that connect all linked entries of ``reps``.

    ``reps``: distinct ``fp`` with its representative ``rep``."""
    n = max_bits + 1
    width = [BITS // n + (1 if c < BITS % n else 0) for c in range(n)]
    begin = [sum(width[:c]) for c in range(n)]
    rotated = [F.col("fp") if not b else F.shiftleft("fp", b).bitwiseOR(F.shiftrightunsigned("fp", BITS - b)) for b in begin]
    # The chunk number stands in the low bits, beyond the chunk's own (top) bits.
    entry = [F.struct(F.shiftrightunsigned(r, BITS - w).alias("value"), F.lit(c).alias("chunk"), r.alias("key"))
             for c, (r, w) in enumerate(zip(rotated, width, strict=True))]
    rows = reps.select("fp", "rep", F.explode(F.array(*entry)).alias("e")).select(
        "fp", "rep", "e.chunk", "e.value", "e.key")
    hot = rows.groupBy("chunk", "value").count().where(F.col("count") > block).select(
        "chunk", "value", F.ceil(F.col("count") / block).cast("int").alias("nb"))
    rows = rows.join(hot, ["chunk", "value"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "chunk", "value", F.least("mine", "x").alias("x"), F.greatest("mine", "x").alias("y"), "key", "rep")
    depth = min(width)

    def run(batches):
        held, count = [], 0

        def done(parts, last):
            """Joins whole units; what may go on in the next batch is kept."""
            t = pa.Table.from_batches(parts)
            cols = [t.column(c).to_numpy() for c in ("chunk", "value", "x", "y")]
            key, rep = t.column("key").to_numpy().view(np.uint64), t.column("rep").to_numpy()
            new = np.zeros(len(key), bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            unit = np.cumsum(new)
            stop = len(key) if last else int(np.flatnonzero(new)[-1]) if new.any() else 0
            u, k, r = unit[:stop], key[:stop], rep[:stop]
            order = np.lexsort((k, u))
            u, k, r = u[order], k[order], r[order]
            out = None
            if stop:
                root = trie_join(u, k, depth, max_bits).root
                low = np.full(len(r), np.iinfo(np.int64).max)
                np.minimum.at(low, root, r)
                low = low[root]
                e = low != r
                out = pa.RecordBatch.from_arrays([pa.array(r[e]), pa.array(low[e])], ["u", "v"])
            return out, t.slice(stop).to_batches()

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= GATHER:
                out, held = done(held, False)
                count = sum(b.num_rows for b in held)
                if out is not None:
                    yield out
        if held:
            out, _ = done(held, True)
            if out is not None:
                yield out

    unit = ["chunk", "value", "x", "y"]
    return rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (u, v): the smallest node reachable.

    Alternates large-star and small-star; every round is a written table, and
    only two numbers per round reach the driver."""
    def both(e):
        return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e, pick):
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        j = e.join(low, "u")
        return pick(j)

    def large(j):
        return j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(j):
        return (j.select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v")))

    def digest(e):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    edges = materialize(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = digest(edges)
    while seen[0]:
        step = star(both(edges), large).where("u <> v").distinct()
        step = star(step, small).distinct()
        edges = materialize(step, name)
        now = digest(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    known = fps.where("doc_id is not null")
    reps = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    edges = star_edges(reps, max_bits, block)
    # A doc_id that stands under several fingerprints ties them together.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    tie = known.join(several, "doc_id").join(reps.select("fp", "rep"), "fp").where("rep <> doc_id").select(
        F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    comp = components(edges.union(tie))
    label = reps.join(comp, reps.rep == comp.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("label"))
    out = fps.join(label, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("label")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one document of each group: the one whose doc_id is the component's.

    Rows without a doc_id are in no group and stay.  Rows that repeat a kept
    doc_id are copies or ties of it, and one of them stays: the one whose
    text's hash is smallest."""
    found = near_duplicates(docs, shingle, max_bits)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    key = F.col("doc_id").cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = (docs.join(keep, key == F.col("__keep"), "left_semi")
                .groupBy(key.alias("__id")).agg(F.min_by(row, F.xxhash64(F.coalesce("text", F.lit("")))).alias("__row")))
    return kept.select("__row.*").unionByName(docs.where(F.col("doc_id").isNull()))
