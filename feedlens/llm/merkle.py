"""A Merkle manifest of a table, by time-forward processing in Spark.

Every row is a leaf: the SHA-256 of its fields.  The leaves of a group, in the
order of the key, form a tree: runs of ``FAN`` consecutive nodes become their
digest until one node is left, and the groups' last nodes, in the order of the
groups, form the last tree alike.  A leaf's proof is the siblings on its way to
the root, level by level.

Time-forward processing evaluates the tree in one sweep over its nodes in the
order of their labels (the leaf where a node ends, then its level): a node
sends its digest to its parent through a priority queue ordered by label, so
all children of a node have come when the sweep reaches it.  The proofs take
the reversed sweep: a node sends its children the suffix of their proofs.

The queue is external.  A tree is cut into tiers of ``TIER`` levels and a tier
into chunks of ``FAN ** TIER`` neighbours; a task sweeps one chunk at a time,
with the messages for nodes of the open chunk in a heap (a few a level).  What
is meant for later labels, the tops of the chunks, goes as rows through Spark's
sorted exchange to the next tier; on the way down the suffix of a chunk's top
is a row that comes before the chunk's nodes.  A group that holds a third of
all rows is many chunks.  Texts are read once, for the leaves, and never
shuffled.  Places come from a range partitioning by group and key, with one
count per partition and group.

Defined cases.  A null field has a mark of its own (``-``); rows without a group
are a group, the first; a null key comes first, rows of equal keys go by their
digest.  An empty table has no root and no proofs.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.session import materialize

FAN = 8
TIER = 4
CHUNK = FAN ** TIER


def leaf_digest(fields: list[Column]) -> Column:
    """Hex digest of the fields, each ``-`` if null, else byte count, ``:``, value."""
    def said(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*map(said, fields)).cast("binary"), 256)


def number(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` plus ``place`` (from 0, per tree, by ``order``) and ``total``.

    Rows are range-partitioned and sorted; a tree's rows are neighbours in each
    partition, so a place is the row's distance from the first one there plus
    the counts of earlier partitions."""
    by = [tree, *order, "tie"]
    laid = (rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
            .drop("tie").withColumn("at", F.monotonically_increasing_id()))
    laid = materialize(laid.withColumn("part", F.shiftright("at", 33)), name)
    runs = laid.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    w = "partition by `{}` order by part rows between unbounded preceding and 1 preceding".format(tree)
    runs = runs.select(F.col(tree).alias("of"), F.col("part").alias("in"), "first",
                       F.expr(f"coalesce(sum(n) over ({w}), 0)").alias("before"),
                       F.expr(f"sum(n) over (partition by `{tree}`)").alias("total"))
    return (laid.join(runs, F.col(tree).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
            .withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "of", "in", "first", "before"))


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(total: int) -> int:
    """Levels of this tier above the nodes of a tree of so many."""
    h = 0
    while h < TIER and FAN ** h < total:
        h += 1
    return h


class Sweep:
    """One chunk of a tier, the one from ``place`` on; nodes come in order of their places."""

    def __init__(self, place: int, total: int):
        self.all, self.total, self.top = total, min(total, place + CHUNK), levels(total)
        self.heap, self.families = [], []

    def send(self, level: int, index: int, value: str):
        """A node's digest to its parent, under the parent's label."""
        if level < self.top:
            end = min((index // FAN + 1) * FAN ** (level + 1), self.total)
            heappush(self.heap, (end, level + 1, index, value))
        else:
            self.result = (index, value)

    def reach(self, place: int):
        """Evaluates the nodes that end at or before a leaf's place."""
        heap = self.heap
        while heap and heap[0][0] <= place:
            label, first, children = heap[0][:2], heap[0][2], []
            while heap and heap[0][:2] == label:
                children.append(heappop(heap)[3])
            self.families.append((label[1], first // FAN, children))
            self.send(label[1], first // FAN, digest(children))

    def leaf(self, place: int, value: str):
        self.reach(place)
        self.send(0, place, value)

    def close(self) -> tuple[int, str]:
        """Place and digest of the chunk's top in the next tier."""
        self.reach(self.total)
        index, value = self.result
        return index, value

    def proofs(self, suffix):
        """``(place, proof)`` of every leaf, last first: the reversed sweep."""
        if self.top == 0:
            yield self.result[0], suffix
            return
        heap, families = [], {}
        for level, index, children in self.families:
            families[level, index] = children
        heappush(heap, (0, -self.top, -self.result[0], suffix))
        while heap:
            _, level, index, suffix = heappop(heap)
            level, index = -level, -index
            if level == 0:
                yield index, suffix
                continue
            children = families[level, index]
            for k in range(len(children)):
                left, right = "".join(children[:k]), "".join(children[k + 1:])
                child = index * FAN + k
                end = min((child + 1) * FAN ** (level - 1), self.total)
                heappush(heap, (-end, 1 - level, -child, (left, right, suffix)))


def pack(proof) -> bytes:
    """A proof as bytes: per level the counts of siblings on both sides, then their digests."""
    out = []
    while proof:
        left, right, proof = proof
        out.append(bytes([len(left) // 64, len(right) // 64]) + bytes.fromhex(left + right))
    return b"".join(out)


def unpack(raw: bytes):
    """The opposite of ``pack``."""
    steps, i = [], 0
    while i < len(raw):
        a, b = raw[i:i + 2]
        steps.append((raw[i + 2:i + 2 + 32 * a].hex(), raw[i + 2 + 32 * a:i + 2 + 32 * (a + b)].hex()))
        i += 2 + 32 * (a + b)
    proof = ()
    for left, right in reversed(steps):
        proof = (left, right, proof)
    return proof


def folded(leaf: str, proof) -> tuple[str, str]:
    """``(root, digest of the siblings)`` that a leaf and its proof give."""
    said = hashlib.sha256()
    while proof:
        left, right, proof = proof
        said.update((left + right).encode())
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf, said.hexdigest()


def chunks(nodes: DataFrame) -> DataFrame:
    """Nodes dealt out by chunk, in order."""
    keyed = nodes.withColumn("chunk", F.expr(f"case when place < 0 then -place - 1 else place div {CHUNK} end"))
    return keyed.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "place")


def arrow_of(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def batches_of(rows, arrow: pa.Schema, size: int = 4096):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)


def climb(nodes: DataFrame) -> DataFrame:
    """The next tier of ``tree, place, total, digest``: the tops of the chunks."""
    schema = nodes.select("tree", "place", "total", "digest").schema

    def run(batches):
        arrow = arrow_of(schema)

        def tops():
            at = sweep = None
            for batch in batches:
                for tree, place, total, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at != (tree, place // CHUNK):
                        if at:
                            yield close(at[0], sweep)
                        at, sweep = (tree, place // CHUNK), Sweep(place, total)
                    sweep.leaf(place, value.hex())
                    sweep.families.clear()
            if at:
                yield close(at[0], sweep)

        def close(tree, sweep):
            place, value = sweep.close()
            return tree, place, -(-sweep.all // CHUNK), bytes.fromhex(value)

        yield from batches_of(tops(), arrow)

    return chunks(nodes.select("tree", "place", "total", "digest")).select("tree", "place", "total", "digest").mapInArrow(run, schema)


def descend(nodes: DataFrame, above: DataFrame, carried: list[T.StructField], emit, schema: T.StructType) -> DataFrame:
    """``emit(tree, place, row, proof, subroot)`` for every node of a tier.

    ``above``: ``tree, place, proof, subroot`` of the tops of the tier's chunks."""
    names = [f.name for f in carried]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in carried]
    told = above.select("tree", (-F.col("place") - 1).alias("place"), F.lit(None).cast("long").alias("total"),
                        F.lit(None).cast("binary").alias("digest"), "proof", "subroot", *none)
    mine = nodes.select("tree", "place", "total", "digest", F.lit(None).cast("binary").alias("proof"),
                        F.lit(None).cast("binary").alias("subroot"), *names)

    def run(batches):
        arrow = arrow_of(schema)

        def answers():
            told = sweep = None
            held = {}
            for batch in batches:
                for tree, place, total, value, proof, subroot, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if place < 0:
                        if told:
                            yield from close(told, sweep, held)
                        told, sweep, held = (tree, unpack(proof), subroot), None, {}
                        continue
                    if sweep is None:
                        sweep = Sweep(place, total)
                    sweep.leaf(place, value.hex())
                    held[place] = (value, row)
            if told:
                yield from close(told, sweep, held)

        def close(told, sweep, held):
            sweep.close()
            tree, suffix, subroot = told
            for place, proof in sweep.proofs(suffix):
                yield emit(tree, place, *held[place], proof, subroot)

        yield from batches_of(answers(), arrow)

    return chunks(mine.unionByName(told)).drop("chunk").mapInArrow(run, schema)


@dataclass
class Manifest:
    """Written tables of a manifest: ``tiers`` of the groups' trees (the first
    holds the leaves), ``upper`` of the groups' tree, and the ``root``."""
    tiers: list[DataFrame]
    upper: list[DataFrame]
    root: str | None

    def subroots(self) -> DataFrame:
        """``tree`` (the group) and its ``digest``."""
        return self.tiers[-1].select("tree", "digest")


def tiers_over(nodes: DataFrame, name: str) -> list[DataFrame]:
    """All tiers of the trees, up to one node each (finished trees are carried)."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 1) > 1:
        out.append(materialize(climb(out[-1]), name))
    return out


def build(rows: DataFrame, fields: list[str], key: str, group: str, claim: Column | None = None) -> Manifest:
    """The manifest of ``rows``.  ``claim``: another hex digest that some rows
    claim as theirs (null: the leaf itself), checked by ``proofs``."""
    leaf = leaf_digest([F.col(f"`{f}`") for f in fields])
    claim = F.lit(None).cast("binary") if claim is None else F.unhex(claim)
    leaves = rows.select(F.col(f"`{group}`").cast("string").alias("tree"), F.col(f"`{key}`").alias("key"),
                         F.unhex(leaf).alias("digest"), claim.alias("claim"))
    leaves = materialize(leaves, "merkle-leaves")
    tiers = tiers_over(materialize(number(leaves, "tree", ["key", "digest"], "merkle-laid"), "merkle-placed"), "merkle-tier")
    groups = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    upper = tiers_over(materialize(number(groups, "tree", ["group"], "merkle-groups"), "merkle-upper"), "merkle-upper-tier")
    top = upper[-1].first()
    return Manifest(tiers, upper, bytes(top["digest"]).hex() if top else None)


PROOFS = T.StructType([T.StructField("tree", T.StringType()), T.StructField("place", T.LongType()),
                       T.StructField("proof", T.BinaryType()), T.StructField("subroot", T.BinaryType())])


def down(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """``PROOFS`` of the nodes of ``tiers[0]``, from those of ``tiers[-1]``."""
    for nodes in reversed(tiers[:-1]):
        above = materialize(descend(nodes, above, [], lambda tree, place, value, row, proof, subroot:
                                    (tree, place, pack(proof), subroot), PROOFS), "merkle-proofs")
    return above


def proofs(manifest: Manifest, with_proof: bool = False) -> DataFrame:
    """``key, tree, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]`` of every row.

    ``folded_root`` is recomputed from the claimed digest, else the leaf, and the
    siblings; ``proof`` is packed (``unpack``)."""
    upper, tiers = manifest.upper, manifest.tiers
    start = upper[-1].select("tree", "place", F.lit(b"").alias("proof"), F.col("digest").alias("subroot"))
    above = materialize(descend(upper[0], down(upper[1:] or upper, start), [T.StructField("group", T.StringType())],
                                lambda tree, place, value, row, proof, subroot: (row[0], 0, pack(proof), value), PROOFS), "merkle-proofs")
    above = down(tiers[1:] or tiers, above)
    leaves, root = tiers[0], manifest.root
    kind = leaves.schema["key"].dataType
    text = T.StringType()
    out = T.StructType([T.StructField("key", kind), T.StructField("tree", text)]
                       + [T.StructField(c, text) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
                       + [T.StructField("verified", T.BooleanType())] + [T.StructField("proof", T.BinaryType())] * with_proof)

    def emit(tree, place, value, row, proof, subroot):
        key, claim = row
        found, said = folded((claim or value).hex(), proof)
        return (key, tree, value.hex(), subroot.hex(), root, said, found, found == root) + ((pack(proof),) if with_proof else ())

    return descend(leaves, above, [T.StructField("key", kind), T.StructField("claim", T.BinaryType())], emit, out)
