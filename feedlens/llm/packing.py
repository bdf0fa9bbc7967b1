"""Best-fit packing of token pieces into sequences under several capacities.

Every document becomes the ids of its text followed by one end id; documents
longer than a sequence are cut into pieces of exactly the sequence length, but
for the first piece, which takes the rest.  Ids come from a byte-level BPE
vocabulary file whose path is a parameter (``tiktoken`` over the ``.tiktoken``
file, which holds the same vocabulary as the ``tokenizers`` file and gives the
same ids; tests hold one against the other).

Packing is vector best-fit: a sequence has capacities of tokens, of pieces and
of attention cost (the sum of squared piece lengths).  Pieces go in order of
decreasing size; each is placed in the open sequence that has room in every
dimension and is best by ``rule``: the smallest weighted residual norm after
placing (``norm``) or the largest weighted dot product of demand and residual
(``dot``).  If none has room, a new sequence is opened.

Scale: a full-length piece is a sequence by itself.  All other pieces are
dealt at random (a number drawn when the pieces are written) into lots of
about ``lot`` pieces, and each lot is packed alone in one task; a lot loses at
most its last few partly filled sequences.  The number of lots follows the
number of pieces, so memory in a task is fixed, and copies of one document
spread over all lots.  Only lengths are shuffled.

Defined cases.  Null text is the empty text: one piece of the end id.  A null
or repeated ``doc_id`` is carried as it is; every row makes its own pieces.
An empty table packs into nothing.  Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm import textnum as tn
from feedlens.session import materialize

END = 0


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and how the residuals are weighed."""
    tokens: int = 2048
    pieces: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"

    def sizes(self, length: np.ndarray) -> np.ndarray:
        return np.stack([length, np.ones_like(length), length * length], 1).astype(np.float64)

    def caps(self) -> np.ndarray:
        return np.array([self.tokens, self.pieces, self.attention], np.float64)


def encoder(path: str):
    """A tiktoken encoding over a ``.tiktoken`` vocabulary file."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter."""
    first = n - (n - 1) // size * size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, size: int = 2048, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, number[, ids]``.

    ``number`` tells the rows of one run apart; write the result before use."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        enc, count = encoder(path), TaskContext.get().partitionId() << 36
        for part in tn.chunks(batches, "text", 1 << 20):
            rows, blobs = [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.append(enc.encode_to_numpy(text or "", disallowed_special=()), END).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), size)):
                    raw = ids[s:s + n].tobytes()
                    rows.append((doc, k, s, n, zlib.crc32(raw), count))
                    count += 1
                    if with_ids:
                        blobs.append(raw)
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            if with_ids:
                cols.append(pa.array(blobs, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "number"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, number long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(length: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each piece; pieces in the order of placing."""
    limit, weight = cap.caps(), np.array(cap.weights)
    size = cap.sizes(length) / limit
    room = np.ones((256, 3))                  # residuals of the open bins, as shares
    name = np.zeros(256, np.int64)            # their numbers
    used, made = 0, 0
    where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    filled: list[int] = []
    eps = 1e-12
    smallest = np.minimum.accumulate(size[::-1], axis=0)[::-1]
    for i, s in enumerate(size):
        if i % 512 == 0 and used:             # bins that nothing to come fits into are closed
            live = np.flatnonzero((room[:used] >= smallest[i] - eps).all(axis=1))
            room[:len(live)], name[:len(live)] = room[live], name[live]
            used = len(live)
        r = room[:used]
        fits = np.flatnonzero((r[:, 0] >= s[0] - eps) & (r[:, 1] >= s[1] - eps) & (r[:, 2] >= s[2] - eps))
        if len(fits):
            left = r[fits]
            if cap.rule == "dot":
                k = fits[np.argmax((left * s) @ weight)]
            else:
                k = fits[np.argmin(((left - s) ** 2) @ weight)]
        else:
            if used == len(room):
                room, name = np.concatenate([room, np.ones_like(room)]), np.concatenate([name, np.zeros_like(name)])
            k, used = used, used + 1
            room[k], name[k] = 1.0, made
            filled.append(0)
            made += 1
        room[k] -= s
        where[i], offset[i] = name[k], filled[name[k]]
        filled[name[k]] += int(length[i])
    return where, offset


def pack(rows: DataFrame, cap: Capacity = Capacity(), lot: int = 20_000) -> DataFrame:
    """``rows`` (with ``number``, ``length``; written before) plus ``sequence_id, offset``.

    ``sequence_id`` is the ``number`` of the piece placed first."""
    full = rows.where(F.col("length") >= cap.tokens)
    part = rows.where(F.col("length") < cap.tokens)
    lots = max(1, -(-part.count() // lot))

    def run(t: pa.Table) -> pa.Table:
        length, number = t.column("length").to_numpy(), t.column("number").to_numpy()
        order = np.lexsort((number, -length))
        length, number = length[order], number[order]
        where, offset = best_fit(length, cap)
        _, first = np.unique(where, return_index=True)
        return pa.table({"number": number, "sequence_id": number[first][where], "offset": offset})

    # an explicit number of partitions, so that lots are not gathered in one task
    dealt = part.select("number", "length", F.pmod(F.xxhash64("number"), F.lit(lots)).alias("lot")).repartition(min(lots, 20_000), "lot")
    placed = dealt.groupBy("lot").applyInArrow(lambda t: run(t), "number long, sequence_id long, offset long")
    return part.join(placed, "number").unionByName(
        full.withColumn("sequence_id", F.col("number")).withColumn("offset", F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, cap: Capacity = Capacity(), vocabulary: str | None = None,
                   with_ids: bool = False, lot: int = 20_000) -> DataFrame:
    """The pieces of all documents with their places."""
    return pack(materialize(pieces(docs, cap.tokens, vocabulary, with_ids), "pieces"), cap, lot)
