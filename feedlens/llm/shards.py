"""Documents in shards, and an exchange that tells every shard corpus-wide counts.

A shard is a run of documents with about ``SHARD_BYTES`` of text, kept as one
row of a written table (texts compressed, bucketed by shard, so later passes
join to it without moving it).  For a count, each shard sends its *distinct*
64-bit keys with its own counts, sorted and cut by key range into as many
ranges as the corpus needs; one task adds up one range and answers every shard
in the order of its question.  A key that a third of the corpus holds costs
one entry a shard, and neither texts nor positions travel.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm import textnum as tn
from feedlens.llm.common import small_batches
from feedlens.session import materialize, scratch_path

SHARD_BYTES = 4 << 20      # text of one shard, but for a longer single text
RANGE_KEYS = 1 << 20       # keys that one range holds, about
QUESTION = "bucket int, shard long, keys binary, counts binary"
ANSWER = "shard long, bucket int, totals binary, distinct long, total long"


def build(docs: DataFrame, flag=None) -> DataFrame:
    """The written shard table of ``(doc_id, text)``; ``flag`` is a boolean column kept per document."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      (F.lit(False) if flag is None else flag).alias("flag"))

    def run(batches):
        count, pack = TaskContext.get().partitionId() << 36, zstandard.ZstdCompressor(level=3)
        for part in tn.chunks(batches, "text", SHARD_BYTES):
            texts = tn.text_bytes(part.column("text"))
            one = lambda v, t: pa.array([v], pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array([count]), one(part.column("doc_id").to_pylist(), pa.int64()),
                 one(part.column("flag").to_pylist(), pa.bool_()), one([len(t) for t in texts], pa.int64()),
                 pa.array([sum(map(len, texts))]), pa.array([pack.compress(b"".join(texts))], pa.binary())],
                ["shard", "doc_ids", "flags", "sizes", "bytes", "texts"])
            count += 1

    schema = "shard long, doc_ids array<long>, flags array<boolean>, sizes array<long>, bytes long, texts binary"
    name = f"feedlens_shards_{uuid.uuid4().hex[:12]}"
    (src.mapInArrow(run, schema).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
        .option("path", scratch_path(spark, "shards")).saveAsTable(name))
    return spark.table(name)


def rows_of(batch: pa.RecordBatch):
    """``(shard, doc_ids, flags, texts)`` of every shard in a batch."""
    unpack = zstandard.ZstdDecompressor()
    for i in range(batch.num_rows):
        get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
        sizes, total = get("sizes"), get("bytes")
        text = unpack.decompress(get("texts"), max_output_size=max(total, 1)) if total else b""
        ends = np.cumsum(sizes).tolist()
        yield get("shard"), get("doc_ids"), get("flags"), [text[e - n:e] for e, n in zip(ends, sizes, strict=True)]


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys: the first whole, then differences in as few bytes as the largest needs."""
    if not len(keys):
        return b""
    d = np.diff(keys)
    width = max(1, (int(d.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    width, d = raw[0], np.frombuffer(raw, np.uint8, offset=9)
    out = np.zeros((len(d) // width + 1, 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8, 1)
    out[1:, :width] = d.reshape(-1, width)
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """Non-negative counts in as few bytes each as the largest needs."""
    width = max(1, (int(n.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + n.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    d = np.frombuffer(raw, np.uint8, offset=1)
    out = np.zeros((len(d) // raw[0], 8), np.uint8)
    out[:, :raw[0]] = d.reshape(-1, raw[0])
    return out.reshape(-1).view("<u8").astype(np.int64)


def ranges(table: DataFrame, keys_a_byte: float) -> int:
    """How many key ranges the corpus needs."""
    total = table.agg(F.sum("bytes")).first()[0] or 0
    return max(1, -(-int(total * keys_a_byte) // RANGE_KEYS))


def question(shard: int, keys: np.ndarray, counts: np.ndarray, n_ranges: int) -> pa.RecordBatch:
    """The rows that ask for the totals of a shard's sorted distinct keys."""
    at = ((keys >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
    cut = np.searchsorted(at, np.arange(n_ranges + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), shard, np.int64)),
         pa.array([pack_keys(keys[cut[b]:cut[b + 1]]) for b in full], pa.binary()),
         pa.array([pack_counts(counts[cut[b]:cut[b + 1]]) for b in full], pa.binary())],
        ["bucket", "shard", "keys", "counts"])


def exchange(questions: DataFrame, bits: bool, name: str) -> DataFrame:
    """The written answers: totals in the order of the keys, or (``bits``) whether a total is over 1.

    Each range also answers, under a null shard, how many of its keys have a
    total over 0 and what the totals add up to."""
    def add(t: pa.Table) -> pa.Table:
        keys = [unpack_keys(k) for k in t.column("keys").to_pylist()]
        counts = np.concatenate([unpack_counts(c) for c in t.column("counts").to_pylist()])
        cut = np.cumsum([0, *map(len, keys)])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        s = flat[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))
        total = np.empty(len(flat), np.int64)
        total[order] = sums[np.cumsum(new) - 1]
        out = [np.packbits(total[a:b] > 1).tobytes() if bits else pack_counts(total[a:b])
               for a, b in zip(cut[:-1], cut[1:], strict=True)]
        n = len(out)
        return pa.table({
            "shard": pa.array([*t.column("shard").to_pylist(), None], pa.int64()),
            "bucket": pa.array([t.column("bucket")[0].as_py()] * (n + 1), pa.int32()),
            "totals": pa.array([*out, None], pa.binary()),
            "distinct": pa.array([None] * n + [int((sums > 0).sum())], pa.int64()),
            "total": pa.array([None] * n + [int(sums.sum())], pa.int64())})

    return materialize(questions.groupBy("bucket").applyInArrow(lambda t: add(t), ANSWER), name)


def with_answers(table: DataFrame, **answers: DataFrame) -> DataFrame:
    """The shard table with one column of answers, ``list of (bucket, totals)``, for each name."""
    for name, a in answers.items():
        mine = (a.where("shard is not null").groupBy("shard")
                 .agg(F.sort_array(F.collect_list(F.struct("bucket", "totals"))).alias(name)))
        table = table.join(mine, "shard", "left")
    return table


def answer_bits(cell, counts: np.ndarray) -> np.ndarray:
    """The answered bits in key order; ``counts[b]`` keys were asked of range b."""
    out = [np.unpackbits(np.frombuffer(x["totals"], np.uint8), count=int(counts[x["bucket"]])) for x in cell or []]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def answer_counts(cell) -> np.ndarray:
    out = [unpack_counts(x["totals"]) for x in cell or []]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def asked(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    """How many of the sorted keys fall in each range."""
    at = ((keys >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
    return np.diff(np.searchsorted(at, np.arange(n_ranges + 1, dtype=np.uint64)))
