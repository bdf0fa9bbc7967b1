"""M7 — any outside model on whole texts, in Arrow batches.

``score_external`` takes a factory of an object from a list of texts to
probabilities.  The factory is called once per Python worker process, in the
process (workers are reused, so many tasks share a model), and the object is
given batches bounded in texts and bytes.  Texts go from the scan to the object
and are neither shuffled nor joined: the plan has no exchange.

A model comes as a file: ``ship`` hands one file of the shared folder to Spark,
which puts a copy beside every executor, and ``shipped`` finds it there.  A text that
is null, that the object fails on, or for which it returns no finite
probabilities keeps null scores (M6 drops it); one bad text costs no other.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from feedlens.functions import fixed
from feedlens.functions import probs as P
from feedlens.functions import text as T
from feedlens.operators import linear

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Scorer = Callable[[list[str]], np.ndarray]
N_CLASSES = len(fixed.CLASS_NAMES)


def ship(spark: SparkSession, path: str) -> str:
    """Gives one file to all executors; the name to find it by.  Names must differ within a session."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def ship_table(df: DataFrame, path: str) -> str:
    """The same for a small table, written to ``path`` as one Parquet file."""
    spark = df.sparkSession
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return ship(spark, spark.read.parquet(path).inputFiles()[0])


def shipped(name: str) -> str:
    """Where a file given to ``ship`` lies, seen from a task."""
    from urllib.parse import unquote

    from pyspark import SparkFiles
    return SparkFiles.get(unquote(name))


def loaded(token: str, factory: Callable[[], Scorer]) -> Scorer:
    """The factory's object, made once per process and ``token``."""
    models = sys.__dict__.setdefault("_feedlens_models", {})
    if token not in models:
        models.clear()           # a worker holds one model at a time
        models[token] = factory()
    return models[token]


def pieces(texts: pa.Array, max_texts: int, max_bytes: int):
    """Slices ``(from, to)`` of at most so many texts and, but for one longer text, bytes."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(texts):
        base = ends[lo - 1] if lo else 0
        hi = min(max(lo + 1, int(np.searchsorted(ends, base + max_bytes, side="right"))), lo + max_texts)
        yield lo, hi
        lo = hi


def ask(model: Scorer, texts: list[str]) -> np.ndarray:
    """Probabilities of the texts; rows of NaN where the model fails."""
    try:
        p = np.asarray(model(texts), float)
        if p.shape != (len(texts), N_CLASSES):
            raise ValueError(f"the scorer returned shape {p.shape} for {len(texts)} texts")
        return p
    except Exception:  # noqa: BLE001 - as for a single text, a failure is a missing score
        if len(texts) == 1:
            return np.full((1, N_CLASSES), np.nan)
        return np.concatenate([ask(model, [t]) for t in texts])


def score_external(docs: DataFrame, factory: Callable[[], Scorer], key="doc_id", text: str = "text", keep: tuple[str, ...] = (),
                   max_texts: int = 256, max_bytes: int = 4 << 20) -> DataFrame:
    """``(*key, *keep, p, pred, predicted_class, confidence)`` of every row, scored by the factory's object."""
    carry = ([key] if isinstance(key, str) else list(key)) + list(keep)
    base = docs.select(*carry, F.col(text).cast("string").alias("_text"))
    schema = base.drop("_text").schema.add("p", S.ArrayType(S.DoubleType()))
    token, names = uuid.uuid4().hex, [*carry, "p"]

    def run(batches):
        model = loaded(token, factory)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi in pieces(texts, max_texts, max_bytes):
                part = texts.slice(lo, hi - lo).to_pylist()
                have = [i for i, t in enumerate(part) if t is not None]
                p = np.full((len(part), N_CLASSES), np.nan)
                if have:
                    p[have] = ask(model, [part[i] for i in have])
                good = np.isfinite(p).all(axis=1)
                rows = pa.array([list(x) if g else None for x, g in zip(p.tolist(), good, strict=True)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], rows], names=names)

    out = base.mapInArrow(run, schema).withColumn("pred", P.argmax(F.col("p")))
    return out.withColumns({"predicted_class": P.label_decode(F.col("pred")), "confidence": F.element_at("p", F.col("pred") + 1)})


class HashedModel:
    """The hashed softmax model (``linear``) as an outside object: it reads its file,
    splits texts into tokens and scores them, all in Python."""

    def __init__(self, path: str, fold: tuple[str, str], pattern: str, marks: str):
        import pyarrow.parquet as pq
        import regex
        table = pq.read_table(path)
        self.w = np.zeros((linear.BUCKETS + 1, N_CLASSES))
        self.w[table["bucket"].to_numpy()] = np.stack([table[f"w{k}"].to_numpy() for k in range(N_CLASSES)], 1)
        self.fold, self.marks, self.token = str.maketrans(*fold), regex.compile(marks), regex.compile(pattern)
        self.seen: dict[str, int] = {}

    def bucket(self, token: str) -> int:
        b = self.seen.get(token)
        if b is None:
            import hashlib
            if len(self.seen) > 100_000:
                self.seen.clear()
            b = self.seen[token] = int(hashlib.md5(token.encode()).hexdigest()[:4], 16)
        return b

    def __call__(self, texts: list[str]) -> np.ndarray:
        lists = []
        for t in texts:
            t = t.lower()
            t = t if t.isascii() else self.marks.sub("", t.translate(self.fold))
            lists.append([self.bucket(x) for x in self.token.findall(t)])
        offsets = np.cumsum([0, *map(len, lists)])
        flat = np.fromiter((b for x in lists for b in x), np.int64, int(offsets[-1]))
        return linear.softmax(linear.logits(self.w, len(texts), *linear.vectors(offsets, flat)))


def hashed_model(name: str) -> Callable[[], Scorer]:
    """The factory of a ``HashedModel`` from the file shipped as ``name``."""
    fold, marks = T.accent_fold_table(), T.MARKS
    pattern = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08X}", T.token_pattern())
    return lambda: HashedModel(shipped(name), fold, pattern, marks)
