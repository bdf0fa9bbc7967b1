"""M1 with an evaluation history: softmax regression by distributed gradient steps.

Features are hashed: a token's bucket is the number of its MD5's first four hex
digits, a text's vector the counts of its buckets, divided by their norm, and a
constant.  So a model is one table of at most ``BUCKETS + 1`` rows, whatever
the corpus: it may be collected, sent to every task and loaded by a process.

Each epoch is one pass over the written features of the train split: a task
adds up the gradient of its rows in an array and sends it as one row per
bucket, and the sums become the next weights, which are written (a lost driver
or executor costs at most the running epoch).  With ``steps`` above 1 an epoch
makes that many updates, each on every ``steps``-th row of the train order.
After every epoch the validation split is scored and measured (E9); the
patience rule (O5) ends the fit, and the weights of the best epoch (O4: first
maximum of macro F1) are the model.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from feedlens.functions import fixed
from feedlens.functions import text as T
from feedlens.functions import probs as P
from feedlens.operators import evaluation as E
from feedlens.operators.ordering import early_stop_point
from feedlens.session import materialize
from feedlens.sources.models import publish, published

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 16
BIAS = BUCKETS            # the constant's row
LOSS = -1                 # a task's loss travels as a row of its own
PIECE = 1 << 16           # numbers of a batch worked on at a time, or one text's
N_CLASSES = len(fixed.CLASS_NAMES)


def buckets(text: Column) -> Column:
    """The bucket of every token of a text (null for a null text)."""
    return F.transform(T.tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"))


def vectors(offsets: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, bucket, value)`` of the texts' vectors, without the constant,
    from the buckets of all their tokens."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair, n = np.unique(row.astype(np.int64) * BUCKETS + flat, return_counts=True)
    row, bucket = pair // BUCKETS, pair % BUCKETS
    norm = np.sqrt(np.bincount(row, weights=n.astype(float) ** 2, minlength=len(offsets) - 1))
    return row, bucket, n / norm[row]


def logits(w: np.ndarray, n: int, row: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
    """``n`` rows of class sums under weights ``w`` (``BUCKETS + 1`` by classes)."""
    z = np.stack([np.bincount(row, weights=w[bucket, k] * value, minlength=n) for k in range(w.shape[1])], 1)
    return z + w[BIAS]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def pieces(batch: pa.RecordBatch, lists: int):
    """The batch in slices of whole rows whose lists (column number ``lists``) hold
    at most ``PIECE`` numbers, or of one row: the arrays made of a slice do not
    grow with the batch, which has as many long texts as Arrow rows."""
    ends = np.asarray(batch.column(lists).offsets)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def features(docs: DataFrame, carry: tuple[str, ...], text: str = "text") -> DataFrame:
    """``(*carry, bucket array, value array)``, one row a text that is not null; no shuffle."""
    base = docs.where(F.col(text).isNotNull()).select(*carry, buckets(F.col(text)).alias("_b"))
    schema = base.drop("_b").schema.add("bucket", S.ArrayType(S.IntegerType())).add("value", S.ArrayType(S.DoubleType()))

    def run(batches):
        for batch in (p for b in batches for p in pieces(b, b.num_columns - 1)):
            lists = batch.column(batch.num_columns - 1)
            offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            row, bucket, value = vectors(offsets, np.asarray(lists.flatten()))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            cols = [pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[f.name for f in schema])

    return base.mapInArrow(run, schema)


def _unpacked(batch: pa.RecordBatch):
    """``(row, bucket, value)`` of a batch of ``features``."""
    b, v = batch.column("bucket"), batch.column("value")
    offsets = np.asarray(b.offsets)
    return np.repeat(np.arange(batch.num_rows), np.diff(offsets)), np.asarray(b.flatten()), np.asarray(v.flatten())


def gradient(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """``(bucket, g0, g1, g2)``: the sums over ``rows`` (``label``, features) of the
    cross entropy's gradient; row ``LOSS`` holds the loss and the row count."""
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = sent.value
        g, loss, n = np.zeros_like(w), 0.0, 0
        for batch in (p for b in batches for p in pieces(b, 1)):
            row, bucket, value = _unpacked(batch)
            y = batch.column("label").to_numpy()
            p = softmax(logits(w, batch.num_rows, row, bucket, value))
            loss -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
            n += len(y)
            p[np.arange(len(y)), y] -= 1
            for k in range(w.shape[1]):
                g[:BUCKETS, k] += np.bincount(bucket, weights=p[row, k] * value, minlength=BUCKETS)
            g[BIAS] += p.sum(axis=0)
        if n:
            at = np.flatnonzero(g.any(axis=1))
            out = np.concatenate([g[at], [[loss, n, 0.0]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, LOSS).astype(np.int32)), *[pa.array(out[:, k]) for k in range(3)]],
                                             ["bucket", "g0", "g1", "g2"])

    part = rows.select("label", "bucket", "value").mapInArrow(run, "bucket int, g0 double, g1 double, g2 double")
    return part.groupBy("bucket").agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(3)])


def score_features(rows: DataFrame, w: np.ndarray, carry: tuple[str, ...]) -> DataFrame:
    """``(*carry, p, pred)`` of rows of ``features``."""
    sent = rows.sparkSession.sparkContext.broadcast(w)
    base = rows.select(*carry, "bucket", "value")
    schema = base.drop("bucket", "value").schema.add("p", S.ArrayType(S.DoubleType()))

    def run(batches):
        for batch in (p for b in batches for p in pieces(b, b.num_columns - 1)):
            p = softmax(logits(sent.value, batch.num_rows, *_unpacked(batch)))
            lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], lists], names=[*carry, "p"])

    return base.mapInArrow(run, schema).withColumn("pred", P.argmax(F.col("p")))


def to_array(weights: DataFrame) -> np.ndarray:
    """A model's table as an array; it has at most ``BUCKETS + 1`` rows."""
    w, pdf = np.zeros((BUCKETS + 1, N_CLASSES)), weights.toPandas()
    w[pdf["bucket"].to_numpy()] = pdf[["w0", "w1", "w2"]].to_numpy()
    return w


def to_table(spark: SparkSession, w: np.ndarray) -> DataFrame:
    """The opposite of ``to_array``; buckets without weight have no row."""
    at = np.flatnonzero(w.any(axis=1))
    columns = [pa.array(at.astype(np.int32)), *[pa.array(w[at, k]) for k in range(N_CLASSES)]]
    return spark.createDataFrame(pa.table(columns, ["bucket", "w0", "w1", "w2"])).coalesce(1)


HISTORY = ("epoch int, loss double, n long, accuracy double, precision double, recall double, "
           "f1_macro double, f1_weighted double")


@dataclass
class LinearModel:
    weights: DataFrame        # (bucket, w0, w1, w2), the best epoch's
    history: DataFrame        # one row an evaluation: HISTORY
    stop: DataFrame           # O5 on the history: n_steps, best_step, best_metric, stop_step

    def save(self, path: str) -> None:
        publish(self.weights.sparkSession, path, lambda folder: self.weights.coalesce(1).write.parquet(folder))

    @staticmethod
    def load(spark: SparkSession, path: str) -> DataFrame:
        """The weights of a saved model."""
        return spark.read.parquet(published(spark, path))


def fit(split: DataFrame, epochs: int = 20, lr: float = 8.0, weight_decay: float = fixed.WEIGHT_DECAY, steps: int = 1,
        patience: int = fixed.EARLY_STOPPING_PATIENCE, text: str = "text") -> LinearModel:
    """Fits on the rows of ``split`` (``ord, pos, text, label, split``) marked
    ``train`` and evaluates on ``validation`` after every epoch.

    ``loss`` is the mean cross entropy on train of the epoch's updates, taken
    before each.  Ends after ``epochs`` or when ``patience`` evaluations in a
    row have not raised macro F1.  Without train rows this raises."""
    spark = split.sparkSession
    feats = materialize(features(split.where("split in ('train', 'validation')"), ("split", "pos", "label"), text), "linear-features")
    train, val = feats.where("split = 'train'"), feats.where("split = 'validation'")
    if train.isEmpty():
        raise ValueError("no training rows: nothing to fit")
    w = np.zeros((BUCKETS + 1, N_CLASSES))
    decay = np.full((BUCKETS + 1, 1), 1.0 - lr * weight_decay)
    decay[BIAS] = 1.0
    saved, rows, best, since = [], [], -np.inf, 0
    for epoch in range(1, epochs + 1):
        loss = seen = 0.0
        for s in range(steps):
            sums = gradient(train if steps == 1 else train.where(F.pmod(F.col("pos") + s, F.lit(steps)) == 0), w).toPandas()
            sums = sums.set_index("bucket")                # at most BUCKETS + 2 rows
            if LOSS not in sums.index:                     # no row in this step's share
                continue
            step_loss, n, _ = sums.loc[LOSS]
            g = sums.drop(index=LOSS)
            w = w * decay
            w[g.index.to_numpy()] -= lr / n * g.to_numpy()
            loss, seen = loss + step_loss, seen + n
        table = materialize(to_table(spark, w), f"linear-weights-{epoch}")
        m = E.eval_metrics(score_features(val, w, ("label",))).first()
        rows.append((epoch, float(loss / seen), int(m["n"] or 0), *[float(m[c]) for c in ("accuracy", "precision", "recall", "f1_macro", "f1_weighted")]))
        saved.append(table)
        since = 0 if m["f1_macro"] > best else since + 1
        best = max(best, m["f1_macro"])
        if since >= patience:
            break
    history = materialize(spark.createDataFrame(rows, HISTORY).coalesce(1), "linear-history")
    stop = early_stop_point(history.select(F.lit("fit").alias("run"), "epoch", "f1_macro"), "run", ("epoch",), "f1_macro", patience, chunks=1).drop("run")
    return LinearModel(saved[int(stop.first()["best_step"]) - 1], history, stop)


def score_linear(docs: DataFrame, weights: DataFrame, carry: tuple[str, ...], text: str = "text") -> DataFrame:
    """``(*carry, p, pred, predicted_class, confidence)`` of every text that is not null; no shuffle."""
    out = score_features(features(docs, carry, text), to_array(weights), carry)
    return out.withColumns({"predicted_class": P.label_decode(F.col("pred")), "confidence": F.element_at("p", F.col("pred") + 1)})
