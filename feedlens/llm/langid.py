"""Language ID: averaged hashed subword embeddings with a linear softmax.

Subwords are the 3- and 4-byte pieces of a text's words (A-Z lower-cased,
every other ASCII byte is a word border, one border byte belongs to a piece),
hashed into ``buckets`` rows of an embedding table.  A text is the average of
its pieces' embeddings; a linear layer and a softmax name the language.  Both
tables are trained by mini-batch stochastic gradient descent in numpy.

Training sample: at most ``per_lang`` texts of each language, those with the
smallest hash of doc_id among the learning rows, whole texts; a fifth of them
is held back for calibration.  Calibration fits a temperature and two rejection
limits, each passed by all but ``loss`` of the held-back texts, their first
1, 3 and 12 words, and halves of two of them: the least confidence, and how far
a text's subwords may be less usual in the learning texts than its language's
(their mean log share; texts of few subwords may be further off).  The second
tells unlearned languages and letter noise, which the softmax may be sure of.

Scoring covers every row and every byte: embedding and layer are multiplied
out to one integer weight per bucket and language, so a score does not depend
on how rows are dealt to tasks.

Defined cases.  Text null or without a letter: ``und``, score 0, rejected.
Text with letters but no piece the model knows of: the learned prior decides.
No learning rows at all: every row is ``und``.  Rows that repeat are scored
alike.  Other columns are carried through by ``filter_languages`` only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm import textnum as tn
from feedlens.llm.common import hash_order, share_below
from feedlens.session import materialize

UND = "und"
SCALE = 1 << 20        # integer weights: exact sums
BORDER = 0x20
BEGINNINGS = (1, 3, 12)     # words of the short texts that calibration makes

_MAP = np.full(256, BORDER, np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def pieces(texts: list[bytes], buckets: int):
    """``(bucket, doc)`` index arrays of all subwords, one pair per length."""
    text, at = tn.joined(texts)
    b = _MAP[np.frombuffer(b"\n" + text, np.uint8)]     # text d's pieces start at at[d], its border, or later
    edge = b == BORDER
    w = b.astype(np.uint32)
    three = w[:-2] | (w[1:-1] << np.uint32(8)) | (w[2:] << np.uint32(16))
    for n in (3, 4):
        if len(b) < n:
            continue
        if n == 3:
            ok = np.flatnonzero(~edge[1:-1])
            code = three[ok]
        else:
            ok = np.flatnonzero(~(edge[1:-2] | edge[2:-1]))
            code = three[ok] | (w[3:][ok] << np.uint32(24))
        h = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D if n == 3 else 0x297A2D39)
        h ^= h >> np.uint32(12)
        h = h * np.uint32(0x9E3779B1)
        yield (h >> np.uint32(16)).astype(np.int32) % buckets, np.searchsorted(ok, at)


@dataclass
class LangModel:
    langs: list[str]
    weights: np.ndarray      # buckets x languages, integers
    bias: np.ndarray
    temperature: float
    threshold: float
    known: np.ndarray | None = None      # buckets, integers: log share in the learning texts
    usual: tuple | None = None           # mean of it by language, variance of a text and of a subword, limit

    def strange(self, texts: list[bytes], best: np.ndarray) -> np.ndarray:
        """Whether the subwords of texts named ``best`` are too unusual."""
        if self.usual is None:
            return np.zeros(len(texts), bool)
        total, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for idx, cut in pieces(texts, len(self.known)):
            count += np.diff(cut)
            acc = np.zeros(len(idx) + 1, np.int64)
            np.cumsum(self.known[idx], out=acc[1:])
            total += acc[cut[1:]] - acc[cut[:-1]]
        mean, wide, narrow, limit = self.usual
        n = np.maximum(count, 1)
        return (count > 0) & (distance(total / n / SCALE, n, mean[best], wide, narrow) > limit)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        count = np.zeros(len(texts), np.int64)
        for idx, cut in pieces(texts, len(self.weights)):
            count += np.diff(cut)
            for k in range(len(self.langs)):
                acc = np.zeros(len(idx) + 1, np.int64)
                np.cumsum(self.weights[:, k][idx], out=acc[1:])
                total[:, k] += acc[cut[1:]] - acc[cut[:-1]]
        return total / np.maximum(count, 1)[:, None] / SCALE + self.bias

    def probs(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def distance(share, n, mean, wide: float, narrow: float):
    """How many deviations a text's mean log share is below its language's."""
    return (mean - share) / np.sqrt(wide + narrow / n)


def sample(docs: DataFrame, learn, per_lang: int, total: int = 20_000) -> DataFrame:
    """The bounded learning sample ``(doc_id, lang, text)``, whole texts: of every
    language ``per_lang`` documents chosen by hash, or as many fewer as keep the
    whole sample within ``total`` (but one at least)."""
    rows = (docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
                .select("doc_id", "lang"))
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__size")), "language-sizes")
    each = max(1, min(per_lang, total // max(sizes.count(), 1)))
    # one row a language, as the model itself has one column a language
    thin = rows.join(F.broadcast(sizes), "lang").where(share_below(F.col("__size"), each)).select("doc_id", "lang").distinct()
    w = Window.partitionBy("lang").orderBy(hash_order("doc_id"), "doc_id")
    few = thin.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= each).select("doc_id", "lang")
    return (docs.select("doc_id", "lang", "text").join(F.broadcast(few), ["doc_id", "lang"])
                .dropDuplicates(["doc_id", "lang"]))


class Shares:
    """Rows of subword counts as shares, kept sparse; dense only a few rows at a time."""

    def __init__(self, idx: pa.ListArray, n: pa.ListArray, buckets: int):
        self.ends, self.idx, self.buckets = np.asarray(idx.offsets), np.asarray(idx.flatten()), buckets
        self.ends = self.ends - self.ends[0]
        count = np.asarray(n.flatten())
        row = np.repeat(np.arange(len(idx)), np.diff(self.ends))
        self.size = np.bincount(row, weights=count, minlength=len(idx)).astype(np.float32)
        self.share = (count / np.maximum(self.size, 1)[row]).astype(np.float32)

    def dense(self, at) -> np.ndarray:
        x = np.zeros((len(at), self.buckets), np.float32)
        for r, o in enumerate(at):
            lo, hi = self.ends[o], self.ends[o + 1]
            x[r, self.idx[lo:hi]] = self.share[lo:hi]
        return x

    def dot(self, m: np.ndarray) -> np.ndarray:
        rows = range(len(self.size))
        parts = [self.dense(rows[lo:lo + 256]) @ m for lo in range(0, len(rows), 256)]
        return np.concatenate(parts) if parts else np.zeros((0, *m.shape[1:]), np.float32)

    def mean(self, at: np.ndarray) -> np.ndarray:
        return sum((self.dense(at[lo:lo + 256]).sum(axis=0) for lo in range(0, len(at), 256)), np.zeros(self.buckets, np.float32)) / max(len(at), 1)


def train(docs: DataFrame, learn=None, per_lang: int = 400, total: int = 20_000, buckets: int = 8192, dim: int = 16,
          epochs: int = 30, rate: float = 4.0, loss: float = 0.001) -> LangModel | None:
    """Fits the model; ``learn`` selects the learning rows (default: all)."""
    learn = F.lit(True) if learn is None else learn

    def count(batches):
        for part in tn.chunks(batches, "text", 1 << 20):
            whole = tn.text_bytes(part.column("text"))
            cols, names = [part.column("doc_id"), part.column("lang")], ["doc_id", "lang"]
            for k in ("", *BEGINNINGS):
                texts = [b" ".join(t.split(None, k)[:k]) for t in whole] if k else whole
                found = [[] for _ in texts]
                for idx, cut in pieces(texts, buckets):
                    for d in range(len(texts)):
                        found[d].append(idx[cut[d]:cut[d + 1]])
                pairs = [np.unique(np.concatenate(f) if f else np.empty(0, np.int32), return_counts=True) for f in found]
                cols += [pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())),
                         pa.array([p[1].astype(np.float32) for p in pairs], pa.list_(pa.float32()))]
                names += [f"idx{k}", f"n{k}"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kinds = ", ".join(f"idx{k} array<int>, n{k} array<float>" for k in ("", *BEGINNINGS))
    rows = sample(docs, learn, per_lang, total).mapInArrow(count, f"doc_id long, lang string, {kinds}").toArrow()
    rows = rows.filter(pc.greater(pc.list_value_length(rows.column("idx")), 0))
    if not rows.num_rows:
        return None
    ids = rows.column("doc_id").to_numpy()
    order = np.lexsort((ids, (ids.astype(np.uint64) * np.uint64(tn.BASE)) >> np.uint64(20)))
    rows = rows.take(pa.array(order)).combine_chunks()
    lang = np.array(rows.column("lang").to_pylist(), object)
    langs = sorted(set(lang))
    number = {v: k for k, v in enumerate(langs)}
    y = np.array([number[v] for v in lang])

    def shares(k, at=None):
        """Subword shares of the rows (``at``)."""
        idx, n = (rows.column(f"{c}{k}").combine_chunks() for c in ("idx", "n"))
        if at is not None:
            idx, n = idx.take(pa.array(at)), n.take(pa.array(at))
        return Shares(idx, n, buckets)

    x = shares("")
    held = np.arange(len(y)) % 5 == 4
    if held.sum() < 20 or len(langs) < 2:
        held[:] = False
    fit = np.flatnonzero(~held)
    emb, lin, bias = descend(x, fit, y, len(langs), dim, epochs, rate)
    known = np.log(0.99 * x.mean(fit) + 0.01 / buckets)
    at = np.flatnonzero(held) if held.any() else fit
    back = shares("", at)
    cx, cy = back.dot(emb @ lin) + bias, y[at]
    best, threshold, usual = 1.0, 0.0, None
    if len(langs) > 1:
        def nll(t):
            z = cx / t
            z = z - z.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(cy)), cy]))
        best = min((2.0 ** (k / 4) for k in range(-16, 13)), key=nll)
        # what has to stay: held-back texts, their beginnings, and halves of two of them
        turn = np.roll(np.arange(len(cy)), 1)
        near, size = back.dot(known), back.size
        keep = [(cx, near, size), ((cx + cx[turn]) / 2, (near + near[turn]) / 2, size + size[turn])]
        for k in BEGINNINGS:
            part = shares(k, at)
            keep.append((part.dot(emb @ lin) + bias, part.dot(known), part.size))
        mean = np.array([near[cy == k].mean() if (cy == k).any() else near.mean() for k in range(len(langs))])
        sure, off = [], []
        for z, share, sizes in keep:
            z = np.exp((z - z.max(axis=1, keepdims=True)) / best)
            some = sizes > 0
            sure.append((z.max(axis=1) / z.sum(axis=1))[some])
            off.append(np.stack([share, sizes, mean[z.argmax(axis=1)]])[:, some])
        threshold = float(np.quantile(np.concatenate(sure), loss))
        wide = float(np.mean((off[0][0] - off[0][2]) ** 2)) + 1e-6
        share, n, usually = np.concatenate(off[2:], axis=1)
        narrow = float(np.mean(np.maximum((share - usually) ** 2 - wide, 0) * n))
        far = distance(*np.concatenate(off, axis=1), wide, narrow)
        usual = (mean, wide, narrow, float(np.quantile(far, 1 - loss)) * (1 + 2 / len(cy) ** 0.5))
    return LangModel(langs, np.rint(emb @ lin * SCALE).astype(np.int64), bias, best, threshold,
                     np.rint(known * SCALE).astype(np.int64), usual)


def descend(x: Shares, rows: np.ndarray, y, classes: int, dim: int, epochs: int, rate: float):
    """Mini-batch SGD on the embedding, the linear layer and its bias, over ``rows``."""
    rng = np.random.default_rng(7)
    emb = rng.normal(0, 0.1, (x.buckets, dim)).astype(np.float32)
    lin = rng.normal(0, 0.1, (dim, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rows[rng.permutation(len(rows))]
        for lo in range(0, len(order), 16):
            at = order[lo:lo + 16]
            batch = x.dense(at)
            h = batch @ emb
            z = h @ lin + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = z / z.sum(axis=1, keepdims=True)
            g[np.arange(len(at)), y[at]] -= 1
            g /= len(at)
            down = g @ lin.T
            lin -= step * 0.1 * (h.T @ g)
            bias -= step * 0.01 * g.sum(axis=0)
            touched = np.flatnonzero(batch.any(axis=0))
            emb[touched] -= step * 10 * (batch[:, touched].T @ down)
    return emb, lin, bias


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: LangModel | None, columns: list[str]) -> DataFrame:
    """``columns`` of every row with ``lang_pred``, ``score`` and ``rejected``."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(vars(model) if model else None)      # buckets x languages integers: bounded
    src = docs.select(*[F.col(f"`{c}`") for c in columns],
                      F.col("text").cast("string").alias("__text"))

    def run(batches):
        m = LangModel(**shared.value) if shared.value else None
        for part in tn.chunks(batches, "__text", 1 << 20):
            raw = part.column("__text")
            letter = np.array([has_letter(t) for t in raw.to_pylist()], bool)
            if m is None:
                letter[:] = False
            pred, score, strange = np.full(len(raw), UND, object), np.zeros(len(raw)), np.zeros(len(raw), bool)
            if letter.any():
                texts = tn.text_bytes(raw)
                p = m.probs(m.logits(texts))
                best = p.argmax(axis=1)
                strange = m.strange(texts, best)
                pred[letter] = np.array(m.langs, object)[best[letter]]
                score[letter] = np.round(p[np.arange(len(best)), best], 9)[letter]
            out = ~letter | strange | (score < (m.threshold if m else 0.0))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(out)],
                [*columns, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in src.dtypes[:-1])
    return src.mapInArrow(run, f"{kinds}{', ' if kinds else ''}lang_pred string, score double, rejected boolean")


def filter_languages(docs: DataFrame, model: LangModel | None) -> DataFrame:
    """``docs`` without the rows that the model rejects; same columns."""
    temp = docs.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(docs.columns)}).withColumn(
        "text", F.col(f"c{docs.columns.index('text')}"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = predict(temp, model, names).where(~F.col("rejected")).select(*names)
    return kept.toDF(*docs.columns)
