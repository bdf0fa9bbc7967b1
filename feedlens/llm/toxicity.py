"""Toxicity scores: gradient-boosted trees over dense features, isotonic calibration.

Features of a text: densities and counts of lexicon hits (whole words and word
beginnings), their learned weights, hits beside a second-person word, hits
that show only once disguises are undone, capitals, punctuation, and disguised
words: those with digits or symbols of ``DISGUISE`` and ``DROPPED`` inside or at
an end (``DROPPED`` at an end and closing ``!`` are punctuation, unless undoing
them shows a hit).  The lexicon is learned: words, and word
beginnings of 4 to 8 letters, that are far more frequent in toxic learning
texts; the ``lexicon`` strongest are kept.

Learning uses a bounded sample of labelled rows: at most ``per_class`` of each
class, those with the smallest hash of doc_id, whole texts, weighted back to
the classes' true shares.  A quarter of it is held back, and an isotonic
regression on it turns the trees' margin into a probability.  Scoring covers
every row and whole texts.

Defined cases.  Null text is the empty text and is scored.  Labels that are
null or neither 0 nor 1 teach nothing; of several labels of a doc_id the
larger counts.  If the learning rows lack a class, every score is the share of
toxic ones among them (0 without any).  Rows that repeat are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm import textnum as tn
from feedlens.llm.common import hash_order, share_below
from feedlens.session import materialize

NAMES = ["hits", "hit_density", "weight", "weight_density", "strongest", "near_second_person", "second_person",
         "disguised", "disguised_words", "capitals", "exclamations", "punctuation", "log_words"]
INNER = [f"__f_{n}" for n in NAMES]      # columns of their own beside the caller's
#: fixed values: second-person words of the languages at hand, in UTF-8
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos "
                 "ti usted ustedes tus vosotros su").split()
PREFIXES = (4, 5, 6, 7, 8)
NEAR = 40                 # bytes between a hit and a second-person word
UPPER = bytes(range(65, 91))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
PLAIN = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))
#: fixed values: symbols that stand for letters
DISGUISE = bytes.maketrans(b"013457@$!|", b"oieastasil")
DROPPED = b"*._-~'`^"
SYMBOLS = b"0123456789@$!|" + DROPPED
#: a run of letters and SYMBOLS with at least one of SYMBOLS; linear in the text
ODD = re.compile(rb"(?<![a-z\x80-\xff%b])[a-z\x80-\xff]*+[%b][a-z\x80-\xff%b]*+" % ((re.escape(SYMBOLS),) * 3))


def plain(text: bytes) -> str:
    """Letters only, one byte a character, borders as spaces."""
    return " " + text.translate(PLAIN).decode("latin-1") + " "


def open_up(text: bytes) -> str:
    """The same after undoing disguises."""
    return plain(text.translate(DISGUISE, DROPPED))


def disguised(text: bytes, find, odd) -> tuple[int, int]:
    """How many hits show only once disguises are undone, and how many words are disguised."""
    hits = words = 0
    for t in odd.findall(text):
        core = t.strip(DROPPED)
        bare = core.rstrip(b"!" + DROPPED)
        letters = bare.translate(None, SYMBOLS)
        if not letters or len(letters) == len(core):
            continue
        new = max(count_hits(open_up(w), find) for w in {core, bare, core[:len(bare) + 1]}) - count_hits(plain(t), find)
        hits += max(0, new)
        words += len(letters) < len(bare) or new > 0
    return hits, words


def count_hits(flat: str, find) -> int:
    return sum(1 for _, (unit, _) in find.iter(flat) if unit)


def units(text: bytes) -> set[str]:
    """Words and word beginnings of a text: ' word ' and ' begi'."""
    out = set()
    for w in set(plain(text).split()):
        u = w.encode("latin-1").decode("utf-8", "ignore")
        out.add(f" {w} ")
        for n in PREFIXES:
            if len(u) > n:
                out.add(" " + u[:n].encode().decode("latin-1"))
    return out


def lowered(column) -> list[bytes]:
    return [(t or "").lower().encode() for t in column.to_pylist()]


def automaton(weights: dict[str, float]):
    import ahocorasick
    a = ahocorasick.Automaton()
    for w in SECOND_PERSON:
        a.add_word(f" {w.encode().decode('latin-1')} ", ("", 0.0))
    for u, w in weights.items():
        a.add_word(u, (u, w))
    a.make_automaton()
    return a


def features(raw: bytes, text: bytes, find, odd) -> list[float]:
    """The feature values of one text; ``text`` is ``raw`` lower-cased."""
    hits, second = [], []
    flat = plain(text)
    for end, (unit, w) in find.iter(flat):
        (hits if unit else second).append((end, w))
    n = max(1, flat.count(" ") - 1)
    starts = {e for e, _ in hits}
    more, odd_words = disguised(text, find, odd)
    near, at = 0, np.array([e for e, _ in second])
    if hits and second:
        k = np.searchsorted(at, [e for e, _ in hits])
        for (e, _), p in zip(hits, k, strict=True):
            near += any(0 <= q < len(at) and abs(int(at[q]) - e) <= NEAR for q in (p - 1, p))
    weight = [w for _, w in hits]
    letters = max(1, len(raw))
    return [float(len(starts)), len(starts) / n, sum(weight), sum(weight) / n, max(weight, default=0.0), near / n * 100,
            len(second) / n, float(more), odd_words / n,
            (len(raw) - len(raw.translate(None, UPPER))) / letters, text.count(b"!") / n,
            (len(raw) - len(raw.translate(None, MARKS))) / letters, math.log1p(n)]


def with_features(docs: DataFrame, weights: dict[str, float], columns: list[str]) -> DataFrame:
    """``columns`` of every row with one double per feature."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)       # the lexicon: bounded
    src = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("__text"))

    def run(batches):
        find = automaton(shared.value)
        for part in tn.chunks(batches, "__text"):
            raw, low = tn.text_bytes(part.column("__text")), lowered(part.column("__text"))
            x = np.array([features(r, t, find, ODD) for r, t in zip(raw, low, strict=True)], np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(x[:, k].copy()) for k in range(x.shape[1])]],
                                             [*columns, *INNER])

    kinds = ", ".join(f"`{c}` {t}" for c, t in src.dtypes[:-1])
    return src.mapInArrow(run, ", ".join([kinds, *[f"{n} double" for n in INNER]]))


def sample(docs: DataFrame, labels: DataFrame, learn, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """The learning sample ``(doc_id, y, text)`` and the classes' sizes."""
    y = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(learn)
               .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")))
    y = y.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [y.where((F.col("y") == c) & share_below(F.lit(sizes.get(c, 0)), per_class)).orderBy(hash_order("doc_id"), "doc_id").limit(per_class)
           for c in (0, 1)]
    few = few[0].unionByName(few[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"])
    return materialize(rows, "toxic-sample"), sizes


def learn_lexicon(rows: DataFrame, size: int, least: int = 4, odds: float = 3.0) -> dict[str, float]:
    """Unit -> log odds of standing in a toxic text, for the ``size`` strongest units."""
    def count(batches):
        for part in tn.chunks(batches, "text", 8 << 20):
            n: list[Counter] = [Counter(), Counter()]
            for y, t in zip(part.column("y").to_pylist(), lowered(part.column("text")), strict=True):
                n[y].update(units(t))
            keys = list(n[0].keys() | n[1].keys())       # every unit: only totals are held against limits
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([n[1][u] for u in keys], pa.int64()),
                                              pa.array([n[0][u] for u in keys], pa.int64())], ["unit", "bad", "good"])

    t = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = t.get(1, 0), t.get(0, 0)
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    top = (rows.mapInArrow(count, "unit string, bad long, good long").groupBy("unit")
               .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
               .where(F.col("bad") >= max(least, bad // 300)).withColumn("w", ratio).where(F.col("w") >= odds)
               .orderBy(F.desc(F.col("bad") * F.col("w")), "unit").limit(size).collect())
    return {r["unit"]: float(r["w"]) for r in top}


class Model:
    """A fitted scorer: lexicon, trees and calibration, or one constant score."""

    def __init__(self, lexicon=None, trees=None, curve=None, constant: float = 0.0):
        self.lexicon, self.trees, self.curve, self.constant = lexicon or {}, trees, curve, constant

    def margins(self, x: DataFrame) -> DataFrame:
        v = VectorAssembler(inputCols=INNER, outputCol="__x").transform(x)
        out = self.trees.transform(v)
        return out.withColumn("__margin", vector_to_array("__raw")[1])

    def score(self, docs: DataFrame, columns: list[str]) -> DataFrame:
        """``columns`` of every row with ``score`` in 0..1."""
        if self.trees is None:
            return docs.select(*columns).withColumn("score", F.lit(float(self.constant)))
        out = self.curve.transform(self.margins(with_features(docs, self.lexicon, columns)))
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("__p"), F.lit(0.0))))
        return out.select(*columns, p.alias("score"))


def train(docs: DataFrame, labels: DataFrame, learn, per_class: int = 4000, lexicon: int = 400,
          trees: int = 12, depth: int = 3) -> Model:
    """Fits lexicon, trees and calibration on the labelled rows that ``learn`` selects."""
    rows, sizes = sample(docs, labels, learn, per_class)
    if len(sizes) < 2:
        return Model(constant=1.0 if sizes.get(1) else 0.0)
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held")), F.lit(4)) == 0
    words = learn_lexicon(rows.where(~held), lexicon)
    got = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(sizes[1] / got[1])).otherwise(F.lit(sizes[0] / got[0]))
    x = materialize(with_features(rows, words, ["doc_id", "y", "text"]).drop("text").withColumn("__w", share)
                    .withColumn("label", F.col("y").cast("double")), "toxic-features")
    fit, rest = x.where(~held), x.where(held)
    if fit.select("y").distinct().count() < 2 or rest.select("y").distinct().count() < 2:
        fit, rest = x, x
    v = VectorAssembler(inputCols=INNER, outputCol="__x").transform(fit)
    gbt = GBTClassifier(featuresCol="__x", labelCol="label", weightCol="__w", predictionCol="__pred", maxIter=trees,
                        maxDepth=depth, seed=11).setRawPredictionCol("__raw").setProbabilityCol("__prob").fit(v)
    model = Model(words, gbt)
    iso = IsotonicRegression(featuresCol="__margin", labelCol="label", weightCol="__w", predictionCol="__p")
    model.curve = iso.fit(model.margins(rest))
    return model
