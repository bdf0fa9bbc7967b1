"""Language-model scores by deleted interpolation of n-gram estimates.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased,
then one end token.  The probability of a token ``w`` after ``v`` mixes
maximum-likelihood estimates over all learning texts:

    p(w | v) = l2[b] * c(v w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1)

``b`` is the bucket of the context's count c(v) (powers of two; bucket 0 is a
context never seen, with l2 = 0).  The first token's context is a begin mark.

Weights are learned by expectation-maximisation on held-out counts, held out
by deletion: every learning token in turn is taken out of all counts before
its own estimates are formed.  What EM needs of the corpus is a histogram over
(bucket, log ratio of the order-2 and of the order-1 estimate to the uniform
one) in steps of 1/``STEPS`` octave: it covers every token, its size is fixed
by the ranges of the ratios, and only it reaches the driver.

Counts of words and word pairs are corpus-wide and exact (64-bit hashes of the
words stand for them), by the exchange of ``shards``: the corpus' distinct
n-grams per shard are what is moved.

Defined cases.  Null or empty text: the end token alone.  Rows are scored one
by one; a repeated doc_id or row counts as often as it stands there.  With no
learning rows N and V are 0, every count is 0 and every token has probability
1.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm import shards as S
from feedlens.llm import textnum as tn

BUCKETS = 24
STEPS = 8                 # histogram steps an octave
LOW, HIGH = -34, 62       # octaves of the ratios that the histogram tells apart
END = np.uint64(0x1B873593CC9E2D51)
BEGIN = np.uint64(0x85EBCA6BC2B2AE35)
PAIR = np.uint64(0xD6E8FEB86659FD93)


class Tokens:
    """The tokens of one shard, their distinct words and pairs, and learning counts."""

    def __init__(self, texts: list[bytes], learn: list[bool]):
        data, starts, ends, first = tn.doc_words(texts, tn.NOT_SPACE, tn.LOWER)
        n = np.diff(first) + 1                                  # with the end token
        self.first = np.concatenate([[0], np.cumsum(n)])
        last = self.first[1:] - 1
        word = np.empty(self.first[-1], np.uint64)
        is_end = np.zeros(len(word), bool)
        is_end[last] = True
        word[is_end] = END
        word[~is_end] = tn.hash_spans(data, starts, ends)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.first[:-1]] = BEGIN
        learning = np.repeat(np.array([bool(x) for x in learn], bool), n)
        pair = tn.mix(before * PAIR + word)
        self.words, self.word_of = np.unique(word, return_inverse=True)
        self.word_count = np.bincount(self.word_of[learning], minlength=len(self.words))
        self.pairs, self.pair_of = np.unique(pair, return_inverse=True)
        self.pair_count = np.bincount(self.pair_of[learning], minlength=len(self.pairs))
        # The word and the context of each distinct pair.
        some = np.empty(len(self.pairs), np.int64)
        some[self.pair_of] = np.arange(len(word))
        self.pair_word = self.word_of[some]
        ctx = np.searchsorted(self.words, before[some])
        begin = before[some] == BEGIN
        self.pair_context = np.where(begin, -1, np.minimum(ctx, len(self.words) - 1))

    def counts(self, word_cell, pair_cell, begins: int):
        """Corpus counts of each distinct pair: c(v w), c(v), c(w)."""
        c_word = S.answer_counts(word_cell)
        c_pair = S.answer_counts(pair_cell)
        c_ctx = np.where(self.pair_context < 0, begins, c_word[self.pair_context])
        return c_pair, c_ctx, c_word[self.pair_word]


def bucket(n: np.ndarray) -> np.ndarray:
    """0 for a count of 0, else 1 + the whole part of its logarithm to base 2."""
    out = np.zeros(len(n), np.int64)
    some = n > 0
    out[some] = np.minimum(np.frexp(n[some].astype(np.float64))[1], BUCKETS - 1)
    return out


def ratio_bin(x: np.ndarray) -> np.ndarray:
    """Histogram step of a ratio; 0 is the step of ratio zero."""
    out = np.zeros(len(x), np.int64)
    some = x > 0
    octave = np.clip(np.log2(x[some]), LOW, HIGH - 1 / STEPS)
    out[some] = 1 + np.floor((octave - LOW) * STEPS + 0.5).astype(np.int64)
    return out


def bin_ratio(k: np.ndarray) -> np.ndarray:
    return np.where(k == 0, 0.0, np.exp2((k - 1) / STEPS + LOW))


@dataclass
class Corpus:
    """Totals of the learning texts and the mixture weights by bucket."""
    tokens: int
    distinct: int
    begins: int
    weights: list[list[float]]      # per bucket: l2, l1, l0


def em(cells: list[tuple[int, int, int, int]], rounds: int = 200) -> list[list[float]]:
    """Mixture weights by bucket from the histogram ``(bucket, bin 2, bin 1, tokens)``."""
    out = [[0.0, 0.5, 0.5] if b == 0 else [1 / 3] * 3 for b in range(BUCKETS)]
    a = np.array(sorted(cells), np.int64).reshape(-1, 4)
    for b in range(BUCKETS):
        c = a[a[:, 0] == b]
        if not len(c):
            if b:
                out[b] = list(out[b - 1])
            continue
        f = np.stack([bin_ratio(c[:, 1]), bin_ratio(c[:, 2]), np.ones(len(c))], 1)
        n = c[:, 3].astype(np.float64)
        lam = np.array(out[b])
        for _ in range(rounds):
            part = f * lam
            new = (part / part.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            done = np.abs(new - lam).max() < 1e-9
            lam = new
            if done:
                break
        lam = np.maximum(lam, [0.0 if b == 0 else 1e-6, 1e-6, 1e-6])   # nothing is impossible
        out[b] = (lam / lam.sum()).tolist()
    return out


def ask(which: str, n_ranges: int):
    def run(batches):
        for batch in batches:
            for shard, _, flags, texts in S.rows_of(batch):
                t = Tokens(texts, flags)
                yield S.question(shard, getattr(t, which), getattr(t, which[:-1] + "_count"), n_ranges)
    return run


def fit(docs: DataFrame, learn) -> tuple[DataFrame, Corpus]:
    """The shard table with its answered counts, and the fitted model.

    ``learn`` is a boolean column that selects the learning texts."""
    table = S.build(docs, F.coalesce(learn, F.lit(False)))
    answers = {}
    for which, share in (("words", 0.03), ("pairs", 0.11)):
        n = S.ranges(table, share)
        answers[which] = S.exchange(table.mapInArrow(ask(which, n), S.QUESTION), False, which)
    total = answers["words"].where("shard is null").agg(F.sum("distinct"), F.sum("total")).first()
    begins = table.agg(F.sum(F.size(F.filter("flags", lambda x: x)))).first()[0]
    n, v, begins = int(total[1] or 0), int(total[0] or 0), int(begins or 0)
    counted = S.with_answers(table, **answers)

    def histogram(batches):
        for batch in batches:
            words, pairs = batch.column("words").to_pylist(), batch.column("pairs").to_pylist()
            for i, (_, _, flags, texts) in enumerate(S.rows_of(batch)):
                t = Tokens(texts, flags)
                c_pair, c_ctx, c_word = t.counts(words[i], pairs[i], begins)
                own = t.pair_count > 0
                mass = t.pair_count[own]
                ctx = c_ctx[own] - 1                        # the token itself is taken out
                f2 = np.where(ctx > 0, (c_pair[own] - 1) / np.maximum(ctx, 1), 0.0) * (v + 1)
                f1 = (c_word[own] - 1) / max(n - 1, 1) * (v + 1)
                code = (bucket(ctx) * 1024 + ratio_bin(f2)) * 1024 + ratio_bin(f1)
                code, back = np.unique(code, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.bincount(back, mass, len(code)).astype(np.int64))],
                                                 ["code", "n"])

    cells = counted.mapInArrow(histogram, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    weights = em([(r["code"] >> 20, (r["code"] >> 10) & 1023, r["code"] & 1023, r["n"]) for r in cells])
    return counted, Corpus(n, v, begins, weights)


SCORES = ("doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(counted: DataFrame, model: Corpus) -> DataFrame:
    """One row per document: token counts, the add-one unigram score and the model's, log10."""
    def run(batches):
        lam = np.array(model.weights)
        n, v = model.tokens, model.distinct
        for batch in batches:
            words, pairs = batch.column("words").to_pylist(), batch.column("pairs").to_pylist()
            for i, (_, ids, flags, texts) in enumerate(S.rows_of(batch)):
                t = Tokens(texts, flags)
                c_pair, c_ctx, c_word = t.counts(words[i], pairs[i], model.begins)
                mix = lam[bucket(c_ctx)]
                p = (mix[:, 0] * c_pair / np.maximum(c_ctx, 1) + mix[:, 1] * c_word / max(n, 1) + mix[:, 2] / (v + 1))
                if not n:
                    p[:] = 1.0
                base = np.log10((c_word + 1) / (n + v + 1))[t.pair_of]
                full = np.log10(p)[t.pair_of]
                known = (c_word > 0)[t.pair_of].astype(np.int64)
                cut = t.first[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([bool(x) for x in flags]), pa.array(np.diff(t.first).astype(np.int64)),
                     pa.array(np.add.reduceat(known, cut)), pa.array(np.full(len(ids), n, np.int64)),
                     pa.array(np.add.reduceat(base, cut)), pa.array(np.add.reduceat(full, cut))],
                    ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.mapInArrow(run, SCORES)
