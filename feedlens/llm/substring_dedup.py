"""Substring dedup by level-wise doubling of repeated word windows.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A window is ``length``
consecutive words of one document; every word covered by a window whose word
sequence also starts anywhere else (the same document included) is removed.

Levels.  The first level looks at windows of ``start`` words.  Two equal
windows of ``length`` words hold equal ``start``-word windows at every offset,
so one of them stands for the whole window: the one with the smallest hash
(the same in both).  Only these are counted corpus-wide.  A window of the next
level, twice as long, is looked at only where the one below is repeated, and
so on up to ``length``; a level without repeats leaves nothing to extend.
Counting uses the exchange of ``shards``: distinct 64-bit window hashes per
shard go out, one bit per hash comes back.

Defined cases.  Null or empty text: no words.  Rows are judged one by one, so
a row that is repeated, whatever its doc_id, is a copy and loses its windows;
doc_ids, null included, are only carried.  Texts of less than ``length`` words
lose nothing.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedlens.llm import shards as S
from feedlens.llm import textnum as tn

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` consecutive values."""
    have, n = 1, len(x) - width + 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[:n], x[width - have:width - have + n])


class Windows:
    """The windows of one shard's texts and their first-level representatives."""

    def __init__(self, texts: list[bytes], start: int, length: int):
        self.data, self.starts, self.ends, self.first = tn.doc_words(texts, tn.NOT_SPACE)
        self.words = tn.hash_spans(self.data, self.starts, self.ends)
        self.start, self.length = start, length
        n = len(self.words) - length + 1
        self.valid = np.zeros(max(n, 0), bool)
        self.least = np.zeros(max(n, 0), np.uint64)
        self.keys = np.empty(0, np.uint64)
        self.twice = np.empty(0, bool)
        if n <= 0:
            return
        doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.valid = doc[:n] == doc[length - 1:]
        low = tn.window_hashes(self.words, start)
        span = length - start + 1
        self.least = sliding(low, span, np.minimum)
        # Places that stand for some window: distinct places, so two of one hash are a repeat.
        up = np.concatenate([np.zeros(span - 1, np.uint64), np.where(self.valid, self.least, np.uint64(0)),
                             np.zeros(span - 1, np.uint64)])
        chosen = low[sliding(up, span, np.maximum) == low]
        self.keys, count = np.unique(chosen, return_counts=True)
        self.twice = count > 1

    def candidates(self, live: np.ndarray) -> np.ndarray:
        """Start words of the windows whose representative is repeated."""
        at = np.flatnonzero(self.valid)
        if not len(at) or not live.any():
            return at[:0]
        k = np.searchsorted(self.keys, self.least[at])
        return at[live[k]]

    def level(self, at: np.ndarray, size: int):
        """Hashes of the ``size`` words at the places ``at``: of each, and distinct with 'twice'."""
        h = tn.window_hashes(self.words, size)[at] if len(at) else np.empty(0, np.uint64)
        keys, back, count = np.unique(h, return_inverse=True, return_counts=True)
        return keys, back, count > 1


def survivors(w: Windows, cells: list, sizes: list[int], n_ranges: int):
    """Window starts that are repeated at every level answered so far."""
    at = None
    for cell, size in zip(cells, [w.start, *sizes], strict=False):
        if at is None:
            at = w.candidates(S.answer_bits(cell, S.asked(w.keys, n_ranges)))
        else:
            keys, back, _ = w.level(at, size)
            at = at[S.answer_bits(cell, S.asked(keys, n_ranges))[back]] if len(at) else at
    return at


def doubled(start: int, length: int) -> list[int]:
    """The lengths above the first level: doubled, the last cut to ``length``."""
    out, n = [], start
    while n < length:
        n = min(2 * n, length)
        out.append(n)
    return out


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 35, start: int | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: word counts, removed spans (in words) and the SHA-256 of the
    words left, joined by one space; ``with_text`` adds them as ``kept``."""
    start = start or (length + 1) // 2
    sizes = doubled(start, length) or [length]
    table = S.build(docs)
    n = S.ranges(table, 0.02)
    names: list[str] = []
    answers: dict[str, DataFrame] = {}
    for k in range(len(sizes) + 1):
        def ask(batches, level=k, names=tuple(names)):
            for batch in batches:
                cells = [batch.column(c).to_pylist() for c in names]
                for i, (shard, _, _, texts) in enumerate(S.rows_of(batch)):
                    w = Windows(texts, start, length)
                    if level == 0:
                        keys, twice = w.keys, w.twice
                    else:
                        at = survivors(w, [c[i] for c in cells], sizes, n)
                        keys, _, twice = w.level(at, sizes[level - 1])
                    yield S.question(shard, keys, twice.astype(np.int64) + 1, n)

        src = S.with_answers(table, **answers)
        answers[f"level{k}"] = S.exchange(src.mapInArrow(ask, S.QUESTION), True, f"repeats-{k}")
        names.append(f"level{k}")

    span = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))

    def finish(batches):
        for batch in batches:
            cells = [batch.column(c).to_pylist() for c in names]
            for i, (_, ids, _, texts) in enumerate(S.rows_of(batch)):
                w = Windows(texts, start, length)
                at = survivors(w, [c[i] for c in cells], sizes, n)
                edge = np.zeros(len(w.words) + 1, np.int32)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                yield result(w, ids, gone, span, with_text)

    schema = RESULT + ", spans array<struct<start: int, words: int>>" + ", kept string" * with_text
    return S.with_answers(table, **answers).mapInArrow(finish, schema)


def result(w: Windows, ids: list, gone: np.ndarray, span, with_text: bool) -> pa.RecordBatch:
    stay = ~gone
    data = w.data.copy()
    data[w.ends] = 0x20                       # the byte after a word parts it from the next
    edge = np.zeros(len(data) + 1, np.int8)
    edge[w.starts[stay]] += 1
    edge[w.ends[stay] + 1] -= 1
    kept = data[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
    sizes = np.concatenate([[0], np.cumsum(np.where(stay, w.ends - w.starts + 1, 0))])[w.first]
    n_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
    texts, spans = [], []
    for d in range(len(ids)):
        texts.append(kept[sizes[d]:max(sizes[d], sizes[d + 1] - 1)])
        if n_gone[d]:
            e = np.diff(gone[w.first[d]:w.first[d + 1]].astype(np.int8), prepend=0, append=0)
            spans.append([{"start": a, "words": b - a} for a, b in
                          zip(np.flatnonzero(e == 1).tolist(), np.flatnonzero(e == -1).tolist(), strict=True)])
        else:
            spans.append([])
    cols = [pa.array(ids, pa.int64()), pa.array(np.diff(w.first).astype(np.int64)), pa.array(n_gone.astype(np.int64)),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(spans, span)]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
    if with_text:
        cols.append(pa.array([t.decode() for t in texts], pa.string()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(cols, names)
