"""Benchmark decontamination by suffix arrays over the training texts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  The
training texts are read once, in shards of about a million words that one task
holds at a time.  A shard gets a suffix array over its words, sorted to the
length of a window.  Every suffix of every item is binary-searched in every
shard: the search narrows the range of matching suffixes word by word, which
gives all places of the item's windows.  Hits come from the ranges as they
are.  Verbatim matches are followed to their whole length, by binary search
over hashes of stretches, from the places where text and item differ in the
word before, so repeated words cost no more than others.  A window is
``window`` consecutive item words; an item with fewer, but not none, is one
window.  A document word inside any
occurrence of a window is hit; a document with a hit is contaminated.

The benchmark reaches the tasks in blocks of about ``block_bytes`` of text,
gathered and broadcast one block at a time, each searched against all
documents; the blocks' findings are merged.  Only per-document findings leave
a task.

Defined cases.  Null or wordless texts and items: no words, no hits.  Items
without an id take no part.  Rows that repeat an item_id are one item with
several texts.  Document rows are judged one by one: a null or repeated
doc_id is carried as it is.  Words of different documents never form a match.
An empty benchmark hits nothing.  Extra columns are carried, not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm import textnum as tn
from feedlens.session import materialize

SHARD = 1 << 20        # words of a shard; word ids fit 21 bits
NO_WORD = np.array([0x5D1A_0000_0000_0001, 0x5D1A_0000_0000_0002], np.uint64)    # before a text's, an item's first word


@dataclass
class Items:
    """Tokenised benchmark items: word hashes of all items, end to end."""
    ids: list[str]
    words: np.ndarray      # uint64
    item: np.ndarray       # of each word
    end: np.ndarray        # of each word: one past its item's last word


def tokenise(ids: list[str], texts: list[bytes]) -> Items:
    data, s, e, first = tn.doc_words(texts, tn.ALNUM, tn.LOWER)
    n = np.diff(first)
    return Items(ids, tn.hash_spans(data, s, e), np.repeat(np.arange(len(ids)), n),
                 np.repeat(first[1:], n))


def suffix_array(sym: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of their first ``depth`` symbols at least.

    Symbols are below 2**21.  The first sort packs three of them into one key;
    then the known depth doubles, and only ties are sorted again."""
    n = len(sym)
    pad = np.concatenate([sym, np.zeros(2, np.int64)])
    key = (pad[:-2] << 42) | (pad[1:-1] << 21) | pad[2:]
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    known = 3
    alone = np.concatenate([new[1:], [True]]) & new
    at = np.flatnonzero(~alone)
    while known < depth and len(at):
        pos = order[at]
        group, then = rank[pos], rank[np.minimum(pos + known, n)]
        o = np.lexsort((then, group))
        pos, group, then = pos[o], group[o], then[o]
        order[at] = pos
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        rank[pos] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~(np.concatenate([new[1:], [True]]) & new)]
        known *= 2
    return order


def bound(sym, sa, depth, lo, hi, want, right):
    """First place in each [lo, hi) whose symbol at ``depth`` is >= want (> if right)."""
    lo, hi = lo.copy(), hi.copy()
    last = len(sym) - 1
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        at = sa[mid] + depth
        got = np.where(at > last, -1, sym[np.minimum(at, last)])
        less = got <= want[open_] if right else got < want[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]


def search(sym: np.ndarray, sa: np.ndarray, test: np.ndarray, end: np.ndarray, window: np.ndarray):
    """For every test suffix: longest match, one place of it, range of its window.

    ``test``: symbols of all suffixes (0: not in the shard); ``end``: where the
    suffix's item ends; ``window``: the length its window has."""
    n = len(test)
    length, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    wlo, whi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    act = np.arange(n)
    lo, hi, depth = np.zeros(n, np.int64), np.full(n, len(sa), np.int64), 0
    while len(act):
        want = test[act + depth]
        ok = want > 0
        act, lo, hi, want = act[ok], lo[ok], hi[ok], want[ok]
        lo2 = bound(sym, sa, depth, lo, hi, want, False)
        hi2 = bound(sym, sa, depth, lo2, hi, want, True)
        ok = lo2 < hi2
        act, lo, hi = act[ok], lo2[ok], hi2[ok]
        depth += 1
        length[act], place[act] = depth, sa[lo] if len(lo) else lo
        full = window[act] == depth
        wlo[act[full]], whi[act[full]] = lo[full], hi[full]
        more = act + depth < end[act]
        act, lo, hi = act[more], lo[more], hi[more]
    return length, place, wlo, whi


def prefixes(h: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any stretch of words (``same``)."""
    acc = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * tn.tables(len(h) + 1)[0][:len(h)], out=acc[1:])
    return acc


def match_lengths(docs: np.ndarray, items: np.ndarray, at, suffix, limit) -> np.ndarray:
    """Length of the common prefix of each (document word, item word) pair, at most
    ``limit``: a binary search over hashes of stretches."""
    inv = tn.tables(max(len(docs), len(items)))[1]
    lo, hi = np.zeros(len(at), np.int64), limit.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = (docs[at + mid] - docs[at]) * inv[at] == (items[suffix + mid] - items[suffix]) * inv[suffix]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def repeat_ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All integers of the ranges ``lo .. lo + size``, end to end."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lo, size)


def left_ends(wlo, whi, prev, before, back, sa):
    """``(suffix, document word)`` pairs whose windows match and whose previous words
    differ: where the longest matches begin.

    Suffixes with one range and one previous word are looked at together, so a
    word repeated in item and text costs its places once, not once a suffix."""
    t = np.flatnonzero(whi > wlo)
    kinds, of = np.unique(np.stack([wlo[t], whi[t], prev[t].view(np.int64)], 1), axis=0, return_inverse=True)
    of = of.ravel()
    size = kinds[:, 1] - kinds[:, 0] if len(kinds) else np.zeros(0, np.int64)
    kind = np.repeat(np.arange(len(kinds)), size)
    at = back[sa[repeat_ranges(kinds[:, 0], size)]] if len(kinds) else np.zeros(0, np.int64)
    fresh = before[at] != kinds[kind, 2].view(np.uint64) if len(kinds) else np.zeros(0, bool)
    kind, at = kind[fresh], at[fresh]
    t = t[np.argsort(of, kind="stable")]
    n = np.bincount(of, minlength=len(kinds))
    first = np.cumsum(n) - n
    return t[repeat_ranges(first[kind], n[kind])], np.repeat(at, n[kind])


def find(texts: list[bytes], items: Items, window: int):
    """Findings in one chunk: ``(n_words, hit, pairs)``; ``pairs`` are
    (document, word in it, item, word in the item, words matched)."""
    data, s, e, first = tn.doc_words(texts, tn.ALNUM, tn.LOWER)
    n_words = np.diff(first)
    words = tn.hash_spans(data, s, e)
    hit = np.zeros(len(words), bool)
    found = []
    if len(words) and len(items.words):
        doc = np.repeat(np.arange(len(texts)), n_words)
        # One separator after each document; position of every word among them.
        spot = np.arange(len(words)) + doc
        total = len(words) + len(texts)
        start = np.flatnonzero(np.concatenate([[True], items.item[1:] != items.item[:-1]]))
        mine = start[np.cumsum(np.isin(np.arange(len(items.words)), start)) - 1]     # each word's item's first word
        wide = np.minimum(window, items.end - mine)
        fits = np.arange(len(items.words)) + wide <= items.end
        # The words before; the first ones have marks that equal nothing.
        before = np.concatenate([[np.uint64(0)], words[:-1]])
        before[first[:-1][n_words > 0]] = NO_WORD[0]
        prev = np.concatenate([[np.uint64(0)], items.words[:-1]])
        prev[start] = NO_WORD[1]
        sums = None
        step = SHARD - window - 2          # shards overlap by a window; matches are followed in the texts
        for a in range(0, total, step):
            lo, hi = np.searchsorted(spot, [a, a + SHARD - 2])
            if lo == hi:
                continue
            vocab, ids = np.unique(words[lo:hi], return_inverse=True)
            sym = np.zeros(int(spot[hi - 1] - spot[lo]) + 2, np.int64)
            sym[spot[lo:hi] - spot[lo]] = ids + 1
            back = np.full(len(sym), -1, np.int64)
            back[spot[lo:hi] - spot[lo]] = np.arange(lo, hi)
            k = np.minimum(np.searchsorted(vocab, items.words), len(vocab) - 1)
            test = np.where(vocab[k] == items.words, k + 1, 0)
            sa = suffix_array(sym, window)
            reach = np.minimum(items.end, np.arange(len(test)) + wide)
            _, _, wlo, whi = search(sym, sa, test, reach, np.where(fits, wide, -1))
            for size in np.unique(wide[whi > wlo]):
                some = np.flatnonzero((whi > wlo) & (wide == size))
                cover = np.zeros(len(sa) + 1, np.int32)
                np.add.at(cover, wlo[some], 1)
                np.add.at(cover, whi[some], -1)
                at = back[sa[np.flatnonzero(np.cumsum(cover[:-1]) > 0)]]
                edge = np.zeros(len(words) + 1, np.int32)
                edge[at] += 1
                np.add.at(edge, at + size, -1)
                hit |= np.cumsum(edge[:-1]) > 0
            suffix, at = left_ends(wlo, whi, prev, before, back, sa)
            if len(at):
                sums = sums or (prefixes(words), prefixes(items.words))
                d, it = doc[at], items.item[suffix]
                length = match_lengths(*sums, at, suffix, np.minimum(items.end[suffix] - suffix, first[d + 1] - at))
                o = np.lexsort((at, -length, it, d))
                keep = o[np.concatenate([[True], (d[o][1:] != d[o][:-1]) | (it[o][1:] != it[o][:-1])])]
                found += zip(d[keep].tolist(), (at[keep] - first[d[keep]]).tolist(), it[keep].tolist(),
                             (suffix - mine[suffix])[keep].tolist(), length[keep].tolist(), strict=True)
            if a + SHARD >= total:
                break
    return n_words, hit, first, found


def blocks(bench: DataFrame, block_bytes: int):
    """The benchmark's items, one bounded block after the other."""
    rows = bench.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()
        yield tokenise([r["id"] for r in got], [r["text"].encode() for r in got])


SPAN = "array<struct<start: int, words: int>>"
MATCH = "array<struct<item_id: string, item_at: int, doc_at: int, words: int>>"


def scan(docs: DataFrame, items: Items, columns: list[str], window: int) -> DataFrame:
    """``columns`` of every row with ``__words, __hit, __spans, __matches`` for one block."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(items))     # one block: bounded
    src = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("__text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))
    match = pa.list_(pa.struct([("item_id", pa.string()), ("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())]))

    def run(batches):
        it = Items(**shared.value)
        for part in tn.chunks(batches, "__text", 6 << 20):
            n_words, hit, first, found = find(tn.text_bytes(part.column("__text")), it, window)
            matches: list[list] = [[] for _ in n_words]
            best: dict = {}
            for d, at, k, item_at, n in found:      # a long text is several shards
                key = (d, it.ids[k])
                if n > best.get(key, (0,))[0]:
                    best[key] = (n, item_at, at)
            for (d, name), (n, item_at, at) in sorted(best.items()):
                matches[d].append({"item_id": name, "item_at": item_at, "doc_at": at, "words": n})
            spans: list[list] = [[] for _ in n_words]
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[first[1:]] - total[first[:-1]]
            for d in np.flatnonzero(n_hit):
                edge = np.diff(hit[first[d]:first[d + 1]].astype(np.int8), prepend=0, append=0)
                spans[d] = [{"start": a, "words": b - a} for a, b in
                            zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
                 pa.array(spans, span), pa.array(matches, match)],
                [*columns, "__words", "__hit", "__spans", "__matches"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in src.dtypes[:-1])
    return src.mapInArrow(run, f"{kinds}{', ' if kinds else ''}__words long, __hit long, __spans {SPAN}, __matches {MATCH}")


def contamination(docs: DataFrame, bench: DataFrame, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, matches`` of every row: hit words as spans,
    and the longest verbatim match with each item found."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                      F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__id"))
    parts = [scan(src, items, ["doc_id", "__id"], window) for items in blocks(bench, block_bytes)]
    names = ["doc_id", "__words as n_words", "__hit as n_hit", "__spans as spans", "__matches as matches"]
    if len(parts) == 1:
        return parts[0].selectExpr(*names)
    all_ = None
    for p in parts:
        p = materialize(p, "contamination")
        all_ = p if all_ is None else all_.unionByName(p)
    words = F.array_distinct(F.flatten(F.collect_list(F.flatten(F.transform(
        "__spans", lambda s: F.sequence(s["start"], s["start"] + s["words"] - 1))))))
    one = (all_.groupBy("doc_id", "__id").agg(
        F.max("__words").alias("__words"), F.sort_array(words).alias("w"), F.count(F.lit(1)).alias("n"),
        F.array_distinct(F.flatten(F.collect_list("__matches"))).alias("__matches"))
        .withColumn("__hit", F.size("w").cast("long"))
        .withColumn("__spans", F.transform("w", lambda x: F.struct(x.alias("start"), F.lit(1).alias("words"))).cast(SPAN))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("n") / len(parts)).cast("int")))))
    return one.selectExpr(*names)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` without the documents that hold a window of any item; same columns."""
    names = docs.columns
    out = docs.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(names)})
    cols = out.columns
    for k, items in enumerate(blocks(bench, block_bytes)):
        src = (materialize(out, "clean") if k else out).withColumn("text", F.col(f"c{names.index('text')}"))
        out = scan(src, items, cols, window).where("__hit = 0").select(*cols)
    return out.toDF(*names)
