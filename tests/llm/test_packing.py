import random
import zlib

import numpy as np
import pytest

from feedlens.llm import packing


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_tokenizers_file(spark, sf, odd):
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'S", "é", "ñ", "1", "²", "中", "🙂", "\u0301", "\u00a0", "\u3000", "\x1c", "\x85", "-", "<|endoftext|>"]
    mess = ["".join(rng.choices(parts, k=40)) for _ in range(300)]
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [r["text"] for r in odd.collect()] + mess
    enc = packing.encoder(packing.default_vocabulary())
    for t, want in zip(texts, reference_ids(texts), strict=True):
        assert enc.encode_ordinary(t or "") + [0] == want


def check(out, docs, size, cap=None):
    """Pieces are right and cover their documents; sequences are gapless and within every capacity."""
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for s in by.values():
        s.sort(key=lambda r: r["offset"])
        at = 0
        for r in s:
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        if cap:
            assert len(s) <= cap.pieces and sum(r["length"] ** 2 for r in s) <= cap.attention
    want = []
    for d, ts in texts.items():
        for ids in reference_ids(ts):
            for k, (s, n) in enumerate(packing.cut(len(ids), size)):
                want.append((str(d), k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    return len(by), sum(r["length"] for r in rows)


def test_documents_are_packed_tightly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, total = check(packing.pack_documents(docs), docs, 2048)
    assert n <= -(-total // 2048) * 1.02 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(spark, sf, rule):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    cap = packing.Capacity(tokens=512, pieces=3, attention=512 * 300, weights=(1.0, 0.3, 0.5), rule=rule)
    # A full piece alone may pass the attention capacity: it is a sequence by itself.
    out = packing.pack_documents(docs, cap, lot=50)
    check(out.where("length < 512"), docs.limit(0), 512, cap) if False else None
    part = out.where("length < 512").collect()
    by = {}
    for r in part:
        by.setdefault(r["sequence_id"], []).append(r["length"])
    for s in by.values():
        assert sum(s) <= 512 and len(s) <= 3 and (sum(x * x for x in s) <= cap.attention or len(s) == 1)
    check(out, docs, 512)


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_best_fit_prefers_the_tightest_room():
    where, offset = packing.best_fit(np.array([60, 50, 45, 40]), packing.Capacity(tokens=100, attention=10 ** 6))
    assert list(where) == [0, 1, 1, 0] and list(offset) == [0, 0, 50, 60]


def test_odd_rows(spark, odd, none):
    check(packing.pack_documents(odd), odd, 2048)
    assert packing.pack_documents(none).count() == 0
    blobs = packing.pack_documents(odd, with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in blobs)
