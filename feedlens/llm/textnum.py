"""Words and word hashes of whole texts as numpy arrays, one chunk at a time.

Runs inside tasks.  A chunk is a slice of an Arrow batch whose texts add up to
about ``max_bytes`` (one longer text is a chunk of its own).  Word hashes are
64-bit polynomial hashes read off prefix sums, then mixed; window hashes are
the same over word hashes, so a window of any length costs the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 19           # bytes hashed at once
BASE = 0x9E3779B97F4A7C15   # odd, so it has an inverse modulo 2**64
_TABLES: dict[str, np.ndarray] = {}

#: white space of the word patterns: [\x20\x09-\x0D]
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def byte_table(word_bytes) -> np.ndarray:
    """A 256-entry table that is True for the bytes in ``word_bytes``."""
    out = np.zeros(256, bool)
    out[list(word_bytes)] = True
    return out


NOT_SPACE = byte_table(set(range(256)) - set(SPACES))
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] on lower-cased bytes: digits, a-z, all non-ASCII
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def chunks(batches, column: str, max_bytes: int = 4 << 20):
    """Slices of the batches holding about ``max_bytes`` of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, lo = np.cumsum(sizes, dtype=np.int64), 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least ``n`` of each."""
    if len(_TABLES.get("pow", ())) < n:
        size = max(n, 1 << 16)
        for name, x in (("pow", BASE), ("inv", pow(BASE, -1, 1 << 64))):
            t = np.full(size, x, np.uint64)
            t[0] = 1
            _TABLES[name] = np.multiply.accumulate(t)
    return _TABLES["pow"], _TABLES["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts with a line feed after each, and where each text starts."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return b"\n".join([*texts, b""]), starts


def word_spans(data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of word bytes."""
    edge = np.diff(word[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(starts, base + SEGMENT)))
        part = data[base:int(ends[hi - 1])]
        up, inv = tables(len(part))
        acc = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=acc[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each window of ``k`` consecutive word hashes."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    up, inv = tables(n + 1)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=acc[1:])
    return mix((acc[k:] - acc[:n - k + 1]) * inv[:n - k + 1] + np.uint64(k))


def doc_words(texts: list[bytes], word: np.ndarray, lower: np.ndarray = IDENTITY):
    """``(data, starts, ends, first)``: the joined bytes, the word spans, and
    ``first[d]`` = number of words before text ``d`` (one more entry at the end)."""
    text, at = joined(texts)
    data = np.frombuffer(text, np.uint8)
    if lower is not IDENTITY:
        data = lower[data]
    starts, ends = word_spans(data, word)
    return data, starts, ends, np.searchsorted(starts, at)
