"""Vectorised text helpers shared by the training-data operators.

Workers get Arrow batches.  A batch's string column is one contiguous UTF-8
buffer plus offsets, so tokenising and hashing are numpy passes over that
buffer instead of a Python loop per word.  Long inputs are walked in chunks
of about ``CHUNK_BYTES`` (a longer single text is one chunk), which bounds
the working memory of a task whatever the batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

# Mixing constants of the splitmix64 finaliser and an odd multiplier (fixed values).
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_M1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_M2)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of a hash base and their inverses modulo 2**64, grown on demand."""

    def __init__(self, base: int = _BASE):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


def prefix_hash(data: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums S with S[j]-S[i] = sum of (byte+1) * base**position over [i, j)."""
    up, _ = powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hash of every byte span [start, end), independent of its position."""
    _, down = powers.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def class_table(pairs, high: bool) -> np.ndarray:
    """Byte class: the given inclusive ranges, and all bytes >= 0x80 if ``high``."""
    t = np.zeros(256, bool)
    for a, b in pairs:
        t[a:b + 1] = True
    t[128:] = high
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and digits, and every non-ASCII character
WORD = class_table([(48, 57), (65, 90), (97, 122)], True)
#: everything but space, tab, line feed, vertical tab, form feed, carriage return
NONSPACE = ~class_table([(9, 13), (32, 32)], False)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (i, j) whose texts add up to about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def text_chunks(column, limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets) for consecutive row ranges of a string column."""
    raw, off = text_buffer(column)
    for i, j in chunks(off, limit):
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]


def spans(mask: np.ndarray, offsets: np.ndarray):
    """Maximal runs of ``mask`` that do not cross a row border: (start, end, row)."""
    if not len(mask):
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(len(mask), bool)
    before[0] = False
    before[1:] = mask[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    before[inner] = False
    start = np.flatnonzero(mask & ~before)
    after = np.empty(len(mask), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[inner - 1] = False
    end = np.flatnonzero(mask & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, powers: Powers):
    """Word spans, rows and hashes of the lower-cased (A-Z) bytes."""
    start, end, row = spans(table[data], offsets)
    low = LOWER[data]
    return start, end, row, span_hash(prefix_hash(low, powers), start, end, powers)


def shingles(word_hash: np.ndarray, row: np.ndarray, n_rows: int, size: int):
    """Hashes of ``size`` consecutive words within a row, with their rows.

    A row of fewer words, but not none, is one shingle of all its words.
    """
    k = len(word_hash)
    h = np.zeros(max(0, k - size + 1), np.uint64)
    for i in range(size):
        h = h * np.uint64(_BASE) + word_hash[i:i + len(h)]
    same = row[:len(h)] == row[size - 1:size - 1 + len(h)] if len(h) else np.zeros(0, bool)
    h, r = mix(h[same]), row[:len(h)][same]
    count = np.bincount(row, minlength=n_rows) if k else np.zeros(n_rows, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.zeros(len(short), np.uint64)
        for i, (f, c) in enumerate(zip(first, count[short])):
            v = 0
            for w in word_hash[f:f + c].tolist():
                v = (v * _BASE + w + 1) & _MASK
            extra[i] = v
        h, r = np.concatenate([h, mix(extra)]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r
