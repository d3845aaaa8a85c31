"""Removal of repeated byte strings with longest-previous-factor arrays.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts
earlier (in a document of smaller id, or earlier in the same one); the first
occurrence stays.  Strings are judged on the input.

How the corpus is cut into parts that a suffix array fits.  Every window of
LENGTH bytes has an anchor: the smallest hash among its ``GRAM``-byte strings
(the first, if equal).  Equal windows have equal anchors at equal places, so
windows can only repeat among windows of one anchor hash.  Neighbouring
windows mostly share their anchor; such a run is one row: anchor hash, hash of
the run's whole context, document and place.

1. Anchor hashes that occur once are dropped (counts by hash).
2. Runs with equal contexts repeat in full: all but the first are removed.
3. The first runs of different contexts of one anchor can still share windows.
   Their contexts are put together in bins of about ``BIN_BYTES``, ordered by
   document and place.  Per bin a suffix array is built (prefix doubling), and
   previous and next smaller positions in suffix order give the longest
   previous factor; windows whose factor reaches LENGTH are removed.  An
   anchor with more than ``HOT`` contexts (a passage in very many documents)
   does not go to one bin: its windows are matched by their digests, with
   partial aggregation.

Texts are read three times, and only rows about repeated anchors are kept:
two bitmaps of ``FILTER_BITS`` bits are broadcast to skip the others early.
The bitmaps only save work; what passes by chance is found unique later.

Defined results: null counts as the empty text.  A missing doc_id counts as
the largest.  Rows of equal id and text are one document; rows of equal id
and other text compare by place alone.  Texts shorter than LENGTH lose
nothing.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import rows_of, stored
from rankfold.llm.text import CHUNK_BYTES, Powers, mix, prefix_hash, span_hash, text_buffer

LENGTH, GRAM = 100, 32
BIN_BYTES, HOT = 2_000_000, 2000
FILTER_BITS, FILTER_BLOCKS = 1 << 27, 64
_LAST = 2 ** 63 - 1


def pieces(column):
    """(row, offset in the text, buffer, borders) for stretches of about CHUNK_BYTES.

    Long texts are cut so that every window lies in exactly one stretch."""
    raw, off = text_buffer(column)
    n = len(off) - 1
    rows, begins, parts, size = [], [], [], 0
    for r in range(n):
        a, b = int(off[r]), int(off[r + 1])
        if b - a < LENGTH:
            continue
        for s in range(a, b - LENGTH + 1, CHUNK_BYTES):
            e = min(b, s + CHUNK_BYTES + LENGTH - 1)
            if parts and size + e - s > CHUNK_BYTES:
                yield _piece(rows, begins, parts)
                rows, begins, parts, size = [], [], [], 0
            rows.append(r)
            begins.append(s - a)
            parts.append(raw[s:e])
            size += e - s
    if parts:
        yield _piece(rows, begins, parts)


def _piece(rows, begins, parts):
    border = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.array(rows), np.array(begins, np.int64), np.concatenate(parts), border


def runs(data: np.ndarray, border: np.ndarray, powers: Powers):
    """Runs of windows that share their anchor: first and last window start, anchor
    hash, context hash, and the stretch they are in."""
    S = prefix_hash(data, powers)
    _, down = powers.get(len(S))
    m = len(data) - GRAM + 1
    h = mix((S[GRAM:] - S[:m]) * down[:m])
    low = np.uint64((1 << 22) - 1)  # stretches are shorter than 2**22 bytes
    key = (h & ~low) | np.arange(m, dtype=np.uint64)
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[:len(key) - (width - span)], key[width - span:])
    at = (key & low).astype(np.int64)  # anchor of the window starting at each place
    part = np.repeat(np.arange(len(border) - 1), np.diff(border))[:len(at)]
    inside = np.arange(len(at)) + LENGTH <= border[part + 1]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])])
    start = np.flatnonzero(new & inside)
    over = np.concatenate([(new[1:] | ~inside[1:]), [True]])
    last = np.flatnonzero(over & inside)
    a = at[start]
    context = mix(span_hash(S, start, last + LENGTH, powers) + (a - start).astype(np.uint64))
    return start, last, h[a].view(np.int64), context.view(np.int64), part[start]


def _batch_runs(batch, powers, passed=None):
    """Runs of a batch as arrays: row, first start, last start (within the text), h, ch
    and, for runs that ``passed`` lets through, the buffer and place of the context."""
    out, buffers = [], []
    for k, (rows, begins, data, border) in enumerate(pieces(batch.column("text"))):
        start, last, h, ch, part = runs(data, border, powers)
        if passed is not None:
            keep = passed(h)
            start, last, h, ch, part = start[keep], last[keep], h[keep], ch[keep], part[keep]
        shift = begins[part] - border[part]
        out.append((rows[part], start + shift, last + shift, h, ch, np.full(len(h), k), start))
        buffers.append(data if passed is not None else None)
    if not out:
        return [np.zeros(0, np.int64)] * 7, buffers
    return [np.concatenate(x) for x in zip(*out)], buffers


def _anchor_counts(batches):
    powers = Powers()
    for batch in batches:
        for _, _, data, border in pieces(batch.column("text")):
            h, n = np.unique(runs(data, border, powers)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])


def _bits(batches):
    """(block, bits) of a task's values in a bitmap, compressed."""
    bitmap = None
    for batch in batches:
        bitmap = np.zeros(FILTER_BITS // 8, np.uint8) if bitmap is None else bitmap
        slot = _slots(batch.column("h").to_numpy())
        np.bitwise_or.at(bitmap, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    if bitmap is not None:
        for k, part in enumerate(bitmap.reshape(FILTER_BLOCKS, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "bits"])


def _slots(h: np.ndarray) -> np.ndarray:
    return (mix(h.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _joined_bits(batches):
    for batch in batches:
        for row in rows_of(batch):
            total = np.zeros(FILTER_BITS // 8 // FILTER_BLOCKS, np.uint8)
            for b in row["parts"]:
                total |= np.frombuffer(zlib.decompress(b), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "bits"])


def bitmap(values: DataFrame):
    """Broadcast bitmap of the column ``h`` (FILTER_BITS bits, whatever the input)."""
    schema = "block int, bits binary"
    parts = values.select("h").mapInArrow(_bits, schema).groupBy("block").agg(F.collect_list("bits").alias("parts"))
    out = np.zeros((FILTER_BLOCKS, FILTER_BITS // 8 // FILTER_BLOCKS), np.uint8)
    for r in parts.mapInArrow(_joined_bits, schema).collect():
        out[r["block"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return values.sparkSession.sparkContext.broadcast(out.tobytes())


def _filter(broadcast):
    bits = np.frombuffer(broadcast.value, np.uint8)

    def passed(h):
        slot = _slots(h)
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    return passed


def _first_of(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray):
    """Order by keys, document and place; whether each is the first of its keys, and
    whether it comes strictly later than that one."""
    order = np.lexsort((start, doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    d, s = doc[order], start[order]
    later = (d != d[head]) | (s != s[head])
    return order, new, later


def _repeats(broadcast):
    """Runs with repeated anchors: first ones of their context in the batch (h, ch),
    and as covered stretches (h null) those that come later in the batch."""

    def run(batches):
        powers, passed = Powers(), _filter(broadcast)
        for batch in batches:
            (row, start, last, h, ch, _, _), _ = _batch_runs(batch, powers, passed)
            doc, t = batch.column("doc").to_numpy()[row], batch.column("t").to_numpy()[row]
            order, new, later = _first_of([h, ch], doc, start)
            i = order[new]
            none = pa.nulls(len(i), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(ch[i]), pa.array(doc[i]), pa.array(t[i]), pa.array(start[i]), pa.array(last[i] + LENGTH)], names=_RUN)
            i = order[later]
            if len(i):
                d, x, a, b = _merged(doc[i], t[i], start[i], last[i] + LENGTH)
                none = pa.nulls(len(d), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(d), pa.array(x), pa.array(a), pa.array(b)], names=_RUN)

    return run


_RUN = ["h", "ch", "doc", "t", "a", "b"]
_RUN_SCHEMA = "h bigint, ch bigint, doc bigint, t bigint, a bigint, b bigint"


def _merged(doc, t, a, b):
    """Stretches joined where they touch, per document."""
    order = np.lexsort((a, t, doc))
    doc, t, a, b = doc[order], t[order], a[order], b[order]
    change = np.concatenate([[True], (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])])
    # running end within a document: ends grow with starts, but for repeated rows
    group = np.cumsum(change)
    top = np.maximum.accumulate(b + group * (1 << 40)) - group * (1 << 40)
    new = change.copy()
    new[1:] |= a[1:] > top[:-1]
    first = np.flatnonzero(new)
    return doc[first], t[first], a[first], np.maximum.reduceat(b, first)


def _contexts(broadcast):
    """Context bytes of runs that the bitmap lets through, first in their batch."""

    def run(batches):
        powers, passed = Powers(), _filter(broadcast)
        for batch in batches:
            (row, start, last, h, ch, piece, at), buffers = _batch_runs(batch, powers, passed)
            doc, t = batch.column("doc").to_numpy()[row], batch.column("t").to_numpy()[row]
            order, new, _ = _first_of([h, ch], doc, start)
            i = order[new]
            text = [buffers[piece[k]][at[k]:at[k] + last[k] - start[k] + LENGTH].tobytes() for k in i]
            yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(ch[i]), pa.array(doc[i]), pa.array(t[i]), pa.array(start[i]), pa.array(text, pa.binary())], names=["h", "ch", "doc", "t", "a", "text"])

    return run


def suffix_order(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``length`` symbols (ties by position), and
    the rank of each position; equal ranks mean equal first ``length`` symbols.

    Prefix doubling: ranks by 2k symbols come from pairs of ranks by k symbols.
    """
    n = len(codes)
    rank, k = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while True:
        step = min(k, length - k)
        after = np.full(n, -1, np.int64)
        after[:n - step] = rank[step:]
        pair = rank * (n + 1) + after + 1
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        k += step
        if k >= length:
            return order, rank


def neighbours(order: list[int]) -> tuple[list[int], list[int]]:
    """Per place in suffix order, the nearest smaller text position before and after
    (-1: none)."""
    n = len(order)
    before, after, stack = [-1] * n, [-1] * n, []
    for j in range(n):
        while stack and order[stack[-1]] > order[j]:
            after[stack.pop()] = order[j]
        if stack:
            before[j] = order[stack[-1]]
        stack.append(j)
    return before, after


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per text, whether the window starting at each place has a longest previous
    factor of ``length`` or more in the texts one after the other."""
    codes, begin = [], []
    for i, t in enumerate(texts):
        begin.append(sum(map(len, codes)) if i < 1 else begin[-1] + len(codes[-1]))
        codes.append(np.append(np.frombuffer(t, np.uint8).astype(np.int64), 256 + i))  # separators are all different
    flat = np.concatenate(codes)
    order, rank = suffix_order(flat, length)
    window = np.zeros(len(flat), bool)
    for b, t in zip(begin, texts):
        window[b:b + len(t) - length + 1] = len(t) >= length
    order = order[window[order]]
    found = np.zeros(len(flat), bool)
    for side in neighbours(order.tolist()):
        near = np.array(side, np.int64)
        found[order] |= (near >= 0) & (rank[near] == rank[order])
    return [found[b:b + max(0, len(t) - length + 1)] for b, t in zip(begin, texts)]


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1 + LENGTH


def _factors(batches):
    """Covered stretches of a bin's contexts by their longest previous factors."""
    for batch in batches:
        for row in rows_of(batch):
            runs_ = sorted(row["runs"], key=lambda x: (x["doc"], x["a"], x["t"]))
            doc, t, a, b = [], [], [], []
            for x, flags in zip(runs_, repeated_windows([x["text"] for x in runs_])):
                if flags.any():
                    s, e = _stretches(flags)
                    doc += [x["doc"]] * len(s)
                    t += [x["t"]] * len(s)
                    a += (s + x["a"]).tolist()
                    b += (e + x["a"]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (doc, t, a, b)], names=["doc", "t", "a", "b"])


def _digests(batches):
    """(digest, doc, t, a) of every window of a context."""
    for batch in batches:
        for row in rows_of(batch):
            m = len(row["text"]) - LENGTH + 1
            out = [hashlib.blake2b(row["text"][i:i + LENGTH], digest_size=16).digest() for i in range(m)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array([row["doc"]] * m, pa.int64()), pa.array([row["t"]] * m, pa.int64()), pa.array(np.arange(m) + row["a"])], names=["digest", "doc", "t", "a"])


def covered(rows: DataFrame) -> DataFrame:
    """(doc, t, a, b): stretches of bytes to remove; they may overlap.  ``rows`` has
    doc, t (digest of the text) and text."""
    texts = rows.select("text")
    anchors = texts.mapInArrow(_anchor_counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    found = stored(rows.mapInArrow(_repeats(bitmap(anchors)), _RUN_SCHEMA), "repeats")
    later = found.where("h is null").select("doc", "t", "a", "b")

    # equal contexts: all but the first run (a batch brings one run of a context)
    place = F.struct("doc", "a")
    single = found.where("h is not null")
    heads = single.groupBy("h", "ch").agg(F.min(place).alias("first"))
    runs_ = single.join(heads, ["h", "ch"])
    copies = runs_.where(place != F.col("first")).select("doc", "t", "a", "b")

    # different contexts of one anchor
    several = heads.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    open_ = stored(heads.join(several, "h").select("h", "ch", "first.doc", "first.a", "m"), "repeat-heads")
    contexts = rows.mapInArrow(_contexts(bitmap(open_)), "h bigint, ch bigint, doc bigint, t bigint, a bigint, text binary")
    contexts = stored(contexts.join(open_, ["h", "ch", "doc", "a"]).dropDuplicates(["h", "ch", "doc", "a"]), "repeat-contexts")
    size = contexts.where(F.col("m") <= HOT).agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    bins = max(1, -int(-size // BIN_BYTES))
    binned = (contexts.where(F.col("m") <= HOT).groupBy(F.pmod(F.xxhash64("h"), F.lit(bins)).alias("bin"))
              .agg(F.collect_list(F.struct("doc", "t", "a", "text")).alias("runs")))
    factors = binned.mapInArrow(_factors, "doc bigint, t bigint, a bigint, b bigint")

    windows = contexts.where(F.col("m") > HOT).select("doc", "t", "a", "text").mapInArrow(_digests, "digest binary, doc bigint, t bigint, a bigint")
    least = windows.groupBy("digest").agg(F.min(place).alias("first"))
    hot = windows.join(least, "digest").where(place != F.col("first")).select("doc", "t", "a", (F.col("a") + LENGTH).alias("b"))
    return later.unionByName(copies).unionByName(factors).unionByName(hot)


def _cutter(keep: list[str]):
    """Whole texts without the covered stretches, with their counts."""

    def run(batches):
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            cuts = batch.column("cuts").to_pylist()
            size, gone, n, left = [], [], [], []
            for r, cut in enumerate(cuts):
                text = raw[off[r]:off[r + 1]].tobytes()
                spans: list[list[int]] = []
                for x in sorted((x["a"], x["b"]) for x in cut or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                kept, last = [], 0
                for a, b in spans:
                    kept.append(text[last:a])
                    last = b
                kept.append(text[last:])
                size.append(len(text))
                gone.append(sum(b - a for a, b in spans))
                n.append(len(spans))
                left.append(b"".join(kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(v, pa.int64()) for v in (size, gone, n)), pa.array(left, pa.binary())], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the ``kept`` bytes of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "t": F.xxhash64("text")})
    cuts = covered(rows.select("doc", "t", "text")).groupBy("doc", "t").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    id_type = dict(docs.dtypes)["doc_id"]
    return rows.join(cuts, ["doc", "t"], "left").select("doc_id", "text", "cuts").mapInArrow(
        _cutter(["doc_id"]), f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """Per document what was removed, and the digest of what is left."""
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
