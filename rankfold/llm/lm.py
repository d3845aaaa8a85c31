"""Language-model scoring with a log-frequency Bloom filter.

The model is a bigram model over lower-cased words (A-Z) with one end token a
text.  A bigram's training count is quantised to q = 1 + floor(log_b(count))
and entered into a Bloom filter as the pairs (bigram, 1) .. (bigram, q).
Scoring probes (bigram, 1), (bigram, 2), ... until one is missing; the last
level found gives the count back as the middle of its range.  Probabilities
are smoothed towards the exact unigram model (Dirichlet prior of weight MU):

    p(w | h) = (count(h w) + MU * p1(w)) / (count(h) + MU)
    p1(w)    = (c(w) + 1) / (N + V + 1)

How it scales.  Texts are encoded once, in blocks of about ``BLOCK_BYTES``:
word numbers local to the block and the block's dictionary.  So corpus
statistics move once per distinct word of a block, not per occurrence: the
dictionaries, packed by hash segment, meet in one group per segment, which
hands exact corpus counts back to each block.  Bigrams go by hash to filter
segments likewise, already summed per block; their number grows with the
corpus.  Segments are built in Spark, one bounded group each, and
broadcast in passes of at most ``PASS_BYTES``; a bigram belongs to one
segment, so the passes' partial sums add up to the same score.

Defined results: null counts as the empty text, which is one end token.
Without training rows all counts are 0.  Rows are never merged; only the
named columns are read.  Words are told apart by 64-bit hashes, bigrams in
the filter by segment and 32 bits more (a share below the filter's own false
positives).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import id_bucket, rows_of, stored
from rankfold.llm.text import NONSPACE, Powers, chunks, mix, text_chunks, words

BASE, BITS_PER_ENTRY, PROBES = 1.5, 10, 4
#: weight of the unigram model
MU = 50.0
FOLDS, HELD_OUT = 7, 2
#: text of a block, tokens that a filter segment stands for, filter bytes in one pass
BLOCK_BYTES, SEGMENT_TOKENS, PASS_BYTES = 4 << 20, 2_000_000, 128 << 20
#: dictionary entries (distinct words of a block) that are summed together
SEGMENT_WORDS = 500_000
#: hash of the end token, which is also what stands before a text's first word
END = np.uint64(0x656E64)

_BLOCK = "block bigint, ids array<{id}>, held array<boolean>, lengths binary, tokens binary, hashes binary, train binary"


def _encoder(batches):
    """One row per block: documents, their lengths in tokens, local word numbers
    (0: the most frequent), the words' hashes and training counts."""
    powers, n = Powers(), 0
    part = TaskContext.get().partitionId()
    for batch in batches:
        for i, j, data, off in text_chunks(batch.column("text"), BLOCK_BYTES):
            hashes, lengths = [], []
            for a, b, piece, at in _within(data, off):
                _, _, row, h = words(piece, at, NONSPACE, powers)
                count = np.bincount(row, minlength=b - a)
                # the end token after each text's last word
                hashes.append(np.insert(h, np.cumsum(count), END))
                lengths.append(count + 1)
            h, length = np.concatenate(hashes), np.concatenate(lengths)
            rows = batch.slice(i, j - i)
            held = rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            distinct, local, total = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-total, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            tokens = rank[local]
            train = np.bincount(tokens, np.repeat(~held, length), len(order)).astype(np.int64)
            one = lambda a: pa.array([a.tobytes()], pa.binary())
            ids = rows.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(held)), one(length.astype(np.int32)), one(tokens), one(distinct[order]), one(train)],
                names=["block", "ids", "held", "lengths", "tokens", "hashes", "train"])
            n += 1


def _within(data, off):
    """Tokenising runs over smaller chunks of a block."""
    for a, b in chunks(off):
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]


def _by_segment(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's words by (segment, hash), and the segments in it."""
    segment = (hashes % np.uint64(segments)).astype(np.int64)
    order = np.lexsort((hashes, segment))
    return order, segment[order]


def _dictionary(segments: int):
    """(segment, block, hashes, counts): a block's distinct words and their training
    counts, packed by hash segment."""

    def run(batches):
        for batch in batches:
            for block, hashes, train in zip(*(batch.column(c).to_pylist() for c in ("block", "hashes", "train"))):
                h, n = np.frombuffer(hashes, np.uint64), np.frombuffer(train, np.int64)
                order, segment = _by_segment(h, segments)
                cut = np.flatnonzero(np.diff(segment)) + 1
                where = segment[np.concatenate([[0], cut])]
                pack = lambda a: pa.array([x.tobytes() for x in np.split(a[order], cut)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.full(len(where), block)), pack(h), pack(n)], names=["segment", "block", "hashes", "counts"])

    return run


def _totals(batches):
    """Corpus counts of a segment's words, handed back to each block in its order, and
    (block null) the segment's tokens and distinct words in training."""
    for batch in batches:
        for row in rows_of(batch):
            parts = row["parts"]
            h = np.concatenate([np.frombuffer(p["hashes"], np.uint64) for p in parts])
            n = np.concatenate([np.frombuffer(p["counts"], np.int64) for p in parts])
            _, at = np.unique(h, return_inverse=True)
            total = np.zeros(int(at.max()) + 1, np.int64)
            np.add.at(total, at, n)
            back = np.split(total[at], np.cumsum([len(p["counts"]) // 8 for p in parts])[:-1])
            k = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p["block"] for p in parts] + [None], pa.int64()), pa.array([row["segment"]] * (k + 1), pa.int64()),
                 pa.array([b.tobytes() for b in back] + [None], pa.binary()), pa.array([None] * k + [int(total.sum())], pa.int64()), pa.array([None] * k + [int((total > 0).sum())], pa.int64())],
                names=["block", "segment", "counts", "tokens", "words"])


def bigrams(hashes: np.ndarray, tokens: np.ndarray, length: np.ndarray, segments: int):
    """Per token: the filter segment and the 32-bit hash of the bigram ending there,
    and the local number of the word before (-1: the start of the text)."""
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], np.cumsum(length)[:-1]])] = -1
    left = np.where(before >= 0, hashes[before], END)
    g = mix(left * np.uint64(0x9E3779B97F4A7C15) + hashes[tokens])
    return ((g >> np.uint64(32)) % np.uint64(segments)).astype(np.int64), g.astype(np.uint32), before


def _unpack(row: dict):
    return (np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["tokens"], np.int32),
            np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.array(row["held"], bool))


def _counted(segments: int):
    """(segment, payload): a block's training bigrams, summed, by filter segment.

    A payload holds the bigrams seen once (32-bit hashes) and those seen more
    often (hashes, then counts).
    """

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                hashes, tokens, length, held = _unpack(row)
                segment, g, _ = bigrams(hashes, tokens, length, segments)
                used = np.repeat(~held, length)
                code, n = np.unique(segment[used].astype(np.uint64) << np.uint64(32) | g[used], return_counts=True)
                seg = (code >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.diff(seg)) + 1
                where, payload = [], []
                for c, k in zip(np.split(code, cut), np.split(n, cut)):
                    if len(c):
                        once = k == 1
                        low = c.astype(np.uint32)
                        where.append(int(c[0] >> np.uint64(32)))
                        payload.append(np.uint32(once.sum()).tobytes() + low[once].tobytes() + low[~once].tobytes() + k[~once].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(payload, pa.binary())], names=["segment", "payload"])

    return run


def levels(g: np.ndarray, level: int, bits: int):
    """Filter positions of (bigram, level), one array per probe."""
    h = mix(g.astype(np.uint64) << np.uint64(8) | np.uint64(level))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * (step & np.uint64(0xFFFFFFFF))) % np.uint64(bits)).astype(np.int64)


def quantised(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def expected(q: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level; 0 for level 0."""
    return np.where(q > 0, (BASE ** (q - 1.0) + BASE ** q - 1) / 2, 0.0).clip(0)


def _built(batches):
    """(segment, bits, filter) from all payloads of a segment."""
    for batch in batches:
        for row in rows_of(batch):
            once, more, counts = [], [], []
            for p in row["payloads"]:
                k = int(np.frombuffer(p, np.uint32, 1)[0])
                rest = np.frombuffer(p, np.uint32, offset=4)
                m = (len(rest) - k) // 2
                once.append(rest[:k])
                more.append(rest[k:k + m])
                counts.append(rest[k + m:])
            g, at = np.unique(np.concatenate(once + more), return_inverse=True)
            n = np.bincount(at, np.concatenate([np.ones(sum(map(len, once))), *counts]))
            q = quantised(np.maximum(1, n))
            bits = int(max(64, BITS_PER_ENTRY * q.sum()) + 7) // 8 * 8
            seen = np.zeros(bits, bool)
            for level in range(1, int(q.max()) + 1):
                for pos in levels(g[q >= level], level, bits):
                    seen[pos] = True
            yield pa.RecordBatch.from_arrays([pa.array([row["segment"]], pa.int64()), pa.array([bits], pa.int64()), pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits", "filter"])


def probe(bits: np.ndarray, start: np.ndarray, size: np.ndarray, segment: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Levels found for bigrams, probing each until one is missing."""
    level = np.zeros(len(g), np.int64)
    live = np.flatnonzero(size[segment] > 0)
    k = 0
    while len(live):
        k += 1
        seg = segment[live]
        h = mix(g[live].astype(np.uint64) << np.uint64(8) | np.uint64(k))
        low, step = h & np.uint64(0xFFFFFFFF), ((h >> np.uint64(32)) | np.uint64(1)) & np.uint64(0xFFFFFFFF)
        hit = np.ones(len(live), bool)
        for i in range(PROBES):
            pos = ((low + np.uint64(i) * step) % size[seg]).astype(np.int64)
            hit &= (bits[start[seg] + (pos >> 3)] >> (pos & 7).astype(np.uint8) & 1).astype(bool)
        live = live[hit]
        level[live] = k
        if k == 200:
            break
    return level


def _scorer(broadcast, segments: int, word_segments: int, total: int, vocabulary: int):
    """(block, i, ...) per document: the pass's part of the score, and the counts."""

    def run(batches):
        first, held_segments, sizes, bits = broadcast.value
        size = np.zeros(segments, np.uint64)
        start = np.zeros(segments, np.int64)
        mine = np.zeros(segments, bool)
        mine[held_segments] = True
        size[held_segments] = sizes
        start[held_segments] = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) // 8)[:-1]]) if len(sizes) else 0
        if first is not None:  # bigrams of segments that hold nothing count in the first pass
            mine |= ~np.isin(np.arange(segments), first)
        bits = np.frombuffer(bits, np.uint8)
        for batch in batches:
            for row in rows_of(batch):
                hashes, tokens, length, held = _unpack(row)
                c = np.empty(len(hashes), np.int64)
                back = sorted(row["counts"], key=lambda x: x["segment"])
                c[_by_segment(hashes, word_segments)[0]] = np.frombuffer(b"".join(x["counts"] for x in back), np.int64)
                segment, g, before = bigrams(hashes, tokens, length, segments)
                ends = int(c[np.flatnonzero(hashes == END)[0]])
                unigram = (c[tokens] + 1) / (total + vocabulary + 1)
                context = np.where(before >= 0, c[before], ends)
                both = np.minimum(expected(probe(bits, start, size, segment, g)), context)
                logp = np.where(mine[segment], np.log10((both + MU * unigram) / (context + MU)), 0.0)
                at = np.concatenate([[0], np.cumsum(length)[:-1]])
                m = len(length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, row["block"])), pa.array(np.arange(m)), pa.array(row["ids"], batch.schema.field("ids").type.value_type), pa.array(held), pa.array(length),
                     pa.array(np.add.reduceat((c[tokens] > 0).astype(np.int64), at)), pa.array(np.add.reduceat(np.log10(unigram), at)), pa.array(np.add.reduceat(logp, at))],
                    names=["block", "i", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, pass_bytes: int = PASS_BYTES, segment_tokens: int = SEGMENT_TOKENS, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    split = docs.select("doc_id", "text", (id_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    id_type = dict(split.dtypes)["doc_id"]
    blocks = stored(split.mapInArrow(_encoder, _BLOCK.format(id=id_type)), "lm-blocks")
    tokens = blocks.agg(F.sum(F.octet_length("tokens") / 4).alias("n")).first()["n"] or 0
    segments = max(1, -int(-tokens // segment_tokens))

    entries = blocks.agg(F.sum(F.octet_length("hashes") / 8).alias("n")).first()["n"] or 0
    word_segments = max(1, -int(-entries // segment_words))
    packed = blocks.select("block", "hashes", "train").mapInArrow(_dictionary(word_segments), "segment bigint, block bigint, hashes binary, counts binary")
    counted = stored(packed.groupBy("segment").agg(F.collect_list(F.struct("block", "hashes", "counts")).alias("parts"))
                     .mapInArrow(_totals, "block bigint, segment bigint, counts binary, tokens bigint, words bigint"), "lm-counts")
    totals = counted.agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    total, vocabulary = totals["n"] or 0, totals["v"] or 0
    known = counted.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("segment", "counts")).alias("counts"))
    joined = blocks.drop("train").join(known, "block")

    grams = blocks.select("held", "lengths", "tokens", "hashes").mapInArrow(_counted(segments), "segment bigint, payload binary")
    built = grams.groupBy("segment").agg(F.collect_list("payload").alias("payloads")).mapInArrow(_built, "segment bigint, bits bigint, filter binary")
    built = stored(built, "lm-filter")
    sizes = sorted((r["segment"], r["bits"]) for r in built.select("segment", "bits").collect())
    everything = [s for s, _ in sizes]
    passes: list[list[tuple[int, int]]] = [[]]
    for s, b in sizes:
        if passes[-1] and sum(x // 8 for _, x in passes[-1]) + b // 8 > pass_bytes:
            passes.append([])
        passes[-1].append((s, b))
    out = None
    schema = f"block bigint, i bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    for k, held in enumerate(passes):
        low, high = (held[0][0], held[-1][0]) if held else (0, -1)
        part = built.where(F.col("segment").between(low, high)).select("segment", "filter").toArrow().sort_by("segment")
        bits = b"".join(memoryview(x.as_buffer()) for x in part.column("filter"))
        model = spark.sparkContext.broadcast((everything if k == 0 else None, [s for s, _ in held], [b for _, b in held], bits))
        scored = joined.mapInArrow(_scorer(model, segments, word_segments, total, vocabulary), schema)
        out = scored if out is None else out.unionByName(scored)
    if len(passes) > 1:
        same = [F.first(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")]
        out = out.groupBy("block", "i").agg(*same, F.sum("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
