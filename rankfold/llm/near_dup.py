"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified.

A text is the weighted set of its five-word shingles (words of ASCII letters,
digits and non-ASCII characters, A-Z lower-cased; a shorter text is one
shingle).  A shingle weighs its count in the text times an inverse document
frequency by the share s of documents that hold it:

    idf(s) = IDF_FLOOR + (1 - IDF_FLOOR) * ln(1 / max(s, RARE)) / ln(1 / RARE)

Shares, not counts, make this alike at every corpus size, and they can be had
from a table of hashed counts of fixed size: its error, shingles a text over
slots, does not grow with the corpus either.  The floor keeps the weighted
similarity of copies near the plain one even if a third of all documents
shares their shingles.

Improved consistent weighted sampling gives ``BANDS * ROWS`` samples a text;
texts that agree on all samples of a band share a bucket.  Links are found by

1. comparing every text of a bucket with the bucket's first,
2. ``ROUNDS`` times more, where a bucket of three or more still holds several
   components, with a text picked by a hash of its own for each bucket (a large
   group of loose copies grows together so, without its pairs), and
3. where several components are left even so, comparing the rest across
   components.  The similarity's distance is a metric, so with the distances
   to the first text known, all that cannot come within reach of another
   component is left out without loss; then texts are compared in blocks, but
   for those whose total weights are too far apart to be links.

Every pair found is verified by the exact weighted Jaccard similarity of the
whole texts (0.8 or more).  Equal texts are one entry.  Components are found by
label propagation in Spark; no pairs, links or components come to the driver.

Defined results: null counts as the empty text.  Texts without words are only
duplicates of equal texts.  A class is named by its smallest doc_id (null if
all are null).  Repeated rows are members of one class.  Only the named
columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import returning_memory, rows_of, stored
from rankfold.llm.text import WORD, Powers, mix, shingles, text_buffer, text_chunks, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: rounds of comparing with hashed members of the buckets
ROUNDS = 1
IDF_FLOOR, RARE = 0.75, 5e-4
#: slots of the table of document frequencies, and rows it is summed in
SLOTS, SLOT_BLOCKS = 1 << 22, 64
#: distinct draws of the sampling; shingles are told apart by their hashes
DRAWS, SEED = 4096, 23
#: texts compared with each other in one row
BLOCK = 512


def weighted(data: np.ndarray, off: np.ndarray, powers: Powers):
    """Distinct shingles of each text in a buffer: hash, row and count, sorted by
    row and hash."""
    n = len(off) - 1
    _, _, row, h = words(data, off, WORD, powers)
    s, r = shingles(h, row, n, SHINGLE)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    if not len(s):
        return s, r, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])]))
    return s[new], r[new], np.diff(np.append(new, len(s)))


def _frequencies(batches):
    """(block, task, counts): documents per slot of a task's texts, compressed."""
    powers, total, held, n = Powers(), np.zeros(SLOTS, np.uint32), [], 0

    def add():
        total[:] += np.bincount(np.concatenate(held), minlength=SLOTS).astype(np.uint32)
        held.clear()

    for batch in batches:
        for _, _, data, off in text_chunks(batch.column("text")):
            s, _, _ = weighted(data, off, powers)
            held.append((s % np.uint64(SLOTS)).astype(np.int64))
            n += len(s)
            if n > SLOTS:
                add()
                n = 0
    if held:
        add()
    if total.any():
        parts = total.reshape(SLOT_BLOCKS, -1)
        task = TaskContext.get().partitionId()
        for k in range(SLOT_BLOCKS):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1)], pa.binary())], names=["block", "task", "counts"])


def _summed(batches):
    for batch in batches:
        for row in rows_of(batch):
            total = np.zeros(SLOTS // SLOT_BLOCKS, np.uint64)
            for c in row["parts"]:
                raw = zlib.decompress(c)
                total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * len(total) else np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int32()), pa.array([row["task"]], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "task", "counts"])


def slot_weights(docs: DataFrame, text: str = "text") -> np.ndarray:
    """idf per slot over all documents (SLOTS numbers, whatever the corpus)."""
    schema = "block int, task int, counts binary"
    parts = docs.select(F.col(text).alias("text")).mapInArrow(returning_memory(_frequencies), schema)
    for spread in (64, 1):  # in two steps: a row never gathers more than a share of the tasks
        parts = (parts.groupBy("block", F.pmod("task", F.lit(spread)).alias("task")).agg(F.collect_list("counts").alias("parts"))
                 .mapInArrow(returning_memory(_summed), schema))
    df = np.zeros((SLOT_BLOCKS, SLOTS // SLOT_BLOCKS))
    for r in parts.collect():
        df[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    share = df.ravel() / max(1, docs.count())
    return (IDF_FLOOR + (1 - IDF_FLOOR) * np.log(1 / np.clip(share, RARE, 1)) / np.log(1 / RARE)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling with ``BANDS * ROWS`` samples."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        shape = (BANDS * ROWS, DRAWS)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.lnc = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)

    def sign(self, s: np.ndarray, row: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with shingles, and their samples (rows, samples) as 64-bit hashes."""
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        out = np.empty((len(first), BANDS * ROWS), np.uint64)
        if not len(first):
            return row[first], out
        size = np.diff(np.append(first, len(row)))
        at = (mix(s + np.uint64(SEED)) % np.uint64(DRAWS)).astype(np.int64)
        lnw = np.log(weight).astype(np.float32)
        for k in range(BANDS * ROWS):
            r, beta = self.r[k][at], self.beta[k][at]
            t = np.floor(lnw / r + beta)
            lna = self.lnc[k][at] - r * (t - beta + 1)
            hit = np.flatnonzero(lna == np.repeat(np.minimum.reduceat(lna, first), size))
            best = hit[np.concatenate([[True], row[hit[1:]] != row[hit[:-1]]])]
            out[:, k] = mix(s[best] + t[best].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return row[first], out

    @staticmethod
    def bands(samples: np.ndarray) -> np.ndarray:
        out = np.empty((len(samples), BANDS), np.uint64)
        for b in range(BANDS):
            h = np.full(len(samples), b + 1, np.uint64)
            for k in range(ROWS):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + samples[:, b * ROWS + k])
            out[:, b] = h
        return out


def _signer(table):
    def run(batches):
        powers, sampler, idf = Powers(), Sampler(), np.frombuffer(table.value, np.float32)
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column("text")):
                s, row, tf = weighted(data, off, powers)
                rows, samples = sampler.sign(s, row, tf * idf[(s % np.uint64(SLOTS)).astype(np.int64)])
                size = np.zeros(j - i, np.int64)
                size[rows] = BANDS
                off32 = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                bands = pa.ListArray.from_arrays(off32, pa.array(sampler.bands(samples).view(np.int64).ravel()))
                sig = [b""] * (j - i)
                for r, x in zip(rows.tolist(), samples.astype(np.uint32)):
                    sig[r] = x.tobytes()
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), bands, pa.array(sig, pa.binary())], names=["key", "doc_id", "bands", "sig"])

    return run


def similarity(x, y) -> np.ndarray:
    """Weighted Jaccard similarity per row of two ``weighted`` results with weights."""
    (s1, r1, w1), (s2, r2, w2) = x, y
    s, r = np.concatenate([s1, s2]), np.concatenate([r1, r2])
    w, side = np.concatenate([w1, w2]), np.repeat([False, True], [len(s1), len(s2)])
    order = np.lexsort((side, s, r))
    s, r, w = s[order], r[order], w[order]
    n = int(r[-1]) + 1 if len(r) else 0
    pair = np.flatnonzero((s[1:] == s[:-1]) & (r[1:] == r[:-1]))  # at most two of a shingle and row
    both = np.bincount(r[pair], np.minimum(w[pair], w[pair + 1]), n)
    total = np.bincount(r, w, n)
    return np.divide(both, total - both, out=np.zeros(n), where=total > both)


def _verifier(table):
    def run(batches):
        powers, idf = Powers(), np.frombuffer(table.value, np.float32)

        def weights(data, off):
            s, r, tf = weighted(data, off, powers)
            return s, r, tf * idf[(s % np.uint64(SLOTS)).astype(np.int64)]

        for batch in batches:
            out = []
            for i, j, data, off in text_chunks(batch.column("text_a")):
                part = batch.slice(i, j - i)
                x = weights(data, off)
                # the other side's texts of these rows, in one piece
                y = weights(*text_buffer(part.column("text_b")))
                sim = similarity(x, y)
                out.append(np.concatenate([sim, np.zeros(j - i - len(sim))]))
            sim = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim)], names=["a", "b", "sim"])

    return run


def _sets(table):
    """(key, elements, weights): a text's shingles, a repeated one once per copy, so
    that weighted Jaccard similarity is the weight of the shared elements."""

    def run(batches):
        powers, idf = Powers(), np.frombuffer(table.value, np.float32)
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column("text")):
                s, row, tf = weighted(data, off, powers)
                copy = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
                row, weight = np.repeat(row, tf), np.repeat(idf[(s % np.uint64(SLOTS)).astype(np.int64)], tf)
                element = mix(np.repeat(s, tf) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.lexsort((element, row))
                cut = np.cumsum(np.bincount(row, minlength=j - i))[:-1]
                pack = lambda x: pa.array([v.tobytes() for v in np.split(x[order], cut)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), pack(element), pack(weight)], names=["key", "elements", "weights"])

    return run


def _compared(similar: float):
    """Links between different components of a cell's texts.

    All pairs are compared exactly but those whose total weights rule a link out
    (what they share is at most the smaller), and a pair of several common buckets
    in the first of them."""

    def links(members, band):
        left = [m for m in members if m["side"] != 2]
        right = [m for m in members if m["side"] != 1]
        a, b = (np.frombuffer(b"".join(m["sig"] for m in side), np.uint32).reshape(len(side), BANDS * ROWS) for side in (left, right))
        comp_b = np.array([m["comp"] for m in right], object)
        elements = [np.frombuffer(m["elements"], np.uint64) for m in right]
        total = np.array([np.frombuffer(m["weights"], np.float32).sum(dtype=np.float64) for m in right])
        for i, m in enumerate(left):
            common = (b == a[i]).reshape(len(right), BANDS, ROWS).all(2)
            own, weight = np.frombuffer(m["elements"], np.uint64), np.frombuffer(m["weights"], np.float32)
            mass = weight.sum(dtype=np.float64)
            within = np.minimum(total, mass) >= similar * np.maximum(total, mass) - 1e-6
            pick = np.flatnonzero(within & (comp_b != m["comp"]) & (common.argmax(1) == band) & common[:, band])
            if not len(pick):
                continue
            theirs = np.concatenate([elements[j] for j in pick])
            at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            shared = np.bincount(np.repeat(np.arange(len(pick)), [len(elements[j]) for j in pick]), np.where(own[at] == theirs, weight[at], 0), len(pick))
            near = shared >= similar * (mass + total[pick] - shared)
            yield from ((m["key"], right[j]["key"]) for j in pick[near])

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                found = list(links(row["members"], row["band"]))
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.binary()), pa.array([max(p) for p in found], pa.binary())], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(key, comp): the smallest key of each node's component, by label propagation
    with pointer jumping; every round is written to the shared folder."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "dup-edges")
    label = stored(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "dup-labels")
    while True:
        # a node's own label, its neighbours' labels, and its label's label
        own = label.select("key", F.col("comp").alias("old"), "comp")
        none = F.lit(None).cast("binary").alias("old")
        near = edges.join(label.withColumnRenamed("key", "b"), "b").select(F.col("a").alias("key"), none, "comp")
        beyond = label.join(label.select(F.col("key").alias("comp"), F.col("comp").alias("next")), "comp").select("key", none, F.col("next").alias("comp"))
        new = stored(own.unionByName(near).unionByName(beyond).groupBy("key").agg(F.max("old").alias("old"), F.min("comp").alias("comp")), "dup-labels")
        label = new.select("key", "comp")
        if new.where("old != comp").isEmpty():
            return label


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after more links: only components that they join are looked at."""
    side = lambda c: comp.select(F.col("key").alias(c), F.col("comp").alias(f"of_{c}"))
    ends = links.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    ends = ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a != b").distinct()
    ends = stored(ends, "dup-merges")
    if ends.isEmpty():
        return comp
    into = components(ends).withColumnRenamed("comp", "into")
    single = into.join(comp, "key", "left_anti").select("key", F.col("into").alias("comp"))
    moved = comp.join(into.withColumnRenamed("key", "comp"), "comp", "left").select("key", F.coalesce("into", "comp").alias("comp"))
    return stored(moved.unionByName(single), "dup-labels")


def _links(pairs: DataFrame, texts: DataFrame, table) -> DataFrame:
    """(a, b, sim) of the pairs, from the whole texts."""
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(returning_memory(_verifier(table)), "a binary, b binary, sim double")


def classes(docs: DataFrame, similar: float = SIMILARITY) -> DataFrame:
    """(key, doc_id, class_id, class_size) per row; ``key`` is the text's digest."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    # SLOTS numbers: the bound that makes this broadcast safe
    table = docs.sparkSession.sparkContext.broadcast(slot_weights(rows).tobytes())
    id_type = dict(rows.dtypes)["doc_id"]
    signed = stored(rows.mapInArrow(returning_memory(_signer(table)), f"key binary, doc_id {id_type}, bands array<bigint>, sig binary"), "dup-signatures")
    entries = signed.where(F.size("bands") > 0).dropDuplicates(["key"])

    buckets = stored(entries.select("key", F.posexplode("bands").alias("band", "bucket")), "dup-buckets")
    first = buckets.groupBy("bucket").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = stored(buckets.join(first, "bucket"), "dup-crowded")
    involved = crowded.select("key").distinct()
    texts = stored(rows.select("key", "text").join(involved, "key", "left_semi").dropDuplicates(["key"]), "dup-texts")

    pairs = crowded.where("key != leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    checked = stored(_links(pairs, texts, table), "dup-checked")
    links = checked.where(F.col("sim") >= similar)
    comp = components(links)

    several = crowded.where("n > 2").select("bucket", "band", "key", "leader")

    def placed_by(comp: DataFrame) -> DataFrame:
        """Buckets that still hold several components, with each text's."""
        rows_ = several.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        mixed = rows_.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("bucket")
        return stored(rows_.join(mixed, "bucket"), "dup-placed")

    placed = placed_by(comp)
    for r in range(ROUNDS):
        turn = F.xxhash64("key", "bucket", F.lit(r))
        guest = placed.groupBy("bucket").agg(F.min_by("key", turn).alias("guest"), F.min_by("comp", turn).alias("home"))
        tried = (placed.join(guest, "bucket").where(F.col("comp") != F.col("home"))
                 .select(F.least("key", "guest").alias("a"), F.greatest("key", "guest").alias("b")).distinct())
        comp = merged(comp, stored(_links(tried, texts, table).where(F.col("sim") >= similar).select("a", "b"), "dup-links"))
        placed = placed_by(comp)

    # the rest, with distances to the bucket's first text
    placed = (placed.join(checked.select(F.col("a").alias("leader"), F.col("b").alias("key"), "sim"), ["leader", "key"], "left")
              .withColumn("d", F.when(F.col("key") == F.col("leader"), 0.0).otherwise(1 - F.col("sim"))))
    own = placed.where("key = leader").select("bucket", F.col("comp").alias("home"))
    placed = stored(placed.join(own, "bucket").select("bucket", "band", "key", "comp", "home", "d"), "dup-distances")
    reach = placed.where("comp != home").groupBy("bucket").agg(F.min("d").alias("reach"))
    open_ = placed.join(reach, "bucket").where(((F.col("comp") != F.col("home")) | (F.col("d") >= F.col("reach") - (1 - similar) - 1e-9)) & (F.col("d") > 0))
    open_ = stored(open_.select("bucket", "band", "key", "comp"), "dup-open")
    parted = (open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y"))
               .where("x != y").select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")))
    inside = stored(open_.join(parted, "bucket"), "dup-inside")
    sets = (texts.join(inside.select("key").distinct(), "key", "left_semi")
            .mapInArrow(returning_memory(_sets(table)), "key binary, elements binary, weights binary"))
    sided = (inside.join(entries.select("key", "sig"), "key").join(sets, "key")
             .withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
             # a cell per pair of parts; side 1 and 2: of different parts, 0: within one
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("bucket", "band", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"),
                     F.struct("key", "comp", "sig", "elements", "weights",
                              F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side")).alias("m")))
    cells = sided.groupBy("bucket", "band", "p", "q").agg(F.collect_list("m").alias("members"))
    more = cells.mapInArrow(returning_memory(_compared(similar)), "a binary, b binary").distinct()
    comp = merged(comp, stored(more, "dup-links"))

    ids = signed.groupBy("key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    named = ids.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    named = stored(named, "dup-named")
    name = named.groupBy("comp").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    return signed.select("key", "doc_id").join(named.join(name, "comp").select("key", "class_id", "class_size"), "key")


def report(docs: DataFrame) -> DataFrame:
    """One row per document with its class and the class's documents."""
    return classes(docs).select("doc_id", "class_id", "class_size")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the smallest doc_id (of repeated
    rows one)."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(
        F.min("key").alias("_key"), F.first("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    kept = stored(kept.drop("class_id"), "dup-kept")
    rows = docs.select(*names).withColumn("_text", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    found = rows.join(kept, (F.col("_text") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    # only rows that repeat a document need another shuffle
    once = found.where("_n = 1").select(*names)
    again = found.where("_n > 1").dropDuplicates(["_key", "doc_id"]).select(*names)
    return once.unionByName(again)
