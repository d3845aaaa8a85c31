"""Nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Vectors get one more component so that the largest inner product becomes the
smallest Euclidean distance: x -> (x, sqrt(M^2 - |x|^2)) with M the largest
norm, and queries are scaled to norm M.  Each of ``TABLES`` tables hashes a
vector by several projections floor((a.x + b) / w) on normal (2-stable)
vectors a.  A query visits, in each table, perturbed buckets in the order of
their estimated success: the probability that a neighbour at distance d falls
there, given where the query lies within its cells.  Buckets are visited
until these probabilities add up to what the table owes for ``TARGET`` over
all tables.  Candidates of all tables are merged and ranked by the exact
inner product in double precision.

w, d and the number of projections come from a sample of at most ``SAMPLE``
distinct vectors, chosen by hash; every vector is indexed.  The sample also
gives each query a lower bound on its last place (candidates below it cannot
be in the result, as the sample's best are candidates too), which keeps the
rows that leave a bucket few.

Work is dealt as blocks: members and visiting queries of a bucket are packed
into rows of about ``BLOCK`` vectors, so a crowded bucket spreads over many
tasks, and of the pairs that a task scores only each query's best become rows.
Equal vectors are one entry with their ``k + 1`` smallest ids: no more of them can be in a
result.

Defined results: vectors that are null, zero, hold null or non-finite
components, lack an id or differ in length from the most common one take no
part.  A repeated row (same id and vector) counts once.  Ties go to the
smaller id.  With fewer than k candidates all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.common import bounded_batches, received, rows_of, ship, stored
from rankfold.llm.text import mix

K = 20
TABLES = 8
#: estimated chance that some table visits a neighbour's bucket
TARGET = 0.98
#: distinct vectors that the parameters are fitted on
SAMPLE = 2048
#: vectors in a packed row, and entries a bucket should hold on average
BLOCK, BUCKET = 256, 64
#: scored pairs beyond the best that a task holds, and the best of all its queries together
HELD, HELD_BEST = 200_000, 1_000_000
#: queries whose visits a task makes at once: some hundred rows with a vector each a query
VISITING = 64
#: cells looked at on either side of a query's cell
REACH = 2
SEED = 11


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    v = F.col(vec_col)
    big = F.lit(float("inf"))
    rows = (df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))
            .where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
            .where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("vec", lambda x: x != 0)))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0]["d"] if sizes else 0))


def keyed(rows: DataFrame) -> DataFrame:
    """128-bit key of the vector, equal for equal vectors."""
    return rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.reverse("vec"), F.lit(1))})


class Hashing:
    """Projections of all tables and the estimated success of perturbed buckets."""

    def __init__(self, sample: np.ndarray, n: int, norm: float, k: int, tables: int = TABLES, target: float = TARGET):
        rng = np.random.default_rng(SEED)
        self.norm, self.k = norm, k
        self.sample_size, dim = sample.shape
        per = max(2, round(np.log2(max(2.0, n / BUCKET)) / 1.4))
        x = self.lifted(sample)
        q = self.scaled(sample[: min(256, len(sample))])
        far = np.sqrt(np.maximum(0, 2 * norm * norm - 2 * q @ x.T))
        near = np.sort(far, axis=1)[:, min(k, len(sample) - 1)]
        self.d = float(max(np.median(near), 1e-3 * norm))
        self.width = 2 * self.d
        self.a = rng.standard_normal((tables, per, dim + 1))
        self.b = rng.random((tables, per)) * self.width
        self.owed = 1 - (1 - target) ** (1 / tables)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.norm ** 2 - (x * x).sum(1)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def scaled(self, q: np.ndarray) -> np.ndarray:
        q = q * (self.norm / np.sqrt((q * q).sum(1)))[:, None]
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1)

    def keys(self, table: int, cells: np.ndarray) -> np.ndarray:
        h = np.full(cells.shape[:-1], table + 1, np.uint64)
        for i in range(cells.shape[-1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[..., i].astype(np.uint64))
        return h.view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows) bucket keys of indexed vectors."""
        x = self.lifted(x)
        return np.stack([self.keys(t, np.floor((x @ a.T + b) / self.width).astype(np.int64)) for t, (a, b) in enumerate(zip(self.a, self.b))])

    def probes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query index, bucket key) of all visits of the queries."""
        q = self.scaled(q)
        owner, key = [], []
        for t, (a, b) in enumerate(zip(self.a, self.b)):
            place = (q @ a.T + b) / self.width
            cell = np.floor(place).astype(np.int64)
            chance = self._chances((place - cell) * self.width)
            todo, most = np.arange(len(q)), 64
            while len(todo):  # twice as many for the queries that still owe some
                steps, mass = self._best(chance[todo], most)
                total = np.cumsum(mass, axis=1)
                done = (total[:, -1] >= self.owed) | (steps.shape[1] < most)
                need = np.minimum((total < self.owed).sum(1) + 1, steps.shape[1])
                for i in np.flatnonzero(done):
                    cells = cell[todo[i]] + steps[i, :need[i]]
                    key.append(self.keys(t, cells))
                    owner.append(np.full(need[i], todo[i]))
                todo, most = todo[~done], most * 2
        return np.concatenate(owner), np.concatenate(key)

    def _chances(self, inside: np.ndarray) -> np.ndarray:
        """(rows, projections, 2 * REACH + 1): where a neighbour at distance d falls."""
        edges = (np.arange(-REACH, REACH + 2) * self.width - inside[..., None]) / self.d
        p = np.diff(_normal_cdf(edges), axis=-1)
        return np.maximum(p, 1e-12)

    @staticmethod
    def _best(chance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` likeliest perturbations, best first: steps and probabilities.

        Built projection by projection: the best combinations of the first i
        only extend best combinations of the first i - 1.
        """
        n, per, width = chance.shape
        mass = np.ones((n, 1))
        steps = np.zeros((n, 1, 0), np.int64)
        offsets = np.arange(width) - REACH
        for i in range(per):
            wide = (mass[:, :, None] * chance[:, i, None, :]).reshape(n, -1)
            order = np.argsort(-wide, axis=1, kind="stable")[:, :most]
            mass = np.take_along_axis(wide, order, 1)
            before = np.take_along_axis(steps, (order // width)[:, :, None], 1)
            steps = np.concatenate([before, offsets[order % width][:, :, None]], axis=2)
        return steps, mass


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    """Normal distribution function (tanh form, error under 2e-4)."""
    return 0.5 * (1 + np.tanh(np.sqrt(2 / np.pi) * (z + 0.044715 * z ** 3)))


def _matrix(column) -> np.ndarray:
    """Arrow list column of equal lengths as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _index(broadcast):
    def run(batches):
        h, _ = received(broadcast)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"))
            raw = pa.array([v.tobytes() for v in x.astype(np.float32 if pa.types.is_float32(batch.column("vec").type.value_type) else np.float64)], pa.binary())
            for keys in h.buckets(x):
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("entry"), raw], names=["key", "entry", "raw"])

    return run


def _visit(broadcast):
    """Probes of the queries, with the score that a candidate must reach, and as
    key null the sample's best as first candidates."""

    def run(batches):
        h, (entries, sample) = received(broadcast)
        for batch in (b.slice(a, VISITING) for b in batches for a in range(0, b.num_rows, VISITING)):
            q = _matrix(batch.column("vec"))
            s = q @ sample.T
            k = min(h.k + 1, len(sample))
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(s, top, 1).min(1) - 1e-9 if k > h.k else np.full(len(q), -np.inf)
            owner, key = h.probes(q)
            raw = pa.array([v.tobytes() for v in q], pa.binary())
            qk = [batch.column(c) for c in ("k1", "k2")]
            take = pa.array(owner)
            none = pa.nulls(len(owner), pa.int64()), pa.nulls(len(owner), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(key), *(c.take(take) for c in qk), raw.take(take), pa.array(least[owner]), *none], names=_VISIT)
            who = np.repeat(np.arange(len(q)), k)
            what = top.ravel()
            score = (q[who] * sample[what]).sum(1)
            no = [pa.nulls(len(who), t) for t in (pa.int64(), pa.binary(), pa.float64())]
            yield pa.RecordBatch.from_arrays([no[0], *(c.take(pa.array(who)) for c in qk), no[1], no[2], pa.array(entries[what]), pa.array(score)], names=_VISIT)

    return run


_VISIT = ["key", "k1", "k2", "raw", "least", "entry", "score"]


class _Best:
    """Running best entries of a task's queries; only these leave the task."""

    def __init__(self, k: int):
        self.k, self.number, self.keys = k, {}, []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def queries(self, visits) -> np.ndarray:
        out = np.empty(len(visits), np.int64)
        for i, v in enumerate(visits):
            key = (v["k1"], v["k2"])
            if key not in self.number:
                self.number[key] = len(self.keys)
                self.keys.append(key)
            out[i] = self.number[key]
        return out

    def add(self, query, entry, score) -> None:
        self.parts.append((query, entry, score))
        self.pending += len(query)
        if self.pending > HELD + 2 * self.k * len(self.keys):
            self.cut()

    def cut(self) -> None:
        """The k best distinct entries of each query (ties: smaller entry)."""
        if not self.parts:
            return
        query, entry, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((entry, -score, query))
        query, entry, score = query[order], entry[order], score[order]
        new = np.ones(len(query), bool)  # an entry has one score, so its repeats are neighbours
        new[1:] = (query[1:] != query[:-1]) | (entry[1:] != entry[:-1])
        query, entry, score = query[new], entry[new], score[new]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = place < self.k
        self.parts = [(query[keep], entry[keep], score[keep])]
        self.pending = int(keep.sum())

    def batch(self):
        self.cut()
        query, entry, score = self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        keys = np.array(self.keys, np.int64).reshape(-1, 2)[query]
        out = pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(entry), pa.array(score)], names=["k1", "k2", "entry", "score"])
        self.__init__(self.k)
        return out


def _rank(single: bool, k: int):
    """Scores of packed members against packed visiting queries, the best of a task."""

    def run(batches):
        best = _Best(k)
        for batch in batches:
            for row in rows_of(batch):
                x = np.frombuffer(b"".join(row["raws"]), np.float32 if single else np.float64).reshape(len(row["raws"]), -1).astype(np.float64)
                q = np.frombuffer(b"".join(v["raw"] for v in row["visits"]), np.float64).reshape(len(row["visits"]), -1)
                least = np.array([v["least"] for v in row["visits"]])
                i, j = np.nonzero(q @ x.T >= least[:, None])
                best.add(best.queries(row["visits"])[i], np.array(row["entries"], np.int64)[j], (q[i] * x[j]).sum(1))
                if len(best.keys) * k > HELD_BEST:
                    yield best.batch()
        yield best.batch()

    return run


def _dealt(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``part``: splits the rows of a key into groups of about BLOCK, by a hash."""
    counts = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    return df.join(counts, key).withColumn("part", F.pmod(F.xxhash64(*by), F.col("parts")))


def search(df: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of each query row."""
    spark = df.sparkSession
    bounded_batches(spark)  # packed rows hold hundreds of vectors
    rows = usable(df, id_col, vec_col)
    order = Window.partitionBy("k1", "k2").orderBy("id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = (keyed(rows).select("k1", "k2", "id", "vec", F.dense_rank().over(order).alias("rank"), F.first("id").over(upto).alias("entry"))
               .where(F.col("rank") <= k + 1))
    members = stored(members.dropDuplicates(["entry", "id"]), "ann-entries")
    entries = members.where("id = entry").select("entry", "vec")
    about = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("m")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not about["n"]:
        return empty
    # SAMPLE rows: the bound that makes collecting and shipping them safe
    picked = entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).collect()
    sample = np.array([r["vec"] for r in picked], np.float64)
    hashing = Hashing(sample, about["n"], float(np.sqrt(about["m"])), k, tables, target)
    bound = ship(spark, (hashing, (np.array([r["entry"] for r in picked], np.int64), sample)))
    single = dict(entries.dtypes)["vec"] == "array<float>"

    asked = usable(queries, id_col, vec_col).where(F.size("vec") == sample.shape[1])
    asked = keyed(asked)
    distinct = asked.dropDuplicates(["k1", "k2"]).select("k1", "k2", "vec")
    visits = stored(distinct.mapInArrow(_visit(bound), "key bigint, k1 bigint, k2 bigint, raw binary, least double, entry bigint, score double"), "ann-visits")
    index = entries.mapInArrow(_index(bound), "key bigint, entry bigint, raw binary")
    packed = (_dealt(index, "key", ["entry"]).groupBy("key", "part")
              .agg(F.collect_list("entry").alias("entries"), F.collect_list("raw").alias("raws")).drop("part"))
    callers = (_dealt(visits.where("key is not null"), "key", ["k1", "k2"]).groupBy("key", "part")
               .agg(F.collect_list(F.struct("k1", "k2", "raw", "least")).alias("visits")).drop("part"))
    found = packed.join(callers, "key").mapInArrow(_rank(single, k + 1), "k1 bigint, k2 bigint, entry bigint, score double")
    first = visits.where("key is null").select("k1", "k2", "entry", "score")
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "entry")
    merged = (found.unionByName(first).groupBy("k1", "k2", "entry").agg(F.max("score").alias("score"))
              .withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"))
    ids = members.select("entry", "id")
    each = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "id")
    lists = (merged.join(ids, "entry").withColumn("r", F.row_number().over(each)).where(F.col("r") <= k + 1)
             .select("k1", "k2", "id", "score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.select(F.col("id").alias("query_id"), "k1", "k2").distinct().join(lists, ["k1", "k2"])
            .where(F.col("id") != F.col("query_id")).withColumnRenamed("id", "vec_id")
            .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def exact(df: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> list[tuple[int, int, int, float]]:
    """Brute force on small inputs, for measuring recall in tests."""
    rows = usable(df, id_col, vec_col).distinct().collect()
    asked = {r["id"] for r in usable(queries, id_col, vec_col).collect()}
    x, ids = np.array([r["vec"] for r in rows], np.float64), np.array([r["id"] for r in rows])
    out = []
    for i in np.flatnonzero(np.isin(ids, list(asked))):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return out
