"""Sharding by longest processing time.

Documents of equal text form a group that stays together.  Groups, largest
first, go to the shard that is least loaded so far, which a heap keeps at its
top.  A group's size is the sum of its documents' sizes (UTF-8 bytes plus one
each), so shards come out nearly equal in bytes: two differ by no more than the
smallest group dealt last, unless one group alone outweighs a fair share.

Groups of the same size are interchangeable to that rule, so the heap takes a
histogram of group sizes instead of the groups: each size with the number of
groups that have it, descending.  The driver holds one entry a distinct size.
Distinct sizes add up to the table's bytes T at most, so there are no more than
sqrt(2 T) of them (14 million at 100 TB, far fewer with texts of ordinary
lengths), whatever the number of documents.  A long run of equal sizes takes one
step of the heap for all whole rounds (``deal``), with the same outcome.  The
groups of a size are numbered by a distributed sort and take their shards by
that number; nothing but sizes and counts reaches the driver.

A group is known by size, crc32 and 64-bit hash of the text (some 96 bits of
hash: two different texts of one of 10^10 groups meet with a chance below
10^-8, and would only share a shard).  Rows join their group on that key, so a
group with a third of all rows is one row on one side, and its rows on the other
side are split by adaptive execution.

Defined results: a null text counts as an empty one (size 1, crc32 0, the same
group).  Repeated rows are documents of their own.  A null doc_id is kept and
sorts first.  An empty table gives an empty result.  Only doc_id and text are
read; ``write_shards`` carries all columns along.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import stored
from rankfold.session import default_parallelism
from rankfold.streaming.shards import row_index

SHARDS = 8

#: columns that tell a group, beside each other
_KEY = ["size", "text_crc32", "text_hash"]
#: groups of one size beyond which whole rounds are dealt at once
_RUN = 64


def group_key(text: str = "text") -> list:
    """Size and hashes of a text, as columns; null is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [(F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("text_hash")]


def _rounds(loads: list[int], size: int, count: int) -> list[int]:
    """Groups of ``size`` each load takes before any heap would pass a level: the
    highest level that ``count`` groups reach.  Up to len(loads) groups are left."""
    def taken(level):
        return [max(0, -(-(level - x) // size)) for x in loads]

    low, high = min(loads), min(loads) + size * count + 1  # too low or right, too high
    while high - low > 1:
        mid = (low + high) // 2
        if sum(taken(mid)) <= count:
            low = mid
        else:
            high = mid
    return taken(low)


def deal(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For (group size, number of groups), sizes descending: how many of these groups
    each shard gets when one after the other goes to the least loaded shard (ties to
    the smaller number)."""
    heap = [(0, s) for s in range(shards)]
    for size, count in sizes:
        given = [0] * shards
        if count > _RUN * shards:
            loads = [x for x, _ in sorted(heap, key=lambda e: e[1])]
            given = _rounds(loads, size, count)
            heap = [(x + size * g, s) for s, (x, g) in enumerate(zip(loads, given))]
            heapq.heapify(heap)
        for _ in range(count - sum(given)):
            load, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        yield size, given


def _plan(groups: DataFrame, shards: int) -> DataFrame:
    """(bytes, first, ends): per group size, the number of its first group in the
    order of sizes and, by shard, up to which of its groups that shard takes."""
    spark = groups.sparkSession
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes")).toArrow()
    out, first = {"bytes": [], "first": [], "ends": []}, 0
    for size, given in deal(zip(sizes.column("bytes").to_pylist(), sizes.column("n").to_pylist()), shards):
        ends = [sum(given[:s + 1]) for s in range(shards)]
        for k, v in zip(out, (size, first, ends)):
            out[k].append(v)
        first += ends[-1]
    schema = pa.schema([("bytes", pa.int64()), ("first", pa.int64()), ("ends", pa.list_(pa.int64()))])
    return spark.createDataFrame(pa.table(out, schema=schema))


def place_groups(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The groups among rows that carry ``group_key``: key, documents, bytes, shard."""
    counted = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"))
    counted = counted.withColumn("bytes", F.col("size") * F.col("n_docs")).withColumn("_descending", -F.col("bytes"))
    groups = row_index(counted, ["_descending", "text_hash", "text_crc32", "size"], out_col="_place")
    nth = F.col("_place") - F.col("first")
    return (groups.join(_plan(groups, shards), "bytes")
            .select(*_KEY, "n_docs", "bytes", F.size(F.filter("ends", lambda e: e <= nth)).alias("shard")))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and its slot there (from 0,
    by doc_id)."""
    rows = stored(docs.select("doc_id", *group_key()), "shard-rows")
    placed = rows.join(stored(place_groups(rows, shards), "shard-groups"), _KEY).select("doc_id", *_KEY, "shard")
    numbered = row_index(placed, ["shard", "doc_id", "text_hash", "text_crc32", "size"], out_col="_place")
    first = numbered.groupBy("shard").agg(F.min("_place").alias("_first"))
    # one row a shard
    return (numbered.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).alias("slot")))


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``assign`` with the law that holds (sizes near equal; the others don't)."""
    return assign(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """All columns of ``docs`` as Parquet under ``path/shard=<number>/``, which must
    not exist; a column ``shard`` gives way to the folder's."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"]).alias("doc"), *group_key())
    groups = stored(place_groups(rows.select(*_KEY), shards), "shard-groups").select(*_KEY, "shard")
    out = rows.join(groups, _KEY).repartitionByRange(default_parallelism(spark), "shard", "text_hash")
    out.select("doc.*", "shard").write.partitionBy("shard").parquet(path)
