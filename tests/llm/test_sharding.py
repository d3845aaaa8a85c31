"""Sharding by longest processing time against the plain rule."""

import collections
import random
import zlib

import pytest

from rankfold.llm import sharding


def plain(sizes, shards):
    """Every group on its own: descending, to the least loaded shard."""
    loads = [0] * shards
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return loads


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_equal_sizes_are_dealt_like_single_groups(seed):
    rng = random.Random(seed)
    shards = rng.choice([1, 2, 3, 8])
    sizes = [rng.choice([1, 2, 3, 7, 1000, rng.randint(1, 50)]) for _ in range(rng.randint(0, 5000))] + [rng.randint(1, 20_000)] * rng.randint(0, 3)
    histogram = sorted(collections.Counter(sizes).items(), reverse=True)
    loads = [0] * shards
    for size, given in sharding.deal(histogram, shards):
        assert sum(given) == dict(histogram)[size] and min(given) >= 0
        loads = [x + size * g for x, g in zip(loads, given)]
    assert loads == plain(sizes, shards)


def check(rows, texts, shards=8):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id is not None, r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (i is not None, i, size(t), zlib.crc32((t or "").encode())) for i, t in texts)
    assert {r.law for r in rows} <= {"bytes"} and {r.grown_shard for r in rows} <= {None}
    by_key, by_shard, loads = collections.defaultdict(set), collections.defaultdict(list), [0] * shards
    for r in rows:
        by_key[r.size, r.text_crc32].add(r.shard)
        by_shard[r.shard].append((r.slot, r.doc_id is not None, r.doc_id))
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in by_key.values())
    for slots in by_shard.values():
        assert [s for s, _, _ in sorted(slots)] == list(range(len(slots)))
        assert [x[1:] for x in sorted(slots)] == sorted(x[1:] for x in slots)
    groups = collections.Counter()
    for _, t in texts:
        groups[t or ""] += size(t)
    assert sorted(loads) == sorted(plain(groups.values(), shards))


def test_given_documents(spark, docs_of, small_texts):
    check(sharding.report(docs_of(small_texts, extra=True)).collect(), small_texts)


def test_hot_group_nulls_empty_and_repeated_rows(spark, docs_of):
    texts = [(i, f"text number {i} " * (i % 7)) for i in range(300)] + [(1000 + i, "a hot text") for i in range(200)]
    texts += [(5, None), (6, ""), (6, ""), (6, "six"), (6, "six"), (7, "lang €" * 20_000)]
    check(sharding.report(docs_of(texts, extra=True)).collect(), texts)
    for few in ([], [(1, None)], [(1, "a"), (2, "b"), (3, "a")]):
        check(sharding.report(docs_of(few)).collect(), few)


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (None, None), (2, "b")], "doc_id bigint, text string")
    rows = sharding.report(docs).collect()
    assert len(rows) == 4 and sorted(r.slot for r in rows if r.size == 2 and r.doc_id is None) == [0, 1]


def test_written_shards_hold_every_row_and_column(spark, docs_of, tmp_path):
    texts = [(i, f"word {i % 40} " * (i % 11)) for i in range(400)] + [(9, None)]
    docs = docs_of(texts, extra=True)
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, docs.collect()))
    where = collections.defaultdict(set)
    for r in back.collect():
        where[r.text or ""].add(r.shard)
    assert all(len(s) == 1 for s in where.values()) and set().union(*where.values()) == {0, 1, 2, 3}
