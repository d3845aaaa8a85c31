"""Plan shapes (pushdown, semi joins, window limits, no global windows on
event-sized data), sources and sinks, file jobs, sequence jobs, validators."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from small_tables import SF_SMALL
from rankfold.operators import reshape, sequences, validate
from rankfold.operators.indexing import dense_index
from rankfold.operators.ranking import top_k_per_user
from rankfold.operators.split import split_flat
from rankfold.plans import jobs
from rankfold.sources import adapters, events, sinks
from rankfold.streaming.shards import read_shard, row_index, write_shards


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scratch():
    return tempfile.mkdtemp(prefix="rankfold-test-")


def test_split_plan_has_pushdown_and_semi_join(spark):
    d = scratch()
    adapters.multi_event(spark, SF_SMALL).write.parquet(os.path.join(d, "ev.parquet"))
    df = events.read_events(spark, d, None, "ev")
    s = split_flat(df, 28 * 86400, 0, 1800)
    txt = plan(s.test)
    assert "LeftSemi" in txt
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp,2419200)" in txt
    pruned = plan(s.test.select("uid"))
    assert "ReadSchema: struct<uid:bigint,timestamp:bigint>" in pruned


def test_top_k_uses_window_group_limit(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("uid"), F.col("id").alias("item_id"),
                                  (F.col("id") * 13 % 101).cast("double").alias("score"))
    txt = plan(top_k_per_user(df, 5))
    assert "WindowGroupLimit" in txt


def test_dense_index_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 10007).alias("uid"))
    for parts in (1, 7, 32):
        d = dense_index(df, "uid", 1, "idx", num_partitions=parts)
        rows = sorted((r.uid, r.idx) for r in d.collect())
        assert [r[1] for r in rows] == list(range(1, len(rows) + 1))
    # the numbering reads a checkpoint, so repeated use cannot disagree
    d = dense_index(df, "uid", 0, "idx")
    assert d.join(d.withColumnRenamed("idx", "idx2"), "uid").filter("idx <> idx2").count() == 0


def test_row_index_and_shards(spark):
    df = spark.range(1003).select((F.col("id") * 37 % 1003).alias("k"))
    r = row_index(df, ["k"]).collect()
    assert sorted((x.k, x.row_idx) for x in r) == [(i, i) for i in range(1003)]
    out = os.path.join(scratch(), "shards")
    write_shards(df, ["k"], 4, out)
    got = [read_shard(spark, out, w).select("k").collect() for w in range(4)]
    assert [len(g) for g in got] == [251, 251, 251, 250]
    assert [x.k for g in got for x in g] == list(range(1003))


def test_sinks_and_output_naming(spark):
    d = scratch()
    df = adapters.multi_event(spark, SF_SMALL)
    first = sinks.resolve_output_path(spark, d, "likes.parquet", "columns")
    sinks.write_parquet(df, first)
    second = sinks.resolve_output_path(spark, d, "likes.parquet", "columns")
    assert second.endswith("columns_likes.parquet")
    sinks.write_parquet(df, second)
    with pytest.raises(FileExistsError):
        sinks.resolve_output_path(spark, d, "likes.parquet", "columns")
    assert spark.read.parquet(first).count() == df.count()


def test_make_multievent_and_sequential_jobs(spark):
    src = scratch()
    for kind, t in adapters.event_kind_tables(spark, SF_SMALL).items():
        t.write.parquet(f"{src}/{kind}s.parquet")
    out = jobs.make_multievent(spark, src, tie_cols=["event_id"])
    me = spark.read.parquet(out)
    assert me.count() == adapters.multi_event(spark, SF_SMALL).count()
    assert set(me.columns) >= {"uid", "timestamp", "item_id", "event_type", "played_ratio_pct"}
    dst = scratch()
    written = jobs.transform_to_sequential(spark, src, dst, "structs", files=["likes.parquet"])
    seq = spark.read.parquet(written[0])
    assert seq.columns == ["uid", "events"]
    assert seq.select(F.sum(F.size("events"))).first()[0] == spark.read.parquet(f"{src}/likes.parquet").count()


def test_sequence_jobs(spark):
    rows = [(1, [5, 6, 7, 8]), (2, [9])]
    seq = spark.createDataFrame(rows, "uid long, item_id array<long>")
    nr = {r.uid: r for r in sequences.next_item_rows(seq, 10, max_seq_len=2, seed=1).collect()}
    assert nr[1].item_ids == [6, 7] and nr[1].positive_ids == [7, 8] and nr[1].length == 2
    assert all(1 <= x <= 10 for x in nr[1].negative_ids)
    assert nr[2].item_ids == [] and nr[2].negative_ids == []
    pos = sorted(tuple(r) for r in sequences.position_table(seq).collect())
    assert pos[0] == (1, 0, 5, 3, True) and pos[3] == (1, 3, 8, 0, True)
    held = spark.createDataFrame([(1, [3])], "uid long, item_id array<long>")
    b = sequences.flatten_batches(sequences.eval_rows(seq, held, 3), ["item_id_train", "item_id_valid"], 1).collect()
    assert b[0].item_id_train_ids == [6, 7, 8] and b[0].item_id_train_lengths == [3]


def test_validators(spark):
    ranked = spark.createDataFrame([(1, 1, 5, 1.0), (1, 2, 6, 2.0)], "uid long, rank int, item_id long, score double")
    assert validate.unsorted_scores(ranked).count() == 1
    targets = spark.createDataFrame([(2, 5)], "uid long, item_id long")
    with pytest.raises(ValueError):
        validate.require_valid(ranked.filter("rank = 1"), targets)
    with pytest.raises(ValueError):
        validate.require_valid(ranked.filter("rank = 1"), None, ks=[2])
    validate.require_valid(ranked.filter("rank = 1"), ranked.select("uid", "item_id"), ks=[1])


def test_union_fills_missing_listen_columns(spark):
    tables = adapters.event_kind_tables(spark, SF_SMALL)
    u = reshape.union_event_kinds(tables)
    likes = u.filter("event_type = 'like'")
    assert likes.filter(F.col("played_ratio_pct").isNotNull()).count() == 0
    assert u.filter("event_type = 'listen'").select(F.min("event_ord")).first()[0] == 0


def test_small_helpers(spark):
    from rankfold.streaming.shards import iter_slices

    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "uid long, rank int, item_id long")
    targets = spark.createDataFrame([(2, 9)], "uid long, item_id long")
    assert [r.uid for r in validate.cut_off_ranked(ranked, targets).collect()] == [2]
    numbered = spark.range(10).withColumnRenamed("id", "row_idx")
    sizes = [s.count() for s in iter_slices(numbered, "row_idx", 4)]
    assert sizes == [4, 4, 2]
