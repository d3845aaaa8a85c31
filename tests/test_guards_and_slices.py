"""Slices in one pass, pushed time ranges, checked lists, default scores, and
operators that must act on the test tables."""

import pytest
from pyspark.sql import functions as F

from rankfold.operators.metrics import default_scores, evaluate, ranked_from_lists
from rankfold.operators.validate import require_valid
from rankfold.plans import params as P
from rankfold.plans import queries as Q
from rankfold.recommenders import itemknn
from rankfold.sources import adapters
from rankfold.streaming.shards import iter_rows, iter_slices, read_slice, write_slices
from small_tables import SF_SMALL


def counted(spark, n):
    """A frame of ``n`` rows and the number of rows computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return spark.range(0, n, 1, 4).mapInArrow(run, "id long"), seen


@pytest.mark.parametrize("size", [1, 7, 50, 200])
def test_slices_compute_their_source_once(spark, size):
    df, seen = counted(spark, 100)
    parts = [[r.id for r in s.collect()] for s in iter_slices(df, "id", size)]
    assert [sorted(p) for p in parts] == [list(range(i, min(100, i + size))) for i in range(0, 100, size)]
    assert seen.value == 100  # however many slices


def test_written_slices_are_read_by_pruning(spark, tmp_path):
    df, seen = counted(spark, 1000)
    out = str(tmp_path / "slices")
    back = write_slices(df.select((F.lit(999) - F.col("id")).alias("k")), ["k"], 64, out)
    assert seen.value == 1000 and back.count() == 1000
    for number in (0, 7, 15):
        part = read_slice(spark, out, number)
        assert [r.k for r in part.collect()] == list(range(64 * number, min(1000, 64 * number + 64)))
        assert f"slice={number}/" in "".join(part.inputFiles()) or "PartitionFilters: [isnotnull(slice" in part._jdf.queryExecution().toString()
    scan = read_slice(spark, out, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slice" in scan and "slice#" in scan
    assert seen.value == 1000


def test_rows_one_slice_at_a_time(spark):
    df, seen = counted(spark, 50)
    assert [r.id for r in iter_rows(df, "id", 8)] == list(range(50)) and seen.value == 50
    assert list(iter_rows(spark.range(0).toDF("id"), "id", 8)) == []


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("segment", ["train", "val", "test"])
def test_time_ranges_reach_the_scan(spark, segment):
    for s, column in ((Q.inter_split(spark, SF_SMALL), "o_orderdate"), (Q.me_split(spark, SF_SMALL, P.ME_VAL_SIZE), "ts")):
        pushed = [line for line in formatted(getattr(s, segment)).split("\n") if "PushedFilters" in line]
        assert any((f"LessThan({column}," in p) == (segment != "test") and (f"GreaterThanOrEqual({column}," in p) == (segment != "train")
                   for p in pushed if column in p)


def test_lists_are_cut_before_their_shuffle(spark):
    """A group limit stands below the exchange by (trial, user), and lists meet norms after the cut."""
    text = plan(itemknn.itemknn_ranked(Q.knn_split(spark, SF_SMALL).train, 24.0, 5))
    lines = [x.strip(" :+-*()0123456789") for x in text.split("== Initial Plan ==")[0].split("\n")]
    limits = [i for i, x in enumerate(lines) if x.startswith("WindowGroupLimit")]
    assert len(limits) == 2
    between = "\n".join(lines[limits[0]:limits[1]])
    assert "Exchange hashpartitioning(trial" in between and "Partial" in lines[limits[1]]


LISTS = [(1, 1, 10, 0.9), (1, 2, 11, 0.5), (1, 3, 12, 0.5), (2, 1, 11, 0.4), (2, 2, 10, 0.3), (2, 3, 13, 0.1)]
SCHEMA = "uid long, rank int, item_id long, score double"


def report(spark, lists, metrics=("ndcg@3", "recall@2"), targets=((1, 10), (2, 13)), **kw):
    t = spark.createDataFrame(list(targets), "uid long, item_id long")
    return {(r.metric, r.k): r.value for r in evaluate(lists, t, list(metrics), strict=True, **kw).collect()}


def test_checked_lists_pass(spark):
    lists = spark.createDataFrame(LISTS, SCHEMA)
    assert report(spark, lists) == report(spark, lists.drop("score")) == report(spark, lists, width=3)
    t = spark.createDataFrame([(1, 10), (2, 13)], "uid long, item_id long")
    require_valid(lists, t, [3])


@pytest.mark.parametrize("bad, what", [
    ([(1, 1, 10, 0.1), (1, 2, 11, 0.5)], "descending"), ([(1, 1, 10, 0.5), (1, 1, 11, 0.4)], "twice"),
    ([(2, 1, 10, 0.5)], "without a ranked list"), ([(1, 1, 10, 0.5)], "beyond the longest list")])
def test_what_lists_must_not_be_fails_the_evaluation(spark, bad, what):
    lists = spark.createDataFrame(bad, SCHEMA)
    k = 1 if what != "beyond the longest list" else 2
    with pytest.raises(Exception, match=what):
        report(spark, lists, [f"recall@{k}"], [(1, 10)])
    if what in ("descending", "twice"):
        with pytest.raises(ValueError):
            require_valid(lists)


def test_widths_are_checked(spark):
    lists = spark.createDataFrame(LISTS, SCHEMA)
    with pytest.raises(ValueError, match="cut-off"):
        report(spark, lists, ["recall@5"], width=3)
    with pytest.raises(Exception, match="beyond the lists' width"):
        report(spark, lists, ["recall@2"], width=2)


def test_default_scores(spark):
    lists = spark.createDataFrame([(1, [7, 5, 9]), (2, [5]), (3, [])], "uid long, item_ids array<long>")
    rows = {(r.uid, r.rank, r.item_id, r.score) for r in ranked_from_lists(lists).collect()}
    assert rows == {(1, 1, 7, 3.0), (1, 2, 5, 2.0), (1, 3, 9, 1.0), (2, 1, 5, 3.0)}
    assert {r.score for r in default_scores(ranked_from_lists(lists).drop("score"), 10).collect()} == {10.0, 9.0, 8.0}


def test_unseen_items_are_dropped_from_the_test_tables(spark):
    """Without the operator there are more rows."""
    keep = Q.me_split(spark, SF_SMALL, P.ME_VAL_SIZE, releases=True)
    drop = Q.me_split(spark, SF_SMALL, P.ME_VAL_SIZE, True, releases=True)
    assert 0 < drop.test.count() < keep.test.count() and 0 < drop.val.count() < keep.val.count()
    lists = Q.QUERIES["seq_split_test_seen_items"](spark, SF_SMALL)
    assert lists.agg(F.sum(F.size("item_id"))).first()[0] == drop.test.count()


def test_unknown_items_fall_into_the_spare_bucket(spark):
    """J5, R7."""
    n = Q.me_split(spark, SF_SMALL, P.ME_VAL_SIZE, releases=True).train.select("item_id").distinct().count()
    counts = Q.QUERIES["unknown_item_bucket"](spark, SF_SMALL)
    spare = counts.where(F.col("item_idx") == n).agg(F.sum("value")).first()[0]
    assert spare > 0 and counts.agg(F.max("item_idx")).first()[0] == n


def test_long_histories_are_cut(spark):
    """Lists are longer than the limit without it."""
    d = Q.seq_data(spark, SF_SMALL)
    longest = Q.QUERIES["seq_listen_lists"](spark, SF_SMALL).agg(F.max(F.size("item_id"))).first()[0]
    assert longest > P.SEQ_MAX_LEN == d.train.agg(F.max(F.size("item_id"))).first()[0]


def test_releases_leave_other_columns_alone(spark):
    a, b = adapters.multi_event(spark, SF_SMALL), adapters.multi_event(spark, SF_SMALL, releases=True)
    assert a.drop("item_id").exceptAll(b.drop("item_id")).count() == 0
    changed = a.select("event_id", "item_id").join(b.select("event_id", F.col("item_id").alias("new")), "event_id").where("item_id <> new")
    assert changed.where("item_id % 4 <> 0").count() == 0 < changed.count()
