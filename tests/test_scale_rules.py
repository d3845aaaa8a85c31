"""Behaviour at scale shapes: hot keys, exact negatives, file order, paddings."""

import math

import pytest
from pyspark.sql import functions as F

from rankfold.operators.metrics import evaluate
from rankfold.operators.ranking import pad_with_zero_scores
from rankfold.operators.split import split_flat
from rankfold.plans import jobs
from rankfold.recommenders import bpr
from rankfold.recommenders import factorization as mf


def test_hot_user_is_split_in_the_time_split(spark):
    """One user with a third of the events: AQE splits the semi join's partition."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        # several map outputs, or there is nothing to split a partition by
        ev = spark.range(0, 600_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1).cast("long").alias("uid"),
            (F.col("id") * 7919 % 100_003).alias("item_id"), (F.col("id") % 2 * 100).alias("timestamp"))
        test = split_flat(ev, 100, 0, 10).test
        out = test.agg(F.sum("item_id"))
        assert out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        assert test.count() == 100_000  # only the hot user is in both segments
    finally:
        for k in low:
            spark.conf.set(k, keep[k]) if k in keep else spark.conf.unset(k)


def test_every_open_pair_gets_an_exact_negative(spark):
    """Users who have nearly every item still get a uniform unseen one."""
    n = 60
    rows = [(u, i, 0) for u in range(40) for i in range(n) if i != u % n or u == 39]
    rows += [(99, 3, 0)]
    train = spark.createDataFrame(rows, "uid long, item_id long, timestamp long")
    for attempts in (2, 16):
        got = {(r.uid, r.item_id): r.neg_item_id for r in mf.bpr_triples(train, seed=1, attempts=attempts).collect()}
        seen = {(u, i) for u, i, _ in rows}
        assert set(got) == seen
        for (u, _), neg in got.items():
            assert (neg is None) == (u == 39) and (u, neg) not in seen


def test_unseen_draws_reach_every_gap(spark):
    """The exact draw alone: all unseen items occur, no seen one does."""
    seen = [0, 1, 4, 5, 6, 9]
    train = spark.createDataFrame([(u, i, 0) for u in range(200) for i in seen] + [(1000, i, 0) for i in range(12)], "uid long, item_id long, timestamp long")
    ix = mf.indexed_pairs(train)
    idict = ix.items.withColumnRenamed("item_id", "neg_item_id")
    pairs = ix.pairs.select("uid", "item_id").where("uid < 1000")
    out = mf._unseen_draw(pairs, pairs, idict, 12, 7).collect()
    assert len(out) == 1200 and {r.neg_item_id for r in out} == set(range(12)) - set(seen)


def test_bpr_norms_do_not_grow_with_the_data(spark):
    def largest(users):
        rows = spark.range(users).select(F.col("id").alias("uid"), F.explode(F.array(F.lit(0), F.col("id") % 19 + 1)).alias("item_id"),
                                         F.lit(0).alias("timestamp"))
        _, items = bpr.bpr_fit(rows.select("uid", F.col("item_id").cast("long").alias("item_id"), "timestamp"), rank=4, learning_rate=0.05, iterations=2, seed=3)
        return max(math.sqrt(sum(x * x for x in r.embedding)) for r in items.collect())

    a, b = largest(200), largest(5000)
    assert 0.5 < a / b < 2


def test_padding_gives_every_user_a_list(spark):
    ranked = spark.createDataFrame([(1, 1, 5, 0.5)], "uid long, rank int, item_id long, score double")
    items = spark.createDataFrame([(i,) for i in range(4, 9)], "item_id long")
    users = spark.createDataFrame([(1,), (2,), (2,)], "uid long")
    got = sorted((r.uid, r.rank, r.item_id) for r in pad_with_zero_scores(ranked, items, 3, users=users).collect())
    assert got == [(1, 1, 5), (1, 2, 4), (1, 3, 6), (2, 1, 4), (2, 2, 5), (2, 3, 6)]


@pytest.mark.parametrize("file_order", [False, True])
def test_fold_keeps_file_order(spark, tmp_path, file_order):
    """A small first part and a large second one: Spark packs the large one first."""
    src = tmp_path / "src"
    for name, lo, n in (("a", 0, 10), ("b", 10, 200_000)):
        df = spark.range(lo, lo + n, 1, 1).select(F.lit(1).cast("long").alias("uid"), F.col("id").alias("item_id"), F.lit(5).cast("long").alias("timestamp"),
                                                  F.lit(1).cast("short").alias("is_organic"))
        df.coalesce(1).write.parquet(str(tmp_path / name))
    import shutil

    (src / "log.parquet").mkdir(parents=True)
    for k, name in enumerate("ab"):
        part = next((tmp_path / name).glob("part-*.parquet"))
        shutil.copy(part, src / "log.parquet" / f"part-{k}.parquet")
    (out,) = jobs.transform_to_sequential(spark, str(src), str(tmp_path / "out"), "columns", files=["log.parquet"], file_order=file_order)
    items = spark.read.parquet(out).first()["item_id"]
    assert list(items) == list(range(200_010))


def test_positions_of_the_sorted_log(spark):
    from rankfold.streaming.shards import numbered, shard_rows

    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    rows = numbered(df.orderBy("x"), "pos").collect()
    assert all(r.x == r.pos for r in rows)
    shards = shard_rows(df, ["x"], 7).collect()
    assert all(r.row_idx == r.x and r.shard == r.x // 143 for r in shards)


@pytest.mark.parametrize("folded", [False, True])
def test_written_lists_are_not_broadcast(spark, folded):
    """Lists whose file is small beside the targets: in a broadcast they are many times that."""
    lists = spark.range(2000).select(F.col("id").alias("uid"), F.sequence(F.lit(1), F.lit(100)).cast("array<bigint>").alias("item_ids"))
    if not folded:
        lists = lists.select("uid", F.posexplode("item_ids").alias("p", "item_id")).select("uid", (F.col("p") + 1).alias("rank"), "item_id")
    targets = spark.range(3_000_000).select((F.col("id") % 2000).alias("uid"), (F.col("id") % 1009).alias("item_id"))
    report = evaluate(lists, targets, ["recall@100"], strict=True, width=100)
    report.collect()
    final = report._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BuildLeft" not in final


def test_als_blocks_follow_the_work_a_pair(spark):
    """Copies of factors are what a fit shuffles: short fits of low rank have few blocks."""
    assert mf.als_blocks(193_000_000, 16, 5) <= 8  # 97 at 2 million pairs a block
    assert mf.als_blocks(193_000_000, 64, 100) == 97
    assert mf.als_blocks(1000, 16, 5) == 4 and mf.als_blocks(0, 64, 100) == 4
    assert mf.als_blocks(10 ** 10, 1, 1) == -(-10 ** 10 // mf.MOST_PAIRS_PER_BLOCK)


def test_als_residuals_of_pairs_already_numbered(spark):
    train = spark.range(400).select((F.col("id") % 23).alias("uid"), (F.col("id") * 7 % 31).alias("item_id"))
    indexed = mf.indexed_pairs(train)
    users, items = mf.als_factors(train, rank=4, reg=0.05, iterations=5, seed=1, indexed=indexed)
    plain = {r.uid: (r.n_items, round(r.residual, 6)) for r in mf.als_residuals(train, users, items, 0.05).collect()}
    given = {r.uid: (r.n_items, round(r.residual, 6)) for r in mf.als_residuals(train, users, items, 0.05, indexed=indexed).collect()}
    assert given == plain and len(plain) == 23


def test_long_fits_have_blocks_for_more_slots(spark):
    """the 3.2 million pairs of six times sf0.1 made 4 blocks, so 4 of twelve slots worked."""
    assert mf.als_blocks(3_200_000, 64, 100) == 12 and mf.als_blocks(3_200_000, 64, 10) == 4
    assert mf.als_blocks(540_000, 64, 100) == 4
    assert mf.fits_at_once(3_200_000, 64, 10, 12) == 3 and mf.fits_at_once(3_200_000, 64, 100, 12) == 2
    assert mf.fits_at_once(1000, 64, 10, 800) == mf.FITS_AT_ONCE


def test_fits_side_by_side_equal_fits_in_turn(spark):
    train = spark.range(400).select((F.col("id") % 23).alias("uid"), (F.col("id") * 7 % 31).alias("item_id"))
    indexed = mf.indexed_pairs(train)

    def fit(reg):
        users, items = mf.als_factors(train, rank=4, reg=reg, iterations=3, seed=1, indexed=indexed)
        return sorted(map(tuple, users.collect())) + sorted(map(tuple, items.collect()))

    regs = [0.01, 0.1, 1.0]
    assert mf.fitted_together(fit, regs, spark, 3) == [fit(r) for r in regs]
